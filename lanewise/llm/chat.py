"""Chat text with marked turns, checked by parsing it again.

A turn is ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line
end. The parser cuts at these marks and takes one backslash away wherever
``<``, one or more backslashes and ``|`` follow each other. Every turn is
rendered, parsed and compared with its source; where they differ, its role and
text are escaped (one more backslash between ``<`` and ``|``; line ends of a
role as well) and compared again, until they are identical. Escaped text holds
no ``<|``, so the second turn of this always ends it; a difference that is
still there raises an error.

DataFrame functions only. Turns are rendered, parsed and escaped as rows; only
finished pieces of a conversation are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MASKED_ROLE = "assistant"  # the role under the loss mask


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(escaped(role), r"%", "%25"), r"\n", "%0A")


def _plain_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescaped(role), "%0A", "\n"), "%25", "%")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parsed(chat: Column) -> Column:
    """Array of (role, text) of a rendered chat, in order and unescaped; null for a turn with marks inside."""
    turns = F.split(chat, r"\Q" + END + "\n" + r"\E")
    whole = F.slice(turns, 1, F.size(turns) - 1)  # what follows the last mark is empty

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        head = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(head) + 2, F.length(body))
        clean = ~(body.contains(START) | body.contains(END))  # a mark inside a turn is no valid chat
        return F.struct(F.when(clean, _plain_role(head)).alias("role"), F.when(clean, unescaped(text)).alias("text"))

    return F.transform(whole, turn)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, chat): the rendered text of every conversation, turns in order.

    Null roles and texts are empty. Rows with the same turn follow each other
    by role and text; null turns come first; a repeated row is a turn of its
    own; rows without conv_id are one conversation. Further columns are
    ignored; an empty table gives an empty result. A conversation is one value
    and has to fit into a row.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    out = rows.withColumns({"r": F.col("role"), "t": F.col("text")})

    def same() -> Column:
        """Whether the turn as it is now, with a turn after it, is read back as it was."""
        probe = F.concat(rendered(F.col("r"), F.col("t")), F.lit(f"{START}x\n{END}\n"))
        turn = F.struct(F.col("role"), F.col("text"))
        after = F.struct(F.lit("x").alias("role"), F.lit("").alias("text"))
        return parsed(probe).eqNullSafe(F.array(turn, after))

    out = out.withColumn("ok", same())
    out = out.withColumns(
        {
            "r": F.when(F.col("ok"), F.col("r")).otherwise(_escaped_role(F.col("role"))),
            "t": F.when(F.col("ok"), F.col("t")).otherwise(escaped(F.col("text"))),
        }
    )
    piece = F.when(same(), rendered(F.col("r"), F.col("t"))).otherwise(F.raise_error(F.lit("a turn is not read back as it was")))
    turns = out.withColumn("piece", piece).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("turns")
    )
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("chat"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, all of it read from the rendered text."""
    turns = chats.withColumn("turns", parsed(F.col("chat")))
    masked = F.filter("turns", lambda t: t["role"] == MASKED_ROLE)
    return turns.withColumn("loss_text", F.array_join(F.transform(masked, lambda t: t["text"]), ""))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation: turns, their digest, the masked text's length and digest, and the length of the whole."""
    read = read_chats(format_chats(conversations))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(lines).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"),
    )
