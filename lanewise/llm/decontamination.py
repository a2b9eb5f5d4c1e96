"""Benchmark items inside documents: containment MinHash by item size, verified by exact shingle containment.

Items fall into size classes. Of an item the smallest shingle hashes are kept,
as many as its class's upper size u asks for: ``u - ceil(share * u / 100) + 1``.
A document that contains ``share`` per cent of the item's shingles misses fewer
than that, so at least one of the kept hashes is among the document's, however
long it is: the search loses nothing. Documents found this way are read again
and the shared shingles are counted exactly.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import BROADCAST_ROWS, keep_ids, staged


def shingle_hashes(text: Column, size: int) -> Column:
    """64-bit hashes of the ``size``-word shingles of a text in lower case; fewer words make one, none none."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        width = F.least(F.size(w), F.lit(size))
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    # As a lambda's argument the words are cut once for a text, not once for each shingle.
    return F.flatten(F.transform(F.array(words), of_words))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document holds ``share`` per cent of the shingles.

    Null or empty texts hold and are nothing. Rows that repeat an id are one
    document (or item) with the shingles of all of them; rows without an id are
    one document with id null. Further columns are ignored. Without documents
    or items the result is empty.
    """
    least = lambda n: F.ceil(n * share / 100).cast("int")
    per_item = Window.partitionBy("item_id")
    rows = (
        items.select("item_id", F.explode(shingle_hashes(F.col("text"), size)).alias("h"))
        .distinct()
        .withColumn("n_item", F.count("*").over(per_item).cast("int"))
        .withColumn("rank", F.row_number().over(per_item.orderBy("h")))
    )
    upper = F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("int")  # of the size class
    index = staged(rows.select("item_id", "h", "n_item", (F.col("rank") <= upper - least(upper) + 1).alias("kept")), "items")

    def found_in(texts: DataFrame, wanted: DataFrame) -> DataFrame:
        return texts.select("doc_id", F.explode(shingle_hashes(F.col("text"), size)).alias("h")).join(_small(wanted), "h")

    texts = docs.select("doc_id", "text")
    near = staged(found_in(texts, index.where("kept").select("h", "item_id")).select("doc_id", "item_id").distinct(), "near")
    pair = near.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"))
    known = keep_ids(texts, near.where("doc_id is not null").select("doc_id").distinct(), "doc_id")
    texts = known.union(texts.where("doc_id is null"))
    shared = (
        found_in(texts, index.select("h", "item_id", "n_item"))
        .groupBy("doc_id", "item_id", "n_item")
        .agg(F.countDistinct("h").alias("n_shared"))
        .where(F.col("n_shared") >= least(F.col("n_item")))
    )
    return shared.join(pair, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi").select(
        "doc_id", "item_id", "n_shared", F.col("n_item").cast("long").alias("n_item")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """Rows of ``docs`` that contain no item; rows without an id are kept."""
    bad = staged(contained_items(docs, items, size, share).where("doc_id is not null").select("doc_id").distinct(), "bad")
    return keep_ids(docs, bad, "doc_id", "left_anti")
