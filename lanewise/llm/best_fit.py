"""Packing of token pieces into sequences of fixed capacity.

Only the number of pieces of every length matters, so the packing is planned on
a table of at most ``capacity`` counts, however many documents there are.

First the plan is reduced as Martello and Toth do. For a piece, longest first, a
set of one to three pieces that contains it is sought that dominates every other
set that could share its sequence: whatever else shares it can be exchanged for
the set's pieces without need of a further sequence. Such sets are fixed for
good, as often as their lengths are there, and taken out of the counts. What no
set dominates is packed best fit, longest first.

Pieces of one length are alike, so each gets a rank among them and the plan says
which ranks go where. Ranks are sums of counts by input partition and place
within the partition; no task sees all pieces of a length.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from lanewise.llm.common import sliced_by_bytes, staged, worker_cache

#: (how many sequences, [(length, how often in each), ...]) of sequences that look alike.
Pattern = tuple[int, list[tuple[int, int]]]

_REMEMBERED = 500_000
_REMEMBERED_LENGTH = 64
_RUN_BYTES = 8 << 20


# ---- the plan -----------------------------------------------------------------
def dominating(left: np.ndarray, w: int) -> list[int] | None:
    """The set of at most three lengths with ``w`` that dominates all others, if there is one.

    ``left`` has how many pieces of each length are there, one of ``w`` included.
    """
    room = len(left) - 1 - w
    others = left.copy()
    others[w] -= 1
    lengths = np.flatnonzero(others)
    few = np.repeat(lengths[:3], np.minimum(others[lengths[:3]], 3))[:3]  # the three shortest
    if not len(few) or few[0] > room:
        return [w]
    longest = int(lengths[np.searchsorted(lengths, room, "right") - 1])
    if longest == room or len(few) < 2 or few[:2].sum() > room:
        return [w, longest]
    if len(few) == 3 and few.sum() <= room:
        return None  # more than two may join: no small set dominates
    a, b = _greatest_pair(others, lengths, room)
    if longest >= a + b:
        return [w, longest]
    if a == longest:
        # A pair of two pieces longer than b would not be dominated by a and b.
        others[a] -= 1
        above = np.flatnonzero(others[b + 1 :]) + b + 1
        two = np.repeat(above[:2], np.minimum(others[above[:2]], 2))[:2]
        if len(two) < 2 or two.sum() > room:
            return [w, a, b]
    return None


def _greatest_pair(others: np.ndarray, lengths: np.ndarray, room: int) -> tuple[int, int]:
    """(a, b), a >= b, of greatest sum within ``room``; of equal sums that of greatest a."""
    best = (0, 0)
    for a in lengths[::-1].tolist():
        upto = lengths[: np.searchsorted(lengths, min(a, room - a), "right")]
        if len(upto) and upto[-1] == a and others[a] < 2:
            upto = upto[:-1]
        if len(upto) and a + int(upto[-1]) > sum(best):
            best = (a, int(upto[-1]))
    return best


def reduce_by_dominance(left: np.ndarray) -> list[Pattern]:
    """Fix dominating sets; ``left``, the counts by length, keeps what is not fixed."""
    fixed: list[Pattern] = []
    for w in range(len(left) - 1, 0, -1):
        while left[w] and (found := dominating(left, w)):
            parts = [(x, found.count(x)) for x in dict.fromkeys(found)]
            # Fewer pieces never undo dominance, so the set is fixed as often as it is there.
            times = min(int(left[x]) // n for x, n in parts)
            for x, n in parts:
                left[x] -= times * n
            fixed.append((times, parts))
    return fixed


def best_fit(left: np.ndarray) -> list[Pattern]:
    """Best fit, longest first, of the counts by length; sequences that look alike are kept together."""
    capacity = len(left) - 1
    by_room: dict[int, list[Pattern]] = {}
    for w in np.flatnonzero(left)[::-1].tolist():
        n = int(left[w])
        while n:
            room = min((r for r in by_room if r >= w), default=None)
            times, parts = by_room[room].pop() if room is not None else (n, [])
            if room is not None and not by_room[room]:
                del by_room[room]
            whole = capacity if room is None else room
            each = whole // w  # a sequence takes them until it has no room
            full = min(times, n // each)
            rest = min(n - full * each, each - 1) if full < times else 0
            if full:
                by_room.setdefault(whole - w * each, []).append((full, [*parts, (w, each)]))
            if rest:
                by_room.setdefault(whole - w * rest, []).append((1, [*parts, (w, rest)]))
            untouched = times - full - (1 if rest else 0)
            if room is not None and untouched:
                by_room.setdefault(room, []).append((untouched, parts))
            n -= full * each + rest
    return [pattern for group in by_room.values() for pattern in group]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences for ``counts`` pieces by length: dominating sets first, the rest best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left[length] += n
    fixed = reduce_by_dominance(left)
    return fixed + best_fit(left)


class Places:
    """Which rank of a length goes into which sequence, and where in it."""

    def __init__(self, patterns: list[Pattern]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for times, parts in patterns:
            offset = 0
            for length, n in parts:
                first = used.get(length, 0)
                rows.setdefault(length, []).append((first, times, base, offset))
                used[length] = first + times * n
                offset += length * n
            base += times
        self.sequences = base
        self.of = {length: np.array(r, np.int64) for length, r in rows.items()}

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of ranks of one length."""
        rows = self.of[length]
        first, times, base, offset = rows[np.searchsorted(rows[:, 0], ranks, "right") - 1].T
        turn = ranks - first
        return base + turn % times, offset + length * (turn // times)


# ---- tokens -------------------------------------------------------------------
#: Letters in any reading, and what may follow them without being one.
_LETTERS, _OTHERS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-@\[-`{-~"


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Remembered(dict):
    """Ids of parts of texts as bytes; the parts asked for last are remembered."""

    def __init__(self, make: Callable[[str | bytes], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most
        self.before: dict[str | bytes, bytes] = {}

    def __missing__(self, part: str | bytes) -> bytes:
        if (found := self.before.get(part)) is None:
            found = self.make(part)
        self.keep(part, found)
        return found

    def keep(self, part: str | bytes, found: bytes) -> None:
        if len(part) <= _REMEMBERED_LENGTH:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[part] = found


def _among(*ranges: tuple[int, int]) -> np.ndarray:
    """Whether a byte lies in one of the ranges."""
    found = np.zeros(256, bool)
    for first, last in ranges:
        found[first : last + 1] = True
    return found


_LETTER = _among((0x41, 0x5A), (0x61, 0x7A))
_LETTER_END = _among((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))  # after the byte C3
_SIGN, _PLAIN = _among((0x21, 0x40), (0x5B, 0x60), (0x7B, 0x7E)), _among((0x21, 0x7E))
_SOLID = _among((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xFF))  # begins a character, surely no white space


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where parts begin in texts that lie end to end: at their starts and at most of the places that ``Tokens`` cuts."""
    starts, ends = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0]
    cut = np.zeros(len(data) + 2, bool)  # two more, so that small texts need no care
    here = cut[: len(data)]
    here[:-1] = (data[:-1] == 0x20) & _SOLID[data[1:]]
    here[ends - 1] = False
    line = data == 0x0A
    here[2:] |= _PLAIN[data[:-2]] & line[1:-1] & _SOLID[data[2:]]
    cut[starts + 1] &= ~line[starts]  # the line before is another text's
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _LETTER_END[data[1:]]
    here[1:] |= (letter[:-1] & _SIGN[data[1:]]) | (_PLAIN[data[:-1]] & line[1:])
    here[starts] = True
    return np.flatnonzero(here)


class Tokens:
    """Ids of the tokenizers library, which encodes each different part of the texts once.

    A byte-level tokenizer cuts a text before every blank that another character
    follows, between a letter and a sign or digit of ASCII, before a line break
    and after one that stands alone, whatever is around.
    Texts are cut there and the parts are encoded alone. Other tokenizers, and
    texts with a special token's string, are encoded whole.

    A run of texts is cut as bytes, at most of these places, Arrow finds the
    different parts, and those that are new go through the library together.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.table = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        before = settings.get("pre_tokenizer") or {}
        self.by_parts = (
            before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not settings.get("normalizer")
            and settings["model"].get("type", "BPE") == "BPE"
        )
        self.special = [token["content"] for token in settings.get("added_tokens") or []]
        self.words = re.compile(r"(?= \S)").split
        self.parts = re.compile(rf"(?<=[{_LETTERS}])(?=[{_OTHERS}])|(?<=\S)(?=\n)|(?<=\S\n)(?=\S)").split
        self.is_word = re.compile(f" ?[{_LETTERS}]+").fullmatch
        self.of_part = _Remembered(self._part, _REMEMBERED // 2)
        self.of_word = _Remembered(self._word, _REMEMBERED // 2)
        self.of_bytes = _Remembered(lambda part: self._words(part.decode()), _REMEMBERED)
        self.uncut = Tokenizer.from_file(path)
        if self.by_parts:
            self.uncut.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            vocab = settings["model"]["vocab"]
            self.id_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.id_bytes[list(vocab.values())] = list(map(len, vocab))  # a character stands for a byte
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a worker one core

    def _letters(self, word: str) -> bytes:
        """Nothing to cut in it: straight to the merges."""
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.table))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        if self.is_word(part):
            return self._letters(part)
        ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if self.is_word(word):
            return self._letters(word)
        return b"".join(map(self.of_part.__getitem__, self.parts(word)))

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.of_word.__getitem__, self.words(text)))

    def encode(self, text: str) -> np.ndarray:
        if not self.by_parts or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(self._words(text), "<u4")

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: empty); the texts are cut and encoded together."""
        texts = pc.fill_null(texts, "")
        alone = np.full(len(texts), not self.by_parts)
        for special in self.special:
            alone |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        together = iter(self._together(texts.filter(pa.array(~alone))))
        whole = iter(texts.filter(pa.array(alone)).to_pylist())
        return [self.encode(next(whole)) if is_alone else next(together) for is_alone in alone.tolist()]

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cuts = np.append(_cuts(data, bounds), len(data))
        buffers = [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).dictionary_encode()
        values = self._different(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(values, pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // 4
        ids = np.frombuffer(ids.buffers()[2] or b"", "<u4", ends[-1])
        of_text = ends[np.searchsorted(cuts, bounds)].tolist()
        return [ids[lo:hi] for lo, hi in zip(of_text, of_text[1:])]

    def _different(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different parts; new ones of letters go straight to the merges, all together."""
        found = list(map(self.of_bytes.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        before = self.of_bytes.before
        self._learn([parts[i] for i in new if len(parts[i]) <= _REMEMBERED_LENGTH and parts[i] not in before])
        for i in new:
            found[i] = self.of_bytes[parts[i]]
        return found

    def _learn(self, parts: list[bytes]) -> None:
        parts = [part for part in parts if self.is_word(part.decode())]
        if not parts:
            return
        texts = [part.decode() for part in parts]
        (coded,) = self.uncut.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, "<u4")
        id_ends, part_ends = np.cumsum(self.id_bytes[ids]), np.cumsum(list(map(len, parts)))
        if not len(ids) or id_ends[-1] != part_ends[-1]:
            return  # a vocabulary without some bytes: each part is encoded alone
        ends = (np.searchsorted(id_ends, part_ends, "right") * 4).tolist()
        coded_bytes = ids.tobytes()
        for part, start, end in zip(parts, [0, *ends], ends):
            self.of_bytes.keep(part, coded_bytes[start:end])


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces of at most ``capacity`` ids, numbered within their partition and length (``part``, ``nth``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("best_fit")
        coder = cache.get(path) or cache.setdefault(path, Tokens(path))
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in sliced_by_bytes((b for b in batches if b.num_rows), 1, _RUN_BYTES):
            rows = []
            for doc_id, text_ids in zip(batch.column(0).to_pylist(), coder.encode_all(batch.column(1))):
                ids = np.append(text_ids, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[start:end]
                    row = (doc_id, piece, start, end - start, zlib.crc32(own.tobytes()), part, int(seen[end - start]))
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)
                    seen[end - start] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())][: len(names)]
    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


# ---- packing ------------------------------------------------------------------
def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Per piece of a document's ids: where it stands in the document and in the packed sequences.

    A document's ids are those of the tokenizers library, without special tokens
    added, and then ``end_id``. More than ``capacity`` ids are cut into pieces of
    ``capacity``, the first of which may be shorter. Columns: id, piece, start,
    length, ids_crc32, sequence_id, offset and, if asked for, ``ids``.

    A null or empty text has ``end_id`` alone; null ids and repeated rows are
    rows like any other; equal lengths are told apart by their place in the
    input; other columns are ignored; an empty table gives an empty result.
    ``tokenizer_path`` is read on every worker.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = staged(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    places = Places(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in (3, 5))
            sequence, offset = np.zeros((2, len(length)), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                sequence[rows], offset[rows] = places.find(int(length[rows[0]]), rank[rows])
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    ids = ["ids"] if with_ids else []
    ranked = pieces.join(offsets, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"), *ids
    )
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *ids]
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return ranked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of whole sequences from the pieces of ``pack_documents(with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most capacity ids
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
