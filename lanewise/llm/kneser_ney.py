"""Interpolated modified Kneser-Ney model of order 2 or 3: counted by Spark jobs, kept as sorted arrays, mapped by workers.

Counts are summed in each map task, shuffled as packed arrays by bucket and
merged there. A bucket leaves files in the shared folder: the sorted word
hashes of a range with their counts (a word's place is its number), the sorted
bigrams of a range of first words with counts, and the figures that the model
needs by word. Bigrams of the few first words that alone would fill a bucket
are dealt out by the second word as well. Workers map the files and look up
sorted batches; no process holds the model.

    p(v | u) = max(c(uv) - D(c(uv)), 0) / c(u)
               + (D1 n1(u) + D2 n2(u) + D3 n3(u)) / c(u) * p(v)
    p(v)     = max(k(v) - E(k(v)), 0) / K + (E1 m1 + E2 m2 + E3 m3) / K / (V + 1)

n1, n2, n3: words that follow u once, twice, more often; k(v): different words
before v, K their sum, m1, m2, m3 the words v with k = 1, 2, more; D and E from
the counts of counts. A word unseen before as u leaves p(v).

Order 3 puts p(w | u v) on top, with counts of trigrams over those of the pair u v.
The counts c of p(w | v) then are those of different words before v w (at the start
of a text, where nothing comes before, they stay counts). Trigrams lie in the bucket
of their first two words: by place of the pair the sorted third words. A pair unseen
leaves p(w | v), and so does the start of a text.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import (
    mix,
    mounted,
    shared_folder,
    shuffles_dropped,
    sliced_by_bytes,
    staged,
    word_hashes,
    worker_cache,
)

END = b"\n"  # no word has white space in it
_CHUNK = 1_500_000  # tokens counted at a time
_LOOKUP = 600_000  # tokens scored at a time
_TEXT_BYTES = 1 << 20  # text cut into words at a time
_RANGE_WORDS = 50_000  # words whose predecessor counts travel in one piece
_SHIFT = np.uint64(32)


@dataclass
class Model:
    folder: str
    sizes: list[int]  # words by bucket
    tokens: int = 0
    docs: int = 0
    bigrams: int = 0
    hot: dict[int, list[int]] = field(default_factory=dict)  # first word: n1, n2, n3
    discounts: list[float] = field(default_factory=list)  # of bigrams
    low_discounts: list[float] = field(default_factory=list)  # of continuation counts
    low_rest: float = 1.0
    order: int = 2
    middle_hot: dict[int, list[int]] = field(default_factory=dict)  # order 3, first word of pairs: n1, n2, n3, sum
    middle_discounts: list[float] = field(default_factory=list)  # of pairs' continuation counts

    def __post_init__(self) -> None:
        self.starts = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)
        self.ranges = self.starts[:-1] // _RANGE_WORDS

    @property
    def words(self) -> int:
        return int(self.starts[-1])


def _save(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        np.save(file, array)
    os.replace(own, f"{folder}/{name}.npy")


def _save_small(folder: str, name: str, values: np.ndarray) -> None:
    """Counts as bytes, those from 255 on with their places in a file beside."""
    _save(folder, name, np.minimum(values, 255).astype(np.uint8))
    large = np.flatnonzero(values >= 255)
    _save(folder, f"{name}-large", np.stack((large, values[large])))


def _small(folder: str, name: str, at: np.ndarray) -> np.ndarray:
    """The counts at these places."""
    values = _mapped(folder, name)[at].astype(np.int64)
    large = np.flatnonzero(values == 255)
    if len(large):
        places, counts = _mapped(folder, f"{name}-large")
        values[large] = counts[np.searchsorted(places, at[large])]
    return values


def _mapped(folder: str, name: str) -> np.ndarray | None:
    cache = worker_cache("kneser_ney")
    key = (folder, name)
    if key not in cache:
        if cache and next(iter(cache))[0] != folder:
            cache.clear()
        path = f"{folder}/{name}.npy"
        cache[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
    return cache[key]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[at], np.add.reduceat(counts, at)


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of a sorted array."""
    if len(bucket):
        at = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield int(bucket[lo]), lo, hi


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    """(first column, token hashes, tokens of each text, texts) for texts of about ``most`` tokens together."""
    rows, found, lengths, total = [], [], [], 0
    for batch in sliced_by_bytes(batches, 1, _TEXT_BYTES):
        tokens, by_text = word_hashes(batch.column(1), END)
        rows += batch.column(0).to_pylist()
        found.append(tokens)
        lengths.append(by_text)
        total += len(tokens)
        if total >= most:
            yield rows, np.concatenate(found), np.concatenate(lengths), len(rows)
            rows, found, lengths, total = [], [], [], 0
    if rows:
        yield rows, np.concatenate(found), np.concatenate(lengths), len(rows)


def _numbers(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Number of each word of sorted hashes, -1 if unknown."""
    out = np.full(len(hashes), -1, np.int64)
    bucket = ((hashes >> _SHIFT) * np.uint64(len(model.sizes))) >> _SHIFT
    for b, lo, hi in _pieces(bucket):
        known = _mapped(model.folder, f"hash-{b}")
        if known is not None and len(known):
            at = np.searchsorted(known, hashes[lo:hi])
            at[at == len(known)] = 0
            out[lo:hi] = np.where(known[at] == hashes[lo:hi], at + model.starts[b], -1)
    return out


def _figures(model: Model, name: str, numbers: np.ndarray) -> np.ndarray:
    """A figure by word for sorted numbers."""
    out = np.zeros(len(numbers), np.int64)
    for b, lo, hi in _pieces(np.searchsorted(model.starts, numbers, "right") - 1):
        values = _mapped(model.folder, f"{name}-{b}")
        if values is not None:
            out[lo:hi] = values[numbers[lo:hi] - model.starts[b]]
    return out


def _buckets(model: Model, keys: np.ndarray) -> np.ndarray:
    """Bucket of each bigram: the first word's range, or a hash of both for hot first words."""
    n = len(model.sizes)
    first = (keys >> _SHIFT).astype(np.int64)
    out = np.minimum(np.searchsorted(model.starts, first, "right") - 1, n - 1)
    if model.hot:
        hot = np.isin(first, np.fromiter(model.hot, np.int64, len(model.hot)))
        out[hot] = n + (mix(keys[hot]) % np.uint64(n)).astype(np.int64)
    return out


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]


def discounts(t: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the counts of counts; fixed halves where a count is missing."""
    if not all(t):
        return [0.5, 1.0, 1.5]
    y = t[0] / (t[0] + 2 * t[1])
    found = [k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1)]


def _merge_by_bucket(batches: Iterator[pa.RecordBatch], unpack: Callable) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    parts: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            parts.setdefault(row["bucket"], []).append(unpack(row))
    return {b: _summed(np.concatenate([k for k, _ in p]), np.concatenate([c for _, c in p])) for b, p in parts.items()}


def train(texts: DataFrame, order: int = 2) -> Model:
    """Count and store the model of (any column, text as binary)."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 2 * parts
    folder = mounted(shared_folder(spark, "kneser-ney"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _, docs in _chunks(batches, _CHUNK):
            h, c = np.unique(tokens, return_counts=True)
            found = list(_pieces(((h >> _SHIFT) * np.uint64(n)) >> _SHIFT))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in found], pa.int32()),
                    pa.array([h[lo:hi].tobytes() for _, lo, hi in found], pa.binary()),
                    pa.array([c[lo:hi].astype(np.uint32).tobytes() for _, lo, hi in found], pa.binary()),
                    pa.array([docs if not i else 0 for i in range(len(found))], pa.int64()),
                ],
                ["bucket", "keys", "counts", "docs"],
            )

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = 0

        def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
            nonlocal docs
            docs += row["docs"]
            return np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)

        for b, (h, c) in _merge_by_bucket(batches, unpack).items():
            _save(folder, f"hash-{b}", h)
            _save(folder, f"count-{b}", c)
            top = np.argsort(-c)[:64]  # enough: of a bucket's words few can hold 1/n of all tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (b, len(h), int(c.sum()), docs)] + [pa.array([top.tolist()]), pa.array([c[top].tolist()])],
                ["bucket", "size", "tokens", "docs", "top", "top_counts"],
            )
            docs = 0

    words = (
        texts.mapInArrow(count_words, "bucket int, keys binary, counts binary, docs long")
        .repartition(parts, "bucket")
        .mapInArrow(store_words, "bucket long, size long, tokens long, docs long, top array<long>, top_counts array<long>")
        .collect()
    )
    sizes = [0] * n
    for r in words:
        sizes[r.bucket] = r.size
    model = Model(folder, sizes, sum(r.tokens for r in words), sum(r.docs for r in words), order=order)
    hot = [int(model.starts[r.bucket]) + k for r in words for k, c in zip(r.top, r.top_counts, strict=True) if c * n > model.tokens]
    model.hot = {k: [0, 0, 0] for k in [*hot, model.words]}  # the last: the start of a text

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, lengths, _ in _chunks(batches, _CHUNK):
            h, where = np.unique(tokens, return_inverse=True)
            keys, c = np.unique(_pair_keys(model, _numbers(model, h)[where], lengths), return_counts=True)
            bucket = _buckets(model, keys)
            order = np.argsort(bucket, kind="stable")
            keys, c, bucket = keys[order], c[order], bucket[order]
            found = list(_pieces(bucket))
            # first words as differences: mostly zeros, which the shuffle's compression takes away
            u = [np.diff((keys[lo:hi] >> _SHIFT).astype(np.uint32), prepend=np.uint32(0)) for _, lo, hi in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in found], pa.int32()),
                    pa.array([x.tobytes() for x in u], pa.binary()),
                    pa.array([keys[lo:hi].astype(np.uint32).tobytes() for _, lo, hi in found], pa.binary()),
                    pa.array([c[lo:hi].astype(np.uint32).tobytes() for _, lo, hi in found], pa.binary()),
                ],
                ["bucket", "first", "second", "counts"],
            )

    def store_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
            first = np.cumsum(np.frombuffer(row["first"], np.uint32), dtype=np.uint64)
            second = np.frombuffer(row["second"], np.uint32).astype(np.uint64)
            return (first << _SHIFT) | second, np.frombuffer(row["counts"], np.uint32).astype(np.int64)

        for b, (keys, c) in _merge_by_bucket(batches, unpack).items():
            _save(folder, f"pair-{b}", keys)
            _save(folder, f"pair-count-{b}", np.minimum(c, 255).astype(np.uint8))
            large = np.flatnonzero(c >= 255)
            _save(folder, f"pair-large-{b}", np.stack((large, c[large])))
            first = (keys >> _SHIFT).astype(np.int64)
            levels = [c == 1, c == 2, c >= 3]
            hot: list[list[int]] = []
            if b < n:
                for k, level in enumerate(levels, 1):
                    _save(folder, f"after{k}-{b}", np.bincount(first[level] - model.starts[b], minlength=sizes[b]).astype(np.uint32))
            else:
                hot = [[w, *(int(np.count_nonzero(first[level] == w)) for level in levels)] for w in np.unique(first).tolist()]
            second, k = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
            found = list(_pieces(model.ranges[np.searchsorted(model.starts, second.astype(np.int64), "right") - 1]))
            rows = [(w, second[lo:hi].astype(np.uint32).tobytes(), k[lo:hi].astype(np.uint32).tobytes()) for w, lo, hi in found]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            empty = [None] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int32()),
                    pa.array(columns[1], pa.binary()),
                    pa.array(columns[2], pa.binary()),
                    pa.array([[*_of_counts(c), len(keys)], *empty], pa.list_(pa.int64())),
                    pa.array([hot, *empty], pa.list_(pa.list_(pa.int64()))),
                ],
                ["bucket", "keys", "counts", "totals", "hot"],
            )

    pairs = staged(
        texts.mapInArrow(count_pairs, "bucket int, first binary, second binary, counts binary")
        .repartition(parts, "bucket")
        .mapInArrow(store_pairs, "bucket int, keys binary, counts binary, totals array<long>, hot array<array<long>>"),
        "pair-figures",
    )
    totals = np.zeros(5, np.int64)
    for r in pairs.where("totals is not null").select("totals", "hot").collect():  # a row for each bucket
        totals += np.array(r.totals)
        for w, *counts in r.hot:
            model.hot[w] = [a + b for a, b in zip(model.hot[w], counts, strict=True)]
    model.bigrams = int(totals[4])
    model.discounts = discounts(totals[:4].tolist())

    def store_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(row["keys"], np.uint32).astype(np.int64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)

        for w, k in _merge_by_bucket(batches, unpack).values():
            for b, lo, hi in _pieces(np.searchsorted(model.starts, w, "right") - 1):
                values = np.zeros(sizes[b], np.uint32)
                values[w[lo:hi] - model.starts[b]] = k[lo:hi]
                _save(folder, f"before-{b}", values)
            yield pa.RecordBatch.from_arrays([pa.array([[*_of_counts(k), int(np.count_nonzero(k >= 3))]])], ["totals"])

    before = (
        pairs.select("bucket", "keys", "counts").repartition(parts, "bucket").mapInArrow(store_before, "totals array<long>").collect()
    )
    low = np.sum([np.zeros(5, np.int64), *(np.array(r.totals) for r in before)], 0)
    model.low_discounts = discounts(low[:4].tolist())
    if model.bigrams:
        model.low_rest = float(np.dot(model.low_discounts, [low[0], low[1], low[4]])) / model.bigrams
    if order == 3:
        _train_triples(model, texts, parts)
    return model


_TRIPLES = "bucket int, first binary, second binary, counts binary"


def _pair_keys(model: Model, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Key of each known token with the one before it, or the start of its text."""
    first = np.concatenate(([0], second[:-1]))
    first[np.cumsum(lengths) - lengths] = model.words
    return (first.astype(np.uint64) << _SHIFT) | second.astype(np.uint64)


def _packed(bucket: np.ndarray, keys: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: high halves of sorted keys as differences, low halves, counts."""
    order = np.argsort(bucket, kind="stable")
    keys, c, bucket = keys[order], c[order], bucket[order]
    found = list(_pieces(bucket))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b for b, _, _ in found], pa.int32()),
            pa.array([np.diff((keys[lo:hi] >> _SHIFT).astype(np.uint32), prepend=np.uint32(0)).tobytes() for _, lo, hi in found], pa.binary()),
            pa.array([keys[lo:hi].astype(np.uint32).tobytes() for _, lo, hi in found], pa.binary()),
            pa.array([c[lo:hi].astype(np.uint32).tobytes() for _, lo, hi in found], pa.binary()),
        ],
        ["bucket", "first", "second", "counts"],
    )


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    first = np.cumsum(np.frombuffer(row["first"], np.uint32), dtype=np.uint64)
    second = np.frombuffer(row["second"], np.uint32).astype(np.uint64)
    return (first << _SHIFT) | second, np.frombuffer(row["counts"], np.uint32).astype(np.int64)


def _train_triples(model: Model, texts: DataFrame, parts: int) -> None:
    """Trigrams by pair, and the continuation counts of the pairs."""
    spark, folder, n = texts.sparkSession, model.folder, len(model.sizes)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, lengths, _ in _chunks(batches, _CHUNK):
            h, where = np.unique(tokens, return_inverse=True)
            second = _numbers(model, h)[where]
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(lengths) - lengths] = False
            at = np.flatnonzero(inner)
            pairs, back = np.unique(_pair_keys(model, second, lengths)[at - 1], return_inverse=True)
            bucket, place = _pair_places(model, pairs)
            keys, c = np.unique((back.astype(np.uint64) << _SHIFT) | second[at].astype(np.uint64), return_counts=True)
            pair = (keys >> _SHIFT).astype(np.int64)
            # pairs of a bucket are in the order of their places, so its keys stay sorted
            yield _packed(bucket[pair], (place[pair].astype(np.uint64) << _SHIFT) | (keys & np.uint64(0xFFFFFFFF)), c)

    def store_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (keys, c) in _merge_by_bucket(batches, _unpacked).items():
            size = len(_mapped(folder, f"pair-{b}"))
            place = (keys >> _SHIFT).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=size))))
            _save(folder, f"triple-ends-{b}", ends.astype(np.uint32 if len(keys) < 1 << 32 else np.uint64))
            _save(folder, f"triple-{b}", keys.astype(np.uint32))
            _save_small(folder, f"triple-count-{b}", c)
            for k in (1, 2):
                _save_small(folder, f"triple-after{k}-{b}", np.bincount(place[c == k], minlength=size))
            yield pa.RecordBatch.from_arrays([pa.array([_of_counts(c)])], ["totals"])

    found = texts.mapInArrow(count_triples, _TRIPLES).repartition(parts, "bucket").mapInArrow(store_triples, "totals array<long>").collect()
    model.discounts = discounts(np.sum([[0] * 4, *(r.totals for r in found)], 0).tolist())

    def continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for b in batch.column(0).to_pylist():
                known = _mapped(folder, f"pair-{b}")
                if known is None:
                    continue
                none = np.empty(0, np.uint32).tobytes()  # each bucket with pairs gets a row
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([none], pa.binary())] * 3], ["bucket", "first", "second", "counts"])
                third = _mapped(folder, f"triple-{b}")
                if third is None:
                    continue
                pair = np.repeat(known, np.diff(_mapped(folder, f"triple-ends-{b}").astype(np.int64)))
                parts.append(np.unique((pair << _SHIFT) | third.astype(np.uint64), return_counts=True))
        if parts:  # together, so that a task sends one piece to each bucket
            keys, c = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts]))
            yield _packed(_buckets(model, keys), keys, c)

    def store_continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (keys, c) in _merge_by_bucket(batches, _unpacked).items():
            known = np.asarray(_mapped(folder, f"pair-{b}"))
            first = (known >> _SHIFT).astype(np.int64)
            k = np.zeros(len(known), np.int64)
            k[np.searchsorted(known, keys)] = c
            opening = np.flatnonzero(first == model.words)
            k[opening] = _pair_counts(model, known[opening])
            _save_small(folder, f"pair-before-{b}", k)
            levels, hot = [k == 1, k == 2, k >= 3], []
            if b < n:
                at = first - model.starts[b]
                for j, level in enumerate(levels, 1):
                    _save(folder, f"middle{j}-{b}", np.bincount(at[level], minlength=model.sizes[b]).astype(np.uint32))
                total = np.zeros(model.sizes[b], np.int64)
                np.add.at(total, at, k)
                _save(folder, f"middle-sum-{b}", total)
            else:
                hot = [[w, *(int((first[level] == w).sum()) for level in levels), int(k[first == w].sum())] for w in np.unique(first).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_of_counts(k)], pa.list_(pa.int64())), pa.array([hot], pa.list_(pa.list_(pa.int64())))], ["totals", "hot"]
            )

    found = (
        spark.range(0, 2 * n, 1, parts)
        .mapInArrow(continuations, _TRIPLES)
        .repartition(parts, "bucket")
        .mapInArrow(store_continuations, "totals array<long>, hot array<array<long>>")
        .collect()
    )
    model.middle_discounts = discounts(np.sum([[0] * 4, *(r.totals for r in found)], 0).tolist())
    model.middle_hot = {w: [0] * 4 for w in model.hot}
    for r in found:
        for w, *counts in r.hot:
            model.middle_hot[w] = [a + b for a, b in zip(model.middle_hot[w], counts, strict=True)]


def _pair_places(model: Model, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and place in it of sorted pairs, place -1 if unseen."""
    bucket = _buckets(model, keys)
    place = np.full(len(keys), -1, np.int64)
    order = np.argsort(bucket, kind="stable")
    for b, lo, hi in _pieces(bucket[order]):
        known = _mapped(model.folder, f"pair-{b}")
        if known is not None and len(known):
            which = order[lo:hi]
            at = np.searchsorted(known, keys[which])
            at[at == len(known)] = 0
            place[which] = np.where(known[at] == keys[which], at, -1)
    return bucket, place


def _triple_figures(model: Model, pairs: np.ndarray, back: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each (sorted pair ``back``, third word): trigram count; of each pair: sum of trigrams, weight of what they leave."""
    bucket, place = _pair_places(model, pairs)
    low, high, total = (np.zeros(len(pairs), np.int64) for _ in range(3))
    weight = np.zeros(len(pairs))
    count = np.zeros(len(third), np.int64)
    d = np.array([0.0, *model.discounts])
    of = bucket[back]
    order, ask = np.argsort(bucket, kind="stable"), np.argsort(of, kind="stable")
    asked = {b: ask[lo:hi] for b, lo, hi in _pieces(of[ask])}
    for b, lo, hi in _pieces(bucket[order]):
        words = _mapped(model.folder, f"triple-{b}")
        if words is None:
            continue
        which = order[lo:hi]
        which = which[place[which] >= 0]
        at = place[which]
        ends = _mapped(model.folder, f"triple-ends-{b}")
        low[which], high[which] = ends[at], ends[at + 1]
        one, two = (_small(model.folder, f"triple-after{k}-{b}", at) for k in (1, 2))
        weight[which] = d[1] * one + d[2] * two + d[3] * (high[which] - low[which] - one - two)
        total[which] = _small_pairs(model, b, at) * (high[which] > low[which])
        rows = asked[b]
        left, right = low[back[rows]], high[back[rows]]
        end = right.copy()
        while (open_ := np.flatnonzero(left < right)).size:  # all searches take a step at a time
            mid = (left[open_] + right[open_]) >> 1
            less = words[mid] < third[rows[open_]]
            left[open_[less]], right[open_[~less]] = mid[less] + 1, mid[~less]
        there = np.flatnonzero(left < end)
        there = there[words[left[there]] == third[rows[there]]]
        count[rows[there]] = _small(model.folder, f"triple-count-{b}", left[there])
    return count, total, weight


def _small_pairs(model: Model, b: int, at: np.ndarray) -> np.ndarray:
    """Counts of the pairs at these places of a bucket."""
    count = _mapped(model.folder, f"pair-count-{b}")[at].astype(np.int64)
    large = np.flatnonzero(count == 255)
    if len(large):
        places, values = _mapped(model.folder, f"pair-large-{b}")
        count[large] = values[np.searchsorted(places, at[large])]
    return count


def _pairs_before(model: Model, keys: np.ndarray) -> np.ndarray:
    """Continuation counts of sorted pairs, 0 if unseen."""
    out = np.zeros(len(keys), np.int64)
    bucket, place = _pair_places(model, keys)
    order = np.argsort(bucket, kind="stable")
    for b, lo, hi in _pieces(bucket[order]):
        which = order[lo:hi]
        which = which[place[which] >= 0]
        if len(which):
            out[which] = _small(model.folder, f"pair-before-{b}", place[which])
    return out


def _pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted bigrams, 0 if unseen."""
    out = np.zeros(len(keys), np.int64)
    bucket = _buckets(model, keys)
    order = np.argsort(bucket, kind="stable")
    for b, lo, hi in _pieces(bucket[order]):
        known = _mapped(model.folder, f"pair-{b}")
        if known is None or not len(known):
            continue
        which = order[lo:hi]
        at = np.searchsorted(known, keys[which])
        at[at == len(known)] = 0
        count = _mapped(model.folder, f"pair-count-{b}")[at].astype(np.int64)
        large = np.flatnonzero(count == 255)
        if len(large):
            places, values = _mapped(model.folder, f"pair-large-{b}")
            count[large] = values[np.minimum(np.searchsorted(places, at[large]), len(places) - 1)]
        out[which] = np.where(known[at] == keys[which], count, 0)
    return out


def token_scores(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(training count, log10 probability) of each token of texts of these lengths."""
    h, where = np.unique(tokens, return_inverse=True)
    number = _numbers(model, h)
    seen = np.flatnonzero(number >= 0)
    order = seen[np.argsort(number[seen], kind="stable")]
    figures = {name: np.zeros(len(h), np.int64) for name in ("count", "before", "after1", "after2", "after3")}
    if model.order == 3:
        figures |= {name: np.zeros(len(h), np.int64) for name in ("middle1", "middle2", "middle3", "middle-sum")}
    for name, values in figures.items():
        values[order] = _figures(model, name, number[order])
    for w, after in model.hot.items():
        for k, value in enumerate(after, 1):
            figures[f"after{k}"][number == w] = value
    for w, after in model.middle_hot.items():
        for name, value in zip(("middle1", "middle2", "middle3", "middle-sum"), after, strict=True):
            figures[name][number == w] = value
    d, e = np.array([0.0, *(model.middle_discounts if model.order == 3 else model.discounts)]), np.array([0.0, *model.low_discounts])
    k = figures["before"]
    low = model.low_rest / (model.words + 1) + (np.maximum(k - e[np.minimum(k, 3)], 0) / model.bigrams if model.bigrams else 0)
    after, uses_of = ("middle", "middle-sum") if model.order == 3 else ("after", "count")
    rest = sum(d[j] * figures[f"{after}{j}"] for j in (1, 2, 3))

    second = number[where]
    starts = np.cumsum(lengths) - lengths
    first, uses, weight = (np.concatenate(([0], x[where][:-1])) for x in (number, figures[uses_of], rest))
    first[starts], uses[starts] = model.words, model.docs
    weight[starts] = float(np.dot(d[1:], (model.middle_hot if model.order == 3 else model.hot)[model.words][:3]))
    count = np.zeros(len(tokens), np.int64)
    both = np.flatnonzero((first >= 0) & (second >= 0) & (uses > 0))
    if len(both):
        keys, back = np.unique((first[both].astype(np.uint64) << _SHIFT) | second[both].astype(np.uint64), return_inverse=True)
        count[both] = (_pairs_before if model.order == 3 else _pair_counts)(model, keys)[back]
    lower = low[where]
    use = np.maximum(uses, 1)
    p = np.where((uses > 0) & (first >= 0), np.maximum(count - d[np.minimum(count, 3)], 0) / use + weight / use * lower, lower)
    if model.order == 3:
        inner = np.ones(len(tokens), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        at = at[(first[at - 1] >= 0) & (second[at - 1] >= 0)]  # the pair's words are known
        if len(at):
            pairs, back = np.unique((first[at - 1].astype(np.uint64) << _SHIFT) | second[at - 1].astype(np.uint64), return_inverse=True)
            count, total, left = _triple_figures(model, pairs, back, second[at])
            d = np.array([0.0, *model.discounts])
            total, left = total[back], left[back]
            use = np.maximum(total, 1)
            p[at] = np.where(total > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / use + left / use * p[at], p[at])
    return figures["count"][where], np.log10(p)


def score_texts(
    docs: DataFrame, training: str = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 <> 2", order: int = 2
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    The model of ``order`` 2 or 3 learns from the rows where ``training`` is true. Null and empty
    texts are one end token. A null id counts as an empty one in the split and
    stays null. Without training rows every token is unknown and has
    probability 1. Repeated rows are counted and scored each; further columns
    are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), (~F.expr(training)).alias("held_out")).alias("row"),
        F.col("text").cast("binary").alias("text"),
    )
    with shuffles_dropped(docs.sparkSession):
        model = train(rows.where("not row.held_out"), order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, tokens, lengths, _ in _chunks(batches, _LOOKUP):
            count, logs = token_scores(model, tokens, lengths)
            at = np.cumsum(lengths) - lengths
            base = np.log10((count + 1) / (model.tokens + model.words + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["doc_id"] for r in kept], pa.int64()),
                    pa.array([r["held_out"] for r in kept], pa.bool_()),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                    pa.array(np.full(len(kept), model.tokens, np.int64)),
                    pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(logs, at)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    out = rows.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
