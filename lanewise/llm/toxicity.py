"""Toxicity scores from a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (5 and 7 code points, lower case,
no white space inside, a blank at either end of a word counts) hashed to 2^20
slots. A slot's value is its log-count ratio between toxic and other training
rows, and a row's values are scaled to length one; logistic regression with
balanced classes is fitted to them. Texts of any length are scored whole.

The fit takes a bounded sample of the labelled rows, ``TOXIC_ROWS`` and
``OTHER_ROWS`` at most, picked by a hash of the id. Everything else reads all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import keep_ids, sliced, small_batches, staged, worker_cache

BITS = 20
ORDERS = (5, 7)
TOXIC_ROWS, OTHER_ROWS = 3_000, 5_000
LEAST_ROWS = 8  # slots seen in fewer training rows are left out
REJECT_AT = 0.7
_BLOCK = 1 << 20  # code points hashed at a time
_FIT_ROWS = 1_000


@dataclass
class Model:
    weights: np.ndarray  # ratio times coefficient
    squares: np.ndarray  # squared ratio
    bias: float


def features(text: str | None) -> np.ndarray:
    """Sorted distinct slots of a text's n-grams; long texts are read in overlapping blocks."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    longest, out = max(ORDERS), []
    for start in range(0, len(points), _BLOCK):
        b = points[start : start + _BLOCK + longest - 1]
        blanks = np.concatenate(([0], np.cumsum(b <= 32)))
        h = b
        for n in range(2, longest + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] * np.uint32(0x85EBCA6B)
            h = h ^ (h >> np.uint32(15))
            if n in ORDERS:
                slots = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                inner = blanks[n - 1 : len(b)] - blanks[1 : len(b) - n + 2]
                out.append(slots[inner == 0])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint32)


def fit(rows: list[np.ndarray], toxic: np.ndarray, turns: int = 60) -> Model:
    """Ratios and coefficients; ``rows`` is emptied. With fewer than two classes every score is the smoothed share of toxic rows."""
    slots = 1 << BITS
    y = np.asarray(toxic, np.float64)
    n, positive = len(y), y.sum()
    if positive in (0, n):
        share = (positive + 1) / (n + 2)
        return Model(np.zeros(slots, np.float32), np.zeros(slots, np.float32), float(np.log(share / (1 - share))))
    counts = np.zeros((2, slots))
    for f, label in zip(rows, y, strict=True):
        counts[int(label), f] += 1
    ratio = np.log((counts[1] + 1) / (positive + 2)) - np.log((counts[0] + 1) / (n - positive + 2))
    ratio[counts.sum(0) < LEAST_ROWS] = 0
    del counts
    blocks = []  # only the slots are kept; what a turn needs besides is as large as a block
    for lo in range(0, n, _FIT_ROWS):
        used = [f[ratio[f] != 0] for f in rows[lo : lo + _FIT_ROWS]]
        rows[lo : lo + _FIT_ROWS] = [None] * len(used)  # their place is needed for the blocks
        norm = np.array([1 / np.sqrt(max(1, float((ratio[f] ** 2).sum()))) for f in used])
        blocks.append((slice(lo, lo + len(used)), np.concatenate(used).astype(np.int32), [len(f) for f in used], norm))
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (n - positive))
    penalty = 0.1 / n
    w, b, zw, zb, t = np.zeros(slots), 0.0, np.zeros(slots), 0.0, 1.0
    for _ in range(turns):  # gradient steps with Nesterov's momentum
        slope, error_sum, scaled = penalty * zw, 0.0, ratio * zw
        for part, at, lengths, norm in blocks:
            row = np.repeat(np.arange(len(lengths)), lengths)
            line = np.bincount(row, scaled[at], len(lengths)) * norm + zb
            error = weight[part] * (1 / (1 + np.exp(-line)) - y[part])
            slope += ratio * np.bincount(at, (error * norm)[row], slots)
            error_sum += error.sum()
        new_w, new_b = zw - 4 * slope, zb - 4 * error_sum
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(b))


def score(model: Model, text: str | None) -> float:
    f = features(text)
    s = float(model.weights[f].sum(dtype=np.float64)) / max(1.0, float(model.squares[f].sum(dtype=np.float64))) ** 0.5
    return float(1 / (1 + np.exp(-np.clip(s + model.bias, -500, 500))))


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text (null: empty) modulo ``divisor``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("toxicity")  # what others left goes
    for batch in sliced(batches):
        found = [features(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["toxic", "slots"])


def train(docs: DataFrame, labels: DataFrame, held_out: int = 1, divisor: int = 3) -> Model:
    """Fit on labelled rows whose id's remainder is not ``held_out``.

    Labels other than 0 and 1 and null ids are not used; an id labelled more
    than once counts as toxic if any label says so.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", divisor) != held_out))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )

    def some(label: int, rows: int) -> DataFrame:
        return known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    sample = some(1, TOXIC_ROWS).union(some(0, OTHER_ROWS))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    toxic, rows = [], []
    # one partition at a time, so that the driver holds the sample's slots once
    for r in texts.select("toxic", "text").mapInArrow(_slots, "toxic int, slots binary").toLocalIterator():
        toxic.append(r.toxic)
        rows.append(np.frombuffer(r.slots, np.uint32))
    return fit(rows, np.array(toxic))


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: int = 1, divisor: int = 3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``REJECT_AT`` on) of every row.

    Null and empty texts have the score of a text without features. Null ids
    stay and are not held out. Repeated rows are scored alike; further columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    trained = train(docs, labels, held_out, divisor)
    sent = spark.sparkContext.broadcast((trained.weights, trained.squares, trained.bias))  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        model = Model(*sent.value)
        for batch in sliced(batches):
            scores = [score(model, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", divisor) == held_out).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= REJECT_AT, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; rows without an id are kept."""
    # staged, as the ids are counted and then joined: texts are scored once
    bad = staged(toxicity_scores(docs, labels).where("predicted = 1 and doc_id is not null").select("doc_id").distinct(), "toxic")
    return keep_ids(docs, bad, "doc_id", "left_anti")
