"""What the operators of this folder share: the shared folder, staged tables, words and hashes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import shuffles_dropped  # noqa: F401  (the operators take it from here)

#: A key list up to this many rows may be broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows that travel to a Python worker at a time.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches.

    Where the setting is missing, a local master (tests) gets a scratch folder
    and any other master an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lanewise-llm-")
    return f"{base.rstrip('/')}/lanewise-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def mounted(path: str) -> str:
    """The plain path of a folder that workers open as files (a mounted share)."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: workers map files of this folder into memory, so it has to be a mounted path")
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; its lineage ends there."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (semi) or is not (anti) among distinct ``ids``.

    The ids are counted; a short list is broadcast so that ``df`` does not move,
    a long one is joined by a shuffle.
    """
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps from task to task of one operator; it goes with the worker or as another operator asks.

    Workers outlive a stage, and what the stage before remembered would stay beside the work of the next.
    """
    kept = sys.modules.setdefault("_lanewise_worker_cache", types.ModuleType("_lanewise_worker_cache")).__dict__.setdefault("kept", {})
    for other in kept.keys() - {owner}:
        del kept[other]
    return kept.setdefault(owner, {})


def small_batches(spark: SparkSession) -> None:
    """Texts travel to Python few rows at a time: neither the executor nor a worker holds all texts of a task.

    Spark's own batches, of 10,000 rows, hold the whole text of a task. A session with smaller ones keeps them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Memory that Arrow and the C library keep for later goes back; the worker waits for its next task without it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python holds the texts of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release_memory()


def sliced_by_bytes(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take about ``size`` bytes together; a longer text stands alone or ends a run."""
    for batch in batches:
        before = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(before // size)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)
    release_memory()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_PLACES = 64  # of these first bytes of a word the values are looked up


def _byte_values(keys: np.ndarray) -> np.ndarray:
    return mix((keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE_VALUES = _byte_values(np.arange(_PLACES << 8))


def _hash_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the non-empty words that lie end to end in ``data``: mixed sums of a value for each byte and place."""
    if not len(starts):
        return np.empty(0, np.uint64)
    places = np.arange(len(data)) - np.repeat(starts, lengths)
    keys = (places << 8) | data
    values = _BYTE_VALUES[np.minimum(keys, len(_BYTE_VALUES) - 1)]
    if int(lengths.max()) > _PLACES:
        late = np.flatnonzero(places >= _PLACES)
        values[late] = _byte_values(keys[late])
    return mix(np.add.reduceat(values, starts))


def word_hashes(texts: pa.Array, last: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z in lower case) of all texts, and their number by text.

    Each text is closed by ``last``, which is no word.
    """
    plain = pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string()))
    cut = pc.ascii_split_whitespace(plain)
    words = cut.flatten()
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    size = np.diff(offsets)
    real = np.flatnonzero(size)  # white space at either end of a text leaves an empty word
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    of_text = np.repeat(np.arange(len(cut)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))[real]
    lengths = np.bincount(of_text, minlength=len(cut)) + 1
    end = np.frombuffer(last, np.uint8)
    out = np.full(int(lengths.sum()), _hash_words(end, np.zeros(1, np.int64), np.array([len(end)]))[0], np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(lengths) - 1] = False
    out[inner] = _hash_words(data, offsets[real] - offsets[0], size[real])
    return out, lengths


_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text whose words have the hashes ``h``.

    Fewer words than ``size`` make one shingle; no words, none.
    """
    if not len(h):
        return np.empty(0, np.uint64)
    width = min(size, len(h))
    value = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        value = value * _BASE + h[i : len(h) - width + 1 + i]
    return np.unique(mix(value))


def text_shingles(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingles of each text."""
    h, lengths = word_hashes(texts, b"\n")
    for end, length in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True):
        yield shingles(h[end - length : end - 1], size)


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reached.

    Every turn takes the smallest root among the neighbours and then the root
    of that root; turns end when nothing changes. Tables only, nothing is
    collected.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    roots = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), name)
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        low = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("next"))
        after = staged(
            low.join(jump, "low", "left").select("node", F.least("low", "next").alias("root"), F.col("root").alias("was")),
            name,
        )
        moved = after.where("root < was").limit(1).count()
        roots = after.select("node", "root")
        if not moved:
            return roots
