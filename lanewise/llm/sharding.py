"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, from the
multivariate hypergeometric law that a uniform permutation of all rows implies
(row sums: the partitions' sizes; column sums: the shards' sizes). Then every
partition permutes its rows, sends the first of them to shard 0, the next to
shard 1 and so on, and every shard permutes what it got.

Both permutations order rows by a hash of seed and row number, so a task that
runs again makes the same choice. A shard is cut into slices of that hash and
the slices are sorted apart: no task holds a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lanewise.llm.common import staged

_SLICE_ROWS = 200_000


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts by partition and shard; shard sizes differ by one at most."""
    total = sum(rows)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    matrix = np.zeros((len(rows), shards), np.int64)
    for p, size in enumerate(rows):
        there, draws = int(left.sum()), size
        for s in range(shards):  # one marginal draw after the other
            others = there - int(left[s])
            matrix[p, s] = _hypergeometric(rng, int(left[s]), others, draws)
            draws -= int(matrix[p, s])
            there = others
        left -= matrix[p]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw; numpy takes less than 10^9 of either kind, larger urns are drawn in parts."""
    if not draws or not good:
        return 0
    if not bad:
        return draws
    part = 500_000_000
    if good < part and bad < part:
        return int(rng.hypergeometric(good, bad, draws))
    if draws > (good + bad) // 2:
        return good - _hypergeometric(rng, good, bad, good + bad - draws)
    # of both halves of the urn: as many draws from one half as that half's share gets
    g, b = good // 2, bad // 2
    first = draws // 2 if draws < 2 else int(rng.binomial(draws, (g + b) / (good + bad)))
    first = min(max(first, draws - (good - g + bad - b)), g + b)
    return _hypergeometric(rng, g, b, first) + _hypergeometric(rng, good - g, bad - b, draws - first)


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard).

    Shards differ by one row at most. Nulls and repeated rows are rows like any
    other; an empty table gives an empty result. Columns named shard or slot
    are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    data = df.drop("shard", "slot")
    spark = df.sparkSession

    def key(turn: int) -> Column:
        return F.xxhash64(F.lit(seed * 2 + turn), "number")

    # The first permutation sorts each partition where it is, so rows move once. They are
    # kept: from here on a row's partition, number and rank in the partition are data.
    rows = staged(
        data.select(F.struct(*(F.col(f"`{c}`") for c in data.columns)).alias("row") if data.columns else F.struct().alias("row"))
        .withColumn("part", F.spark_partition_id())
        .withColumn("number", F.monotonically_increasing_id())
        .sortWithinPartitions(key(0), "number")
        .withColumn("rank", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "rows",
    )
    sizes = [(r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    bounds = spark.createDataFrame(
        [(p, [int(x) for x in np.cumsum(matrix[i])]) for i, (p, _) in enumerate(sizes)],
        T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))]),
    )

    sent = (
        rows.join(F.broadcast(bounds), "part")  # as small as the matrix, which the driver holds
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int"))
        .select("row", "number", "shard", key(1).alias("key"))
    )
    # The second permutation: slices of the hash in order, sorted one by one.
    slices = max(1, -(-sum(n for _, n in sizes) // (shards * _SLICE_ROWS)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    high = F.shiftrightunsigned("key", 33)  # 31 bits
    slot = F.shiftright(high * F.lit(slices), 31).cast("int")
    sent = sent.withColumn("slice", slot)
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sent.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "slice").orderBy("key", "number")
    return (
        sent.withColumn("place", F.row_number().over(order) - 1)
        .join(offsets, ["shard", "slice"])
        .select("row.*", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))
    )


def sharded_documents(docs: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law has none) of every document.

    The documents are shuffled with their whole texts; size and checksum are
    taken from the texts that arrived in the shards. Size is the text's bytes in
    UTF-8 plus 1; a null text has none and the checksum of no bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return shuffle_to_shards(rows, shards, seed).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
