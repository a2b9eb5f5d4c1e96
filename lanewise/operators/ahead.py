"""A filter of the wanted keys sent ahead of a join.

The wanted keys set bits of an array of fixed size (two each, in one 64-bit
number), which a scalar subquery brings to the scan of the large side. Rows whose bits are not all set go there;
of the rest a few are false hits, which the exact join behind drops. So only
about the wanted rows are shuffled, however large their table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^20 bits, 128 KB: one false hit in a hundred at 50,000 keys, one in five at 300,000. More keys only let more rows pass.
BITS = 1 << 20


def _place(key: str, bits: int) -> tuple[Column, Column]:
    """The 64-bit number that a key falls into, and its two bits there."""
    h = F.xxhash64(F.col(key))
    one, two = (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int") for shift in (40, 46))
    bit = [F.call_function("shiftleft", F.lit(1).cast("bigint"), n) for n in (one, two)]
    return F.pmod(h, F.lit(bits // 64)), bit[0].bitwiseOR(bit[1])


def key_bits(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """One row with ``words``, the bits of all keys in 64-bit numbers."""
    word, mask = _place(key, bits)
    found = keys.where(F.col(key).isNotNull()).select(word.alias("word"), mask.alias("bits"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = found.union(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words.agg(F.transform(in_order, lambda w: w.bits).alias("words"))


def may_hold(keys: DataFrame, key: str, bits: int = BITS) -> Column:
    """True for every row whose key is among ``keys``, and for few others; never for NULL."""
    if bits < 64 or bits & (bits - 1):
        raise ValueError("bits must be a power of two, 64 or more")
    word, mask = _place(key, bits)
    there = F.element_at(key_bits(keys, key, bits).scalar(), (word + 1).cast("int"))
    return F.col(key).isNotNull() & (there.bitwiseAND(mask) == mask)


def semi_join_ahead(rows: DataFrame, keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """Rows whose key is among ``keys``; keys may repeat, NULL matches nothing."""
    wanted = keys.select(key).distinct()
    return rows.where(may_hold(wanted, key, bits)).join(wanted, key, "left_semi")
