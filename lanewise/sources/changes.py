"""Change sets merged into the staged leg table.

A change set holds whole rows of legs that are new or have changed, with a
version. The latest version of a leg wins, whichever batch brings it; a batch
that comes twice changes nothing. Only partitions that lose or gain a leg are
written anew, by dynamic overwrite, some at a time; the files of all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise import schema as S
from lanewise.operators.ahead import may_hold
from lanewise.session import drop_folder, shuffles_dropped, use_utc, written
from lanewise.sources.staging import ROW_GROUP_BYTES, normalize_legs, write_staged

VERSION = "version"
_NONE = "__HIVE_DEFAULT_PARTITION__"  # how a folder is named whose partition value is NULL
#: Partitions are written anew in groups of about so many bytes, or in so many groups of a large table.
GROUP_BYTES, GROUPS = 128 << 20, 128
_ROW_BYTES = 128  # about what a staged leg takes
#: A list of ids up to this many rows may be broadcast; a longer one is joined by a shuffle.
_BROADCAST_ROWS = 500_000


def load_versions(spark: SparkSession, path: str, extra: Sequence[str] = (), folders: Sequence[str] = ()) -> DataFrame:
    """The staged table, or some folders of it, with the version of each leg; NULL where it was staged without one."""
    use_utc(spark)
    fields = S.with_text(S.STAGED_LEGS, extra).fields + [T.StructField(VERSION, T.LongType(), True)]
    places = [f"{path.rstrip('/')}/{f}" for f in folders] or [path]
    return spark.read.schema(T.StructType(fields)).option("basePath", path).parquet(*places)


def latest(changes: DataFrame) -> DataFrame:
    """One row a leg: its highest version; of equal versions the row that sorts last, so that every run agrees."""
    rest = [c for c in changes.columns if c not in ("warpId", VERSION)]
    return (
        changes.groupBy("warpId")
        .agg(F.max(F.struct(VERSION, *rest)).alias("row"))
        .select("warpId", *(F.col(f"row.{c}").alias(c) for c in (VERSION, *rest)))
    )


def _partition() -> Column:
    """Folder of a row below the table's."""
    return F.concat_ws("/", *(F.concat(F.lit(f"{m}="), F.coalesce(F.col(m).cast("string"), F.lit(_NONE))) for m in S.MONTHS))


def _count(rows: DataFrame, folder: Column) -> dict[str, int]:
    """Rows of each partition: one row with as many pairs as there are partitions."""
    counts = rows.groupBy(folder.alias("folder")).count()
    return {r["folder"]: r["count"] for r in counts.agg(F.collect_list(F.struct("folder", "count")).alias("all")).first()["all"]}


def _files(spark: SparkSession, path: str, folder: str) -> dict[str, int]:
    """Name and size of the files of a partition; none if it is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{folder}")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().getName(): f.getLen() for f in store.listStatus(place)} if store.exists(place) else {}


def _groups(sizes: dict[str, int]) -> Iterator[list[str]]:
    most = max(GROUP_BYTES, sum(sizes.values()) // GROUPS)
    group, size = [], 0
    for folder in sorted(sizes):
        if group and size + sizes[folder] > most:
            yield group
            group, size = [], 0
        group.append(folder)
        size += sizes[folder]
    yield group


def _months(group: Sequence[str]) -> Column:
    """Pickup months of the partitions of a group, as a range that files can skip by."""
    months = sorted({f.split("/")[0].partition("=")[2] for f in group} - {_NONE})
    inside = F.col("pick_month").isNull() if any(f.startswith(f"pick_month={_NONE}/") for f in group) else F.lit(False)
    return inside | F.col("pick_month").between(F.lit(months[0]).cast("date"), F.lit(months[-1]).cast("date")) if months else inside


def _short(ids: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(ids) if rows <= _BROADCAST_ROWS else ids


def merge_changes(
    spark: SparkSession,
    path: str,
    changes: DataFrame,
    work: str,
    extra: Sequence[str] = (),
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> list[str]:
    """Bring ``changes`` (leg columns and ``version``) into the staged table at ``path``; the partitions written anew.

    ``work`` is a new folder for what the steps hand on. Changed legs are looked
    up by their ids: a filter of the ids is sent ahead, so of the table only ids,
    versions and partitions are read, and only about the changed legs shuffled.
    Then the touched partitions are read whole and written without the legs that
    have changed or moved away, and with the new rows: a group of partitions at a
    time, so that shuffle files and copies of a group only lie beside the table. A
    partition that has lost all its legs is dropped after that. A run that breaks
    off in between leaves a table that the same change set, run again, puts right.
    Versions of NULL are older than any other; a change without a leg id is
    refused. The steps' shuffle files go as each step ends, ``work`` at the end.
    """
    with shuffles_dropped(spark):
        return _merge(spark, path, changes, work, extra, row_group_bytes)


def _merge(
    spark: SparkSession, path: str, changes: DataFrame, work: str, extra: Sequence[str], row_group_bytes: int
) -> list[str]:
    batch = normalize_legs(latest(changes)).sortWithinPartitions(*S.MONTHS)
    batch = written(batch, f"{work}/batch")
    if batch.where(F.col("warpId").isNull()).limit(1).count():
        raise ValueError("changes need leg ids")
    table = load_versions(spark, path, extra)
    known = (
        table.where(may_hold(batch, "warpId"))
        .select("warpId", F.col(VERSION).alias("_known"), _partition().alias("_folder"))
        .groupBy("warpId")
        .agg(F.max("_known").alias("_known"), F.collect_set("_folder").alias("_folders"))
    )
    older = F.coalesce("_known", F.lit(-(2**63))) <= F.coalesce(F.col(VERSION), F.lit(-(2**63)))
    ids = batch.select("warpId", VERSION, _partition().alias("_to"))
    won = written(ids.join(known, "warpId", "left").where(older).select("warpId", "_to", "_folders"), f"{work}/won")
    gain, loss = _count(won, F.col("_to")), _count(won.select(F.explode("_folders").alias("_from")), F.col("_from"))
    files = {f: _files(spark, path, f) for f in sorted({*gain, *loss})}
    sizes = {f: sum(files[f].values()) + _ROW_BYTES * gain.get(f, 0) for f in files}
    names = [c for c in table.columns if c in batch.columns]
    for group in _groups(sizes) if files else ():
        among = F.lit(group)
        brought = _short(won.where(F.array_contains(among, F.col("_to"))).select("warpId"), sum(gain.get(f, 0) for f in group))
        after = batch.where(_months(group) & F.array_contains(among, _partition())).join(brought, "warpId", "left_semi").select(*names)
        if there := [f for f in group if files[f]]:
            gone = _short(won.where(F.arrays_overlap("_folders", among)).select("warpId"), sum(loss.get(f, 0) for f in group))
            after = load_versions(spark, path, extra, there).join(gone, "warpId", "left_anti").select(*names).unionByName(after)
        write_staged(after, path, row_group_bytes=row_group_bytes, dynamic=True)
        for folder in there:  # one that gains no leg and has its old files has lost all its legs
            if folder not in gain and _files(spark, path, folder).keys() == files[folder].keys():
                drop_folder(spark, f"{path.rstrip('/')}/{folder}")
    drop_folder(spark, work)
    return list(files)
