"""Table readers. Schemas are declared; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise import schema as S
from lanewise.functions.times import parse_iso_date
from lanewise.session import use_utc

DIMENSIONS = {"carriers": S.CARRIERS, "clients": S.CLIENTS, "shipments": S.SHIPMENTS}


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    options = {"header": "true"} if fmt == "csv" else {}
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **extra: str,
) -> dict[str, str]:
    """Reader options for a parallel scan of a relational origin.

    Without a numeric column to split on the scan would be one task, so more
    than one partition needs ``partition_column`` and ``bounds``.
    """
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **extra}
    if partition_column is None:
        if partitions != 1:
            raise ValueError("several partitions need a partition column and bounds")
        return options
    if bounds is None:
        raise ValueError("a partition column needs bounds")
    return options | {
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def month_predicates(column: str, first: tuple[int, int], last: tuple[int, int]) -> list[str]:
    """SQL conditions that split a table by the month of a MM/DD/YYYY text, from (year, month) to (year, month).

    The last one takes all other rows: other months, unreadable texts and NULL. Every row meets exactly one.
    """
    months = range(first[0] * 12 + first[1] - 1, last[0] * 12 + last[1])
    if not months:
        raise ValueError("the last month is before the first")
    inside = [f"{column} LIKE '{m % 12 + 1:02d}/__/{m // 12:04d}%'" for m in months]
    return [*inside, f"{column} IS NULL OR NOT ({' OR '.join(inside)})"]


def read_jdbc(spark: SparkSession, schema: T.StructType, predicates: Sequence[str] | None = None, **options) -> DataFrame:
    """Relational origin, cast to the declared schema; column pruning reaches the query.

    ``predicates`` make one task each, for tables without a numeric key. A value that does not fit its type is NULL.
    """
    options = jdbc_options(**options)
    if predicates is None:
        raw = spark.read.format("jdbc").options(**options).load()
    else:
        if "numPartitions" in options:
            raise ValueError("split by a partition column or by predicates, not both")
        raw = spark.read.jdbc(options.pop("url"), options.pop("dbtable"), predicates=list(predicates), properties=options)
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def load_legs(spark: SparkSession, path: str, fmt: str = "parquet", extra: Sequence[str] = ()) -> DataFrame:
    """The leg columns the operators use; ``extra`` names further text columns."""
    use_utc(spark)
    return read_files(spark, path, S.with_text(S.LEGS, extra), fmt)


def load_routes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_files(spark, path, S.ROUTES, fmt)


def load_orders(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return typed_orders(read_files(spark, path, S.ORDERS, fmt))


def load_dimension(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    return read_files(spark, path, DIMENSIONS[name], fmt)


def typed_orders(orders: DataFrame) -> DataFrame:
    """Text money and creation date get typed columns beside them.

    Money has two decimals; the type is wide enough for the largest order.
    """
    return orders.withColumns(
        {
            "revenue": F.col("revenueAllocation").try_cast("decimal(18,2)"),
            "cost": F.col("costAllocation").try_cast("decimal(18,2)"),
            "created_on": parse_iso_date(F.col("createdAt")),
        }
    )
