"""Leg, route and order tables derived from the star-schema sample data.

The sample data has no freight table. The columns below are made from
``lineitem``, ``orders``, ``supplier`` and ``customer`` with integer, decimal
and text arithmetic only, so that any engine derives the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import schema as S
from lanewise.functions.places import leg_number
from lanewise.functions.times import parse_timestamp
from lanewise.session import use_utc, written


def _after(minutes: str) -> str:
    """Ship date plus some minutes as time text."""
    return f"date_format(d + make_dt_interval(0, 0, int({minutes})), 'MM/dd/yyyy HH:mm:ss')"


_MARKET_GAPS = "CASE WHEN p % 41 = 0 THEN NULL WHEN p % 43 = 0 THEN ''"

_KEYS = {
    "shipmentType": f"""CASE WHEN k % 10 = 5 AND n = 7 THEN '{S.FTL}' WHEN k % 10 < 6 THEN '{S.LTL}'
        WHEN k % 10 < 9 THEN '{S.FTL}' ELSE '{S.PARCEL}' END""",
    "pickLocationName": """CASE p % 10 WHEN 0 THEN 'WTCH-' || sm || '-1' WHEN 1 THEN 'ACCL-' || sm
        WHEN 2 THEN 'SB-NYC-UG' WHEN 3 THEN 'ACME Cross-Dock Chicago' WHEN 4 THEN NULL WHEN 5 THEN 'SB-ZZZ-1'
        ELSE 'Vendor ' || p END""",
}

_COLUMNS = {
    "orderCode": "'P-' || k",
    # one number, ((k * 10 + n) * 100000 + p) * 100000 + s, in two parts that stay within bigint
    "warpId": "'S-' || ((k * 10 + n) * 100000 + p + s div 100000) || lpad(string(s % 100000), 5, '0')",
    "loadId": "lpad(string(s), 5, '0') || '-' || date_format(d, 'yyMM')",
    "mainShipment": f"""CASE WHEN n = 7 AND p % 11 = 0 THEN NULL
        WHEN n <= CASE shipmentType WHEN '{S.FTL}' THEN 3 WHEN '{S.PARCEL}' THEN 5 ELSE 1 END THEN 'YES'
        ELSE 'NO' END""",
    "shipmentStatus": """CASE WHEN p % 37 = 0 THEN 'Removed' WHEN st = 'F' OR (st = 'O' AND k % 2 = 0) THEN 'Complete'
        WHEN st = 'O' THEN 'Pending' WHEN k % 3 = 0 THEN 'Canceled' ELSE 'Complete' END""",
    "pickStatus": "CASE WHEN n = 1 THEN NULL WHEN p % 13 = 0 THEN 'Failed' ELSE 'Succeeded' END",
    "dropStatus": "CASE WHEN n = 1 THEN NULL WHEN p % 14 = 0 THEN 'Failed' ELSE 'Succeeded' END",
    "clientName": "CASE WHEN ck % 97 = 0 THEN NULL WHEN ck % 25 = 0 THEN 'DoorDash' ELSE c_name END",
    "carrierName": "if(s % 10 = 0, 'Accelerated USA Inc', s_name)",
    "carrierSaleRep": "'Rep ' || (s % 7)",
    "startMarket": f"{_MARKET_GAPS} ELSE sm END",
    "endMarket": f"{_MARKET_GAPS} WHEN n = 4 THEN sm ELSE cm END",
    "dropLocationName": """CASE WHEN n = 5 THEN pickLocationName WHEN s % 8 = 0 THEN 'WTCH-' || cm || '-2'
        WHEN s % 8 = 1 THEN 'GoBolt NYC Cross-Dock' WHEN s % 8 = 2 THEN NULL WHEN s % 8 = 3 THEN 'DoorDash ' || cm
        ELSE 'Dock ' || ck END""",
    "pickCity": "'City ' || (s % 50)",
    "pickState": "'S' || (s % 9)",
    "dropCity": "'City ' || (ck % 50)",
    "dropState": "'S' || (ck % 9)",
    "pickWindowFrom": f"""CASE WHEN p % 97 = 0 THEN '{S.INVALID_DATE}' WHEN p % 101 = 0 THEN NULL
        ELSE {_after('480')} END""",
    "pickWindowTo": _after("720"),
    "pickTimeArrived": f"CASE WHEN p % 23 = 0 THEN NULL WHEN p % 29 = 0 THEN '' ELSE {_after('480 + 6 * q')} END",
    "pickTimeDeparted": f"if(p % 31 = 0, NULL, {_after('480 + 6 * q + 13 * n')})",
    "dropWindowFrom": _after("1440 * n + 540"),
    "dropWindowTo": _after("1440 * n + 1020"),
    "dropTimeArrived": f"""CASE WHEN p % 19 = 0 THEN NULL WHEN p % 17 = 0 THEN ''
        ELSE {_after('1440 * n + 540 + 12 * q')} END""",
    "dropTimeDeparted": f"""CASE WHEN p % 19 = 0 THEN NULL WHEN p % 17 = 0 THEN ''
        ELSE {_after('1440 * n + 540 + 12 * q + 17 * n')} END""",
    "dropDateArrived": "if(p % 2 = 0, date_format(d + make_dt_interval(int(n)), 'MM/dd/yyyy'), '')",
    "loadBookedTime": _after("-2880 + 445"),
    "pickupDelayCode": """CASE WHEN q < 30 OR p % 4 = 2 THEN NULL WHEN p % 4 = 0 THEN 'Shipper Delay'
        WHEN p % 4 = 1 THEN '' ELSE 'Weather' END""",
    "deliveryDelayCode": """CASE WHEN q < 35 OR p % 4 = 0 THEN NULL WHEN p % 4 = 1 THEN 'Receiver Delay'
        WHEN p % 4 = 2 THEN '' ELSE 'Traffic' END""",
    "equipment": """CASE p % 5 WHEN 0 THEN '53-ft Trailer' WHEN 1 THEN '53-ft Reefer' WHEN 2 THEN '26-ft Straight Truck'
        WHEN 3 THEN 'Cargo Van /w Lift Gate' ELSE 'Reefer Straight box truck' END""",
    "revenueAllocationNumber": "CASE WHEN n = 1 AND p % 7 = 0 THEN 0 WHEN p % 59 = 0 THEN -price ELSE price END",
    "costAllocationNumber": "if(p % 53 = 0, NULL, price * (disc + CAST('0.80' AS DECIMAL(4, 2))))",
    "pieces": "if(p % 47 = 0, 0, q)",
}


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its order, supplier and customer keys.

    Orders get their customer first, so that the line items, the largest table
    by far, are shuffled once, by order, and narrow. No broadcast hints: Spark
    compares each side with its size limit, and for the large sides adaptive
    execution splits skewed join partitions.
    """

    def table(name: str, *columns: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").selectExpr(*columns)

    lines = table(
        "lineitem",
        "l_orderkey AS k",
        "bigint(l_linenumber) AS n",
        "l_partkey AS p",
        "l_suppkey AS s",
        "int(l_quantity) AS q",
        "l_shipdate AS d",
        "CAST(l_extendedprice AS DECIMAL(12, 2)) AS price",
        "CAST(l_discount AS DECIMAL(4, 2)) AS disc",
    )
    orders = table("orders", "o_orderkey AS k", "o_custkey AS ck", "o_orderstatus AS st")
    suppliers = table("supplier", "s_suppkey AS s", "s_name", "'M' || lpad(string(s_nationkey), 2, '0') AS sm")
    customers = table("customer", "c_custkey AS ck", "c_name", "'M' || lpad(string(c_nationkey), 2, '0') AS cm")
    return lines.join(orders.join(customers, "ck"), "k").join(suppliers, "s")


def legs(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """The legs as text; with ``work``, a new folder, the joined tables are written there, for legs that are read often."""
    use_utc(spark)
    # Over thirty derived columns make one method too long for the JIT compiler;
    # beyond this size Spark splits the projection into methods that compile.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    base = _base(spark, sf_dir)
    if work is not None:
        base = written(base, work)
    base = base.selectExpr("*", *(f"{sql} AS {name}" for name, sql in _KEYS.items()))
    derived = _COLUMNS | {name: name for name in _KEYS}
    return base.selectExpr(
        *(f"CAST({derived[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in S.LEGS)
    )


def routes(legs_df: DataFrame) -> DataFrame:
    """One row per load; loads of every sixth supplier are left out on purpose."""
    supplier = "int(substring(loadId, 1, 5))"
    totals = (
        legs_df.where(f"{supplier} % 6 <> 0")
        .groupBy("loadId")
        .agg(F.sum("pieces").alias("palletCount"), F.sum("costAllocationNumber").alias("cost"))
    )
    return totals.selectExpr(
        "loadId AS routeId",
        "palletCount",
        f"if({supplier} % 11 = 0, 'n/a', string(CAST(cost AS DECIMAL(28, 2)))) AS transitCost",
    )


def route_codes(legs_df: DataFrame) -> DataFrame:
    """Load rows with a JSON array of leg codes: one real code and one unknown.

    One row per leg rather than one per load, so that no array grows with the data.
    """
    return legs_df.selectExpr("loadId AS routeId", "to_json(array(warpId, warpId || '0')) AS shipmentCodes")


def orders_fin(legs_df: DataFrame) -> DataFrame:
    """Order-level money as text; headers of multi-row LTL orders carry none."""
    is_copy = f"shipmentType = '{S.LTL}' AND coalesce(mainShipment, '{S.HEADER}') = '{S.HEADER}'"
    booked = F.to_date(parse_timestamp(F.col("loadBookedTime")))
    per_order = legs_df.groupBy("orderCode").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.max("clientName").alias("customerName"),
        F.max("shipmentType").alias("shipmentType"),
        F.max("shipmentStatus").alias("status"),
        F.sum("revenueAllocationNumber").alias("everything"),
        F.expr(f"sum(if({is_copy}, 0, revenueAllocationNumber))").alias("without_copies"),
        F.sum("costAllocationNumber").alias("cost"),
        F.min(booked).alias("first_booked"),
        F.max(leg_number(F.col("warpId"))).alias("warpId"),
    )
    return per_order.selectExpr(
        "orderCode AS code",
        "customerName",
        "shipmentType",
        "status",
        "string(CAST(if(cnt > 1, without_copies, everything) AS DECIMAL(28, 2))) AS revenueAllocation",
        "string(CAST(cost AS DECIMAL(28, 2))) AS costAllocation",
        "date_format(first_booked, 'yyyy-MM-dd') AS createdAt",
        "warpId",
    )
