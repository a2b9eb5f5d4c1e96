"""Report files: headings, row numbers and the export itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: column headings of the exported reports
HEADINGS = {
    "client_summary": {
        "client": "Client Name",
        "shipments": "Total Shipments",
        "otp_on_time": "OTP On Time",
        "otp_rate": "OTP Rate %",
        "otd_on_time": "OTD On Time",
        "otd_rate": "OTD Rate %",
    },
    "client_detail": {
        "order_code": "Order Code",
        "leg_id": "Warp ID",
        "shipment_type": "Shipment Type",
        "pick_location": "Pickup Location",
        "drop_location": "Delivery Location",
        "pick_window": "Pickup Window",
        "pick_arrived": "Pickup Arrival",
        "pick_departed": "Pickup Departure",
        "pick_load_hours": "Pickup Load Time (hrs)",
        "pick_delay_code": "Pickup Delay Code",
        "drop_window": "Delivery Window",
        "drop_arrived": "Delivery Arrival",
        "drop_departed": "Delivery Departure",
        "drop_load_hours": "Delivery Load Time (hrs)",
        "drop_delay_code": "Delivery Delay Code",
        "otp_status": "OTP Status",
        "otd_status": "OTD Status",
    },
    "carrier_transit": {
        "load_id": "Load ID",
        "leg_id": "WarpID",
        "scheduled_pick": "Scheduled Pickup",
        "actual_pick": "Actual Pickup",
        "otp": "OTP",
        "otp_days_late": "OTP Days Late",
        "scheduled_drop": "Scheduled Dropoff",
        "actual_drop": "Actual Dropoff",
        "otd": "OTD",
        "otd_days_late": "OTD Days Late",
        "transit_days": "Transit Days",
        "pallet_count": "Pallet Count",
        "transit_cost": "Transit Cost",
    },
    "lane_profit": {
        "lane": "Lane",
        "order_count": "Orders",
        "total_revenue": "Revenue",
        "total_cost": "Cost",
        "total_profit": "Profit",
        "crossdock_cost": "Cross-dock Cost",
        "crossdock_cost_pct": "Cross-dock Cost Share",
        "margin_pct": "Margin %",
    },
    "drill_down": {
        "order_code": "Order ID",
        "leg_id": "Warp ID",
        "main_shipment": "Main Shipment",
        "lane": "Lane",
        "client": "Customer",
        "carrier": "Carrier",
        "pick_location": "Pickup Location",
        "drop_location": "Drop Location",
        "revenue": "Revenue",
        "cost": "Cost",
        "profit": "Profit",
        "crossdock": "Cross-dock",
        "shipment_type": "Shipment Type",
        "pick_window_from": "Pickup Window",
    },
    "within_market": {
        "market": "Market",
        "order_count": "Orders",
        "total_revenue": "Revenue",
        "total_cost": "Cost",
        "total_profit": "Profit",
        "crossdock_cost": "Cross-dock Cost",
        "crossdock_revenue": "Cross-dock Revenue",
        "margin_pct": "Margin %",
    },
    "market_summary": {
        "market": "Market",
        "shipments": "Shipments",
        "revenue": "Revenue",
        "cost": "Cost",
        "pieces": "Pieces",
        "profit": "Profit",
        "cost_per_piece": "Cost/Piece",
        "margin_pct": "Margin %",
    },
}


def with_headings(df: DataFrame, report: str) -> DataFrame:
    """Project to the columns the report shows, under the names it shows."""
    return df.select(*(F.col(name).alias(title) for name, title in HEADINGS[report].items()))


def number_rows(shown: DataFrame, *order, name: str = "row") -> DataFrame:
    """1-based position, for a frame already cut to a shown top-n.

    One task numbers the rows, so the input must be bounded (a ranking is).
    """
    return shown.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def number_report(df: DataFrame, work: str, *order: Column, name: str = "row") -> DataFrame:
    """1-based position of every row of a report of any length.

    Rows are parted by ranges of ``order``, sorted and numbered within their
    part, and written to ``work``, a new folder; a part's numbers start after the
    rows of all parts before it. No task sees more than one part, and only the
    parts' sizes come together. ``order`` should tell all rows apart; equal rows
    share a part and are numbered as they lie there.
    """
    spark = df.sparkSession
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), nth.alias("_nth"))
    parted.write.parquet(work)
    placed = spark.read.schema(parted.schema).parquet(work)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    starts = sizes.select("_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(  # one row a part
        *(F.col(f"`{c}`") for c in df.columns), (F.col("_start") + F.col("_nth") + 1).alias(name)
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("emptyValue", "").csv(path)
    else:
        writer.format(fmt).save(path)
