"""Layouts of the leg table: buckets by order, change sets, months of delivery, and filters sent ahead."""

from __future__ import annotations

import datetime as dt
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import plans
from checks import Tables
from checks.base import CLIENT, FIRST, LAST
from lanewise import schema as S
from lanewise.operators import orders as R
from lanewise.operators import quality
from lanewise.operators.ahead import key_bits, may_hold, semi_join_ahead
from lanewise.operators.chains import root_legs
from lanewise.operators.dedup import flag_dedup
from lanewise.operators.joins import legs_of
from lanewise.plans import carrier, client, lanes, questions
from lanewise.sources import changes
from lanewise.sources.by_order import open_by_order, stage_by_order, stage_orders_by_code
from lanewise.sources.changes import merge_changes
from lanewise.sources.reports import number_report
from lanewise.sources.staging import load_staged_legs, normalize_legs, stage_legs, write_staged

SF = "/root/testdata/sf0.001"
PER_ORDER = {
    "counts": R.order_row_counts,
    "shape": R.classify_order,
    "revenue": R.ltl_order_revenue,
    "pieces": R.ltl_order_pieces,
    "cost": R.order_cost,
    "ftl": R.ftl_order_pnl,
    "split": R.ftl_market_split,
}


def rows(df, *columns) -> Counter:
    df = df.select(*(columns or sorted(df.columns)))
    return Counter(map(str, df.collect()))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---- buckets by order --------------------------------------------------------------
def test_no_exchange_by_order_in_buckets(spark, no_broadcast):
    tables = Tables.of(spark, SF)
    legs, orders = tables.order_legs.legs, tables.code_orders
    for name, work in PER_ORDER.items():
        assert "Exchange" not in plans.text(work(legs)), name
        assert "Exchange hashpartitioning(orderCode" in plans.text(work(tables.legs)), name
    assert "Exchange" not in plans.text(quality.cross_validate(orders, legs))
    assert "Exchange" not in plans.text(legs.select("orderCode", "warpId").join(R.order_row_counts(legs), "orderCode"))


@pytest.fixture
def hot_legs(make_legs):
    """A third of all rows in one order, a tenth in none."""
    many = [
        {
            "orderCode": "P-hot" if i % 3 == 0 else None if i % 10 == 1 else f"P-{i % 70}",
            "mainShipment": ("YES", "NO", None)[i % 7 % 3],
            "shipmentType": (S.LTL, S.FTL, S.PARCEL)[i % 5 % 3],
            "pickLocationName": ("WTCH-EWR-1", "a", None)[i % 4 % 3],
            "revenueAllocationNumber": i % 11 or None,
            "costAllocationNumber": i % 13,
            "pieces": i % 3,
        }
        for i in range(900)
    ]
    return make_legs(*many)


def test_hot_orders_stay_out_of_the_buckets(spark, hot_legs, tmp_path):
    made = stage_by_order(hot_legs.repartition(4), str(tmp_path), "hot_order_legs", 16, share=1 / 20)
    assert {r[0] for r in made.hot.select("orderCode").distinct().collect()} == {"P-hot", None}
    assert made.legs.where("orderCode = 'P-hot'").count() == 0
    assert rows(made.legs.unionByName(made.hot)) == rows(hot_legs)
    assert made.hot.rdd.getNumPartitions() > 1 or len(list((tmp_path / "hot").glob("part-*"))) > 1
    sizes = [r[1] for r in made.legs.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 300
    for name, work in PER_ORDER.items():
        assert rows(made.per_order(work)) == rows(work(hot_legs)), name
    for kind in S.SHIPMENT_TYPES:
        picked = made.per_order(lambda legs, kind=kind: R.select_financial_rows(legs, kind))
        assert rows(picked) == rows(R.select_financial_rows(hot_legs, kind)), kind
    plain = hot_legs.select("orderCode", "warpId").join(R.order_row_counts(hot_legs), "orderCode")
    assert rows(made.with_order_counts(["warpId"])) == rows(plain)
    money = hot_legs.groupBy(F.col("orderCode").alias("code")).agg(
        F.sum("revenueAllocationNumber").cast("decimal(18,2)").alias("revenue"), F.lit(1).cast("decimal(18,2)").alias("cost")
    )
    orders = stage_orders_by_code(money, str(tmp_path / "orders"), "hot_orders", 16)
    assert rows(made.cross_validate(orders)) == rows(quality.cross_validate(money, hot_legs))


def test_buckets_are_found_by_another_application(spark, hot_legs, tmp_path):
    stage_by_order(hot_legs, str(tmp_path), "first_name", 8)
    again = open_by_order(spark, str(tmp_path), "second_name")
    assert rows(again.legs.unionByName(again.hot)) == rows(hot_legs)
    assert "Exchange" not in plans.text(R.order_cost(again.legs))


def test_an_empty_table_in_buckets(spark, make_legs, tmp_path):
    made = stage_by_order(make_legs({}).limit(0), str(tmp_path), "no_legs", 4)
    assert made.per_order(R.order_cost).count() == made.with_order_counts(["warpId"]).count() == 0


# ---- change sets --------------------------------------------------------------------
def test_change_sets_equal_a_full_restage(spark, make_legs, tmp_path):
    path, names = str(tmp_path / "staged"), S.LEGS.names

    def leg(i, month, version, status="Complete"):
        return {
            "warpId": f"S-{i}",
            "shipmentStatus": status,
            "pickWindowFrom": f"{month:02d}/10/2025 08:00:00" if month else "Invalid date",
            "dropWindowFrom": f"{month or 1:02d}/12/2025 08:00:00",
            "pieces": version,
        }

    def versions(*legs):
        return make_legs(*legs).select(*names).withColumn("version", F.col("pieces").cast("bigint"))

    def files():
        return {p: p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}

    stage_legs(versions(*(leg(i, i % 5 + 1, 1, "Pending") for i in range(40)), leg(90, 11, 1)), path)
    before = files()
    first = [leg(0, 1, 2), leg(90, 12, 2), leg(100, 3, 2), leg(6, 2, 1), leg(6, 2, 2, "Removed")]
    first += [leg(11, 0, 2)]  # its pickup time cannot be read any more
    touched = merge_changes(spark, path, versions(*first), str(tmp_path / "one"))
    months = {t.split("/")[0].removeprefix("pick_month=") for t in touched}
    assert months == {"2025-01-01", "2025-02-01", "2025-03-01", "2025-11-01", "2025-12-01", "__HIVE_DEFAULT_PARTITION__"}
    kept = {p for p in before if re.search("pick_month=2025-0[45]", str(p))}
    assert kept and all(files().get(p) == before[p] for p in kept)
    assert not list(Path(path).glob("pick_month=2025-11-01/*/*"))  # its only leg has moved
    second = [leg(100, 4, 3), leg(0, 1, 1, "Lost"), leg(11, 2, 5), leg(101, 9, 1)]
    merge_changes(spark, path, versions(*second), str(tmp_path / "two"))
    state = {i: leg(i, i % 5 + 1, 1, "Pending") for i in range(40)}
    state |= {0: leg(0, 1, 2), 90: leg(90, 12, 2), 6: leg(6, 2, 2, "Removed"), 11: leg(11, 2, 5), 100: leg(100, 4, 3), 101: leg(101, 9, 1)}
    full = make_legs(*state.values())
    assert rows(load_staged_legs(spark, path), *S.STAGED_LEGS.names) == rows(full, *S.STAGED_LEGS.names)
    again = files()
    assert merge_changes(spark, path, versions(leg(0, 7, 1)), str(tmp_path / "three")) == []
    assert files() == again
    merge_changes(spark, path, versions(*second), str(tmp_path / "four"))  # the same batch once more
    assert rows(load_staged_legs(spark, path), *S.STAGED_LEGS.names) == rows(full, *S.STAGED_LEGS.names)
    with pytest.raises(ValueError, match="leg ids"):
        merge_changes(spark, path, versions(leg(0, 1, 9) | {"warpId": None}), str(tmp_path / "five"))


def test_changes_without_versions_and_a_hot_leg(spark, make_legs, tmp_path):
    path = str(tmp_path / "staged")
    stage_legs(make_legs({}, {}).select(*S.LEGS.names), path)
    change = make_legs(*({"warpId": "S-1", "pieces": i} for i in range(300))).select(*S.LEGS.names)
    merge_changes(spark, path, change.withColumn("version", F.col("pieces").cast("bigint")), str(tmp_path / "w"))
    found = {r.warpId: r.pieces for r in load_staged_legs(spark, path).collect()}
    assert found == {"S-1": 299, "S-2": None}


@pytest.mark.parametrize("most", [1, 30_000])
def test_partitions_are_written_anew_some_at_a_time(spark, make_legs, tmp_path, monkeypatch, most):
    path, work, names = str(tmp_path / "staged"), tmp_path / "work", S.LEGS.names

    def leg(i, month, version):
        return {"warpId": f"S-{i}", "pickWindowFrom": f"{month:02d}/10/2025 08:00:00" if month else None, "pieces": version}

    def versions(*legs):
        return make_legs(*legs).select(*names).withColumn("version", F.col("pieces").cast("bigint"))

    stage_legs(versions(*(leg(i, i % 9 + 1, 1) for i in range(90)), leg(99, 12, 1)), path, parts=3)
    state = {i: leg(i, i % 9 + 1, 1) for i in range(90)} | {99: leg(99, 12, 1)}
    assert rows(load_staged_legs(spark, path), *names) == rows(make_legs(*state.values()), *names)
    plain, written_at_once = changes.write_staged, []

    def seen(df, *a, **b):
        written_at_once.append(df.select(*S.MONTHS).distinct().count())
        plain(df, *a, **b)

    monkeypatch.setattr(changes, "write_staged", seen)
    monkeypatch.setattr(changes, "GROUP_BYTES", most)
    monkeypatch.setattr(changes, "GROUPS", 1000)
    new = {i: leg(i, (i * 5) % 10, 2) for i in range(0, 90, 2)} | {99: leg(99, 4, 2), 200: leg(200, 11, 2)}
    touched = merge_changes(spark, path, versions(*new.values(), leg(1, 8, 0)), str(work))
    assert len(written_at_once) > 3
    assert max(written_at_once) < len(touched) / 2
    assert rows(load_staged_legs(spark, path), *names) == rows(make_legs(*(state | new).values()), *names)
    assert not list(Path(path).glob("pick_month=2025-12-01/*/*"))
    assert not work.exists()


# ---- months of delivery ------------------------------------------------------------------
def test_delivery_windows_skip_partitions(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    tables = Tables.of(spark, SF)
    legs = tables.legs
    for report in (
        lanes.profit_by_lane(legs, FIRST, LAST),
        lanes.drill_down(legs, FIRST, LAST, "customer", CLIENT),
        lanes.profit_within_market(legs, FIRST, LAST),
        questions.customer_otd_by_lane_equipment(legs, CLIENT, "1997-07-15"),
        questions.customer_profit_legs(legs, CLIENT, "1997-07-15"),
        questions.lane_profit_orders(tables.orders, legs, "1997-07-15"),
        questions.lane_profit_legs(legs, "1997-07-15"),
        carrier.carrier_otd(legs, "x", FIRST, LAST),
    ):
        assert re.search(r"PartitionFilters: \[[^\]]*first_drop_month[^\]]*last_drop_month", plans.text(report))
    total = legs.count()
    month = lanes.delivered_between(legs, "1997-06-01", "1997-06-30").select("warpId")
    month.collect()
    assert sum(plans.counted(month, "FileSourceScanExec", "numOutputRows")) < total / 20  # of 84 months


def test_partitions_hold_both_delivery_times(make_legs, spark, tmp_path):
    cases = {
        "S-1": {"dropWindowFrom": "01/30/2025 08:00:00", "dropTimeArrived": "02/01/2025 08:00:00"},
        "S-2": {"dropWindowFrom": "03/01/2025 08:00:00", "dropTimeArrived": "01/05/2025 08:00:00"},
        "S-3": {"dropWindowFrom": "bad", "dropTimeArrived": "01/31/2025 23:59:59"},
        "S-4": {"dropWindowFrom": None, "dropTimeArrived": "bad"},
        "S-5": {"dropWindowFrom": "02/01/2025 00:00:00", "pickLocationName": "a", "dropLocationName": "a"},
    }
    legs = make_legs(*({"warpId": w, **row} for w, row in cases.items()))
    path = str(tmp_path / "staged")
    stage_legs(legs.select(*S.LEGS.names), path)
    staged = load_staged_legs(spark, path)
    assert rows(staged, *S.STAGED_LEGS.names) == rows(legs, *S.STAGED_LEGS.names)
    for first, last in (("2025-01-01", "2025-02-01"), ("2025-02-01", "2025-02-28"), ("2025-01-31", "2025-02-01"), ("2024-01-01", "2024-12-31")):
        plain = legs.drop(*S.MONTHS, *S.DAYS)
        assert rows(lanes.delivered_between(staged, first, last), "warpId") == rows(lanes.delivered_between(plain, first, last), "warpId")


def test_row_groups_of_other_days_and_clients_are_skipped(make_legs, spark, tmp_path):
    one = make_legs({}).select(*S.LEGS.names)
    many = one.crossJoin(spark.range(30_000)).withColumns(
        {
            "warpId": F.concat(F.lit("S-"), "id"),
            "clientName": F.concat(F.lit("client "), F.pmod(F.xxhash64("id"), F.lit(40)).cast("string")),
            "dropWindowFrom": F.format_string("01/%02d/2025 08:00:00", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(28)).cast("int") + 1),
        }
    )
    many.drop("id").coalesce(1).write.parquet(str(tmp_path / "raw"))
    path = str(tmp_path / "staged")
    write_staged(normalize_legs(spark.read.parquet(str(tmp_path / "raw"))), path, row_group_bytes=64_000)
    legs = load_staged_legs(spark, path)
    day = lanes.delivered_between(legs, "2025-01-12", "2025-01-13")
    for df, most in ((day, 1 / 3), (day.where("clientName = 'client 7'"), 1 / 12)):
        shown = df.select("warpId")
        wanted = len(shown.collect())
        read = sum(plans.counted(shown, "FileSourceScanExec", "numOutputRows"))
        assert 0 < wanted <= read < 30_000 * most


# ---- filters sent ahead ---------------------------------------------------------------------
@pytest.fixture
def keyed(spark):
    return spark.range(20_000).selectExpr(
        "concat('S-', id) AS warpId", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 4000) END AS key"
    )


@pytest.mark.parametrize("bits", [64, 4096, 1 << 20])
def test_semi_join_ahead_is_exact(spark, keyed, bits):
    for wanted in (["k1", "k1", None, "k77", "none"], ["hot"], [], [f"k{i}" for i in range(0, 4000, 3)]):
        keys = spark.createDataFrame([(k,) for k in wanted], "key string")
        found = semi_join_ahead(keyed, keys, "key", bits)
        assert rows(found) == rows(keyed.where(F.col("key").isin([k for k in wanted if k])))
    with pytest.raises(ValueError):
        semi_join_ahead(keyed, keys, "key", 100)


def test_bits_are_those_of_the_keys(spark, keyed):
    words = key_bits(keyed.limit(500), "key", 1 << 12).first()["words"]
    assert len(words) == 64
    assert keyed.limit(500).where(F.col("key").isNotNull() & ~may_hold(keyed.limit(500), "key", 1 << 12)).count() == 0


def test_few_legs_are_shuffled_for_one_clients_orders(spark, no_broadcast):
    legs = Tables.of(spark, SF).legs
    total = legs.count()
    headers = client.client_headers(legs, FIRST, LAST).where(F.col("clientName") == CLIENT)
    found = legs_of(legs.select("orderCode", "warpId"), headers)
    count = len(found.collect())
    detail = client.client_detail(legs, CLIENT, FIRST, LAST)
    detail.collect()
    for df in (found, detail):
        moved = sum(plans.counted(df, "ShuffleExchangeExec", "shuffleRecordsWritten"))
        assert 0 < moved < total / 20
    assert 0 < count < total / 20
    kinds = [n.getClass().getSimpleName() for n in plans.nodes(found)]
    assert kinds.count("FileSourceScanExec") == 2  # the legs and the headers; no pass over the legs comes before
    status = client.client_status(legs, CLIENT, FIRST, LAST)
    for report in (client.client_detail_kpis(status), client.otp_otd_trend(status, FIRST, LAST), client.trend_status(status, FIRST, LAST)):
        assert plans.text(report).count("FileScan parquet") == 1
    assert rows(status) == rows(detail.select("pick_from_ts", "otp_status", "otd_status"))


# ---- chains and numbers -----------------------------------------------------------------------
def test_roots_of_long_chains_and_cycles(spark, tmp_path):
    parent = {f"a{i}": f"a{i - 1}" if i else None for i in range(21)}
    parent |= {"b0": "gone", "b1": "b0", "c0": "c2", "c1": "c0", "c2": "c1", "d0": "c1", "d1": "d0", "e": "e", "f": None}
    parent |= {f"h{i}": "f" for i in range(400)}  # a third and more under one root
    rows_in = [(k, v) for k, v in parent.items()] + [(None, "f"), ("b1", "b0"), ("c0", "c2"), ("a7", "b1"), ("a7", None)]
    found = root_legs(spark.createDataFrame(rows_in, "warpId string, parent string"), str(tmp_path / "w"))

    def walk(leg):
        depth, seen = 0, set()
        while parent.get(leg) in parent and leg not in seen:
            seen.add(leg)
            leg, depth = parent[leg], depth + 1
        return (None, None, True) if leg in seen else (leg, depth, False)

    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {k: walk(k) for k in parent}
    empty = spark.createDataFrame([], "warpId string, parent string")
    assert root_legs(empty, str(tmp_path / "none")).count() == 0


def test_rounds_of_chains_leave_each_shipment_once(spark, tmp_path):
    chains = spark.createDataFrame([(f"{c}-{i}", f"{c}-{i - 1}" if i else None) for c in range(9) for i in range(30)], "warpId string, parent string")
    found = root_legs(chains, str(tmp_path / "w"))
    kept = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "w").rglob("part-*.parquet"))
    assert kept == found.count() == 270  # after five rounds
    assert {tuple(r) for r in found.collect()} == {(f"{c}-{i}", f"{c}-0", i, False) for c in range(9) for i in range(30)}


# ---- flags of first rows ----------------------------------------------------------------------
def test_flags_in_steps_move_legs_once(spark, make_legs, tmp_path, no_broadcast):
    def leg(i):
        hour = None if i % 4 == 0 else f"01/10/2025 {i % 5:02d}:00:00"
        return {"warpId": None if i % 7 == 0 else f"S-{i % 40}", "loadId": f"l{i % 6}" if i % 9 else None, "carrierName": "c",
                "pickLocationName": f"p{i % 3}", "dropLocationName": f"d{i % 2}", "pickTimeArrived": hour, "dropTimeArrived": hour}

    legs = make_legs(*map(leg, range(90))).select(
        "warpId", "loadId", "carrierName", "pickLocationName", "dropLocationName", "pick_arrived_ts", "drop_arrived_ts"
    )

    def first(rows_in, side):
        best = {}
        for r in rows_in:
            at = r[f"{side}_arrived_ts"]
            parts = (r.loadId, r.carrierName, r[f"{side}LocationName"], at and at.date())
            key = None if None in parts else parts
            row = ((at is not None, at), (r.warpId is not None, r.warpId))
            best[key] = min(best.get(key, row), row, key=lambda x: (x[0][0], str(x[0][1]), x[1][0], str(x[1][1])))
        return [
            r.warpId is not None
            and best[None if None in (p := (r.loadId, r.carrierName, r[f"{side}LocationName"], (at := r[f"{side}_arrived_ts"]) and at.date())) else p]
            == ((at is not None, at), (True, r.warpId))
            for r in rows_in
        ]

    found = legs.collect()
    want = [(*r, a, b) for r, a, b in zip(found, first(found, "pick"), first(found, "drop"), strict=True)]
    assert any(r[-2] for r in want) and any(r[-1] for r in want)
    for flagged in (flag_dedup(legs), flag_dedup(legs, str(tmp_path / "w"))):
        assert sorted(map(str, map(tuple, flagged.collect()))) == sorted(map(str, want))
    once = legs.localCheckpoint()
    plan = plans.text(flag_dedup(once))
    assert plan.count("Exchange hashpartitioning(coalesce(warpId") == 1


def test_reports_of_any_length_are_numbered(spark, tmp_path):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 90) END AS k", "id", "1 AS row_")
    order = (F.asc("k"), F.desc("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shown = number_report(df.repartition(7), str(tmp_path / "n"), *order)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(df.collect(), key=lambda r: (r.k is not None, r.k or "", -r.id))
    assert [(r.k, r.id) for r in sorted(shown.collect(), key=lambda r: r.row)] == [(r.k, r.id) for r in want]
    assert sorted(r.row for r in shown.select("row").collect()) == list(range(1, 5001))
    assert spark.read.parquet(str(tmp_path / "n")).select("_part").distinct().count() > 1
    assert number_report(df.limit(0), str(tmp_path / "e"), *order).count() == 0


def test_lanes_between_addresses(make_legs):
    legs = make_legs({"revenueAllocationNumber": 5, "shipmentType": S.FTL}, {"revenueAllocationNumber": 7, "shipmentType": S.FTL})
    legs = legs.withColumns({"pickAddress": F.lit("1 A St"), "dropAddress": F.when(F.col("warpId") == "S-1", "2 B St")})
    found = lanes.profit_by_lane(legs, "2025-01-01", "2025-12-31", level="address").collect()
    assert [(r.lane, r.start_address, r.total_revenue) for r in found] == [("1 A St → 2 B St", "1 A St", 5)]
    assert lanes.profit_by_lane(legs, "2025-01-01", "2025-12-31", lanes=["x"], level="address").count() == 0
    with pytest.raises(ValueError, match="level"):
        lanes.profit_by_lane(legs, "2025-01-01", "2025-12-31", level="street")
