"""Partials by day: exact distinct orders and sketched quantiles at every grain."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import plans
from checks import Tables
from lanewise.operators.rollups import SKETCH_ERROR, distinct_orders, order_number, order_partials, quantile_partials, sketched_quantiles
from lanewise.operators.stats import quantile_name
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
START = {
    "day": lambda d: d,
    "week": lambda d: d - dt.timedelta(days=d.weekday()),
    "month": lambda d: d.replace(day=1),
    "quarter": lambda d: d.replace(month=(d.month - 1) // 3 * 3 + 1, day=1),
}


def test_order_numbers_are_each_codes_own(spark):
    codes = ["P-1", "P-01", "P-00001-2501", "P-12501", "P-000012501", "P-0", "P-999999999999", "P-1000000000000", "X", "", None, "P-1\n", "p-1", "P-1-2501"]
    found = [r.n for r in spark.createDataFrame([(c,) for c in codes], "code string").select(order_number(F.col("code")).alias("n")).collect()]
    numbers = [n for n in found if n is not None]
    assert len(set(numbers)) == len(numbers)
    assert [c for c, n in zip(codes, found, strict=True) if n is not None] == ["P-1", "P-00001-2501", "P-12501", "P-0", "P-999999999999"]


def test_orders_count_once_in_every_period(spark):
    rng = random.Random(3)
    codes = [f"P-{n}" for n in (*range(40), 32_767, 32_768, 70_000)] + [f"P-{n:05d}-2501" for n in range(20)] + ["", "odd", "P-07", None]
    legs = [
        (rng.choice(["A", "B", None]), "P-5" if rng.random() < 0.4 else rng.choice(codes), rng.choice([None, *(dt.date(2025, 1, 1) + dt.timedelta(days=k) for k in range(120))]), 1)
        for _ in range(3_000)
    ]
    df = spark.createDataFrame(legs, "market string, orderCode string, when date, bucket int").withColumnRenamed("when", "on")
    partials = order_partials(df, ["market"], "on")
    for grain in (None, *START):
        for by in ([], ["market"]):
            want = defaultdict(set)
            for market, code, on, _ in legs:
                if code is not None:
                    key = (*([market] if by else []), *([on and START[grain](on)] if grain else []))
                    want[key].add(code)
            found = {tuple(r)[:-1]: r.order_count for r in distinct_orders(partials, by, grain).collect()}
            assert found == {k: len(v) for k, v in want.items()}
    assert distinct_orders(order_partials(df.where("false"), ["market"], "on")).first().order_count == 0


def test_sketches_keep_their_error_at_every_grain(spark):
    rng = random.Random(4)
    rows = [(rng.choice("AAAB"), dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(180)), rng.choice([rng.gauss(0, 50), 7.0])) for _ in range(40_000)]
    rows += [("A", dt.date(2025, 1, 1), None), ("C", dt.date(2025, 1, 1), None)]
    partials = quantile_partials(spark.createDataFrame(rows, "client string, on date, v double"), F.col("v"), ["client"], "on")
    for grain in (None, "week", "month", "quarter"):
        want = defaultdict(list)
        for client, on, v in rows:
            if v is not None:
                want[(client, START[grain](on) if grain else None)].append(v)
        found = sketched_quantiles(partials, ["client"], grain, (0.1, 0.25, 0.5, 0.9)).collect()
        assert len(found) == len(want)
        for r in found:
            values = sorted(want[(r.client, r.period if grain else None)])
            assert (r.n, r.least, r.greatest) == (len(values), values[0], values[-1])
            for p in (0.1, 0.25, 0.5, 0.9):
                q = r[quantile_name(p)]
                below, upto = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
                assert below - SKETCH_ERROR - 1 / len(values) <= p <= upto + SKETCH_ERROR + 1 / len(values)
    assert sketched_quantiles(partials.where("false")).count() == 0


def test_reports_read_partials_only(spark):
    tables = Tables.of(spark, SF)
    for df in (distinct_orders(tables.market_orders, grain="month"), sketched_quantiles(tables.profit_sketches, ["clientName"], "month")):
        df.collect()
        scanned = sum(plans.counted(df, "FileSourceScanExec", "numOutputRows"))
        assert 0 < scanned <= (tables.market_orders.count() if "order_count" in df.columns else tables.profit_sketches.count())
        assert "orderCode" not in plans.text(df)
