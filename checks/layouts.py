"""Known queries on tables laid out by order, and on tables kept up to date by change sets."""

from __future__ import annotations

from checks import aggregates, lanes, rows  # noqa: F401  (they register the known queries)
from checks.base import CASES, FIRST, LAST, another_way, case
from lanewise import schema as S
from lanewise.operators import orders as R
from lanewise.operators.rollups import distinct_orders, sketched_quantiles
from lanewise.plans.lanes import profit_by_lane

# ---- legs in buckets of their order, with the columns that the work reads ------------
_TYPE, _MAIN, _PLACES = "shipmentType", "mainShipment", ("pickLocationName", "dropLocationName")
_REVENUE, _COST = "revenueAllocationNumber", "costAllocationNumber"

another_way("a01_order_row_counts_in_buckets", "a01_order_row_counts")(lambda x: x.by_order(_MAIN).per_order(R.order_row_counts))
another_way("a01_order_row_counts_by_type_in_buckets", "a01_order_row_counts_by_type")(
    lambda x: x.by_order(_TYPE, _MAIN).per_order(lambda legs: R.order_row_counts(legs, by_type=True))
)
another_way("j02_legs_with_order_counts_in_buckets", "j02_legs_with_order_counts")(
    lambda x: x.by_order("warpId", _MAIN).with_order_counts(["warpId"])
)
another_way("r02_classify_order_in_buckets", "r02_classify_order")(
    lambda x: x.by_order(_TYPE, _MAIN, "loadId").per_order(R.classify_order)
)
another_way("r05_ltl_order_revenue_in_buckets", "r05_ltl_order_revenue")(
    lambda x: x.by_order(_TYPE, _MAIN, *_PLACES, _REVENUE).per_order(R.ltl_order_revenue)
)
another_way("r06_ltl_order_pieces_in_buckets", "r06_ltl_order_pieces")(
    lambda x: x.by_order(_TYPE, _MAIN, *_PLACES, _REVENUE, "pieces").per_order(R.ltl_order_pieces)
)
another_way("r07_order_cost_in_buckets", "r07_order_cost")(lambda x: x.by_order(_COST).per_order(R.order_cost))
another_way("r08_ftl_order_pnl_in_buckets", "r08_ftl_order_pnl")(
    lambda x: x.by_order(_TYPE, _MAIN, *_PLACES, _REVENUE, _COST, "pieces").per_order(R.ftl_order_pnl)
)
another_way("r09_ftl_market_split_in_buckets", "r09_ftl_market_split")(
    lambda x: x.by_order(_TYPE, _MAIN, *_PLACES, _REVENUE, _COST, "pieces").per_order(R.ftl_market_split)
)
another_way("k07_cross_validate_in_buckets", "k07_cross_validate")(
    lambda x: x.by_order(_REVENUE, _COST).cross_validate(x.code_orders)
)

# ---- change sets -----------------------------------------------------------------------
case(
    "s06_merged_change_sets",
    CASES["s01_legs"].columns,
    "SELECT * FROM legs QUALIFY count(*) OVER (PARTITION BY warpId) = 1",  # changes go by leg id, which has to be unique
)(lambda x: x.merged_legs.select(*S.LEGS.names))
_LANE_COLUMNS = (
    "warpId orderCode shipmentType mainShipment shipmentStatus startMarket endMarket pickLocationName dropLocationName"
    " pickWindowFrom dropWindowFrom dropTimeArrived dropDateArrived revenueAllocationNumber costAllocationNumber"
).split()
another_way("o11_profit_by_lane_after_changes", "o11_profit_by_lane_all")(
    lambda x: profit_by_lane(x.merged(*_LANE_COLUMNS), FIRST, LAST)
)

# ---- partials by day -------------------------------------------------------------------
_WITHIN = lanes.rows_sql(f"{lanes.DELIVERED} AND {lanes.SAME_MARKET}", "All")
case("o16_within_market_orders_once", "order_count i", f"SELECT count(DISTINCT orderCode) AS order_count FROM ({_WITHIN})")(
    lambda x: distinct_orders(x.market_orders)
)
for _grain in ("day", "week", "month", "quarter"):
    case(
        f"a03_orders_once_by_{_grain}",
        "period day, order_count i",
        f"SELECT date_trunc('{_grain}', delivered) AS period, count(DISTINCT orderCode) AS order_count FROM ({_WITHIN}) GROUP BY 1",
    )(lambda x, grain=_grain: distinct_orders(x.market_orders, grain=grain))
case(
    "a03_market_orders_by_quarter",
    "startMarket s, period day, order_count i",
    f"""SELECT startMarket, date_trunc('quarter', delivered) AS period, count(DISTINCT orderCode) AS order_count
        FROM ({_WITHIN}) GROUP BY 1, 2""",
)(lambda x: distinct_orders(x.market_orders, ["startMarket"], "quarter"))
# quantiles within the stated error are tested; what a sketch holds exactly has SQL
case(
    "o36_sketched_profit",
    "clientName s, period day, n i, least r, greatest r",
    """SELECT clientName, date_trunc('month', pf) AS period, count(*) AS n, min(rev - cost) AS least, max(rev - cost) AS greatest
       FROM t WHERE mainShipment = 'YES' AND rev - cost IS NOT NULL GROUP BY 1, 2""",
)(lambda x: sketched_quantiles(x.profit_sketches, ["clientName"], "month"))
