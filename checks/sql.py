"""Small SQL text helpers for the DuckDB side."""

from __future__ import annotations


def pct(n: str, d: str, places: int = 1) -> str:
    """100·n/d in exact integer arithmetic, ties away from zero, NULL for d = 0.

    ``n`` and ``d`` have at most four decimals.
    """
    scale = 100 * 10**places
    a = f"(abs(({n})::DECIMAL(24,4)) * 10000)::HUGEINT * {scale}"
    b = f"(abs(({d})::DECIMAL(24,4)) * 10000)::HUGEINT"
    return (
        f"CASE WHEN ({d}) <> 0 THEN (sign({n}) * sign({d}))::BIGINT"
        f" * ((2 * {a} + {b}) // (2 * {b}))::BIGINT / {10**places}.0::DOUBLE END"
    )


def _times_100(n: str, d: str) -> str:
    return f"(({n})::DOUBLE / nullif(({d})::DOUBLE, 0) * 100)"


def printed(n: str, d: str) -> str:
    """100·n/d in doubles, printed with one decimal and read back."""
    return f"format('{{:.1f}}', {_times_100(n, d)})::DOUBLE + 0.0"


def printed0(n: str, d: str) -> str:
    return f"coalesce({printed(n, d)}, 0)"


def table0(n: str, d: str) -> str:
    """100·n/d in doubles, ten times the value rounded half to even."""
    return f"coalesce(round_even({_times_100(n, d)} * 10, 0) / 10 + 0.0, 0)"


ON_TIME_PICK = "coalesce(pickTimeArrived, '') <> '' AND pa <= pt"
ON_TIME_DROP = "coalesce(dropTimeArrived, '') <> '' AND da <= dt"
DIFFERENT_PLACES = "(pickLocationName IS DISTINCT FROM dropLocationName OR pickLocationName IS NULL)"


def xdock(name: str) -> str:
    return f"regexp_matches({name}, '^(WTCH-|ACCL-|SB-)|Cross-Dock')"


ONE_XDOCK = (
    f"((coalesce({xdock('pickLocationName')}, false))::INTEGER"
    f" + (coalesce({xdock('dropLocationName')}, false))::INTEGER = 1)"
)


def market(name: str) -> str:
    return (
        f"CASE WHEN starts_with({name}, 'WTCH-') OR starts_with({name}, 'ACCL-') THEN substr({name}, 6, 3)"
        f" WHEN regexp_matches({name}, '^SB-(ATL|DC|DAL|SEA|LA|DEN|NYC|PHX|MIA)-') THEN"
        f" map(['ATL','DC','DAL','SEA','LA','DEN','NYC','PHX','MIA'],"
        f" ['ATL','DCA','DFW','SEA','LAX','DEN','EWR','PHX','MIA'])[regexp_extract({name}, '^SB-([A-Z]+)-', 1)]"
        f" WHEN regexp_matches({name}, 'GoBolt.*NYC.*Cross-Dock') THEN 'EWR'"
        f" WHEN regexp_matches({name}, 'Cross-Dock.*Chicago') THEN 'ORD' END"
    )


MARKET = f"coalesce({market('pickLocationName')}, {market('dropLocationName')})"


def quarter(year: int) -> str:
    return (
        f"CASE WHEN regexp_matches(pickWindowFrom, '^(0[1-9]|1[0-2])/.*/{year}')"
        " THEN 'Q' || ((substr(pickWindowFrom, 1, 2)::INTEGER + 2) // 3) ELSE 'Unknown' END"
    )


HEADERS = """
  SELECT * FROM t WHERE shipmentStatus = 'Complete' AND pf::DATE BETWEEN DATE '{first}' AND DATE '{last}'
    AND coalesce(orderCode, '') <> '' AND mainShipment = 'YES' AND {different}
"""


def headers(first: str, last: str) -> str:
    return HEADERS.format(first=first, last=last, different=DIFFERENT_PLACES)
