"""Run a case on both engines and compare rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

from checks.base import CASES, Tables

STAR_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in STAR_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(rows: Iterable) -> Counter:
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return v

    return Counter(tuple(value(v) for v in row) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when the frame and the SQL give the same rows, else what differs."""
    columns = sorted(df.columns)
    ours = df.select(*(f"`{c}`" for c in columns)).collect()
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = [tuple(row[i] for i in at) for row in relation.fetchall()]
    a, b = _canonical(ours), _canonical(theirs)
    if a == b:
        return None
    return (
        f"{len(ours)} rows against {len(theirs)}; only ours {list((a - b).items())[:3]}; "
        f"only SQL {list((b - a).items())[:3]}; columns {columns}"
    )


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    case = CASES[name]
    return difference(case.build(Tables.of(spark, sf_dir)), con, case.sql)
