"""Executed plans and what their operators counted."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df: DataFrame) -> Iterator:
    """Operators of the plan as executed; subqueries are not among them."""

    def walk(node) -> Iterator:
        yield node
        kind = node.getClass().getSimpleName()
        below = []
        if kind == "AdaptiveSparkPlanExec":
            below = [node.executedPlan()]
        elif kind.endswith("QueryStageExec"):
            below = [node.plan()]
        else:
            children = node.children()
            below = [children.apply(i) for i in range(children.size())]
        for child in below:
            yield from walk(child)

    yield from walk(df._jdf.queryExecution().executedPlan())


def counted(df: DataFrame, kind: str, metric: str) -> list[int]:
    """The metric of every operator of a kind, after the plan has run."""
    found = [n for n in nodes(df) if kind in n.getClass().getSimpleName()]
    return [n.metrics().apply(metric).value() for n in found if n.metrics().contains(metric)]
