"""Registered queries, each beside independent SQL for the same result."""

from checks import aggregates, board, carrier, client, lanes, layouts, questions, rows, scalars
from checks.base import CASES, Case, Tables

__all__ = [
    "CASES",
    "Case",
    "Tables",
    "aggregates",
    "board",
    "carrier",
    "client",
    "lanes",
    "layouts",
    "questions",
    "rows",
    "scalars",
]
