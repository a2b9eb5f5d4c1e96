"""Short rows for the worked examples."""

from __future__ import annotations


def money(revenue, cost, flag="NO", **rest) -> dict:
    return {"revenueAllocationNumber": revenue, "costAllocationNumber": cost, "mainShipment": flag, **rest}
