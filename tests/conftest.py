from __future__ import annotations

import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lanewise import local_session
from lanewise import schema as S
from lanewise.sources.staging import normalize_legs


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def make_legs(spark):
    """Typed legs from short dicts; unnamed columns take finished LTL defaults."""

    def build(*rows: dict, **common):
        defaults = {
            "orderCode": "P-00001-2501",
            "shipmentType": S.LTL,
            "mainShipment": "YES",
            "shipmentStatus": "Complete",
            "clientName": "Acme",
            "carrierName": "Carrier",
            "startMarket": "LAX",
            "endMarket": "EWR",
            "pickWindowFrom": "01/10/2025 08:00:00",
            "pickWindowTo": "01/10/2025 12:00:00",
            "dropWindowFrom": "01/12/2025 08:00:00",
            "dropWindowTo": "01/12/2025 12:00:00",
        }
        records = []
        for number, row in enumerate(rows, 1):
            values = defaults | {"warpId": f"S-{number}"} | common | row
            for money in ("revenueAllocationNumber", "costAllocationNumber"):
                if values.get(money) is not None:
                    values[money] = Decimal(str(values[money]))
            records.append(tuple(values.get(name) for name in S.LEGS.names))
        return normalize_legs(spark.createDataFrame(records, S.LEGS))

    return build
