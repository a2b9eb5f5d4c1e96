from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with columns whose names operators use themselves."""

    def build(*rows: tuple):
        return spark.createDataFrame(
            [(i, t, "x", 7) for i, t in rows], "doc_id long, text string, node string, n int"
        )

    return build


@pytest.fixture
def words():
    """Invented prose of n words."""

    def build(n: int, seed: int, vocabulary: int = 2_000) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return build


@pytest.fixture
def sf_small():
    return "/root/testdata/sf0.001"
