"""Periodic runs against a search of every start and period."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lanewise.llm.common import table
from lanewise.llm.periodic_runs import find_runs, periodic_runs


def brute(words: list, shortest: int = 24, periods: int = 3) -> list[tuple[int, int, int]]:
    """Every maximal stretch of smallest period q, found by looking at all periods."""
    runs = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            whole = words[i : i + length]
            smallest = all(whole[k:] != whole[: length - k] for k in range(1, q))
            if length >= max(shortest, periods * q) and smallest:
                runs.append((i, length, q))
            i = j
    return sorted(runs, key=lambda r: (r[0], r[2]))


def expected(doc_id: int | None, text: str | None, plant: bool) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    return (
        doc_id,
        len(runs),
        *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def key(row) -> str:
    return repr(tuple(row))


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_short_alphabets(seed):
    rng = random.Random(seed)
    words: list[int] = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(3)
        unit = [rng.randrange(1 + rng.randrange(3)) for _ in range(rng.randrange(1, 12))]
        if kind == 0:
            words += unit
        elif kind == 1:
            words += unit * rng.randrange(1, 9)
        else:
            inner = unit * rng.randrange(2, 5) + [rng.randrange(3)]
            words += inner * rng.randrange(2, 7)
    shortest = rng.choice([1, 3, 24])
    found = [tuple(r) for r in find_runs(np.array(words), len(words), shortest).tolist()]
    assert found == brute(words, shortest)


def test_less_than_three_periods_is_refused():
    with pytest.raises(ValueError):
        find_runs(np.arange(5), 5, periods=2)


def test_rows_and_edge_cases(docs, words):
    unit = words(50, 3)
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a " * 23), (5, "a " * 24), (6, "é\x1c b " * 40),
        (7, words(400, 1)), (8, f"{words(30, 2)} {unit} {unit} {unit} {unit[:100]}"), (None, "b c " * 30), (None, None),
        (5, "a " * 24), (9, f"{unit} {unit}"), (10, "x y x y z " * 20), (11, ("p " * 24 + "q ") * 6),
    ]
    rows += [(i, words(200 + i, i, 30)) for i in range(100, 160)]  # some of them get a repeated end
    for plant in (False, True):
        found = periodic_runs(docs(*rows).repartition(3), plant=plant).collect()
        assert sorted(key(r[:8]) for r in found) == sorted(key(expected(i, t, plant)) for i, t in rows)
    full = {r.doc_id: r for r in periodic_runs(docs(*rows)).collect()}
    assert full[5].collapsed == "a" and full[5].runs[0].asDict() == {"start": 0, "length": 24, "period": 1}
    assert full[4].collapsed == ("a " * 23).strip()
    assert full[10].collapsed == "x y x y z"
    assert sum(len(set(r.runs)) > 1 for r in full.values()) >= 1
    assert periodic_runs(docs(*rows).limit(0)).count() == 0


def test_a_very_long_text(docs, words):
    text = f"{words(60_000, 5)} {words(20_000, 6, 10**6) + ' '}" + (words(7_000, 7, 10**6) + " ") * 4 + "z " * 90_000
    row = periodic_runs(docs((1, text))).first()
    assert [(r.length, r.period) for r in row.runs] == [(28_000, 7_000), (90_000, 1)]
    assert len(row.collapsed.split()) == 60_000 + 20_000 + 7_000 + 1


def test_query_against_brute_force(spark, sf_small):
    from lanewise.llm import queries

    rows = table(spark, sf_small, "documents").select("doc_id", "text").collect()
    found = queries.QUERIES["op11_periodic_runs"](spark, sf_small).collect()
    assert sorted(key(r) for r in found) == sorted(key(expected(r.doc_id, r.text, True)) for r in rows)
    assert sum(r.n_runs > 0 for r in found) >= 5
