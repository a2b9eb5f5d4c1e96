"""Collocations against dicts, tries against sets, and the query against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry_point
from checks.compare import difference, duck
from lanewise.llm import collocations as C


def brute(rows, longest=3, min_count=10, share=50, top=2000):
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            f = counts.setdefault("und" if lang is None else lang, Counter())
            for k in range(1, longest + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        hidden = set()
        for p, a in found.items():
            for k in range(2, len(p)):
                hidden |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= share * f[p[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in hidden:
                cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def text(rng: random.Random, n: int, vocabulary: int) -> str:
    out = []
    for _ in range(n):
        word = f"w{int(rng.paretovariate(0.6)) % vocabulary}"
        out.append(rng.choice([word, word.upper(), word]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " é ", " "]))
    return "".join(out)


ROWS = [
    (None, None), ("en", ""), (None, "a b c " * 12), ("und", "a b c"), ("en", ".,;:!?\n" * 9), ("", "x y " * 11),
    ("en", "new york city " * 15 + ". new york " * 5), ("en", "aa aa " * 40), ("fr", "É é " * 12 + "\x1c \x1c " * 12),
]


@pytest.fixture
def frame(spark):
    def build(rows):
        return spark.createDataFrame([(lang, t, 1, 2, "h") for lang, t in rows], "lang string, text string, n int, w1 int, word string")

    return build


@pytest.mark.parametrize("rows_in_trie", [2_000_000, 40])
def test_against_dicts(frame, monkeypatch, rows_in_trie):
    monkeypatch.setattr(C, "TRIE_ROWS", rows_in_trie)
    monkeypatch.setattr(C, "_HELD", 500)
    rng = random.Random(5)
    rows = ROWS + [(rng.choice(["en", "en", "de"]), text(rng, 400, 60)) for _ in range(30)] + [("de", text(rng, 40_000, 300))]
    found = sorted(tuple(r) for r in C.collocations(frame(rows).repartition(4)).collect())
    assert found == brute(rows)
    assert len(found) > 300


@pytest.mark.parametrize("rows_in_trie", [2_000_000, 40])
def test_texts_are_read_once_a_level(frame, monkeypatch, rows_in_trie):
    """Words, pairs, and each level's longer phrases: passes do not grow with the number of candidates."""
    monkeypatch.setattr(C, "TRIE_ROWS", rows_in_trie)
    rng = random.Random(7)
    rows = [("en", text(rng, 4000, 200)) for _ in range(6)]
    docs, passes = frame(rows), []
    kind = type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: passes.append(self.columns == ["lang", "text"]) or plain(self, *a, **b))
    found = sorted(tuple(r) for r in C.collocations(docs, longest=4, min_count=3, top=None).collect())
    assert found == brute(rows, longest=4, min_count=3, top=10**9)
    assert sum(1 for r in found if r[2].count(" ") == 1) > 200
    assert sum(passes) == 4


def test_other_parameters(frame):
    rng = random.Random(6)
    rows = ROWS + [("en", text(rng, 300, 20)) for _ in range(8)]
    settings = {"longest": 4, "min_count": 3, "share": 80, "top": 50}
    assert sorted(tuple(r) for r in C.collocations(frame(rows), **settings).collect()) == brute(rows, **settings)
    settings = {"longest": 2, "min_count": 1, "top": None}
    assert sorted(tuple(r) for r in C.collocations(frame(rows), **settings).collect()) == brute(rows, longest=2, min_count=1, top=10**9)
    with pytest.raises(ValueError):
        C.collocations(frame(rows), longest=1)


def test_empty(frame):
    assert C.collocations(frame(ROWS).limit(0)).count() == 0
    assert C.collocations(frame([("en", "one two three"), (None, None)])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_double_arrays(seed):
    rng = np.random.default_rng(seed)
    depth, words = int(rng.integers(1, 4)), int(rng.integers(2, 3000))
    hashes = np.unique(rng.integers(-(2**62), 2**62, words))
    pick = (len(hashes) * rng.random((int(rng.integers(1, 20_000)), depth)) ** 3).astype(int)
    rows = np.unique(hashes[pick], axis=0)
    trie = C.DoubleArray.build(rows)
    known = {tuple(r) for r in rows.tolist()}
    line = hashes[(len(hashes) * rng.random(5000) ** 3).astype(int)]
    places, states = trie.advance(trie.codes(line))
    want = [i for i in range(len(line) - depth + 1) if tuple(line[i : i + depth].tolist()) in known]
    assert places.tolist() == want
    assert trie.rows(states).tolist() == [line[i : i + depth].tolist() for i in want]
    slots = np.flatnonzero(trie.check >= 0)
    parents = trie.check[slots]
    assert len(np.unique(np.stack([parents, slots - trie.base[parents]]), axis=1).T) == len(slots)


def test_bits(spark):
    hashes = C.hash_words("en", [f"w{i}".encode() for i in range(5000)], 0)
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(hashes, hashes[::-1])], "w long, v long")
    for names, keys in ((["w"], hashes), (["w", "v"], C._phrase_keys([hashes, hashes[::-1].copy()]))):
        bits = C.key_bits(rows, names)
        assert C._in_bits(bits, keys).all()
        assert int(np.unpackbits(bits).sum()) == len(np.unique(keys & (C.WORD_BITS - 1)))


def test_equal_hashes_take_another_seed(frame, monkeypatch):
    plain = C.hash_words

    def poor(lang, words, seed):
        return plain(lang, words, seed) if seed else np.array([len(w) for w in words], np.int64)

    rows = [("en", "ab cd ab cd ef " * 20)]
    monkeypatch.setattr(C, "hash_words", poor)
    assert sorted(tuple(r) for r in C.collocations(frame(rows)).collect()) == brute(rows)


def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    name = "op12_phrase_collocations"
    found = entry_point.queries()[name](spark, folder)
    assert difference(found, duck(folder), entry_point.oracle_sql()[name]) is None
