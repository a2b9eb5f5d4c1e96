"""Joins, decontamination, tokens, toxicity and scoring against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from lanewise.llm import kneser_ney, ngram_join, toxicity
from lanewise.llm.common import sliced_by_bytes, word_hashes
from lanewise.llm.decontamination import contained_items, drop_contaminated
from lanewise.llm.kneser_ney import score_texts
from lanewise.llm.ngram_join import Bounds, ngram_components, one_of_each, signatures
from lanewise.llm.sentencepiece_bpe import Encoder, encode_texts

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_shingles(text: str | None, size: int) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def plain_components(rows: list[tuple], size: int, share: int) -> dict:
    sets: dict = defaultdict(list)
    for i, t in rows:
        sets[i].append(plain_shingles(t, size))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in sets}


def altered(text: str, edits: int, seed: int) -> str:
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("size", "share"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(docs, words, size, share):
    rows, k = [], 0
    for base in range(12):
        text = words(random.Random(base).choice([3, 6, 9, 14, 40, 120, 400]), base)
        for copy in range(9):
            rows.append((k, altered(text, copy % 5, 100 * base + copy)))
            k += 1
    passage = words(60, 99)
    rows += [(k + i, f"{words(90, 500 + i)} {passage}") for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, rows[0][1]), (905, rows[0][1])]
    rows += [(906, words(30_000, 5)), (907, words(30_000, 5) + " end")]
    found = ngram_components(docs(*rows, (None, rows[0][1])), size, share).collect()
    assert len(found) == len(rows) + 1
    want = plain_components(rows, size, share)
    texts = dict(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(plain_shingles(texts[r.doc_id], size)))


def test_many_near_copies_share_one_class(docs, words):
    text = words(150, 1)
    rows = [(i, altered(text, i % 4, i)) for i in range(150)]
    want = plain_components(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in ngram_components(docs(*rows), 4, 85).collect()} == want


def test_large_groups_are_multiplied_by_tiles(docs, words, monkeypatch):
    """Near copies of one text: most are linked with none, some with one another; tiles of a few rows."""
    monkeypatch.setattr(ngram_join, "_TILE", 8)
    base = words(120, 1)
    far = [(i, altered(base, 4, i)) for i in range(60)]
    near = [(100 + i, altered(far[7 * i][1], 1, i)) for i in range(8)]
    rows = far + near + [(200, base), (201, base), (202, ""), (203, None)]
    found = {r.doc_id: r.component_id for r in ngram_components(docs(*rows), 5, 80).collect()}
    assert found == plain_components(rows, 5, 80)
    assert 10 < len(set(found.values())) < 70


def test_tile_product_equals_counting(monkeypatch):
    monkeypatch.setattr(ngram_join, "_COLUMNS", 16)
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 40, 100, False).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 92, False), rng.choice(1 << 40, k % 9).astype(np.uint64)))) for k in range(40)]
    sets += [np.empty(0, np.uint64), np.array([5], np.uint64), np.array([5], np.uint64)]
    wanted = ~np.eye(len(sets), dtype=bool)
    found = {tuple(p) for p in ngram_join.tile_product(sets, sets, wanted, 85).tolist()}
    plain = {
        (i, j)
        for i, x in enumerate(sets)
        for j, y in enumerate(sets)
        if i != j and len(x) and 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) and len(y)
    }
    assert found == plain and found


def test_linked_sets_always_show_a_common_signature():
    rng = np.random.default_rng(0)
    for share in (80, 85):
        bounds = Bounds(share)
        for _ in range(1_500):
            n = int(rng.integers(1, 300))
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = int(rng.integers(0, len(x) // 5 + 1))
            y = np.unique(np.concatenate((x[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64))))
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= share * (len(x) + len(y) - both):
                (a, spare_a), (b, spare_b) = signatures(x, bounds), signatures(y, bounds)
                assert np.intersect1d(a, b).size > max(spare_a, spare_b)


def test_folded_sets_lose_no_link_and_drop_most_others():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 1_500, np.uint64)
    sets = [np.unique(np.concatenate((base[: 1_500 - k * 20], rng.integers(0, 1 << 64, k * 20, np.uint64)))) for k in range(40)]
    sets += [np.unique(rng.choice(base, n, False)) for n in (0, 1, 3, 40, 64, 65, 700, 1_100, 1_365, 1_366, 1_450)]
    sizes = np.array([len(h) for h in sets])
    wanted = np.triu(np.ones((len(sets), len(sets)), bool), 1)
    true = {tuple(p) for p in ngram_join.tile_product(sets, sets, wanted, 80).tolist()}
    rows = [ngram_join.folded(h) for h in sets]
    found = {tuple(p) for p in ngram_join.may_be_linked(rows, rows, sizes, sizes, wanted, 80).tolist()}
    assert true and true <= found and len(found) < len(true) + 0.1 * wanted.sum()
    assert sum(b.nbytes for b in rows) <= sum(h.nbytes for h in sets) / 10 + 8 * len(sets)


@pytest.mark.parametrize("edits", [2, 4, 5])
def test_groups_of_near_copies_at_the_bound(docs, words, edits):
    """Pairs that folded columns take for links, among links: all links are found and no other."""
    text = words(220, 9, 50_000)
    rows = [(i, altered(text, edits, 1_000 * edits + i)) for i in range(60)]
    found = {r.doc_id: r.component_id for r in ngram_components(docs(*rows), 5, 80).collect()}
    assert found == plain_components(rows, 5, 80)


def test_tiles_get_folded_sets_and_no_texts(docs, words, spark, monkeypatch):
    """Rows of a large group without links reach the tiles without their texts."""
    seen = {}
    keep = ngram_join.staged

    def staged(df, name):
        seen.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(ngram_join, "staged", staged)
    passage = words(60, 1, 50_000)
    rows = [(i, f"{passage} {words(40, 100 + i, 50_000)}") for i in range(40)]
    found = {r.doc_id: r.component_id for r in ngram_components(docs(*rows), 5, 80).collect()}
    assert found == plain_components(rows, 5, 80)
    assert "tile-links" not in seen and "bits" in seen["likely"][0] and "text" not in seen["likely"][0]


def test_one_of_each_keeps_clean_rows(docs, words):
    text = words(80, 1)
    rows = [(5, text), (3, text), (7, words(80, 2)), (7, words(80, 2)), (8, None), (None, text), (None, "a")]
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in one_of_each(docs(*rows)).collect())
    assert kept == [(False, 0), (False, 0), (True, 3), (True, 7), (True, 8)]
    assert one_of_each(docs()).columns == ["doc_id", "text", "node", "n"]


def test_no_documents(docs, spark):
    empty = docs()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert ngram_components(empty).count() == 0
    assert contained_items(empty, items).count() == 0
    assert encode_texts(empty, corpus_pipeline.piece_model()).count() == 0
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert score_texts(empty).count() == 0


def test_contained_items(docs, spark, words):
    bench = [(i, words(n, 40 + i)) for i, n in enumerate((3, 5, 9, 30, 60, 200))] + [(6, None), (7, ""), (8, words(30, 43))]
    items = spark.createDataFrame([(i, t, "z") for i, t in bench], "item_id long, text string, h string")
    rows = [(i, words(3_000, i)) for i in range(6)]
    rows += [(10 + i, f"{words(500, 70 + i)} {t} {words(500, 90 + i)}") for i, t in bench if t]
    rows += [(20 + i, f"{words(300, 170 + i)} {altered(t, 1, i)}") for i, t in bench if t]
    rows += [(30, bench[0][1]), (31, None), (32, ""), (33, rows[7][1]), (33, rows[7][1])]
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contained_items(docs(*rows), items).collect()}
    want = set()
    for d, t in rows:
        for i, b in bench:
            x, y = plain_shingles(t, 5), plain_shingles(b, 5)
            if y and 100 * len(x & y) >= 80 * len(y):
                want.add((d, i, len(x & y), len(y)))
    assert found == want
    kept = {r.doc_id for r in drop_contaminated(docs(*rows, (None, "a b")), items).collect()}
    assert kept == {d for d, _ in rows} - {d for d, *_ in want} | {None}


def test_encoding_equals_the_library(docs):
    path = corpus_pipeline.piece_model()
    library, own = SentencePieceProcessor(model_file=path), Encoder(path)
    rng = random.Random(3)
    letters = ["ab th eéß😀▁\t\n  \u0000的一", "aeth in ", "    a", "0123.,-"]
    texts = ["".join(rng.choice(letters[k % 4]) for _ in range(rng.randrange(80))) for k in range(6_000)]
    texts += [" " * k + tail for k in range(40) for tail in ("", "a", "the")] + ["a" * 20_000, "xyz " * 20_000]
    for text in texts:
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert own.decode(ids) == library.decode(ids.tolist())
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "é😀"), (1, "Hello  world\n")]
    found = encode_texts(docs(*rows), path).collect()
    assert len(found) == 5
    for r, (i, t) in zip(sorted(found, key=lambda r: (r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda x: (x[0] or 0)), strict=True):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (r.doc_id, r.ids, r.n_tokens) == (i, ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.decoded == (t or "")


def test_backtracking_undoes_greedy_matches():
    own = Encoder(corpus_pipeline.piece_model())
    rng = random.Random(5)
    for _ in range(4_000):
        text = "".join(rng.choice("etaoinsrhld") for _ in range(rng.randrange(1, 25)))
        assert own.backtrack(text) == own.merged(text)


def test_toxicity_on_held_out_rows(spark, words):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        text = words(120, i)
        if i % 5 == 0:
            w = text.split()
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["vilely", "scumbag", "rotten"]) + rng.choice(["", "s", "est"])
            text = " ".join(w)
        rows.append((i, text, int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t, _ in rows] + [(None, None, "en", 1), (5_000, "", "en", 1)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, text int")
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(found) == 902
    out = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert len(out) > 200
    assert sum(p == y for p, y in out) / len(out) > 0.97
    assert found[None].score == found[5_000].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, r in found.items() if not r.predicted}


def test_one_class_of_labels(docs, spark):
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs((1, "a"), (2, "b"), (4, None)), labels).collect()
    assert {r.predicted for r in found} == {0}
    assert len({r.score for r in found}) == 1


def plain_model(texts: list[list[str]]):
    """Interpolated modified Kneser-Ney over bigrams, with dicts."""
    uni, bi = Counter(), Counter()
    for t in texts:
        uni.update(t)
        bi.update(zip(["<s>", *t[:-1]], t, strict=True))
    before, after, uses = Counter(v for _, v in bi), defaultdict(Counter), Counter()
    for (u, _), c in bi.items():
        after[u][min(c, 3)] += 1
        uses[u] += c
    level = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    d, e = (kneser_ney.discounts(level(x.values())) for x in (bi, before))
    rest = sum(e[min(k, 3) - 1] for k in before.values()) / len(bi)

    def score(text: list[str]) -> float:
        total = 0.0
        for u, v in zip(["<s>", *text[:-1]], text, strict=True):
            k, c = before[v], bi[u, v]
            p = (max(k - e[min(k, 3) - 1], 0) / len(bi) if k else 0) + rest / (len(uni) + 1)
            if uses[u]:
                p = (max(c - d[min(c, 3) - 1], 0) if c else 0) / uses[u] + sum(d[j - 1] * m for j, m in after[u].items()) / uses[u] * p
            total += math.log10(p)
        return total

    return uni, score


def test_scores_equal_a_model_of_dicts(docs, words, monkeypatch):
    monkeypatch.setattr(kneser_ney, "_CHUNK", 700)
    monkeypatch.setattr(kneser_ney, "_LOOKUP", 500)
    monkeypatch.setattr(kneser_ney, "_TEXT_BYTES", 2_000)
    rows = [(i, words(60 + i, i, 80) + " the the of the" * (i % 9) + " RARE" * (i % 2)) for i in range(160)]
    rows += [(500, None), (501, ""), (502, "unheard of words the"), (503, "the " * 900), (503, "the " * 900), (None, "the of")]
    found = score_texts(docs(*rows)).collect()
    assert len(found) == len(rows)
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)), "\n"]
    import zlib

    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows}
    uni, score = plain_model([cut(t) for i, t in rows if not held[i]])
    n, v = sum(uni.values()), len(uni)
    text_of = dict(rows)
    for r in found:
        t = cut(text_of[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(uni[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        assert r.score == pytest.approx(score(t), rel=1e-9)
    outside = [r for r in found if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in outside) > sum(r.base_score for r in outside)


def plain_trigrams(texts: list[list[str]]):
    """Interpolated modified Kneser-Ney over trigrams, with dicts; pairs at the start of a text keep their counts."""
    tri, opening = Counter(), Counter(t[0] for t in texts)
    for t in texts:
        tri.update(zip(["<s>", *t[:-2]], t[:-1], t[1:], strict=False))  # a text of one token has none
    bi = Counter((v, w) for _, v, w in tri)
    bi.update({("<s>", w): c for w, c in opening.items()})
    before, v = Counter(w for _, w in bi), len({w for t in texts for w in t})
    level = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
    d3, d2, d1 = (kneser_ney.discounts(level(x.values())) for x in (tri, bi, before))
    uses, left = Counter(), Counter()
    for counts, d in ((tri, d3), (bi, d2)):
        for (*context, _), c in counts.items():
            uses[tuple(context)] += c
            left[tuple(context)] += d[min(c, 3) - 1]
    less = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    rest = sum(d1[min(k, 3) - 1] for k in before.values()) / len(bi)

    def score(text: list[str]) -> float:
        total = 0.0
        for i, w in enumerate(text):
            p = less(before[w], d1) / len(bi) + rest / (v + 1)
            past = ["<s>", *text[:i]]
            for context, counts, d in ((tuple(past[-1:]), bi, d2), (tuple(past[-2:]), tri, d3)):
                if uses[context] and (counts is bi or i):
                    p = less(counts[*context, w], d) / uses[context] + left[context] / uses[context] * p
            total += math.log10(p)
        return total

    return score


def test_order_3_equals_a_model_of_dicts(docs, words, monkeypatch):
    monkeypatch.setattr(kneser_ney, "_CHUNK", 700)
    monkeypatch.setattr(kneser_ney, "_LOOKUP", 500)
    monkeypatch.setattr(kneser_ney, "_TEXT_BYTES", 2_000)
    rows = [(i, words(60 + i, i, 40) + " the the of the" * (i % 9) + " RARE" * (i % 2)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "unheard of words the"), (503, "the " * 900), (503, "the " * 900), (None, "the of")]
    found = score_texts(docs(*rows), order=3).collect()
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)), "\n"]
    score = plain_trigrams([cut(t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2])
    text_of = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        assert r.score == pytest.approx(score(cut(text_of[r.doc_id])), rel=1e-9)


def test_words_hashed_in_batches_are_the_words_of_each_text():
    random = np.random.default_rng(5)
    texts = [None, b"", b" ", b" A b\x0b\x0cC  d ", "É a\u0085b\x1cc".encode(), b"x" * 100_000, b"y" * 64, b"y" * 65, b" a b" * 50_000]
    texts += [random.choice(np.frombuffer(b"aB \t\n\r\x0b\x0c\x1c\xc3\x00", np.uint8), n).tobytes() for n in random.integers(0, 60, 1_000)]
    hashes, lengths = word_hashes(pa.array([b"before", *texts], pa.binary()).slice(1), b"\n")
    words = [[*(t or b"").lower().split(), b"\n"] for t in texts]
    assert lengths.tolist() == [len(w) for w in words]
    known: dict[bytes, int] = {}
    for word, value in zip([w for of_text in words for w in of_text], hashes.tolist(), strict=True):
        assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    assert len(word_hashes(pa.array([], pa.binary()), b"\n")[0]) == 0
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["row", "text"])
    for size in (1, 50, 1 << 30):
        assert [r for part in sliced_by_bytes(iter([batch]), 1, size) for r in part.column(0).to_pylist()] == list(range(len(texts)))
