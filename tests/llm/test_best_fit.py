"""Packing against exhaustive search, and the query against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lanewise.llm.best_fit import Places, Tokens, best_fit, pack_documents, plan, reduce_by_dominance, sequences
from lanewise.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(items: tuple[int, ...], capacity: int) -> int:
    """Fewest sequences, by trying every place for every piece."""
    best = len(items)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                k = rooms.index(r)
                place(i + 1, [*rooms[:k], r - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def histogram(items, capacity):
    return np.bincount(np.array(items, int), minlength=capacity + 1)


@pytest.mark.parametrize("seed", range(150))
def test_fixed_sets_lose_nothing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 13, 20, 31])
    low = rng.choice([1, capacity // 5 + 1, capacity // 4 + 1, capacity // 3])
    items = tuple(sorted((rng.randrange(low, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True))
    left = histogram(items, capacity)
    fixed = reduce_by_dominance(left)
    rest = tuple(np.repeat(np.arange(capacity + 1), left)[::-1].tolist())
    assert sum(n for n, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)


def one_by_one(items, capacity):
    """Best fit, longest first, a piece at a time."""
    rooms: list[int] = []
    for w in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= w]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - w)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_and_places(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 50, 1024])
    items = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, capacity // 4) for _ in range(rng.randrange(1, 400))]
    patterns = best_fit(histogram(items, capacity))
    rooms = sorted(capacity - sum(w * k for w, k in parts) for n, parts in patterns for _ in range(n))
    assert rooms == one_by_one(items, capacity)
    patterns = plan(Counter(items), capacity)
    places = Places(patterns)
    inside: dict[int, list] = {}
    for length, n in Counter(items).items():
        for s, o in zip(*(x.tolist() for x in places.find(length, np.arange(n)))):
            inside.setdefault(s, []).append((o, length))
    assert sorted(inside) == list(range(places.sequences))
    for parts in inside.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert places.sequences <= len(one_by_one(items, capacity)) + 1


def test_a_piece_that_does_not_fit():
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


def test_tokens_are_those_of_the_library():
    texts = [
        "", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\n a\t b \x1c c", "it's  we'll x 　y", "x  y \u0085 z", "é😀 ñ" * 9,
        "<|endoftext|> a b", "a <|endoftext|>b", "don 't", "a" * 3000 + " b", "1 2  3   4", "\x00 \x00", " '  ' s", "".join(chr(i) + " " for i in range(1, 3000)),
    ]
    rng = random.Random(1)
    for letters in ("aZé", "ÿ×÷Àa", "ª²aµ½ºß"):
        alphabet = letters + " ',.1²·́ʼ\n\u00ad"
        texts += ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(2000)]
    alphabet = " \n\t  ab1.'é  \x1c\x85s"
    texts += ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(3000)]
    alphabet = "ab1.'é\x1c \n\u2028"
    texts += [" ".join("".join(rng.choice(alphabet) for _ in range(3)) + "x" for _ in range(20)) for _ in range(2000)]
    texts += ["\n".join("".join(rng.choice("a!1\x1c\x85 ") for _ in range(3)) for _ in range(20)) for _ in range(2000)]
    library, tokens = Tokenizer.from_file(PATH), Tokens(PATH)
    assert tokens.by_parts
    for text in texts:
        assert tokens.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    other = public_tokenizers.path("word_bpe_49k.json")
    assert not Tokens(other).by_parts
    assert Tokens(other).encode("A b c").tolist() == Tokenizer.from_file(other).encode("A b c", add_special_tokens=False).ids


def test_a_run_of_texts_is_encoded_together(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", "\n", "A", "\nA", " ", "  ", "a ", "b  ", " c", "é", "!", "Ã", "×!", "÷\n!", "x\u00a0 y", "a \u2003b", "я ж", "<|endoftext|> a"]
    texts += ["a" * 3000 + " b", " " + "word" * 40, "字 字", "　a 　b", "\U0001f600 a"]
    alphabet = " \n\tab1.'éÿ×÷Àя字\x1c\x85\u00a0\u2028"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(6000)]
    texts += ["\n".join("".join(rng.choice("aé!1 \x1c") for _ in range(3)) for _ in range(9)) for _ in range(1000)]
    library, tokens = Tokenizer.from_file(PATH), Tokens(PATH)
    want = [library.encode(text or "", add_special_tokens=False).ids for text in texts]
    for lo, hi in ((0, len(texts)), (0, 0), (0, 2), (1, 30), (30, len(texts))):
        assert [ids.tolist() for ids in tokens.encode_all(pa.array(texts, pa.string()).slice(lo, hi - lo))] == want[lo:hi]
    other = public_tokenizers.path("word_bpe_49k.json")
    assert Tokens(other).encode_all(pa.array(["A b c"]))[0].tolist() == Tokenizer.from_file(other).encode("A b c", add_special_tokens=False).ids
    # words that are new go to the merges in one call, and none a second time
    tokens, made = Tokens(PATH), []
    monkeypatch.setattr(tokens, "of_word", None)
    learn = tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda parts: (made.append(len(parts)), learn(parts)))
    run = pa.array([" several words", " words of several texts"] * 50)
    assert [len(ids) for ids in tokens.encode_all(run)] == [len(library.encode(text).ids) for text in run.to_pylist()]
    tokens.encode_all(run)
    assert made == [4, 0]


def check(rows, texts, capacity=1024):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    inside: dict[int, list] = {}
    for r in rows:
        inside.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in inside.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]]
        assert sum(n for _, n in parts) <= capacity
    return len(inside), -(-sum(n for parts in inside.values() for _, n in parts) // capacity)


def test_documents_and_edge_cases(docs, words):
    texts = [(None, None), (1, ""), (1, ""), (2, None), (3, words(20_000, 1)), (4, "w " * 5000), (5, "a" * 1023), (6, "<|endoftext|>")]
    texts += [(i, words(i % 40 * 8, i)) for i in range(10, 300)] + [(7, "the same text")] * 200
    frame = docs(*texts).withColumnRenamed("node", "length").withColumnRenamed("n", "part").repartition(5)
    packed = pack_documents(frame, PATH)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    rows = packed.collect()
    made, least = check(rows, texts)
    assert made <= least + 1
    whole = {r.sequence_id: r.ids for r in sequences(packed.sparkSession.createDataFrame(rows, packed.schema)).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert pack_documents(docs(*texts).limit(0), PATH).count() == 0
    small = pack_documents(docs(*texts[:60]), PATH, capacity=64, with_ids=False).collect()
    check(small, texts[:60], 64)


def test_query_on_the_sample(spark, sf_small):
    from lanewise.llm import queries

    rows = queries.QUERIES["op13_best_fit_packing"](spark, sf_small).collect()
    made, least = check(rows, [tuple(r) for r in table(spark, sf_small, "documents").select("doc_id", "text").collect()])
    assert made <= least + 2
