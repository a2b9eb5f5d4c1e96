"""Phrases whose words occur together more often than their parts suggest.

Level by level, as in Apriori: a phrase of k words can only be frequent if both
its parts of k - 1 words are. Candidates of two words are neighbours that pass
the bits of the frequent words; candidates of more words are places where a
frequent phrase is followed, one word on, by one that passes the bits of the
frequent phrases. Each stretch of text says what it
saw and how often, and what adds up to ``min_count`` stays: no frequent phrase
is missed, and every sum is the phrase's count.

Up to ``TRIE_ROWS`` candidates of a level are counted by a double-array trie,
which is broadcast. Workers turn texts into arrays of word codes and take the
states of all places forward together, one word a level: ``next = base[state] +
code`` holds where ``check[next] == state``. Accepting states are counted by
bincount, each task sends its sums, and Spark adds them. More candidates, and
those of the last level, keep the sums they were found with, and the next level's
are found by the bits of both their parts. So a level reads the texts once at
most, however many candidates it has.

Words are 64-bit hashes of language and word. The hashes of frequent words are
checked against those of all words, and another seed is taken if two agree, so
counts are exact.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import BROADCAST_ROWS, mix, shuffles_dropped, staged

#: Candidates in one broadcast trie; levels with more go by the sums of their candidates.
TRIE_ROWS = 1_200_000
#: Bits that say which words, or phrases, may be frequent: a power of two, however many there are.
WORD_BITS = 1 << 27

_BREAK = b"\xff"  # stands in no UTF-8 text
_GROUP_BYTES = 2_000_000
_HELD = 1_000_000  # phrases a task holds before it sums them up
_KNOWN = 300_000
_BLOCK, _TRIES = 4096, 12

_TABLE = bytearray(range(256))
_TABLE[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
_TABLE[ord("\t")] = ord(" ")
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = _BREAK[0]
_TABLE = bytes(_TABLE)


def cut_words(texts: list[bytes]) -> list[bytes]:
    """Words of several texts, with a mark where a piece or a text ends."""
    return _BREAK.join(texts).translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of some texts of one language at a time."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        size: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text := text.as_py():
                held.setdefault(lang, []).append(text)
                size[lang] += len(text)
                if size[lang] > _GROUP_BYTES:
                    yield lang, cut_words(held.pop(lang))
                    del size[lang]
        for lang, texts in held.items():
            yield lang, cut_words(texts)


class Symbols:
    """Numbers of words, remembered by language."""

    def __init__(self, make: Callable[[np.ndarray], np.ndarray], seed: int, nothing: int):
        self.make, self.seed, self.nothing = make, seed, nothing
        self.known: dict[str, dict[bytes, int]] = {}

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        if sum(map(len, self.known.values())) > _KNOWN:
            self.known.clear()
        known = self.known.setdefault(lang, {})
        if new := [w for w in set(words) if w not in known]:
            known.update(zip(new, self.make(hash_words(lang, new, self.seed)).tolist()))
        known[_BREAK] = self.nothing
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def hash_words(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """Signed 64-bit hashes, none of them 0."""
    own, digest = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, own) or 1 for w in words), np.uint64, len(words)).view(np.int64)


# ---- the trie -----------------------------------------------------------------
class DoubleArray:
    """Trie of rows of k words: a state's next by a code is ``base[state] + code`` if ``check`` there is the state.

    ``alphabet`` has the words' hashes in order, ``place`` the code of each.
    """

    def __init__(self, alphabet: np.ndarray, place: np.ndarray, base: np.ndarray, check: np.ndarray, depth: int):
        self.alphabet, self.place, self.base, self.check, self.depth = alphabet, place, base, check, depth

    @classmethod
    def build(cls, rows: np.ndarray) -> DoubleArray:
        """From distinct rows of hashes, at least one."""
        alphabet, codes, often = np.unique(rows, return_inverse=True, return_counts=True)
        place = np.empty(len(alphabet), np.int64)  # frequent words get small codes, so that children lie close together
        place[np.argsort(-often, kind="stable")] = np.arange(len(alphabet))
        codes = place[codes.reshape(rows.shape)]
        codes = codes[np.lexsort(codes.T[::-1])]
        trie = cls(alphabet, place.astype(np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), rows.shape[1])
        trie._grow(2 * len(alphabet) + rows.size // 2 + _BLOCK)
        trie.check[0], trie.base[0] = -2, 1  # the root
        state = np.zeros(len(codes), np.int64)
        for level in range(trie.depth):
            column = codes[:, level]
            first = np.concatenate(([True], (state[1:] != state[:-1]) | (column[1:] != column[:-1])))
            parents, children = state[first], column[first]
            if level:
                trie._place(parents, children)
            slots = trie.base[parents] + children
            trie.check[slots] = parents
            state = slots[np.cumsum(first) - 1]
        used = int(np.flatnonzero(trie.check != -1)[-1]) + 1
        end = max(used, int(trie.base.max()) + len(alphabet)) + 1  # no next state lies beyond
        trie._grow(end)
        trie.base, trie.check = trie.base[:end].copy(), trie.check[:end].copy()
        return trie

    def _grow(self, size: int) -> None:
        if (more := size - len(self.check)) > 0:
            self.base = np.concatenate((self.base, np.zeros(more, np.int32)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int32)))

    def _place(self, parents: np.ndarray, children: np.ndarray) -> None:
        """A base for every parent, so that all its children's slots are free: those with most children first."""
        first = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        count = np.diff(np.append(first, len(parents)))
        end = int(np.flatnonzero(self.check != -1)[-1]) + 1
        rng = np.random.default_rng(0)
        for i in np.argsort(-count, kind="stable")[: int((count > 1).sum())].tolist():
            codes = children[first[i] : first[i] + count[i]]
            base = self._free_base(codes, end, rng)
            slots = base + codes
            self.base[parents[first[i]]] = base
            self.check[slots] = parents[first[i]]
            end = max(end, int(slots[-1]) + 1)
        single = first[count == 1]
        low = len(self.alphabet) + 1  # any code's base there is positive
        free = np.flatnonzero(self.check[low:] == -1)[: len(single)] + low
        if len(free) < len(single):
            have = len(self.check)
            self._grow(have + len(single) - len(free))
            free = np.concatenate((free, np.arange(have, len(self.check))))
        self.base[parents[single]] = free - children[single]
        self.check[free] = parents[single]

    def _free_base(self, codes: np.ndarray, end: int, rng: np.random.Generator) -> int:
        """A base whose slots are free: blocks of bases are tried, from the last ones in use and anywhere before."""
        offsets = codes.tolist()
        last = max(1, end - offsets[-1])
        for start in [*rng.integers(1, last + 1, _TRIES).tolist(), last]:
            self._grow(start + _BLOCK + offsets[-1] + 1)
            taken = np.zeros(_BLOCK, bool)
            for c in offsets:
                taken |= self.check[start + c : start + c + _BLOCK] != -1
                if taken.all():
                    break
            else:
                return start + int(np.argmin(taken))
        base = max(end - offsets[0], 1)  # beyond all slots in use
        self._grow(base + offsets[-1] + 1)
        return base

    def advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, states) of the places of ``codes`` (-1: no word of the trie) where a row starts."""
        codes = np.concatenate((codes, np.full(self.depth, -1, np.int64)))
        places = np.flatnonzero(codes >= 0)
        states = np.zeros(len(places), np.int64)
        for level in range(self.depth):
            code = codes[places + level]
            after = self.base[states] + code
            good = (code >= 0) & (self.check[after] == states)
            places, states = places[good], after[good]
        return places, states

    def rows(self, states: np.ndarray) -> np.ndarray:
        """The words' hashes on the way to the states."""
        out = np.zeros((len(states), self.depth), np.int64)
        word = np.empty_like(self.place)
        word[self.place] = np.arange(len(word))
        for level in range(self.depth - 1, -1, -1):
            parents = self.check[states]
            out[:, level] = self.alphabet[word[states - self.base[parents]]]
            states = parents
        return out

    def hashes(self) -> np.ndarray:
        """The hash of the word of each code."""
        out = np.empty_like(self.alphabet)
        out[self.place] = self.alphabet
        return out

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, hashes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == hashes, self.place[at], -1)


# ---- the jobs -----------------------------------------------------------------
def _names(k: int) -> list[str]:
    return [f"w{i + 1}" for i in range(k)]


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows once each with how often they came; a row may be split over several."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(31) + c.view(np.uint64))
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(first)
    return [*(c[at] for c in columns), np.diff(np.append(at, len(order)))]


class _Held:
    """Phrases seen, summed up when there are many."""

    def __init__(self, width: int):
        self.width, self.parts, self.size = width, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > _HELD:
            yield self.rest()

    def rest(self) -> list[np.ndarray]:
        columns = [np.concatenate([p[i] for p in self.parts] or [np.zeros(0, np.int64)]) for i in range(self.width)]
        self.parts, self.size = [], 0
        return _summed(columns)


def _batches(columns: list[np.ndarray | None], names: list[str], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of long columns; None is a column of nulls."""
    n = max(len(c) for c in columns if c is not None)
    for at in range(0, n, rows):
        size = min(rows, n - at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(size, pa.int64()) if c is None else pa.array(c[at : at + rows], pa.int64()) for c in columns], names
        )


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """lang, word, w (its hash), n of all words of ``rows`` (lang, text in bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, count in counts.items():
                del count[_BREAK]
                words, n = list(count), list(count.values())
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array(part, pa.string()), pa.array(hash_words(lang, part, seed)), pa.array(n[at : at + 50_000])],
                        ["lang", "word", "w", "n"],
                    )
            counts.clear()

        for lang, words in _groups(batches):
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > _KNOWN:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, word string, w long, n long").groupBy("lang", "word", "w").agg(F.sum("n").alias("n"))


_TURN, _REST = 17, 47  # a turn of 64 bits


def _phrase_key(columns: list[Column]) -> Column:
    """One number for the hashes of a phrase's words, the same as ``_phrase_keys``."""
    key = columns[0]
    for c in columns[1:]:
        key = F.shiftleft(key, _TURN).bitwiseOR(F.shiftrightunsigned(key, _REST)).bitwiseXOR(c)
    return key


def _phrase_keys(columns: list[np.ndarray]) -> np.ndarray:
    key = columns[0].view(np.uint64)
    for c in columns[1:]:
        key = (key << np.uint64(_TURN) | key >> np.uint64(_REST)) ^ c.view(np.uint64)
    return key.view(np.int64)


def _in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (WORD_BITS - 1)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def key_bits(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """A bit for every row: ``WORD_BITS`` bits, collected as at most 4,096 rows of 4 KB."""
    at = _phrase_key([F.col(c) for c in columns]).bitwiseAND(F.lit(WORD_BITS - 1)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    table = np.zeros(WORD_BITS // 8, np.uint8)
    for row in parts.collect():
        table[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return table


def pair_candidates(rows: DataFrame, bits: np.ndarray, min_count: int, seed: int) -> DataFrame:
    """w1, w2, n of neighbours that occur ``min_count`` times or more."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = sent.value, _Held(2)
        symbols = Symbols(lambda h: h, seed, 0)
        for lang, words in _groups(batches):
            h = symbols.of(lang, words)
            good = (h != 0) & _in_bits(bits, h)
            both = np.flatnonzero(good[:-1] & good[1:])
            for columns in held.add([h[both], h[both + 1]]):
                yield from _batches(columns, ["w1", "w2", "n"])
        yield from _batches(held.rest(), ["w1", "w2", "n"])

    found = rows.mapInArrow(run, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= min_count)


def count_phrases(rows: DataFrame, candidates: DataFrame, k: int, min_count: int, seed: int, further: bool) -> DataFrame:
    """w1 .. wk, n of the candidates (with their sums n); if asked for, rows with w(k+1) are candidates of the next level."""
    names, n = _names(k), candidates.count()
    schema = ", ".join(f"{w} long" for w in _names(k + 1)) + ", n long"
    context = rows.sparkSession.sparkContext
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    found = candidates.select(*names, F.lit(None).cast("long").alias(f"w{k + 1}"), "n")
    if not further:
        return found
    bits = context.broadcast(key_bits(candidates, names))
    if n > TRIE_ROWS:
        return found.unionByName(_kept(rows.mapInArrow(_longer(bits, k, seed), schema), k, min_count))
    part = candidates.select(*names).toArrow()
    trie = DoubleArray.build(np.stack([part.column(w).to_numpy() for w in names], axis=1))
    sent = context.broadcast((trie.alphabet, trie.place, trie.base, trie.check))
    del part, trie
    return _kept(rows.mapInArrow(_counter(sent, k, seed, bits), schema), k, min_count)


def _kept(counted: DataFrame, k: int, min_count: int) -> DataFrame:
    """The phrases whose sums add up to ``min_count``."""
    sums = counted.groupBy(*_names(k + 1)).agg(F.sum("n").alias("n"))
    with shuffles_dropped(counted.sparkSession):
        return staged(sums.where(F.col("n") >= min_count), f"phrases-{k}")


def _longer(bits: Broadcast, k: int, seed: int) -> Callable:
    """Sums of k + 1 words whose first k and last k both pass the bits of the phrases of k words.

    Parts of a frequent phrase are frequent, so false hits of the bits do not reach ``min_count``.
    """
    names = [*_names(k + 1), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, held = Symbols(lambda h: h, seed, 0), _Held(k + 1)
        for lang, words in _groups(batches):
            h = symbols.of(lang, words)
            if len(h) <= k:
                continue
            start = [h[i : len(h) - k + 1 + i] for i in range(k)]
            good = _in_bits(bits.value, _phrase_keys(start))
            for column in start:
                good &= column != 0
            places = np.flatnonzero(good[:-1] & good[1:])
            for columns in held.add([h[places + i] for i in range(k + 1)]):
                yield from _batches(columns, names)
        yield from _batches(held.rest(), names)

    return run


def _counter(sent: Broadcast, k: int, seed: int, bits: Broadcast) -> Callable:
    """What a task does with the trie: counts come out, and by the bits of all candidates sums of the next level's."""
    names = [*_names(k + 1), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = DoubleArray(*sent.value, k)
        symbols, hashes = Symbols(trie.codes, seed, -1), trie.hashes()
        hits = np.zeros(len(trie.check), np.int64)
        waiting, size = [], 0
        held = _Held(k + 1)
        for lang, words in _groups(batches):
            codes = symbols.of(lang, words)
            places, states = trie.advance(codes)
            waiting.append(states)
            size += len(states)
            if size > _HELD:
                hits += np.bincount(np.concatenate(waiting), minlength=len(hits))
                waiting, size = [], 0
            # a word that no candidate has ends no longer one
            codes = np.concatenate((codes, np.full(k, -1, np.int64)))
            h = hashes[codes]
            places = places[codes[places + k] >= 0]
            columns = [h[places + i] for i in range(k + 1)]
            next_too = _in_bits(bits.value, _phrase_keys(columns[1:]))
            for columns in held.add([c[next_too] for c in columns]):
                yield from _batches(columns, names)
        if waiting:
            hits += np.bincount(np.concatenate(waiting), minlength=len(hits))
        yield from _batches(held.rest(), names)
        yield from _counts(trie, hits, names)

    return run


def _counts(trie: DoubleArray, hits: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Words and counts of the states that were hit."""
    states = np.flatnonzero(hits)
    for at in range(0, len(states), 200_000):
        part = states[at : at + 200_000]
        yield from _batches([*trie.rows(part).T, None, hits[part]], names)


# ---- scores -------------------------------------------------------------------
def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals of 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    product = F.lit(1_000_000).cast("decimal(10,0)") * wide[0] * wide[0]
    return F.call_function("div", product, wide[1] * wide[2])


def scored_phrases(words: DataFrame, levels: dict[int, DataFrame], share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that no longer one stands for.

    ``words`` has w, lang, word, n of the frequent words, ``levels`` by number of
    words w1 .., n of the frequent phrases.
    """
    counts = {1: words.select(F.col("w").alias("w1"), "n")} | levels
    out = None
    for k, phrases in levels.items():
        names = _names(k)
        one = phrases.select(*names, F.col("n").alias("a"))
        for i, w in enumerate(names):
            one = one.join(words.select(F.col("w").alias(w), F.col("word").alias(f"t{i}"), *(["lang"] if i == 0 else [])), w)
        cuts = []
        for j in range(1, k):
            left = counts[j].select(*_names(j), F.col("n").alias(f"l{j}"))
            right = counts[k - j].select(*(F.col(w).alias(names[j + i]) for i, w in enumerate(_names(k - j))), F.col("n").alias(f"r{j}"))
            one = one.join(left, names[:j]).join(right, names[j:])
            cuts.append(
                F.struct(
                    _score(F.col("a"), F.col(f"l{j}"), F.col(f"r{j}")).cast("long").alias("score"),
                    F.lit(j).alias("j"),
                    F.col(f"l{j}").alias("l"),
                    F.col(f"r{j}").alias("r"),
                )
            )
        inside = None  # the most frequent longer phrase that holds these words
        for m, longer in levels.items():
            for o in range(m - k + 1) if m > k else ():
                part = longer.select(*(F.col(f"w{o + i + 1}").alias(w) for i, w in enumerate(names)), F.col("n").alias("longer"))
                inside = part if inside is None else inside.union(part)
        if inside is not None:
            inside = inside.groupBy(*names).agg(F.max("longer").alias("longer"))
            one = one.join(inside, names, "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        one = one.withColumn("best", best).select(
            "lang", F.concat_ws(" ", *(f"t{i}" for i in range(k))).alias("phrase"), "a", "best.l", "best.r", "best.score"
        )
        out = one if out is None else out.union(one)
    return out


def collocations(
    docs: DataFrame,
    longest: int = 3,
    min_count: int = 10,
    share: int = 50,
    top: int | None = 2000,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 to ``longest`` words.

    ``a`` is how often the phrase occurs (``min_count`` at least), ``l`` and
    ``r`` how often the parts at its lowest-scoring cut do, ``n`` all words of
    the language, ``score`` floor(1000000 a a / (l r)). Phrases that stand in a
    longer one with ``share`` hundredths of their count are left out. ``top``
    phrases of each language are returned, all if None.

    A null text is empty, a null language ``und``; repeated rows count as often
    as they stand there; equal scores are ordered by count, then phrase; other
    columns are ignored; an empty table, or one without frequent phrases, gives
    an empty result.
    """
    if longest < 2 or min_count < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    for seed in itertools.count():
        with shuffles_dropped(docs.sparkSession):
            every = staged(count_words(rows, seed), "words")
        shared = every.groupBy("w").agg(F.count("*").alias("words"), F.max("n").alias("most"))
        if not shared.where((F.col("words") > 1) & (F.col("most") >= min_count)).limit(1).count():
            break
    words = every.where(F.col("n") >= min_count)
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    with shuffles_dropped(docs.sparkSession):
        candidates = staged(pair_candidates(rows, key_bits(words, ["w"]), min_count, seed), "pairs")
    levels: dict[int, DataFrame] = {}
    for k in range(2, longest + 1):
        found = count_phrases(rows, candidates, k, min_count, seed, k < longest)
        last = F.col(f"w{k + 1}")
        levels[k] = found.where(last.isNull()).select(*_names(k), "n")
        candidates = found.where(last.isNotNull()).select(*_names(k + 1), "n")
    if words.count() <= BROADCAST_ROWS:
        words = F.broadcast(words)
    scored = scored_phrases(words, levels, share).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
