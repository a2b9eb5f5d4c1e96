"""Periodic runs of words, by a dictionary of basic factors.

The stretches of 1, 2, 4, ... words of a document get names: equal stretches of
one length have equal names, and the names of a length come from the pairs of
names of half of it. At every length ``m``, an occurrence whose next equal one
starts at most ``m`` words later lies with it within twice that length. Such
successors form arithmetic progressions, and their step is the period of the
text there. Places in a row with equal step ``d`` propose the period ``d`` for
all the words they cover, the last place's stretch and the step included.

Where ``m >= d``, a shorter period anywhere in that stretch would make the next
occurrence come sooner, so a proposal ends just where the period ends, and ``d``
is its smallest period. A run of at least three periods is proposed at the
smallest length of at least its period and at each longer one that fits;
proposals are extended to the words they cover and made distinct.

Names hold within one document only, so many short documents are treated as one
array. A place whose name occurs once is left out of all longer lengths.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words taken together; a longer document is an array of its own.
GROUP_WORDS = 400_000


def find_runs(ids: np.ndarray, longest: int, shortest_run: int = 24, periods: int = 3) -> np.ndarray:
    """(start, length, period) of the runs of ``ids``, sorted by start and period.

    ``ids`` are the words of one or more documents that share no id. A run has
    at least ``shortest_run`` words and ``periods`` (3 or more) periods; no
    document is longer than ``longest`` words.
    """
    if periods < 3:
        raise ValueError("runs of less than three periods need not be proposed")
    found = [np.empty((0, 3), np.int64)]
    places = np.arange(len(ids), dtype=np.int64)
    keys = np.asarray(ids, np.int64)
    names = np.full(len(ids), -1, np.int64)
    m = 1
    while len(places):
        order = np.argsort(keys, kind="stable")
        ranked, at = keys[order], places[order]
        same = ranked[1:] == ranked[:-1]
        names[:] = -1
        name = np.concatenate(([0], np.cumsum(~same)))
        often = np.concatenate((same, [False])) | np.concatenate(([False], same))
        names[at[often]] = name[often]
        steps = np.zeros(len(names), np.int64)
        near = same & (at[1:] - at[:-1] <= m)
        steps[at[:-1][near]] = (at[1:] - at[:-1])[near]
        found.append(_proposed(steps, m, shortest_run, periods))
        # A period is at most a third of its document, and its length less than twice that.
        if 3 * m >= 2 * longest:
            break
        places = np.flatnonzero(names[: max(len(names) - m, 0)] >= 0)
        places = places[names[places + m] >= 0]
        keys = names[places] * (len(names) + 1) + names[places + m]
        m *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _proposed(steps: np.ndarray, m: int, shortest_run: int, periods: int) -> np.ndarray:
    """Places in a row with one step, extended to the words they cover, where these are long enough."""
    places = np.flatnonzero(steps)
    if not len(places):
        return np.empty((0, 3), np.int64)
    d = steps[places]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(places) != 1) | (np.diff(d) != 0))))
    last = np.concatenate((first[1:], [len(places)])) - 1
    length = places[last] - places[first] + d[first] + m
    keep = length >= np.maximum(shortest_run, periods * d[first])
    return np.stack((places[first], length, d[first]), axis=1)[keep]


def repeat_from(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p): from word ``a`` on, the words of this document become repeats of ``p`` words; None: they stay."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length/period; ties go to the smaller start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _answers(words: list[list[bytes]], shortest_run: int, periods: int) -> Iterator[tuple]:
    """Per document: its runs and the words that stay."""
    ids: list[int] = []
    for one in words:
        known: dict[bytes, int] = {}
        low = len(ids)
        ids.extend([known.setdefault(w, low + len(known)) for w in one])
    sizes = np.array([len(one) for one in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    runs = find_runs(np.array(ids, np.int64), int(sizes.max(initial=0)), shortest_run, periods)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edges[:-1]) > 0
    of = np.searchsorted(runs[:, 0], starts)
    for i, one in enumerate(words):
        mine = runs[of[i] : of[i + 1]] - np.array([starts[i], 0, 0])
        if not len(mine):
            yield [], one
            continue
        stay = np.flatnonzero(~gone[starts[i] : starts[i + 1]]).tolist()
        yield [tuple(r) for r in mine.tolist()], [one[j] for j in stay]


_RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest_run: int = 24,
    periods: int = 3,
    plant: bool = False,
    with_texts: bool = True,
) -> DataFrame:
    """Per row: id, n_runs, the greatest run, digests of all runs and of the text without repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. With ``plant``, every
    tenth document (by the checksum of its id) gets a repeated end first. With
    ``with_texts``, ``runs`` and the ``collapsed`` text come along.

    A null or empty text has no words, no run and two digests of nothing; rows
    with a null id stay and get no repeated end; repeated rows give equal rows;
    other columns are ignored; an empty table gives an empty result. A text is
    held whole in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                group: list[list[bytes]] = []
                total, first = 0, at
                while at < batch.num_rows and (not total or total < GROUP_WORDS):
                    words = (texts[at].as_py() or b"").split()
                    if plant and (place := repeat_from(len(words), ids[at].as_py())):
                        a, p = place
                        unit = words[a : a + p]
                        words = words[:a] + (unit * ((len(words) - a) // p + 1))[: len(words) - a]
                    group.append(words)
                    total += len(words)
                    at += 1
                yield answer(ids.slice(first, at - first), group)

    def answer(ids: pa.Array, group: list[list[bytes]]) -> pa.RecordBatch:
        counts, best, digests, short, runs_of, texts = [], [], [], [], [], []
        for runs, stay in _answers(group, shortest_run, periods):
            counts.append(len(runs))
            best.append((*(r := _greatest(runs)), 1000 * r[1] // r[2]) if runs else (None,) * 4)
            digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest())
            collapsed = b" ".join(stay)
            short.append(hashlib.sha256(collapsed).hexdigest())
            if with_texts:
                runs_of.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(collapsed.decode("utf-8", "replace"))
        columns = [ids, pa.array(counts, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*best))]
        columns += [pa.array(digests, pa.string()), pa.array(short, pa.string())]
        if with_texts:
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns += [pa.array(runs_of, kind), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += f", runs {_RUNS}, collapsed string" if with_texts else ""
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    names += ["runs", "collapsed"] if with_texts else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
