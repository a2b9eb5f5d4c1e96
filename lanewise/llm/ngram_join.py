"""Jaccard self-join of documents on word n-grams, as a blocked sparse product.

The documents and their distinct n-grams form a sparse 0/1 matrix; the product
with its transpose counts the n-grams two documents share. It is never formed
as a whole:

* Rows fall into size classes and columns (the hash space) into blocks. Two
  sets with ``100 * |x & y| >= share * |x | y|`` differ in at most
  ``2u(100-share)/(100+share)`` n-grams, u being the upper size of the class of
  the larger one. With more blocks than that, some block of the two rows is
  equal. Only rows that share an equal, non-empty block are multiplied; this
  bound loses no link. With some blocks more than needed, documents can leave
  a few values that very many share (a common passage alone in a block). Rows
  with too many empty blocks also meet on the smallest hashes, of which two linked rows always share one among the first
  ``n - ceil(share * n / 100) + 1``.
* Overlap counts of such a pair are summed block by block; the pair is dropped
  as soon as the count so far and what the remaining blocks can add fall below
  the overlap that the two sizes ask for.
* Documents with equal sets are one row of the matrix. Of the rows that share a
  block, one meets all the others first; rows joined by links need no further
  product. What is left of a small group is tested pair by pair. Rows of a
  larger group are dealt into tiles, and a task multiplies two tiles. First the
  rows come with columns folded to a few bits each, which say how much two sets
  share at most. Pairs that reach their bound so are
  counted by their texts; where they are more than the rows, as many as could
  join what they join. If one of these falls short, the tiles are multiplied
  by their incidence matrices, a range of columns at a time, until no pair of
  the tiles can reach its bound. Only links leave the task, so a group of near
  copies of which no two are linked costs a few copies a row and not a row for
  every pair.

Equal blocks are found per map task first, so that of a group of any size one
entry per task is shuffled. Hashes have 64 bits (sets: 128).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import connected, keep_ids, mix, release_memory, shuffles_dropped, sliced, sliced_by_bytes, small_batches, staged, text_shingles, worker_cache

_FLUSH = 700_000
_MASK = (1 << 64) - 1
_PART, _CLASS, _PREFIX = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_EMITTED = "bucket int, sigs binary, nodes binary, many binary, ids binary, known binary, sizes binary, slacks binary, prints binary"
_FOUND = "sig long, node long, doc_id long, n int, slack int, f1 long, f2 long"
_HOT = 16  # rows that share a block value; in more, documents that can spare it leave it, and tiles are multiplied
_TILE = 512  # rows of a tile
_TILE_GRAMS = 1_000_000  # n-grams of a tile: tiles of long documents have fewer rows
_SETS_HELD = 8 << 20  # bytes of sets that a worker remembers
_TEXT_BYTES = 1 << 20  # text cut into words at a time
_COLUMNS = 4_096  # columns multiplied at a time


class Bounds:
    """Size classes, and what the sizes of two sets say about their overlap."""

    def __init__(self, share: int):
        if not 50 < share <= 100:
            raise ValueError("share must be above 50 and at most 100 (per cent)")
        self.share, self.uppers = share, []
        u = 1
        while self.differ(2 * (u + 1)) == 0 and u < 1 << 20:
            u += 1
        while u < 1 << 40:
            self.uppers.append(u)
            u = max(u + 1, u * 7 // 5)

    def differ(self, both: int) -> int:
        """Most n-grams in one set only, of two linked sets with ``both`` n-grams in all."""
        return both * (100 - self.share) // (100 + self.share)

    def need(self, a: int, b: int) -> int:
        """Least overlap of two linked sets of these sizes."""
        return -(-self.share * (a + b) // (100 + self.share))

    def prefix(self, n: int) -> int:
        return n - -(-self.share * n // 100) + 1

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """(class, blocks, empty blocks allowed) for a set of n as the larger or the smaller one."""
        out, j = [], int(np.searchsorted(self.uppers, n))
        while True:
            most = self.differ(2 * self.uppers[j])
            spare = 3 + most * 10 // 100 if most else 0
            out.append((j, most + 1 + spare, spare))
            j += 1
            if n * 100 < self.share * (self.uppers[j - 1] + 1):
                return out


def signatures(h: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, int]:
    """What a set (sorted hashes) shows in its blocks, and how many of these values it can spare.

    Linked sets have more values in common than either of them can spare.
    """
    n, out, slack = len(h), [], 1 << 30
    mixed, high = mix(h), h >> np.uint64(32)
    for j, blocks, spare in bounds.classes(n):
        block = (high * np.uint64(blocks)) >> np.uint64(32)
        at = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1))
        slack = min(slack, spare - (blocks - len(at)))
        out.append(mix(np.add.reduceat(mixed, at) + block[at] * _PART + np.uint64(j * int(_CLASS) & _MASK)))
    if slack < 0:
        out.append(mix(h[: bounds.prefix(n)] + _PREFIX))
    return np.concatenate(out), max(slack, 0)


def _emit(size: int, share: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("ngram_join")  # what others left goes
        bounds, seen = Bounds(share), set()
        sigs, nodes, waiting = [], [], 0

        def rows(columns: dict) -> pa.RecordBatch:
            length = len(columns["bucket"])
            arrays = [
                pa.array(columns.get(name, [None] * length), pa.int32() if kind == "int" else pa.binary())
                for name, kind in (c.split() for c in _EMITTED.split(", "))
            ]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _EMITTED.split(", ")])

        def flush() -> pa.RecordBatch:
            s, d = np.concatenate(sigs), np.concatenate(nodes)
            order = np.lexsort((d, s))
            s, d = s[order], d[order]
            first = np.concatenate(([True], s[1:] != s[:-1]))
            twin = np.concatenate((~first, [False]))
            twin = twin[1:] | ~first  # shares its value with another row of this task
            bucket = ((s >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            # the first of a value goes to its bucket; the others are known to have company
            out = {"bucket": [], "sigs": [], "nodes": [], "many": []}
            for which, company in ((first, False), (~first, True)):
                b, ss, dd, tt = bucket[which], s[which], d[which], twin[which].astype(np.uint8)
                if company:
                    tt = np.full(len(tt), 2, np.uint8)
                at = np.concatenate(([0], np.flatnonzero(np.diff(b)) + 1, [len(b)])) if len(b) else [0]
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    out["bucket"].append(int(b[lo]))
                    for name, x in (("sigs", ss), ("nodes", dd), ("many", tt)):
                        out[name].append(x[lo:hi].tobytes())
            return rows(out)

        for k, batch in enumerate(sliced_by_bytes(batches, 1, _TEXT_BYTES)):
            ids, known, sizes, slacks, prints = [], [], [], [], []
            for doc, h in zip(batch.column(0).to_pylist(), text_shingles(batch.column(1), size), strict=True):
                mark = xxhash.xxh3_128_digest(h.tobytes())
                ids.append(doc or 0)
                known.append(doc is not None)
                sizes.append(len(h))
                prints.append(mark)
                slacks.append(0)
                if doc is None or not len(h):
                    continue
                s, slacks[-1] = signatures(h, bounds)
                if mark in seen:
                    continue
                seen.add(mark)
                sigs.append(s)
                nodes.append(np.full(len(s), doc, np.int64))
                waiting += len(s)
                if waiting >= _FLUSH:
                    yield flush()
                    sigs, nodes, waiting = [], [], 0
            yield rows(
                {
                    "bucket": [int(xxhash.xxh32_intdigest(prints[0]) % buckets) if prints else k % buckets],
                    "ids": [np.array(ids, np.int64).tobytes()],
                    "known": [np.array(known, np.uint8).tobytes()],
                    "sizes": [np.array(sizes, np.int32).tobytes()],
                    "slacks": [np.array(slacks, np.int32).tobytes()],
                    "prints": [b"".join(prints)],
                }
            )
        if waiting:
            yield flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket of block values: the rows that share one with another row."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def rows(length: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[n], k) if n in columns else pa.nulls(length, k) for n, k in zip(names, kinds, strict=True)],
            names,
        )

    def active(s: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(s), 200_000):
            yield rows(len(s[at : at + 200_000]), sig=s[at : at + 200_000].view(np.int64), node=d[at : at + 200_000])

    sigs, nodes, many = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                ids = np.frombuffer(row["ids"], np.int64)
                prints = np.frombuffer(row["prints"], np.int64).reshape(-1, 2)
                known = np.frombuffer(row["known"], np.uint8)
                yield rows(
                    len(ids),
                    doc_id=pa.array(ids, mask=known == 0),
                    n=np.frombuffer(row["sizes"], np.int32),
                    slack=np.frombuffer(row["slacks"], np.int32),
                    f1=prints[:, 0],
                    f2=prints[:, 1],
                )
                continue
            s, d = np.frombuffer(row["sigs"], np.uint64), np.frombuffer(row["nodes"], np.int64)
            m = np.frombuffer(row["many"], np.uint8)
            if len(m) and m[0] == 2:  # has company within its map task: passed on, not kept
                yield from active(s, d)
            else:
                sigs.append(s)
                nodes.append(d)
                many.append(m)
    if sigs:
        s, d, m = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(many)
        order = np.argsort(s, kind="stable")
        s, d, m = s[order], d[order], m[order]
        same = s[1:] == s[:-1]
        keep = (m == 1) | np.concatenate((same, [False])) | np.concatenate(([False], same))
        yield from active(s[keep], d[keep])
    release_memory()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as they travel once for each pair or tile."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in sliced(batches):
        texts = pa.array([None if t is None else packer.compress(t) for t in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["node", "text"])


class _Sets(dict):
    """Shingles of compressed texts; a task and its successors meet many texts again."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.held = size, 0
        self.unpack = zstandard.ZstdDecompressor().decompress

    def __missing__(self, packed: bytes) -> np.ndarray:
        found = next(text_shingles(pa.array([self.unpack(packed)], pa.binary()), self.size))
        if self.held > _SETS_HELD:
            self.clear()
            self.held = 0
        self.held += 8 * len(found) + len(packed)
        self[packed] = found
        return found

    @classmethod
    def of_worker(cls, size: int) -> _Sets:
        return worker_cache("ngram_join").setdefault(size, cls(size))


def _overlap(size: int, share: int):
    """Keep pairs of texts whose overlap, summed over column blocks, reaches the bound of their sizes."""

    def linked(x: np.ndarray, y: np.ndarray, bounds: Bounds) -> bool:
        need = bounds.need(len(x), len(y))
        if not len(x) or not len(y) or min(len(x), len(y)) < need:
            return False
        edges = (np.arange(1, 5, dtype=np.uint64) << np.uint64(62)) - np.uint64(1)  # ends of four column blocks
        xs, ys = np.searchsorted(x, edges, "right"), np.searchsorted(y, edges, "right")
        count = i = j = 0
        for xe, ye in zip(xs, ys, strict=True):
            if xe > i and ye > j:
                part = y[j:ye]
                at = np.searchsorted(part, x[i:xe])
                at[at == len(part)] = 0
                count += int(np.count_nonzero(part[at] == x[i:xe]))
            i, j = xe, ye
            if count + min(len(x) - i, len(y) - j) < need:
                return False
        return count >= need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, sets = Bounds(share), _Sets.of_worker(size)
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            good = []
            for x, y, tx, ty in zip(a, b, ta, tb, strict=True):
                if linked(sets[tx], sets[ty], bounds):
                    good.append((x, y))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], ["a", "b"]
            )
        release_memory()

    return run


def tile_product(x: list[np.ndarray], y: list[np.ndarray], wanted: np.ndarray, share: int) -> np.ndarray:
    """(row of x, row of y) of the ``wanted`` pairs of sets that are linked: x times y transposed, by ranges of columns."""
    nx, ny = np.array([len(h) for h in x]), np.array([len(h) for h in y])
    need = -(-share * (nx[:, None] + ny) // (100 + share))
    live = wanted & (np.minimum(nx[:, None], ny) >= need) & (nx[:, None] > 0) & (ny > 0)
    columns = np.intersect1d(np.concatenate(x), np.concatenate(y))  # the others add nothing

    def incidence(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        at = np.searchsorted(columns, flat)
        at[at == len(columns)] = 0
        held = columns[at] == flat if len(columns) else np.zeros(len(flat), bool)
        row, column = np.repeat(np.arange(len(sets)), sizes)[held], at[held]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    (xr, xc), (yr, yc) = incidence(x, nx), incidence(y, ny)
    left_x, left_y = np.bincount(xr, minlength=len(x)), np.bincount(yr, minlength=len(y))
    overlap = np.zeros(live.shape, np.int64)
    lo = 0
    while True:
        live &= overlap + np.minimum(left_x[:, None], left_y) >= need
        if lo >= len(columns) or not live.any():
            return np.argwhere(live)
        parts = []
        for row, column, left in ((xr, xc, left_x), (yr, yc, left_y)):
            part = slice(*np.searchsorted(column, (lo, lo + _COLUMNS)))
            dense = np.zeros((len(left), min(_COLUMNS, len(columns) - lo)), np.float32)
            dense[row[part], column[part] - lo] = 1
            left -= np.bincount(row[part], minlength=len(left))
            parts.append(dense)
        overlap += (parts[0] @ parts[1].T).astype(np.int64)
        lo += _COLUMNS


def folded(h: np.ndarray) -> np.ndarray:
    """A set's hashes by their leading bits: 2^k columns, three to six for each hash (64 at least), as 64-bit words."""
    k = max(6, (3 * len(h) - 1).bit_length())
    bits = np.zeros(1 << k, np.uint8)
    bits[h >> np.uint64(64 - k)] = 1
    return np.packbits(bits).view(np.uint64)


def halved(rows: np.ndarray) -> np.ndarray:
    """Folded rows with half the columns."""
    bits = np.unpackbits(rows.view(np.uint8), axis=1)
    return np.packbits(bits[:, ::2] | bits[:, 1::2], axis=1).view(np.uint64)


def may_be_linked(x: list[np.ndarray], y: list[np.ndarray], nx: np.ndarray, ny: np.ndarray, wanted: np.ndarray, share: int) -> np.ndarray:
    """(row of x, row of y) of ``wanted`` pairs of folded sets of nx and ny hashes; no linked pair is missing, others may be there."""
    live = np.zeros(wanted.shape, bool)
    by_width = [{w: np.flatnonzero([len(b) == w for b in rows]) for w in {len(b) for b in rows}} for rows in (x, y)]
    for wx, xs in by_width[0].items():
        for wy, ys in by_width[1].items():
            if max(wx, wy) > 2 * min(wx, wy):
                continue  # one set is more than twice the other
            a, b = np.stack([x[k] for k in xs]), np.stack([y[k] for k in ys])
            a, b = (halved(a) if wx > wy else a), (halved(b) if wy > wx else b)
            lost = ny[ys] - np.bitwise_count(b).sum(1, np.int64)  # hashes that share a column with another one of the set
            for k, row in zip(xs, a, strict=True):
                most = np.bitwise_count(b & row).sum(1, np.int64) + np.minimum(lost, nx[k] - int(np.bitwise_count(row).sum()))
                live[k, ys] = np.minimum(most, np.minimum(nx[k], ny[ys])) >= -(-share * (nx[k] + ny[ys]) // (100 + share))
    return np.argwhere(live & wanted & (nx[:, None] > 0) & (ny > 0))


def _fold(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches, 200):
            texts = pa.array([None if t is None else unpack(t) for t in batch.column(1).to_pylist()], pa.binary())
            sets = list(text_shingles(texts, size))
            columns = [pa.array([len(h) for h in sets], pa.int64()), pa.array([folded(h).tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "size", "bits"])

    return run


def _joining(columns: dict[str, list], left: np.ndarray, right: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
    """Of pairs found of rows ``left`` and ``right`` as many as join what they join."""
    good: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    for p, q in found.tolist():
        a, b = int(left[p]), int(right[q])
        x, y = find(columns["comp"][a]), find(columns["comp"][b])
        if x != y:
            root[x] = y
            good.append((columns["node"][a], columns["node"][b]))
    return good


def _multiply_folded(share: int):
    """Pairs of rows of two tiles (or of one) that may be linked: all of them, or as many as could join what they join."""

    def run(rows: pa.Table) -> pa.Table:
        columns = {name: rows.column(name).to_pylist() for name in ("sig", "i", "j", "tile", "node", "comp", "bits")}
        sets, sizes = [np.frombuffer(b, np.uint64) for b in columns["bits"]], rows.column("size").to_numpy()
        tile, comp = np.array(columns["tile"]), np.array(columns["comp"])
        left, right = (np.flatnonzero(tile == columns[name][0]) for name in ("i", "j"))
        good: list[tuple[int, int]] = []
        whole = True
        if len(left) and len(right):
            wanted = comp[left][:, None] != comp[right]
            found = may_be_linked([sets[k] for k in left], [sets[k] for k in right], sizes[left], sizes[right], wanted, share)
            whole = len(found) <= len(left) + len(right)
            node = columns["node"]
            good = [(node[left[p]], node[right[q]]) for p, q in found.tolist()] if whole else _joining(columns, left, right, found)
        out = [(*(columns[name][0] for name in ("sig", "i", "j")), min(g), max(g), whole) for g in good]
        kinds = {"sig": pa.int64(), "i": pa.int32(), "j": pa.int32(), "a": pa.int64(), "b": pa.int64(), "whole": pa.bool_()}
        return pa.table({name: pa.array([o[k] for o in out], kind) for k, (name, kind) in enumerate(kinds.items())})

    return run


def _multiply(size: int, share: int):
    """Links between two tiles of rows (or within one): as many as join what they join."""

    def run(rows: pa.Table) -> pa.Table:
        known = _Sets.of_worker(size)
        columns = {name: rows.column(name).to_pylist() for name in ("i", "j", "tile", "node", "comp")}
        sets = [known[t] for t in rows.column("text").to_pylist()]
        tile, comp = np.array(columns["tile"]), np.array(columns["comp"])
        left, right = (np.flatnonzero(tile == columns[name][0]) for name in ("i", "j"))
        good: list[tuple[int, int]] = []
        if len(left) and len(right):
            found = tile_product([sets[k] for k in left], [sets[k] for k in right], comp[left][:, None] != comp[right], share)
            good = _joining(columns, left, right, found)
        return pa.table(
            {"a": pa.array([min(g) for g in good], pa.int64()), "b": pa.array([max(g) for g in good], pa.int64())}
        )

    return run


def _tiles(g: DataFrame) -> DataFrame:
    """sig, i, j, tile, node, comp: the rows of large groups for each pair of tiles that has something to join.

    Rows of a group's largest component, which need not meet each other, have tiles of their own.
    """
    weight = g.groupBy("sig", "comp").agg(F.count("*").alias("weight"), F.max("n").alias("longest"))
    group = weight.groupBy("sig").agg(
        F.max(F.struct("weight", "comp")).alias("top"), F.sum("weight").alias("all"), F.max("longest").alias("longest")
    )
    room = F.greatest(F.lit(1), F.least(F.lit(_TILE), F.floor(F.lit(_TILE_GRAMS) / F.col("longest"))))
    group = group.select(
        "sig",
        F.col("top.comp").alias("top"),
        F.ceil(F.col("top.weight") / room).cast("int").alias("k"),
        F.ceil((F.col("all") - F.col("top.weight")) / room).cast("int").alias("others"),
    )
    place = F.xxhash64("node")
    dealt = g.join(group, "sig").select(
        "sig",
        "node",
        "comp",
        F.when(F.col("comp") == F.col("top"), F.pmod(place, F.col("k"))).otherwise(F.col("k") + F.pmod(place, F.col("others"))).cast("int").alias("tile"),
        "k",
        (F.col("k") + F.col("others")).alias("tiles"),
    )
    # a tile of the largest component meets the tiles of the others only
    first = F.when(F.col("tile") < F.col("k"), F.col("k")).otherwise(F.lit(0))
    met = dealt.withColumn("other", F.explode(F.sequence(first, F.col("tiles") - 1)))
    return met.select("sig", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "comp")


def one_of_each(docs: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """The document with the smallest id of each group of linked documents.

    Rows with equal ids are one document, of which one row stays. Rows without
    an id are kept.
    """
    groups = staged(ngram_components(docs, size, share).select("doc_id", "component_id"), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = keep_ids(docs, gone, "doc_id", "left_anti")
    twice = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.limit(1).count():
        named = keep_ids(kept.where("doc_id is not null"), twice, "doc_id")
        single = keep_ids(kept.where("doc_id is not null"), twice, "doc_id", "left_anti")
        kept = single.unionByName(named.dropDuplicates(["doc_id"])).unionByName(kept.where("doc_id is null"))
    return kept


def ngram_components(docs: DataFrame, size: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id.

    A text is lower-cased (A-Z) and cut at ASCII white space. Its set holds the
    distinct shingles of ``size`` words; fewer words make one shingle of the
    whole sequence. Two documents are linked when ``100 * |x & y| >= share *
    |x | y|``; component_id is the smallest id reached by links.

    Null and empty texts have an empty set, no links and their own id. A null
    id stays null and is never linked. Rows that repeat an id are one document
    that has the links of each of them. Further columns are ignored; an empty
    table gives an empty result.
    """
    with shuffles_dropped(docs.sparkSession):
        return _components(docs, size, share, id_col, text_col)


def _components(docs: DataFrame, size: int, share: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = staged(
        rows.mapInArrow(_emit(size, share, 8 * parts), _EMITTED).repartition(parts, "bucket").mapInArrow(_meet, _FOUND),
        "blocks",
    )

    listed = found.where("sig is null").select("doc_id", "n", "slack", "f1", "f2")
    real = listed.where("n > 0 and doc_id is not null")
    first = real.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    # An id on several rows is one document: all its sets belong to one node.
    sets = staged(real.join(first, ["f1", "f2"]).select("doc_id", "rep", "n", "slack").distinct(), "sets")
    again = sets.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")

    meets = staged(
        found.where("sig is not null")
        .select("sig", F.col("node").alias("doc_id"))
        .join(sets, "doc_id")
        .select("sig", F.col("rep").alias("node"), "n", "slack")
        .distinct(),
        "met",
    )
    # A text that many documents hold fills a few blocks of each on its own. Documents leave as many of their hot
    # values as they can spare, the most frequent first. As the order is one for all, the last in it of the values
    # that two linked documents have in common is left by neither.
    hot = meets.groupBy("sig").agg(F.count("*").alias("rows")).where(F.col("rows") > _HOT)
    hot_rows = meets.join(hot, "sig").groupBy("node", "sig", "rows").agg(F.min("slack").alias("slack"))
    of_node = Window.partitionBy("node")
    ranked = hot_rows.withColumn("least", F.min("slack").over(of_node)).withColumn(
        "place", F.row_number().over(of_node.orderBy(F.desc("rows"), "sig"))
    )
    gone = ranked.where("place <= least").select("sig", "node")
    meets = meets.join(gone, ["sig", "node"], "left_anti").select("sig", "node", "n").distinct()
    group = meets.groupBy("sig").agg(
        F.count("*").alias("rows"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all")
    ).where("lo < hi")
    alone = group.groupBy("rows", "lo", "hi", "all").agg(F.min("sig").alias("sig")).select("sig")
    open_rows = staged(meets.join(alone, "sig", "left_semi"), "meets")
    nodes = staged(open_rows.select("node").distinct(), "nodes")
    needed = keep_ids(rows.withColumnRenamed("doc_id", "node"), nodes, "node")
    texts = staged(needed.mapInArrow(_packed, "node long, text binary").distinct(), "texts")  # equal texts pack alike

    labels = nodes.select("node", F.col("node").alias("comp"))
    links = staged(again, "links")
    overlap = _overlap(size, share)

    def open_groups(rows_of: DataFrame, labels: DataFrame) -> DataFrame:
        """Groups whose rows are not all joined yet: sig, node, n, comp, rows."""
        g = rows_of.join(labels, "node")
        still = g.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
        return staged(g.join(still.select("sig", "rows"), "sig"), "open")

    def linked(g: DataFrame, lead: DataFrame, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Pairs of a row and a leading row of its group that were not tested before, and those linked."""
        lead = lead.select("sig", F.col("node").alias("p_node"), F.col("n").alias("p_n"), F.col("comp").alias("p_comp"))
        fits = F.least("n", "p_n") * (100 + share) >= share * (F.col("n") + F.col("p_n"))
        pairs = (
            g.join(lead, (g.sig == lead.sig) & (g.comp != lead.p_comp) & fits)
            .select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        return pairs, counted(pairs)

    def counted(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are linked."""
        both = (
            pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .select("a", "b", "ta", "tb")
        )
        return staged(both.mapInArrow(overlap, "a long, b long"), "links")

    g = open_groups(open_rows, nodes.select("node", F.col("node").alias("comp")))
    tested, found_links = linked(g, g.groupBy("sig").agg(F.min(F.struct("node", "n", "comp")).alias("p")).select("sig", "p.*"), None)
    links = links.union(found_links)
    labels = nodes.join(connected(links), "node", "left").select("node", F.coalesce("root", "node").alias("comp"))
    g = open_groups(open_rows, labels)
    small = g.where(F.col("rows") <= _HOT)
    links = links.union(linked(small, small, tested)[1])
    tiles = staged(_tiles(g.where(F.col("rows") > _HOT)), "tiles")
    place = ["sig", "i", "j"]
    bits = staged(texts.mapInArrow(_fold(size), "node long, size long, bits binary"), "folded")
    likely = tiles.join(bits, "node").groupBy(*place).applyInArrow(
        _multiply_folded(share), "sig long, i int, j int, a long, b long, whole boolean"
    )
    likely = staged(likely, "likely")
    true = counted(staged(likely.select("a", "b").distinct(), "pairs"))
    links = links.union(true)
    # Where not all pairs left the task, one that is no link may stand for one that is.
    wrong = staged(likely.where("not whole").join(true, ["a", "b"], "left_anti").select(*place).distinct(), "wrong")
    if wrong.limit(1).count():
        again = tiles.join(wrong, place, "left_semi").join(texts, "node")
        links = links.union(staged(again.groupBy(*place).applyInArrow(_multiply(size, share), "a long, b long"), "tile-links"))

    roots = connected(links, "result")
    by_doc = sets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("root", "rep")).alias("component_id")
    )
    return listed.join(by_doc, "doc_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
