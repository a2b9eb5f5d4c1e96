"""Nearest neighbours by cosine from robust-pruned directed graphs, one per shard.

Equal vectors are one point, with the smallest ids that can be asked for. The
points are dealt into shards by a hash. Each shard builds its graph in one
task: points enter in batches; a greedy beam search in the graph so far (and
the exact distances within the batch) propose neighbours; pruning keeps the
nearest, drops those that lie ``alpha`` times nearer to a kept one than to the
point, and goes on, so that edges point in different directions; reverse edges
are added and pruned alike. A query is searched by beam search in every shard,
blocks of queries with a shard's graph at a time, and the shards' finds are
ranked by the cosine of the original vectors in double precision.

A shard holds ``SHARD_ROWS`` points on average, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import staged

SHARD_ROWS = 4_096
DEGREE, BEAM, ALPHA = 28, 72, 1.2
_BATCH = 256
_QUERY_BLOCK = 8_192


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``beam`` best points met from ``start``, for all queries at once.

    Points and queries have length one; a distance is 2 - 2 cos. Missing
    entries are -1 and infinite.
    """
    n = len(queries)
    rows = np.arange(n)
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    met = np.zeros((n, len(points)), bool)
    ids[:, 0], dist[:, 0], open_[:, 0], met[:, start] = start, 2 - 2 * (queries @ points[start]), True, True
    live = rows
    while len(live):
        place = np.argmax(open_[live], 1)  # beams are sorted: the nearest that is still open
        here = ids[live, place]
        open_[live, place] = False
        near = edges[here]
        fresh = (near >= 0) & ~met[live[:, None], near]
        met[live[:, None], np.where(near >= 0, near, here[:, None])] = True
        d = np.where(fresh, 2 - 2 * np.einsum("qed,qd->qe", points[near], queries[live]), np.inf).astype(np.float32)
        all_ids = np.concatenate((ids[live], near), 1)
        all_dist = np.concatenate((dist[live], d), 1)
        all_open = np.concatenate((open_[live], fresh), 1)
        best = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        dist[live] = np.take_along_axis(all_dist, best, 1)
        open_[live] = np.take_along_axis(all_open, best, 1) & np.isfinite(dist[live])
        live = live[open_[live].any(1)]
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def prune(points: np.ndarray, at: int, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of a point among candidates."""
    near = np.unique(near)
    near = near[(near >= 0) & (near != at)]
    vectors = points[near]
    dist = 2 - 2 * (vectors @ points[at])
    order = np.argsort(dist, kind="stable")[:150]
    near, vectors, dist = near[order], vectors[order], dist[order]
    between = 2 - 2 * (vectors @ vectors.T)
    kept, alive = [], np.ones(len(near), bool)
    for i in range(len(near)):
        if alive[i]:
            kept.append(near[i])
            if len(kept) == degree:
                break
            alive &= alpha * between[i] > dist
    return np.array(kept, np.int32)


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges, start): out-neighbours of every point (-1: none), and where searches begin."""
    n = len(points)
    room = degree + degree // 2
    edges = np.full((n, room), -1, np.int32)
    used = np.zeros(n, np.int32)
    start = int(np.argmax(points @ points.mean(0)))

    def put(at: int, near: np.ndarray) -> None:
        edges[at, : len(near)], edges[at, len(near) :], used[at] = near, -1, len(near)

    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    size, done = 1, 1
    while done < n:
        batch = order[done : done + size]
        found, _ = beam_search(points, edges, start, points[batch], beam)
        inside = points[batch] @ points[batch].T
        mates = batch[np.argsort(-inside, 1, kind="stable")[:, :degree]]
        for at, met, own in zip(batch, found, mates, strict=True):
            near = prune(points, at, np.concatenate((met, own, edges[at])), degree, alpha)
            put(at, near)
            for other in near:
                if at in edges[other, : used[other]]:
                    continue
                if used[other] == room:
                    put(other, prune(points, other, np.append(edges[other], at), degree, alpha))
                else:
                    edges[other, used[other]] = at
                    used[other] += 1
        done += len(batch)
        size = min(_BATCH, 2 * size)
    return edges, start


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return (wide / np.sqrt((wide * wide).sum(1, keepdims=True))).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In double precision; scaled first, as squares of very large or small values do not fit."""
    a, b = (x / np.abs(x).max(-1, keepdims=True) for x in (a, b))
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


def nearest(
    embeddings: DataFrame,
    queries: str = "vec_id % 50 = 0",
    k: int = 5,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    beam: int = BEAM,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest found of every query row but itself.

    ``queries`` says which rows are queries (of ``vec_id``). Ties go to the
    smaller id. Rows whose vector is null, empty, zero or holds a null or
    non-finite value, and rows without an id, take no part. Vectors of another
    length are searched apart. Rows that repeat an id and vector are one; an id
    with several vectors stands for each of them. Further columns are ignored;
    an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    # -0 and 0 are one value; equal vectors are one point with a key of 128 bits.
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.select("vec_id", plain.alias("vector")).withColumn("key", F.md5(F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")))
    ids = rows.select("key", "vec_id").distinct()
    least = staged(_smallest(ids, k + 1), "members")
    points = staged(rows.groupBy("key").agg(F.min("vector").alias("vector"), F.count("*").alias("rows")).drop("rows"), "points")
    shards = max(1, -(-points.count() // shard_rows))
    dealt = points.select(
        "key",
        "vector",
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"),
    )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        vectors = np.array(group["vector"].tolist(), np.float64)
        edges, start = build_graph(_unit(vectors))
        return pd.DataFrame(
            {
                "dim": [vectors.shape[1]],
                "shard": [int(group["shard"].iloc[0])],
                "start": [start],
                "keys": [group["key"].tolist()],
                "vectors": [vectors.tobytes()],
                "edges": [edges.tobytes()],
            }
        )

    graphs = staged(
        dealt.repartition(max(parts, shards), "dim", "shard").groupBy("dim", "shard").applyInPandas(
            build, "dim int, shard int, start int, keys array<string>, vectors binary, edges binary"
        ),
        "graphs",
    )

    asked = staged(ids.where(F.expr(queries)).select("key").distinct().join(points, "key"), "asked")
    blocks = max(1, -(-asked.count() // _QUERY_BLOCK))
    placed = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int")
    every = graphs.select("dim", "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = asked.select("key", "vector", F.size("vector").alias("dim"), placed.alias("block")).join(every, ["dim", "block"])
    copies = graphs.select(
        F.col("dim").alias("g_dim"),
        F.col("shard").alias("g_shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("g_block"),
        "start",
        "keys",
        "vectors",
        "edges",
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "key": [], "score": []}
        if len(left) and len(right):
            graph = right.iloc[0]
            vectors = np.frombuffer(graph["vectors"], np.float64).reshape(-1, graph["g_dim"])
            edges = np.frombuffer(graph["edges"], np.int32).reshape(len(vectors), -1)
            keys, unit = np.array(list(graph["keys"])), _unit(vectors)
            for at in range(0, len(left), _BATCH):
                part = left.iloc[at : at + _BATCH]
                own = np.array(part["vector"].tolist(), np.float64)
                found, _ = beam_search(unit, edges, int(graph["start"]), _unit(own), beam)
                found = found[:, : 4 * (k + 1)]
                exact = np.where(found >= 0, _cosines(own[:, None, :], vectors[found]), -np.inf)
                best = np.argsort(-exact, 1, kind="stable")[:, : 2 * (k + 1)]
                for name, row, scores, chosen in zip(part["key"], found, exact, best, strict=True):
                    for i in chosen:
                        if row[i] >= 0:
                            out["query"].append(name)
                            out["key"].append(keys[row[i]])
                            out["score"].append(float(scores[i]))
        return pd.DataFrame(out)

    hits = staged(
        sent.groupBy("dim", "shard", "block").cogroup(copies.groupBy("g_dim", "g_shard", "g_block")).applyInPandas(
            search, "query string, key string, score double"
        ),
        "hits",
    )
    # Of each distinct query the points that hold its k nearest rows, with ties; then its rows.
    members = hits.join(least, "key").select("query", "score", F.explode("ids").alias("vec_id"))
    near = members.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    near = near.where(F.col("place") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))
    asking = ids.where(F.expr(queries)).select(F.col("key").alias("query"), F.col("vec_id").alias("query_id"))
    pairs = asking.join(near, "query").select("query_id", F.explode("near").alias("hit")).select("query_id", "hit.*").where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _smallest(ids: DataFrame, most: int) -> DataFrame:
    """(key, ids): the ``most`` smallest ids of each key. Each of many slices of a key gives its own first."""
    spread = ids.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    order = lambda *keys: Window.partitionBy(*keys).orderBy("vec_id")
    first = spread.withColumn("n", F.row_number().over(order("key", "slice"))).where(F.col("n") <= most)
    last = first.withColumn("n", F.row_number().over(order("key"))).where(F.col("n") <= most)
    return last.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
