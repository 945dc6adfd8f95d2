"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beam.

Equal vectors are one point of the index. Points are dealt to shards of about `shard_rows` by hash;
every shard builds its graph (greedy searches propose neighbours, relaxed distance pruning keeps
diverse edges), and each block of queries runs a beam search in every shard. The nearest over all
shards are ranked by exact double distance on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import stored


@dataclass(frozen=True)
class Graph:
    """What shapes an index: edges a point, beam of the build, pruning slack, and how many beam entries are expanded at once."""

    degree: int = 32
    build_beam: int = 48
    slack: float = 1.2
    width: int = 4
    seed: int = 5


def _far(points: np.ndarray, norms: np.ndarray, ids: np.ndarray, to: np.ndarray, to_norms: np.ndarray) -> np.ndarray:
    """Squared distances of (rows, c) point ids to each row's vector; the id past the end is infinitely far."""
    out = norms[ids] + to_norms[:, None] - 2 * np.einsum("rcd,rd->rc", points[ids], to, optimize=True)
    out[ids == len(points) - 1] = np.inf
    return out


def beam_search(points: np.ndarray, norms: np.ndarray, edges: np.ndarray, start: int, to: np.ndarray, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of each row's beam, nearest first. points has one row more than there
    are points, for missing edges."""
    m, none = len(to), len(points) - 1
    to_norms = np.einsum("rd,rd->r", to, to)
    ids = np.full((m, beam), none)
    ids[:, 0] = start
    dist = _far(points, norms, ids, to, to_norms)
    done = ids == none
    seen = np.zeros((m, none + 1), bool)
    seen[:, start] = seen[:, none] = True
    live = np.arange(m)
    while len(live):
        open_ = ~done[live]
        rank = np.cumsum(open_, axis=1)
        pick = open_ & (rank <= width)
        live = live[pick.any(1)]
        if not len(live):
            break
        pick = pick[pick.any(1)]
        slot = np.argsort(~pick, axis=1, kind="stable")[:, :width]
        from_ = np.where(np.take_along_axis(pick, slot, 1), np.take_along_axis(ids[live], slot, 1), none)
        done[live] |= pick
        new = np.sort(edges[from_].reshape(len(live), -1), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = none
        new = np.where(seen[live[:, None], new], none, new)
        seen[live[:, None], new] = True
        far = _far(points, norms, new, to[live], to_norms[live])
        all_d, all_i = np.concatenate([dist[live], far], 1), np.concatenate([ids[live], new], 1)
        all_f = np.concatenate([done[live], new == none], 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[live], ids[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_d, all_i, all_f))
    return ids, dist


def robust_prune(points: np.ndarray, norms: np.ndarray, own: np.ndarray, ids: np.ndarray, slack: float, degree: int) -> np.ndarray:
    """For each point of `own` at most `degree` of its candidate ids: the nearest is kept, and drops those
    that are nearer to it, by the slack, than to the point; then the next."""
    none = len(points) - 1
    ids = np.sort(np.where(ids == own[:, None], none, ids), axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = none
    dist = _far(points, norms, ids, points[own], norms[own])
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    near = points[ids]
    between = norms[ids][:, :, None] + norms[ids][:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
    alive = ids != none
    out = np.full((len(own), degree), none)
    row = np.arange(len(own))
    for j in range(degree):
        pick = alive.argmax(1)
        got = alive[row, pick]
        if not got.any():
            break
        out[got, j] = ids[row, pick][got]
        alive &= ~((slack**2 * between[row, pick] <= dist) & got[:, None])
        alive[row, pick] = False
    return out


def build(vectors: np.ndarray, graph: Graph = Graph(), batch: int = 256) -> tuple[np.ndarray, int]:
    """(n, degree) edges, n for none, and the entry point (nearest to the mean)."""
    n, rng = len(vectors), np.random.default_rng(graph.seed)
    points = np.vstack([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    norms = np.einsum("rd,rd->r", points, points)
    edges = np.full((n + 1, graph.degree), n)
    if n > 1:
        edges[:n, : min(graph.degree, n - 1)] = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(graph.degree, n - 1)))) % n
    start = int(((vectors - vectors.mean(0)) ** 2).sum(1).argmin())
    most = 2 * graph.degree + 16
    for slack, beam in ((1.0, graph.build_beam // 2), (graph.slack, graph.build_beam)) if n > 1 else ():
        order = rng.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            found, _ = beam_search(points, norms, edges, start, points[own], beam, graph.width)
            edges[own] = robust_prune(points, norms, own, np.concatenate([found, edges[own]], 1), slack, graph.degree)
            back_to, back_from = edges[own].ravel(), np.repeat(own, graph.degree)
            back_to, back_from = back_to[back_to < n], back_from[back_to < n]
            gap = ((points[back_to] - points[back_from]) ** 2).sum(1)
            order_ = np.lexsort((gap, back_to))
            back_to, back_from = back_to[order_], back_from[order_]
            first = np.append(True, back_to[1:] != back_to[:-1])
            heads = np.flatnonzero(first)
            place = np.arange(len(back_to)) - np.repeat(heads, np.diff(np.append(heads, len(back_to))))
            ok = place < most - graph.degree
            group = np.cumsum(first) - 1
            target = back_to[heads]
            offered = np.full((len(target), most - graph.degree), n)
            offered[group[ok], place[ok]] = back_from[ok]
            edges[target] = robust_prune(points, norms, target, np.concatenate([edges[target], offered], 1), slack, graph.degree)
    return edges[:n].astype(np.int32), start


def usable(c: str) -> Column:
    """Not null, not empty, not zero, without null or non-finite components."""
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(c).isNotNull() & good & F.exists(c, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, members: int) -> DataFrame:
    """dim, vid (the least vec_id), vector, members (the `members` least vec_ids) for each distinct usable vector.

    Ranked first within 32 salts, so copies of one vector that are a third of all rows spread over tasks."""
    rows = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("vec_id IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    in_salt, in_all = Window.partitionBy("vector", "salt").orderBy("vec_id"), Window.partitionBy("vector").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "vector"]).withColumn("at", F.row_number().over(in_salt)).where(F.col("at") <= members)
    few = few.withColumn("at", F.row_number().over(in_all)).where(F.col("at") <= members)
    each = few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    return each.select(F.size("vector").alias("dim"), F.col("members")[0].alias("vid"), "vector", "members")


INDEX = "dim int, shard int, vid long, at int, vector array<double>, edges array<int>, start int"


def build_index(points: DataFrame, shards: int, graph: Graph = Graph()) -> DataFrame:
    """The graph of every shard, a row for each point, written to the shared folder."""

    def run(t: pa.Table) -> pa.Table:
        x = np.stack(t["vector"].to_numpy())
        edges, start = build(x, graph)
        return pa.table(
            {
                "dim": t["dim"], "shard": t["shard"], "vid": t["vid"], "at": pa.array(np.arange(len(x)), pa.int32()),
                "vector": t["vector"], "edges": pa.array(list(edges), pa.list_(pa.int32())), "start": pa.array(np.full(len(x), start), pa.int32()),
            }
        )

    dealt = points.select("dim", F.pmod(F.xxhash64("vid"), F.lit(shards)).cast("int").alias("shard"), "vid", "vector")
    return stored(dealt.groupBy("dim", "shard").applyInArrow(run, INDEX))


def search_index(index: DataFrame, queries: DataFrame, shards: int, *, k: int, beam: int, width: int, block_rows: int = 8192) -> DataFrame:
    """qid, vid, score of the k nearest points that the beam finds in each shard, for queries (dim, qid, vector)."""
    blocks = max(1, -(-queries.count() // block_rows))

    def run(key: tuple, points: pa.Table, asked: pa.Table) -> pa.Table:
        kind = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("score", pa.float64())])
        if not len(points) or not len(asked):
            return kind.empty_table()
        points = points.sort_by("at")
        x, vid = np.stack(points["vector"].to_numpy()), points["vid"].to_numpy()
        edges, start = np.vstack([np.stack(points["edges"].to_numpy()), np.full((1, len(points["edges"][0])), len(x))]), points["start"][0].as_py()
        flat = np.vstack([x, np.zeros((1, x.shape[1]))]).astype(np.float32)
        norms, out = np.einsum("rd,rd->r", flat, flat), []
        q, qid = np.stack(asked["vector"].to_numpy()), asked["qid"].to_numpy()
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            ids, _ = beam_search(flat, norms, edges, start, part.astype(np.float32), beam, width)
            exact = np.sqrt(((x[np.minimum(ids, len(x) - 1)] - part[:, None, :]) ** 2).sum(2))
            exact[ids == len(x)] = np.inf
            name = np.append(vid, np.iinfo(np.int64).max)[ids]
            best = np.lexsort((name, exact), axis=1)[:, :k]
            got = np.take_along_axis(exact, best, 1)
            real = got < np.inf
            out.append((np.repeat(qid[at : at + 256], best.shape[1]).reshape(best.shape)[real], np.take_along_axis(name, best, 1)[real], got[real]))
        return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(kind.names)}, schema=kind)

    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = queries.select("dim", every, F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), "qid", "vector")
    held = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")) if blocks > 1 else index.withColumn("block", F.lit(0))
    pairs = held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block"))
    return pairs.applyInArrow(run, "qid long, vid long, score double")


def nearest(vectors: DataFrame, asked: Column, *, k: int = 10, shard_rows: int = 8192, beam: int = 96, graph: Graph = Graph()) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) for which the column
    `asked` holds, its k nearest other rows by Euclidean distance, ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; only those of
    one length are compared. Equal vectors are distinct candidates; a vec_id given twice with one vector
    counts once. Fewer candidates than k: all of them. Other columns are not looked at."""
    points = stored(distinct_vectors(vectors, k + 1))
    shards = max(1, -(-points.count() // shard_rows))
    index = build_index(points, shards, graph)
    rows = vectors.where(asked & usable("embedding")).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).distinct()
    named = stored(rows.join(points.select("vector", F.col("vid").alias("qid"), "dim"), "vector"))
    queries = named.select("dim", "qid", "vector").dropDuplicates(["qid"])
    found = search_index(index, queries, shards, k=k + 1, beam=max(beam, k + 1), width=graph.width)
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vid"))).where(F.col("place") <= k + 1)
    each = best.join(points.select("vid", "members"), "vid").select("qid", "score", F.explode("members").alias("vec_id"))
    mine = named.select("query_id", "qid").join(each, "qid").where("vec_id <> query_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
