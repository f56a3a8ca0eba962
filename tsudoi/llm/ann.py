"""Nearest neighbours by stable low-dimensional projections under a kd-tree and a chi-square stopping test.

Inner products become distances by one more coordinate: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 qx, so the nearest are those of largest inner product. Gaussian (2-stable)
directions map x' to m numbers; for a pair at distance d the squared projected distance divided by d^2 follows a
chi-square law with m degrees of freedom. A kd-tree over the projections hands out points by growing projected distance,
a leaf at a time; each is verified by its exact inner product. The search stops when the chi-square probability of the
next projected distance, at the distance of the k-th best so far, reaches ``sure``: a point not yet seen that is nearer
than that has been missed with probability 1 - sure at most.

The data are dealt to shards and the queries to blocks of bounded size; every block meets every shard once, in a task of
its own, and keeps its k best of that shard. Of vectors that are equal in all components only the k + 1 with the smallest
ids can be among anyone's k nearest, so the others leave before the shuffle and no vector makes a shard hot.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS, SURE, LEAF, SEED = 8, 0.95, 128, 7
SHARD_ROWS, BLOCK_ROWS = 8192, 1024


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    h = np.minimum(np.asarray(x, float) / 2, 700)
    return 1 - np.exp(-h) * sum(h ** i / math.factorial(i) for i in range(m // 2))


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of each leaf: median cuts of the widest side."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        mine = points[rows]
        axis = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
        order = np.argpartition(mine[:, axis], len(rows) // 2)
        stack += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, norm: float, k: int, m: int, sure: float, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of the k best of x for each query, padded with -1 and -inf, and how many points were verified."""
    directions = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, m))
    lift = np.sqrt(np.maximum(norm ** 2 - (x ** 2).sum(axis=1), 0))
    px, pq = x @ directions[:-1] + lift[:, None] * directions[-1], q @ directions[:-1]
    leaves = kd_leaves(px, leaf)
    low, high = np.array([px[r].min(axis=0) for r in leaves]), np.array([px[r].max(axis=0) for r in leaves])
    bound = np.stack([(np.maximum(np.maximum(a - pq, pq - b), 0) ** 2).sum(axis=1) for a, b in zip(low, high)], axis=1)  # squared distance to boxes
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
    base = (q ** 2).sum(axis=1) + norm ** 2
    active, at, step, verified = np.arange(len(q)), 0, 2, 0
    while len(active) and at < len(leaves):
        turn = order[active, at:at + step]
        for n in np.unique(turn).tolist():
            who = active[(turn == n).any(axis=1)]
            rows = leaves[n]
            s = q[who] @ x[rows].T
            verified += s.size
            s[query_ids[who][:, None] == ids[rows][None, :]] = -np.inf
            better = s.max(axis=1) >= scores[who, -1]
            who, s = who[better], s[better]
            if len(who):
                both = np.concatenate((scores[who], s), axis=1)
                names = np.concatenate((found[who], np.broadcast_to(ids[rows], s.shape)), axis=1)
                names = np.where(np.isneginf(both), -1, names)
                best = np.lexsort((names, -both), axis=-1)[:, :k]
                scores[who], found[who] = np.take_along_axis(both, best, axis=1), np.take_along_axis(names, best, axis=1)
        at += step
        step *= 2
        if at < len(leaves):
            far = np.maximum(base[active] - 2 * scores[active, -1], 1e-12)
            active = active[chi_square_cdf(bound[active, at] / far, m) < sure]
    return found, scores, verified


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one row for each id; null, zero and non-finite vectors, those with null components and rows without id are out.

    Rows that repeat an id count as one, the smallest vector by order of components.
    """
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where("id is not null and v is not null").where(F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, directions: int = DIRECTIONS, sure: float = SURE,
            leaf: int = LEAF, seed: int = SEED, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` its k best others found, best first.

    Ties go to the smaller id. A shorter vector counts as filled up with zeros. With fewer than k others, all come. Extra
    columns are ignored; an empty table gives an empty one.
    """
    if directions % 2:
        raise ValueError("an even number of directions is needed")
    rows = usable(vectors, id_col, vector_col)
    stats = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), F.max(F.size("v")).alias("d"),
                     F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    shards, blocks, size, norm = max(1, -(-stats["n"] // shard_rows)), max(1, -(-stats["q"] // block_rows)), stats["d"] or 1, math.sqrt(stats["norm2"] or 0.0)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    data = rows.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = rows.where(F.col("id") % every == 0).select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def matrix(part: pa.Table) -> np.ndarray:
        column = part.column("v").combine_chunks()
        length = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(column), size))
        out[np.repeat(np.arange(len(column)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = column.flatten().to_numpy()
        return out

    def run(near: pa.Table, asked: pa.Table) -> pa.Table:
        q_ids = asked.column("id").to_numpy()
        if not near.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found, scores, _ = search(near.column("id").to_numpy(), matrix(near), q_ids, matrix(asked), norm, k, directions, sure, leaf, seed)
        have = ~np.isneginf(scores)
        return pa.table({"query_id": np.repeat(q_ids, have.sum(axis=1)), "vec_id": found[have], "score": scores[have]})
    found = data.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
