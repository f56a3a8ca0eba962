"""Exact top-k inner products of integer vectors by a Voronoi kNN join.

Inner products become distances by one more coordinate: with M the largest norm of the data, x' = (x, sqrt(M^2 - |x|^2))
and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 qx. Every vector belongs to the cell of its nearest pivot. From a
summary of the cells (the distances of their k + 1 innermost vectors to the pivot) each query gets a distance within which
its k nearest must lie. Queries are grouped by neighbouring cells into groups of bounded size; a group needs of each cell
only the ring of vectors whose distance to the pivot some query's bound reaches (triangle inequality), and only those are
replicated to it. A group's share is dealt into chunks of bounded size, and (group, chunk) is solved locally: cells that
the bisecting hyperplane or the ring excludes at the bound reached so far are skipped, the others multiplied exactly.

Distances are doubles and only bound the search, with a margin (``slack``) far above their rounding; scores are integers
throughout. Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so the others leave before the
shuffle and no vector makes a cell hot.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsudoi.llm.common import checkpointed, scratch, stored

SCALE, PIVOTS, CELL_ROWS = 256, 256, 512
GROUP_ROWS, CHUNK_ROWS = 8192, 8192
RESULT = "query_id long, rank int, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component; rows without id, vector or with null or non-finite components are out."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id is not null and v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select("id", F.transform(v, lambda x: F.floor(x * scale)).alias("v")).distinct()


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), kind)
    out[np.repeat(np.arange(len(column)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = column.flatten().to_numpy()
    return out


class Space:
    """The pivots and all that is needed to measure distances to them."""

    def __init__(self, pivots: pa.Table, width: int, norm2: int):
        # doubles multiply integers exactly as long as no partial sum passes 2**53
        self.kind = np.float64 if norm2 < 1 << 52 else np.int64
        self.width, self.norm2 = width, norm2
        self.p = matrix(pivots.column("v"), width, self.kind)
        self.lift = self.lifts(self.p)
        self.slack = 1e-6 * max(1.0, math.sqrt(norm2))
        self.apart = self.distances(self.p, self.lift)

    def rows(self, column) -> np.ndarray:
        return matrix(column, self.width, self.kind)

    def lifts(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((self.norm2 - (x * x).sum(axis=1)).astype(float), 0))

    def distances(self, x: np.ndarray, lift: np.ndarray | float = 0.0) -> np.ndarray:
        """From each row to each pivot; queries have lift zero."""
        flat = ((x * x).sum(axis=1)[:, None] + (self.p * self.p).sum(axis=1)[None, :] - 2 * (x @ self.p.T)).astype(float)
        return np.sqrt(flat + (np.reshape(lift, (-1, 1)) - self.lift[None, :]) ** 2)


def neighbouring(points: np.ndarray) -> list[int]:
    """An order of the points in which neighbours are close: halves of the widest side, again and again."""
    if len(points) <= 1:
        return list(range(len(points)))
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) == 1:
            out.append(int(rows[0]))
            continue
        mine = points[rows]
        order = rows[np.argsort(mine[:, int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))], kind="stable")]
        stack += [order[len(order) // 2:], order[:len(order) // 2]]
    return out


def merged(best: np.ndarray, names: np.ndarray, s: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (best, names) and the scores s of ids for each query; own: cells of s that don't count."""
    k = best.shape[1]
    lowest = np.iinfo(np.int64).min
    s = np.where(own, lowest, s)
    if s.shape[1] > k:
        floor_ = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    else:
        floor_ = np.full(len(s), lowest)
    row, col = np.nonzero((s >= np.maximum(floor_, best[:, -1])[:, None]) & (s > lowest))
    rows = np.concatenate((np.repeat(np.arange(len(s)), k), row))
    scores, who = np.concatenate((best.ravel(), s[row, col])), np.concatenate((names.ravel(), ids[col]))
    order = np.lexsort((who, -np.maximum(scores, lowest + 1), rows))
    rows, scores, who = rows[order], scores[order], who[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    keep = place < k
    return scores[keep].reshape(-1, k), who[keep].reshape(-1, k)


def solve(space: Space, near: pa.Table, asked: pa.Table, k: int, block: int = 128) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best of ``near`` for each row of ``asked``, and how many products were formed."""
    near = near.sort_by([("cell", "ascending"), ("r", "ascending")])
    x, ids, marks, cell, r = space.rows(near.column("v")), *(near.column(c).to_numpy() for c in ("id", "mark", "cell", "r"))
    q, q_ids, q_marks, limit = space.rows(asked.column("v")), *(asked.column(c).to_numpy() for c in ("id", "mark", "theta"))
    limit = limit.copy()
    away = space.distances(q)
    home = away.argmin(axis=1)
    base = ((q * q).sum(axis=1)).astype(float) + space.norm2
    lowest = np.iinfo(np.int64).min
    best, names = np.full((len(q), k), lowest), np.full((len(q), k), np.iinfo(np.int64).max)
    cells, first = np.unique(cell, return_index=True)
    ends = np.append(first[1:], len(cell))
    products = 0
    for n in np.argsort(away[:, cells].min(axis=0), kind="stable").tolist():
        c, a, b = int(cells[n]), int(first[n]), int(ends[n])
        gap = space.apart[home, c]
        plane = np.where(gap > 0, (away[:, c] ** 2 - away[np.arange(len(q)), home] ** 2) / (2 * np.where(gap > 0, gap, 1)), 0)
        who = np.flatnonzero((plane <= limit + space.slack) & (away[:, c] - limit <= r[b - 1] + space.slack) & (away[:, c] + limit >= r[a] - space.slack))
        for at in range(0, len(who), block):
            w = who[at:at + block]
            low = a + int(np.searchsorted(r[a:b], (away[w, c] - limit[w]).min() - space.slack, "left"))
            high = a + int(np.searchsorted(r[a:b], (away[w, c] + limit[w]).max() + space.slack, "right"))
            if low >= high:
                continue
            s = (q[w] @ x[low:high].T).astype(np.int64)
            products += s.size
            own = (q_ids[w][:, None] == ids[None, low:high]) & (q_marks[w][:, None] == marks[None, low:high])
            best[w], names[w] = merged(best[w], names[w], s, ids[low:high], own)
            kth = best[w, -1]
            reached = np.sqrt(np.maximum(base[w] - 2 * np.maximum(kth, -(1 << 62)).astype(float), 0))
            limit[w] = np.where(kth > lowest, np.minimum(limit[w], reached + space.slack), limit[w])
    return best, names, products


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = SCALE, pivots: int = PIVOTS,
            cell_rows: int = CELL_ROWS, group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k other rows of largest integer
    inner product, all others if there are fewer; equal scores by smaller id.

    Rows without an id, null vectors and those with null or non-finite components take no part; zero and empty vectors do.
    A shorter vector counts as filled up with zeros. Rows that repeat both id and vector are one row; rows that repeat an id
    with another vector are rows of their own, each with its own answer. Extra columns are ignored; an empty table, or one
    without queries, gives an empty one. Scores must fit 64 bits; an error says so if the largest squared norm doesn't.
    At most ``pivots`` pivots, one for each ``cell_rows`` rows, are taken by hash of the vector.
    """
    spark, rows = vectors.sparkSession, checkpointed(integers(vectors, id_col, vector_col, scale))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    mark = F.xxhash64("v").alias("mark")
    data = rows.withColumn("place", place).where(F.col("place") <= k + 1).select("id", "v", mark)
    queries = rows.where(F.col("id") % every == 0).select("id", "v", mark)
    size = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, y: (a + y.cast("decimal(19,0)") * y).cast("decimal(38,0)"))
    stats = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), F.max(F.size("v")).alias("d"), F.max(size).alias("norm2")).first()
    if not stats["q"]:
        return spark.createDataFrame([], RESULT)
    if stats["norm2"] is None or stats["norm2"] >= 1 << 62:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    count = max(1, min(pivots, stats["n"] // cell_rows))
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(count).toArrow()
    space = Space(chosen, max(1, stats["d"]), int(stats["norm2"]))

    def placed(batches):
        for batch in batches:
            x = space.rows(batch.column("v"))
            away = space.distances(x, space.lifts(x))
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(x)), cell])], names=["id", "v", "mark", "cell", "r"])
    data = checkpointed(data.mapInArrow(placed, "id long, v array<long>, mark long, cell int, r double"))
    inner = F.row_number().over(Window.partitionBy("cell").orderBy("r"))
    summary = data.select("cell", "r").withColumn("t", inner).where(F.col("t") <= k + 1).toArrow()  # k + 1 distances of each pivot
    cell, r = summary.column("cell").to_numpy(), summary.column("r").to_numpy()

    def bounded(batches):
        for batch in batches:
            away = space.distances(space.rows(batch.column("v")))
            reach = away[:, cell] + r[None, :]
            theta = np.partition(reach, k, axis=1)[:, k] if len(cell) > k else np.full(len(away), np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(axis=1).astype(np.int32)), pa.array(theta)], names=["id", "v", "mark", "cell", "theta"])
    queries = checkpointed(queries.mapInArrow(bounded, "id long, v array<long>, mark long, cell int, theta double"))
    asked = {row["cell"]: row["count"] for row in queries.groupBy("cell").count().collect()}  # a row for each pivot at most
    before, start = 0, np.zeros(count)
    for c in neighbouring(space.p):
        start[c] = before
        before += asked.get(c, 0)
    where = np.array([asked.get(c, 0) for c in range(count)], float)

    def grouped(batches):
        for batch in batches:
            c = batch.column("cell").to_numpy()
            spread = (batch.column("mark").to_numpy() ^ batch.column("id").to_numpy()).view(np.uint64).astype(float) / 2.0 ** 64
            group = ((start[c] + np.minimum(spread, 0.999999) * where[c]) // group_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "v", "mark", "theta")), pa.array(group)], names=["id", "v", "mark", "theta", "g"])
    queries = queries.mapInArrow(grouped, "id long, v array<long>, mark long, theta double, g long")

    def rings(batches):
        for batch in batches:
            away, theta, g = space.distances(space.rows(batch.column("v"))), batch.column("theta").to_numpy()[:, None], batch.column("g").to_numpy()
            for one in np.unique(g).tolist():
                mine = g == one
                low, high = (away[mine] - theta[mine]).min(axis=0) - space.slack, (away[mine] + theta[mine]).max(axis=0) + space.slack
                yield pa.RecordBatch.from_arrays([pa.array(np.full(count, one)), pa.array(np.arange(count, dtype=np.int32)), pa.array(low), pa.array(high)], names=["g", "cell", "low", "high"])
    # written, so that its true size decides whether it is broadcast
    ring = stored(queries.mapInArrow(rings, "g long, cell int, low double, high double").groupBy("g", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")), scratch(spark, "rings"))
    chunks = max(1, -(-stats["n"] // chunk_rows))
    needed = data.join(ring, "cell").where(F.col("r").between(F.col("low"), F.col("high"))).select("g", F.pmod(F.xxhash64("id", "mark"), F.lit(chunks)).alias("chunk"), "id", "v", "mark", "cell", "r")
    sent = queries.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "id", "v", "mark", "theta")

    def run(near: pa.Table, wanted: pa.Table) -> pa.Table:
        if not near.num_rows or not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "q_mark": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        best, names, _ = solve(space, near, wanted, k)
        have = best > np.iinfo(np.int64).min
        many = have.sum(axis=1)
        return pa.table({"query_id": np.repeat(wanted.column("id").to_numpy(), many), "q_mark": np.repeat(wanted.column("mark").to_numpy(), many), "vec_id": names[have], "score": best[have]})
    found = needed.groupBy("g", "chunk").cogroup(sent.groupBy("g", "chunk")).applyInArrow(run, "query_id long, q_mark long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_mark").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
