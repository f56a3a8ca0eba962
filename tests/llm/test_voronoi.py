import numpy as np
import pyarrow as pa
import pytest

from tsudoi.llm import voronoi


def plain(rows, k, every):
    """Rows (id, vector) -> (query_id, rank, vec_id, score), by comparing all."""
    ints = list(dict.fromkeys((i, tuple(int(np.floor(np.float64(x) * 256)) for x in v)) for i, v in rows
                              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)))
    out = []
    for n, (i, q) in enumerate(ints):
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, x)), j) for m, (j, x) in enumerate(ints) if m != n)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "a", "b", 1.0) for i, v in rows], "vec_id long, embedding array<float>, v string, cell string, r double")
    return sorted(tuple(r) for r in voronoi.nearest(df, **options).collect())


def vectors(n, d=6, seed=1, clusters=5):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, d)) * 3
    return [(i, (centres[r.integers(clusters)] + 0.2 * r.standard_normal(d)).astype(np.float32).tolist()) for i in range(n)]


def test_against_all_pairs(spark):
    rows = vectors(300) + [(1000 + i, vectors(1, seed=2)[0][1]) for i in range(40)]  # a vector that many ids share
    assert run(spark, rows, every=10) == plain(rows, 5, 10)
    # small cells, groups and chunks
    assert run(spark, rows, every=10, cell_rows=20, group_rows=7, chunk_rows=50) == plain(rows, 5, 10)


def test_odd_rows(spark):
    v = vectors(20, 4)
    rows = v + [(None, v[0][1]), (50, None), (51, [1.0, None, 2.0, 3.0]), (52, [float("nan")] * 4), (100, [float("inf"), 0.0, 0.0, 0.0]), (150, [0.0] * 4), (200, [1.0]), (0, v[3][1]), (0, v[0][1]), (250, [])]
    assert run(spark, rows, every=50) == plain(rows, 5, 50)
    assert run(spark, []) == [] and run(spark, [(0, [1.0, 2.0])]) == [] and run(spark, v[1:], every=50) == []
    assert run(spark, [(0, [1.0]), (50, [2.0])]) == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-100_000, 100_000, 3)]) for i in range(60)]  # products beyond 2**53
    assert run(spark, rows, every=6) == plain(rows, 5, 6)
    with pytest.raises(ValueError):
        run(spark, [(0, [1e30]), (1, [1.0])])


def test_bounds_skip_work():
    rows = vectors(4000, 8, clusters=20)
    x = np.array([[np.floor(np.float64(c) * 256) for c in v] for _, v in rows]).astype(np.int64)
    lists = lambda a: pa.array(a.tolist(), pa.list_(pa.int64()))
    space = voronoi.Space(pa.table({"v": lists(x[:40])}), 8, int((x * x).sum(axis=1).max()))
    f = x.astype(float)
    away = space.distances(f, space.lifts(f))
    near = pa.table({"id": np.arange(4000), "v": lists(x), "mark": np.zeros(4000, np.int64), "cell": away.argmin(axis=1), "r": away.min(axis=1)})
    asked = pa.table({"id": np.arange(0, 4000, 50), "v": lists(x[::50]), "mark": np.zeros(80, np.int64), "theta": np.full(80, np.inf)})
    scores, ids, products = voronoi.solve(space, near, asked, 5)
    s = x[::50] @ x.T
    s[np.arange(80), np.arange(0, 4000, 50)] = -(1 << 62)
    assert (scores == -np.sort(-s, axis=1)[:, :5]).all() and products < 0.5 * s.size
