import numpy as np

from tsudoi.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def exact(rows, k=20):
    clean = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            v = np.array(v, np.float32).astype(float).tolist()
            clean[i] = min(clean.get(i, v), v)
    size = max((len(v) for v in clean.values()), default=0)
    full = {i: np.pad(np.array(v), (0, size - len(v))) for i, v in clean.items()}
    return {q: sorted(((-float(full[q] @ v), i) for i, v in full.items() if i != q))[:k] for q in full if q % 20 == 0}


def test_recall_and_scores(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((3000, 24))
    x *= np.linspace(0.5, 2, 3000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = exact(rows)
    got = {}
    for row in ann.nearest(table(spark, rows), shard_rows=500, block_rows=60).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    hit = sum(len({i for i, _ in got[q].values()} & {i for _, i in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.95
    full = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(abs(s - full[q] @ full[i]) < 1e-9 for q, g in got.items() for i, s in g.values())


def test_search_stops_early():
    r = np.random.default_rng(1)
    centres = 30 * r.standard_normal((40, 16))
    x = centres[np.arange(4000) % 40] + r.standard_normal((4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    found, scores, verified = ann.search(np.arange(4000), x, np.arange(0, 4000, 20), x[::20], 1.0, 20, 8, 0.95, 64, 7)
    best = np.sort(np.where(np.eye(4000, dtype=bool)[::20], -np.inf, x[::20] @ x.T), axis=1)[:, -20:]
    assert verified < 0.35 * 200 * 4000 and (scores >= best[:, :1] - 1e-12).mean() > 0.9


def test_edges(spark):
    same = [1.0, 0.0, 2.0]
    rows = [(i, same) for i in range(100)] + [(100, None), (101, [0.0, 0.0, 0.0]), (120, [float("nan"), 1.0, 1.0]), (140, [float("inf"), 1.0, 1.0]), (160, [None, 1.0, 1.0]), (None, same), (180, [5.0]), (180, [5.0]), (181, [])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(table(spark, rows)).collect())
    want = sorted((q, n + 1, i, -s) for q, best in exact(rows).items() for n, (s, i) in enumerate(best))
    assert got == want
    assert ann.nearest(table(spark, [])).count() == 0
    few = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table(spark, [(20, [1.0]), (21, [2.0]), (22, [-1.0])])).collect()]
    assert sorted(few) == [(20, 1, 21), (20, 2, 22)]
    assert ann.nearest(table(spark, [(20, [1.0])])).count() == 0


def test_chi_square():
    assert abs(float(ann.chi_square_cdf(np.array(15.507), 8)) - 0.95) < 1e-4
