import math
import random
import re

import numpy as np

from tests.llm import cases
from tsudoi.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, k=10):
    every = [(i, terms(t)) for i, t in docs]
    held = [w for _, w in every if w]
    N, L = len(held), sum(map(len, held))
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        found = []
        for i, w in every:
            m = w and 10 + (90 * len(w) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * sum(t in x for x in sets(held)) + 1))) * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 8 * m))
                        for t in set(terms(text)) & set(w))
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


_sets = {}


def sets(held):
    if id(held) not in _sets:
        _sets.clear()
        _sets[id(held)] = [set(w) for w in held]
    return _sets[id(held)]


def run(spark, docs, items, **options):
    b = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in items], "item_id long, text string, id string, item string, score int")
    return sorted((tuple(r) for r in balltree.ranked(cases.docs(spark, docs), b, **options).collect()), key=repr)


def corpus(n=150, seed=5):
    r = random.Random(seed)
    docs = [(i, " ".join(f"W{int(r.paretovariate(0.7)) % 300}{r.choice(['', ',', '.', '-', ' 9'])}" for _ in range(r.randrange(1, 80)))) for i in range(n)]
    return docs + [(n + i, docs[3][1]) for i in range(12)]  # ties beyond the ten


def test_against_all_documents(spark):
    docs = corpus()
    items = [(1, docs[3][1]), (2, "w1 W2 w250"), (2, "w1, w299; zzz"), (2, "w1 W2 w250"), (3, "nothing here"), (4, None), (5, ""), (6, docs[50][1] + " über w7")]
    docs += [(900, "ÜBER über Über w7"), (901, "x" * 300_000 + " w250"), *cases.odd_rows()]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, block_bytes=60, k=3) == plain(docs, items, 3)  # many blocks


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, corpus(5), []) == [] and run(spark, [(1, None), (2, " .")], [(1, "a")]) == []


def test_trees_leave_documents_out():
    """Documents of separate topics: a search opens few of their balls, and finds what a full product finds."""
    r = np.random.default_rng(2)
    row = np.repeat(np.arange(3000), 12)
    term = (r.integers(0, 40, len(row)) + 40 * (row % 30)).astype(np.int64)
    pair = np.unique(row * 1200 + term)
    row, term = pair // 1200, pair % 1200
    value = r.integers(1, 1000, len(row)).astype(np.int64)
    items = balltree.Items(list(range(60)), np.arange(0, 305, 5), np.concatenate([np.sort(r.choice(40, 5, False)) + 40 * (i % 30) for i in range(60)]), None)
    best, place = balltree.Best(60, 10), np.full(1200, -1, np.int64)
    formed = balltree.search(balltree.Shard(np.arange(3000), row, term, value), items, best, place)
    dense = np.zeros((3000, 1200), np.int64)
    dense[row, term] = value
    asked = np.zeros((60, 1200), np.int64)
    for i in range(60):
        asked[i, items.term[items.first[i]:items.first[i + 1]]] = 1
    scores = asked @ dense.T
    order = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    assert (best.id == order).all() and (best.score == np.take_along_axis(scores, order, axis=1)).all()
    assert formed < 0.5 * scores.size


def test_bounds_hold():
    r = np.random.default_rng(4)
    row, term = np.repeat(np.arange(200), 9), r.integers(0, 60, 1800)
    pair = np.unique(row * 60 + term)
    shard = balltree.Shard(np.arange(200), pair // 60, pair % 60, r.integers(1, 10**9, len(pair)).astype(np.int64), leaf=8)
    for n in range(len(shard.balls)):
        t, centroid, along, radius = shard.bounds_of(n)
        start, end, _ = shard.balls[n]
        x = np.zeros((end - start, 60))
        a, b = np.searchsorted(shard.row, (start, end))
        x[shard.row[a:b] - start, shard.term[a:b]] = shard.value[a:b]
        assert np.linalg.norm(x[:, t] - centroid, axis=1).max() <= radius * (1 + 1e-9) + 1 and (x[:, t].max(axis=0) <= centroid + along + 1).all()
