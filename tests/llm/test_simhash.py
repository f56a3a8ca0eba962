import random

import numpy as np
import xxhash

from tests.llm import cases
from tsudoi.llm import simhash
from tsudoi.llm.components import components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, radius=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    first = {}
    for x, (i, _) in zip(label, rows):
        first[x] = i if first.get(x) is None else first[x] if i is None else min(i, first[x])
    return sorted(((i, f, first[x]) for (i, _), f, x in zip(rows, fps, label)), key=repr)


def near_copies(n, seed=3):
    r = random.Random(seed)
    base = cases.words(9, 300).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"new{k}"
        out.append((100 + k, " ".join(w)))
    return out


def result(df):
    return sorted(((r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in df.collect()), key=repr)


def test_against_all_pairs(spark):
    rows = cases.odd_rows() + near_copies(60) + [(500 + k, cases.words(50 + k, 30)) for k in range(40)]
    want = plain_components(rows)
    df = cases.docs(spark, rows)
    assert result(simhash.near_duplicates(df)) == want
    assert result(simhash.near_duplicates(df, shard_rows=3)) == want  # chunks of shards meet too


def test_empty_table(spark):
    df = cases.docs(spark, [])
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_keep_one(spark):
    rows = cases.odd_rows() + near_copies(30)
    df = cases.docs(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = {c for _, _, c in plain_components(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(g for g in groups if g is not None)
    assert ids.count(None) == 1  # one component has documents without an id only


def test_tree_finds_all_pairs():
    r = np.random.default_rng(5)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp[100:] = fp[r.integers(0, 100, 200)] ^ (np.uint64(1) << r.integers(0, 63, 200).astype(np.uint64))
    fp = np.unique(fp)
    tree = simhash.Tree(fp, np.zeros(len(fp), np.int64), np.arange(len(fp)))
    got = {(min(a, b), max(a, b)) for q, n in tree.search(np.arange(len(fp)), 4, most=50) for a, b in zip(q.tolist(), n.tolist())}
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= 4}
    assert got == want


def test_components_of_a_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got.get(x, x) for x in order} == {0} and got[101] == 100 and 200 not in got


def test_keep_one_of_one_id_with_two_texts(spark):
    a, b = cases.words(1, 40), cases.words(2, 40)
    kept = simhash.keep_one(cases.docs(spark, [(5, a), (3, a), (5, b)]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, a), (5, b)]
