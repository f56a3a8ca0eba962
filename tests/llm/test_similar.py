import random

import numpy as np

from tests.llm import cases
from tsudoi.llm import similar


def grams(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Smallest id of each group of rows linked by five-word Jaccard of at least 0.8."""
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * same >= 4 * every and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    return {min(i for x, (i, _) in zip(label, rows) if x == l) for l in set(label)}


def edited(n, seed=8):
    """Groups of a text and copies with one to six words replaced."""
    r, out = random.Random(seed), []
    for g in range(n):
        base = cases.words(700 + g, 200).split()
        out.append((10 * g, " ".join(base)))
        for c in range(1, 5):
            w = list(base)
            for _ in range(r.randrange(1, 7)):
                w[r.randrange(len(w))] = f"new{g}x{c}"
            out.append((10 * g + c, " ".join(w)))
    return out


def test_edited_copies_go(spark):
    rows = edited(25) + [(1000 + k, cases.words(2000 + k, 30)) for k in range(40)] + [(2000, "a b c"), (2001, "A  b c"), (2002, "a b d"), (2003, None), (2004, " ")]
    want = plain_kept(rows)
    df = cases.docs(spark, rows)
    kept = similar.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want
    assert {r.doc_id for r in similar.keep_one(df, block_rows=40).collect()} == want  # blocks meet each other


def test_stage_uses_it(spark):
    import corpus_pipeline
    rows = edited(10)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, cases.docs(spark, rows), "").collect()} == plain_kept(rows)


def test_one_id_with_two_texts(spark):
    a, b = cases.words(1, 40), cases.words(2, 40)
    kept = similar.keep_one(cases.docs(spark, [(3, a), (5, a), (5, b), (None, None), (None, None)]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, a), (5, b), (None, None)], key=repr)
    assert similar.keep_one(cases.docs(spark, [])).count() == 0


def test_near_finds_all_pairs():
    r = np.random.default_rng(4)
    fp = r.integers(0, 1 << 63, 60, dtype=np.int64)
    fp = np.concatenate((fp, fp ^ (1 << r.integers(0, 62, 60)), fp ^ 7))
    n, k = r.integers(50, 70, len(fp)), np.arange(len(fp))
    block = similar.Block(__import__("pyarrow").table({"k": k, "fp": fp, "fp2": fp ^ 1, "n": n, "label": k // 3}))
    got = {(int(block.k[q]), int(block.k[x])) for qs, xs in similar.near(block, block, 12, 18, 0.8, True, rows=7, most=11) for q, x in zip(qs, xs)}
    want = {(a, b) for a in range(len(fp)) for b in range(len(fp)) if (n[b], b) < (n[a], a) and n[b] >= 0.8 * n[a] and a // 3 != b // 3 and (int(fp[a]) ^ int(fp[b])).bit_count() <= 9}
    assert got == want and want


def test_sketches_bound_the_difference():
    r = np.random.default_rng(6)
    for n, d in ((50, 0), (50, 9), (300, 70), (2000, 400)):
        a = r.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate((a[d:], r.integers(0, 1 << 62, d).astype(np.uint64)))
        apart = int(np.bitwise_count(similar.odd_sketch(a) ^ similar.odd_sketch(b)).sum())
        assert apart <= 2 * d and (d == 0) == (apart == 0)


def test_trees_find_what_a_scan_finds():
    r = np.random.default_rng(9)
    fp = np.concatenate((r.integers(0, 1 << 63, 300), np.full(40, 5))).astype(np.uint64)
    fp[100:200] = fp[:100] ^ (np.uint64(1) << r.integers(0, 62, 100).astype(np.uint64))
    tree = similar.Tree(fp, 20, 330, bucket=6)
    assert len(tree.root) == 4  # a pivot with children, not one bucket
    for radius, low, high in ((0, 20, 330), (3, 0, 400), (22, 20, 330), (30, 50, 260)):
        got = [(int(q), int(x), int(d)) for qs, xs, ds in tree.search(fp, radius, low, high, 4) for q, x, d in zip(qs, xs, ds)]
        want = {(q, x): (int(fp[q]) ^ int(fp[x])).bit_count() for q in range(len(fp)) for x in range(max(20, low), min(330, high))}
        assert sorted(got) == sorted((q, x, d) for (q, x), d in want.items() if d <= radius)


def test_blocks_are_trees_of_shards():
    r = np.random.default_rng(4)
    fp = r.integers(0, 1 << 63, 200, dtype=np.int64)
    fp = np.concatenate((fp, fp ^ 7))
    table = __import__("pyarrow").table({"k": np.arange(400), "fp": fp, "fp2": fp, "n": r.integers(50, 70, 400), "label": np.arange(400)})
    whole, cut = similar.Block(table), similar.Block(table, shard_rows=64, bucket=5)
    assert [(t.low, t.high) for t in cut.trees()] == [(low, min(low + 64, 400)) for low in range(0, 400, 64)]
    for every in (True, False):
        a, b = ({(int(x), int(y)) for qs, xs in similar.near(block, block, 22, 36, 0.8, every, rows=9) for x, y in zip(qs, xs)} for block in (whole, cut))
        assert a == b and a
