import re

from tests.llm import cases
from tsudoi.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, bench):
    windows = {}
    for item, text in bench:
        w = tokens(text)
        for k in range(max(1, len(w) - 9) if w and item is not None else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, items = tokens(text), set(), set()
        for win, of in windows.items():
            n = len(win)
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) == win:
                    hit.update(range(k, k + n))
                    items |= of
        out.append((i, len(w), len(hit), sorted(items), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=repr)


def fixture(spark):
    a, b = cases.words(11, 25), cases.words(12, 14)
    bench = [(1, a), (2, b), (3, "Tiny item"), (4, None), (5, ""), (6, "one"), (7, a.upper()), (None, cases.words(2, 50)), (2, "second text of item two, rather short"), (8, "x x x x x x x x x x x x")]
    w = a.split()
    docs = cases.odd_rows() + [
        (20, f"lead {a} tail"), (21, " ".join(w[3:13]) + " cut " + " ".join(w[8:18])), (22, " ".join(w[:9])), (23, f"{b.upper()}, {b}"), (24, "a tiny, ITEM; one"),
        (25, "second text of item two, rather short"), (26, "x " * 40), (27, "tiny"), (28, "item tiny"), (29, " ".join(w[5:25]) + " " + a)]
    return cases.docs(spark, docs), docs, spark.createDataFrame([(i, t, "clash") for i, t in bench], "item_id long, text string, doc_id string"), bench


def test_against_brute_force(spark):
    df, docs, items, bench = fixture(spark)
    assert got(D.report(df, items)) == plain(docs, bench)


def test_blocks_give_the_same(spark):
    df, docs, items, bench = fixture(spark)
    assert got(D.report(df, items, block_bytes=60)) == plain(docs, bench)


def test_filter_and_empty_tables(spark):
    df, docs, items, bench = fixture(spark)
    kept = D.decontaminated(df, items)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _, _, _, c in plain(docs, bench) if not c), key=repr)
    assert D.report(df.limit(0), items).count() == 0
    assert not any(r.contaminated for r in D.report(df, items.limit(0)).collect())


def test_repeated_items_are_dealt_once(spark, monkeypatch):
    dealt, real = [], D.Windows.__init__
    monkeypatch.setattr(D.Windows, "__init__", lambda self, items, *a: dealt.append(items) or real(self, items, *a))
    text = cases.words(3, 12)
    items = spark.createDataFrame([(1, text)] * 50 + [(2, cases.words(4, 12))], "item_id long, text string")
    out = D.report(cases.docs(spark, [(9, text)]), items, block_bytes=200).collect()
    assert out[0]["items"] == [1] and sorted(i for block in dealt for i, _ in block) == [1, 2] and len(dealt) == 1
