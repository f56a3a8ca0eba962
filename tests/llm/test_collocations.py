import random
import re
from collections import Counter

from tests.llm import cases
from tsudoi.llm import collocations


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(rows, least, top=2000):
    """Rows (text, lang) -> the whole report by direct counts."""
    f, out = {}, []
    for text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            c.update(tuple(w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        n, cand, found = sum(a for p, a in c.items() if len(p) == 1), {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed=3, n=60):
    """Random words, a passage that repeats whole, one that repeats with other neighbours, and a run of one word."""
    r, out = random.Random(seed), []
    passage = " ".join(f"p{i}" for i in range(30))
    for i in range(n):
        t = " ".join(f"W{min(r.randrange(12), r.randrange(12))}{r.choice(['', '', '', ',', '.', chr(10), '  ', chr(9)])}" for _ in range(r.randrange(1, 60)))
        if i % 3 == 0:
            t += ". " + passage + r.choice([".", " and", " so on; x"])
        if i % 7 == 0:
            t = "ha " * 9 + t
        out.append((t, [None, "en", "und", "fr"][i % 4]))
    return out


def run(spark, rows, **options):
    full = [(i, t, l, "x", "y", "z") for i, (t, l) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, pair string, n string, phrase string")
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def test_against_direct_counts(spark):
    rows = texts() + [(t, "en") for _, t in cases.odd_rows()] + [("same piece of words", "de")] * 40
    assert run(spark, rows, least=3) == plain(rows, 3) != []
    assert run(spark, rows[:40], least=2, top=5) == plain(rows[:40], 2, 5)


def test_small_combining_and_empty(spark, monkeypatch):
    rows = texts(5, 20)
    want = plain(rows, 2)
    monkeypatch.setattr(collocations, "COMBINE", 50)
    assert run(spark, rows, least=2) == want
    assert run(spark, [], least=2) == [] and run(spark, [(None, None), ("", "en"), (" .\t", "en")], least=1) == []


def test_paths_hold_every_edge_once(spark):
    rows = texts(9, 40)
    df = spark.createDataFrame(rows, "text string, lang string")
    counts = collocations.counted(collocations.longest_runs(collocations.prepared(df, 'text', 'lang'), 3), 3)
    few = collocations.counted(collocations.longest_runs(collocations.prepared(df, 'text', 'lang'), 3, slots=64), 3)  # a filter that lets most pass changes nothing
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, counts.collect()))
    edges = {(r.lang, r.phrase): r.f for r in counts.collect() if r.size == 4}
    found = collocations.paths(counts).collect()
    mine = [((r.lang, " ".join(r.words[i:i + 4])), r.f) for r in found for i in range(len(r.words) - 3)]
    assert len(mine) == len(edges) and dict(mine) == edges
    assert max(len(r.words) for r in found) >= 30  # the repeated passage is one path
