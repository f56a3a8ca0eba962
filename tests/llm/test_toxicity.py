import random
import zlib

import pytest

from tests.llm import cases
from tsudoi.llm import toxicity as X


@pytest.fixture(scope="module")
def corpus():
    r, rows, labels = random.Random(4), [], []
    for i in range(900):
        toxic = i % 7 == 0
        text = cases.words(1000 + i, 60).split()
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["vileword", "nastyterm", "awfulname", "grimslur"]))
        rows.append((i, " ".join(text)))
        if i % 2 or toxic:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, corpus):
    rows, labels = corpus
    odd = [(None if i is None else i + 5000, t) for i, t in cases.odd_rows()]
    df = cases.docs(spark, rows + odd)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5001, None, None), (5002, 1, 7), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = X.report(df, lab).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert sum((r.doc_id % 7 == 0) == bool(r.predicted) for r in held) / len(held) > 0.97
    kept = X.accepted(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in out)


def test_held_out_labels_are_not_learned_from(spark, corpus):
    rows, labels = corpus
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    df, schema = cases.docs(spark, rows[:300]), "doc_id long, quality int, toxic int"
    score = lambda lab: sorted((r.doc_id, r.score) for r in X.report(df, spark.createDataFrame(lab, schema)).collect())
    assert score(labels) == score(flipped)


def test_nothing_to_learn_from(spark):
    df = cases.docs(spark, cases.odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in X.report(df, none).collect())
    assert X.report(df.limit(0), none).count() == 0
