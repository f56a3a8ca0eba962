import importlib.util

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_decontaminate import plain as contaminated
from tests.llm.test_similar import plain_kept
from tests.llm.test_secret_scan import plain as secrets


def folder(spark, tmp_path):
    bench = [(1, cases.words(77, 20))]
    rows = [(i, cases.words(3000 + i // 2, 120) + (" tail" if i % 2 else "")) for i in range(60)]
    rows += [(100 + i, cases.words(4000 + i, 60) + (" vileword nastyterm" * 3)) for i in range(40)]
    rows += [(200, cases.words(5000, 20) + " " + bench[0][1]), (201, "token = 'abcdefgh123' " + cases.words(5001, 40)), (202, None), (203, ""), (204, cases.words(5002, 9000))]
    cases.docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(100 <= i < 140)) for i, _ in rows if i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, bench


def test_stages(spark, tmp_path):
    where, rows, bench = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, kept = docs.columns, [dict(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{where}/out-{name}"
        stage(spark, docs, where).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    clean = {i: t for i, t in rows if not 100 <= i < 140}
    assert kept[1] == clean
    assert set(kept[2]) == plain_kept(list(clean.items()))
    assert set(kept[3]) == {r[0] for r in contaminated(list(kept[2].items()), bench) if not r[4]} and 200 not in kept[3] and 201 in kept[3]
    assert set(kept[4]) == set(kept[3]) and all(not secrets(t or "")[1] for t in kept[4].values()) and "[SECRET]" in kept[4][201]
    assert all(kept[4][i] == t for i, t in kept[3].items() if not secrets(t or "")[1])


def test_run_packs_every_kept_document(spark, tmp_path):
    where, _, _ = folder(spark, tmp_path)
    pieces = corpus_pipeline.run(spark, where).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert all(sum(n for _, n, _ in cut) == cut[0][2] for cut in by_doc.values())
    filled = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024 and 202 in by_doc


def test_entry_registers_everything():
    import __spark_entry__ as e
    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(names) and importlib.util.find_spec("tsudoi.llm.queries")
