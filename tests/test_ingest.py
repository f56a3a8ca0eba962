import json

import pytest
from pyspark.sql import functions as F

from tsudoi.functions.dates import day
from tsudoi.operators.state import upsert
from tsudoi.sources import readers
from tsudoi.streaming import ingest

SCHEMA = "id long, title string"


def test_one_folder_with_both_encodings(spark, tmp_path):
    head = "ページタイトル,ページURL,開催日時,ところ,内容,関連リンクURL2\r\n"
    record = lambda n: f'"区民""まつり""{n}",https://c/{n},2026年8月1日,港区役所,"一行目\r\n二行目①～",https://l/{n}\r\n'
    for name, enc, ids in (("u.csv", "utf-8-sig", range(3)), ("s.csv", "cp932", range(3, 6)), ("plain.csv", "utf-8", range(6, 8))):
        (tmp_path / name).write_bytes((head + "".join(map(record, ids)) + "\r\n,,,,\r\n").encode(enc))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(head.encode("cp932"))
    (tmp_path / "short.csv").write_bytes("ところ,ページタイトル\r\n港区役所\r\nx,短い\r\n".encode())
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    got = sorted((r.title, r.description, r.official_url, r.related_urls) for r in readers.read_open_data(spark, str(tmp_path), day("2026-08-01")).collect())
    want = [(f'区民"まつり"{n}', "一行目 二行目①～", f"https://c/{n}", [f"https://l/{n}"]) for n in range(8)]
    assert got == want + [("短い", None, None, [])] and spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_records_come_in_bounded_batches(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f'{i},"x\n{i}"\n' for i in range(500)))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = sorted((int(r.key), r.v, r.line) for r in readers.csv_records(files, {"k": "key", "v": "v", "none": "w"}, {}, "UTF-8", rows=7).collect())
    assert got == [(i, f"x\n{i}", i) for i in range(500)]


def put(folder, name, *rows):
    (folder / f"{name}.json").write_text("".join(json.dumps({"id": i, "title": t}) + "\n" for i, t in rows))


def test_a_killed_batch_is_never_seen_and_its_replay_counts_once(spark, tmp_path):
    feed, root = tmp_path / "feed", str(tmp_path / "table")
    feed.mkdir()
    calls, kill = [], {"on": True}

    def merge(table, batch):
        calls.append(1)
        if kill["on"] and len(calls) == 2:
            # a task dies while the second batch is being written
            return upsert(table, batch, ["id"]).withColumn("title", F.when(F.col("id") == 3, F.raise_error(F.lit("killed"))).otherwise(F.col("title")))
        return upsert(table, batch, ["id"])
    table = lambda: sorted(map(tuple, ingest.current(spark, root, SCHEMA).collect()))
    go = lambda: ingest.ingest_feed(spark, str(feed), SCHEMA, ingest.merged_once(spark, root, "guide", SCHEMA, merge), str(tmp_path / "cp"))
    assert table() == []
    put(feed, "1", (1, "a"), (2, "b"))
    go()
    assert table() == [(1, "a"), (2, "b")]
    put(feed, "2", (2, "B"), (3, "c"))
    with pytest.raises(Exception):
        go()
    assert table() == [(1, "a"), (2, "b")]
    kill["on"] = False
    go()
    assert table() == [(1, "a"), (2, "B"), (3, "c")] and sorted(r.batch for r in ingest.ledger(spark, root).collect()) == [0, 1]
    # the stream replays a committed batch (its own commit was lost): nothing runs, nothing changes
    ingest.merged_once(spark, root, "guide", SCHEMA, merge)(spark.createDataFrame([(9, "again")], SCHEMA), 1)
    assert len(calls) == 3 and table() == [(1, "a"), (2, "B"), (3, "c")]
    # another feed has numbers of its own
    ingest.merged_once(spark, root, "magazine", SCHEMA, merge)(spark.createDataFrame([(9, "new")], SCHEMA), 1)
    assert (9, "new") in table()


def test_repeated_rows_come_once_over_all_batches(spark, tmp_path):
    feed, seen = tmp_path / "feed", []
    feed.mkdir()
    go = lambda: ingest.ingest_feed(spark, str(feed), SCHEMA, lambda batch, n: seen.extend(r.id for r in batch.collect()), str(tmp_path / "cp"), unique=["id"])
    put(feed, "1", (1, "a"), (1, "a"), (2, "b"))
    go()
    put(feed, "2", (2, "again"), (3, "c"))
    go()
    assert sorted(seen) == [1, 2, 3]
