import base64
import hashlib

import pytest

from tests.llm import cases
from tsudoi.llm import warc
from tsudoi.llm.common import scratch

ROWS = [(5, "http://a/ x\r\nEvil: 1", "<p>same é</p>"), (3, "http://b", "<p>same é</p>"), (3, "http://b", "<p>same é</p>"), (7, None, None), (2, "u", ""), (9, "u", "other"), (None, "n", "<p>same é</p>"),
        (None, "n", "only unnamed"), (None, "m", "only unnamed"), (11, "long", cases.words(1, 60_000))]


def plain(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        again = first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, key string, payload string")


def test_round_trip(spark):
    path = scratch(spark, "warc")
    warc.write(pages(spark, ROWS), path)
    back = warc.read(spark, path)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == plain(ROWS)
    assert sorted((r.page_id or -1, bytes(r.payload)) for r in back.collect()) == sorted((i or -1, (h or "").encode()) for i, _, h in ROWS)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    raw = {r.page_id: bytes(r.record) for r in warc.record_bytes(back).collect()}
    head, body = raw[9].split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 5" in head and body == b"other\r\n\r\n"
    assert b"WARC-Refers-To: <urn:page:3>" in raw[5] and raw[5].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and b"\r\nEvil" not in raw[5]


def test_small_payloads_may_stay_responses(spark):
    path = scratch(spark, "warc")
    warc.write(pages(spark, ROWS), path, least=1)
    kinds = {r.page_id: r.record_type for r in warc.read(spark, path).collect()}
    assert kinds[7] == kinds[2] == "response" and kinds[5] == "revisit"


def test_broken_store_is_noticed(spark):
    path, other = scratch(spark, "warc"), scratch(spark, "warc")
    warc.write(pages(spark, ROWS[:2]), path)
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    spark.read.parquet(f"{path}/payloads").selectExpr("key", "cast('tampered' as binary) payload").write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="SHA-256"):
        warc.read(spark, other).collect()


def test_empty(spark):
    path = scratch(spark, "warc")
    warc.write(pages(spark, []), path)
    assert warc.read(spark, path).count() == 0
