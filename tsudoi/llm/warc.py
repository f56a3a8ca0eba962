"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256; record headers are stored apart, exactly as they stand in a WARC file,
and a record is put together again by a join on that key. The key is verified twice: when writing, all payloads under one
SHA-256 must agree in length, SHA-1 and MD5, else the write fails; when reading, each stored payload is hashed again and
must have the digest that its key and its headers give.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsudoi.llm.common import only

CRLF = "\r\n"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # digits of conv() and of RFC 4648


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits of the digest at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def payload_of(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def header(kind: Column, page_id: Column, url: Column, digest: Column, size: Column, refers_to: Column) -> Column:
    """The WARC header block of one record. A revisit names the response and holds no payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\x00-\\x20\\x7F]", "")
    urn = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("none")), F.lit(">"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", urn(page_id)), line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"), line("WARC-Refers-To", urn(refers_to)))).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(size.cast("string"))), F.lit(CRLF))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Writes ``path``/payloads (key, payload) and ``path``/records (page_id, key, header).

    Of the records with equal payloads of at least ``least`` bytes the one with the smallest id is the response and the
    others revisit it. A null html is an empty payload. A null id counts as larger than any other; rows that repeat the
    response's id and payload are responses too. Control characters and spaces are left out of URLs in headers; extra
    columns are ignored; an empty table gives empty archives.
    """
    payload = payload_of(F.col(f"`{html_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("key"))
    facts = rows.select("page_id", "url", "key", F.octet_length("payload").alias("size"), base32_sha1(F.col("payload")).alias("digest"), F.md5("payload").alias("other"))
    proof = F.concat_ws(" ", F.col("size").cast("string"), "digest", "other")
    first = facts.groupBy("key").agg(F.min("page_id").alias("first"), F.min(proof).alias("low"), F.max(proof).alias("high"))
    first = first.select("key", "first", F.assert_true(F.col("low") == F.col("high"), F.lit("two payloads have one SHA-256")).alias("same"))
    joined = facts.join(first, "key")
    again = (F.col("size") >= least) & (F.col("first") != F.coalesce(F.col("page_id"), F.col("first") + 1))
    kind = F.when(F.coalesce(again, F.lit(False)) & F.col("same").isNull(), F.lit("revisit")).otherwise("response")
    joined.select("page_id", "key", header(kind, F.col("page_id"), F.col("url"), F.col("digest"), F.col("size"), F.col("first")).alias("header")).write.parquet(f"{path}/records")
    # the bytes move once: only rows that hold the first id of their key, met and made unique by the same (name, key)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    keys = first.select(F.coalesce(F.col("first").cast("string"), F.lit("")).alias("name"), "key")
    held = rows.select(name.alias("name"), "key", "payload").join(keys, ["name", "key"], "left_semi")
    held.dropDuplicates(["name", "key"]).select("key", "payload").write.parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its payload: page_id, header, payload, payload_bytes, payload_digest, record_type, refers_to.

    Type, digest and reference are parsed from the header; the bytes come from the payload store. A payload that doesn't
    have the digest of its key or of the header fails the read.
    """
    stored = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")
    kept = F.assert_true(F.sha2("payload", 256) == F.col("key"), F.lit("a stored payload doesn't have its SHA-256")).isNull()
    stored = stored.select("key", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), kept.alias("kept"))
    records = spark.read.parquet(f"{path}/records")
    field = lambda name: F.regexp_extract("header", f"(?m)^{name}: (.*)$", 1)
    whole = records.join(stored, "key")
    same = F.assert_true(F.concat(F.lit("sha1:"), "payload_digest") == field("WARC-Payload-Digest"), F.lit("a header and its payload disagree")).isNull()
    refers = F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1)
    kind = records.schema["page_id"].dataType.simpleString()
    return whole.where(F.col("kept") & same).select("page_id", "header", "payload", "payload_bytes", "payload_digest", field("WARC-Type").alias("record_type"),
                                                    F.when(refers != "", refers).cast(kind).alias("refers_to"))


def record_bytes(records: DataFrame) -> DataFrame:
    """(page_id, record binary): the bytes of each record as they stand in a WARC file."""
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    return only(records.select("page_id", F.concat(F.encode("header", "UTF-8"), body, end).alias("record")), "page_id", "record")
