"""Readers and sinks."""
from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsudoi.functions import classify, feeddates
from tsudoi.functions.text import clean_text, truncate
from tsudoi.functions.urls import absolute_url
from tsudoi.operators.pages import strip_tags
from tsudoi.plans.ranking import top_k

# Header names of the municipal event file.
OPEN_DATA_COLUMNS = {"ページタイトル": "title", "ページURL": "official_url", "開催日時": "raw_date", "開催日詳細": "raw_date_detail", "ところ": "venue", "内容": "description", "対象": "target",
                     "費用": "price_text", "緯度": "latitude", "経度": "longitude", "分類": "category_0", "第1分類": "category_1", "第2分類": "category_2", "問い合わせ先1": "contact_name",
                     "問い合わせ先電話番号1": "phone", "問い合わせ先フリー入力": "contact_free"}


EXPECTED_HEADER = "ページタイトル"
LINKS = tuple(f"関連リンクURL{i}" for i in range(1, 6))


def decoded(content: bytes, encoding: str | None = None, expected: str = EXPECTED_HEADER) -> str:
    """The text of one file: UTF-8 if it is that and its first line holds the expected header, else Shift_JIS."""
    if encoding is None:
        try:
            text = content.decode("utf-8-sig")
            if expected in text.split("\n", 1)[0]:
                return text
        except UnicodeDecodeError:
            pass
    # the code page is Shift_JIS with the letters that files in practice hold
    name = "cp932" if encoding is None or encoding.lower().replace("-", "_") in ("shift_jis", "sjis", "cp932") else "utf-8-sig" if encoding.upper() == "UTF-8" else encoding
    return content.decode(name, errors="replace")


def csv_records(files: DataFrame, columns: Mapping[str, str], lists: Mapping[str, Sequence[str]], encoding: str | None = None, rows: int = 4096) -> DataFrame:
    """files(path, content) to (path, line, a string for each of ``columns``, an array for each of ``lists``): records of
    quoted CSV, cut as RFC 4180 says, so a field may hold line ends. Columns go by the header of their own file; ``line`` numbers
    the records of a file. A file is read by one task, a bounded number of records at a time."""
    names = [*columns.values()]
    schema = ", ".join(["path string", "line long", *[f"`{n}` string" for n in names], *[f"`{n}` array<string>" for n in lists]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                reader = csv.reader(io.StringIO(decoded(content.as_py(), encoding), newline=""))
                place = {h.replace("\ufeff", "").strip(): i for i, h in reversed([*enumerate(next(reader, []))])}
                at = [place.get(h, -1) for h in columns]
                many = [[place[h] for h in hs if h in place] for hs in lists.values()]
                held: list[tuple[int, list[str]]] = []
                for line, record in enumerate(chain(reader, [None])):
                    if record:
                        held.append((line, record))
                    if held and (record is None or len(held) >= rows):
                        cell = lambda r, i: r[i] if 0 <= i < len(r) else None
                        arrays = [pa.array([path] * len(held)), pa.array([n for n, _ in held], pa.int64())]
                        arrays += [pa.array([cell(r, i) for _, r in held], pa.string()) for i in at]
                        arrays += [pa.array([[cell(r, i) for i in some] for _, r in held], pa.list_(pa.string())) for some in many]
                        yield pa.RecordBatch.from_arrays(arrays, names=["path", "line", *names, *lists])
                        held = []
    return files.select("path", "content").mapInArrow(run, schema)


def read_open_data(spark: SparkSession, path: str, today: Column, encoding: str | None = None) -> DataFrame:
    """S1. Quoted multi-line CSV with a header row, columns by name, dates and rules added. A folder may hold UTF-8 and
    Shift_JIS copies: each file is decoded by itself, and no setting of the session changes."""
    raw = csv_records(spark.read.format("binaryFile").load(path), OPEN_DATA_COLUMNS, {"links": LINKS}, encoding)
    cols = [clean_text(F.col(n)).alias(n) for n in OPEN_DATA_COLUMNS.values()]
    df = raw.select(*cols, F.array_compact(F.transform("links", clean_text)).alias("related_urls"))
    df = df.where(F.col("title").isNotNull() | F.col("official_url").isNotNull())
    df = df.withColumns({
        "dates": feeddates.open_data_dates(F.col("raw_date"), F.col("raw_date_detail")), "category": F.nullif(F.concat_ws(" / ", "category_0", "category_1", "category_2"), F.lit("")),
        "contact": F.coalesce(F.nullif(F.concat_ws(" ", "contact_name", "phone"), F.lit("")), "contact_free"), "latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double")})
    return df.withColumns({
        "filter": classify.outing_filter(F.col("title"), F.col("category"), F.col("target"), F.col("description")), "area_status": classify.area_status(F.col("title"), F.col("venue"), F.col("description")),
        "lifecycle": feeddates.lifecycle(F.col("dates.occurrences"), today)}).drop("category_0", "category_1", "category_2", "contact_name", "contact_free")


def read_json_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S2. Files {events: [...]}: one row per event without an error; ``schema`` is the DDL of one event. A cut is the
    caller's, who knows an order."""
    files = spark.read.schema(f"events array<struct<{schema}>>").option("multiLine", True).json(path)
    rows = files.select(F.explode("events").alias("e")).select("e.*")
    if "error" in rows.columns:
        rows = rows.where(F.col("error").isNull()).drop("error")
    return rows


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S3. Raw pages keyed by URL."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def feed_kind(content_type: Column, body: Column) -> Column:
    ct, head = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.substring(body, 1, 400))
    return (F.when(F.contains(ct, F.lit("rss")), "rss").when(F.contains(ct, F.lit("atom")), "atom").when(head.rlike("<rss|<rdf:rdf"), "rss")
            .when(F.contains(head, F.lit("<feed")) & F.contains(head, F.lit("atom")), "atom"))


def feed_items(feeds: DataFrame, key: str = "page_id", url: str = "url", body: str = "xml", limit: int = 20) -> DataFrame:
    """S4. feeds(key, url, xml) to (key, pos, kind, feed_title, title, link, published, excerpt): the first ``limit`` items."""
    step = feeds.withColumn("kind", feed_kind(F.lit(None).cast("string"), F.col(body))).where(F.col("kind").isNotNull())
    tag = lambda c, name: F.regexp_extract(c, rf"(?is)<{name}\b[^>]*>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{name}\s*>", 1)
    words = lambda c, *names: F.coalesce(*[clean_text(strip_tags(tag(c, n))) for n in names])
    items = F.when(F.col("kind") == "atom", F.regexp_extract_all(body, F.lit(r"(?is)<entry\b[^>]*>(.*?)</entry\s*>"), 1)).otherwise(
        F.regexp_extract_all(body, F.lit(r"(?is)<item\b[^>]*>(.*?)</item\s*>"), 1))
    rows = step.select(key, url, "kind", words(F.col(body), "title").alias("feed_title"), F.posexplode(F.slice(items, 1, limit)).alias("pos", "item"))
    href = F.coalesce(F.nullif(F.regexp_extract("item", r"""(?is)<link\b[^>]*rel=["']alternate["'][^>]*href=["']([^"']+)""", 1), F.lit("")), F.nullif(F.regexp_extract("item", r"""(?is)<link\b[^>]*href=["']([^"']+)""", 1), F.lit("")))
    link = F.when(F.col("kind") == "atom", href).otherwise(F.coalesce(words(F.col("item"), "link"), href))
    title, summary = words(F.col("item"), "title"), words(F.col("item"), "description", "summary", "content:encoded", "content")
    return rows.select(key, "pos", "kind", "feed_title", title.alias("title"), absolute_url(link, F.col(url)).alias("link"),
                       words(F.col("item"), "pubDate", "dc:date", "published", "updated").alias("published"), truncate(F.concat_ws(" — ", title, summary), 400).alias("excerpt"))


def read_catalogue(spark: SparkSession, path: str, columns: Sequence[str] | None = None, status: str | None = None) -> DataFrame:
    """S5. The catalogue with projection and status filter left to the Parquet scan; every row is read."""
    df = spark.read.parquet(path)
    if status is not None:
        df = df.where(F.col("status") == status)
    return df if columns is None else df.select(*columns)


def write_report(rows: DataFrame, summary: Mapping[str, Column], path: str) -> None:
    """S6. Result rows as JSON lines and one summary row beside them."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.agg(*[c.alias(n) for n, c in summary.items()]).write.mode("overwrite").json(f"{path}/summary")


def write_version(table: DataFrame, root: str, version: str, partition_by: Sequence[str] = ()) -> str:
    """S7. A new table version in its own folder; a reader switches by name, so a failed write is never seen
    and an executor lost on the way only repeats tasks."""
    target = f"{root}/version={version}"
    writer = table.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    return target
