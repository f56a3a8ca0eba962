"""Token ids in directly addressable codes.

An id is cut into 8-bit chunks. Level 0 holds the low chunk of every id, level k the chunk k of those ids that have one;
a bitmap per level says which ids go on, and a rank directory counts its ones, so token i is read by following ranks
(``access``) without decoding what lies before it. A file row is a segment of whole documents; rows lie in document order
and know how many ids of their file precede them, and a small directory adds the ids of earlier files.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsudoi.llm.common import slices
from tsudoi.llm.tokens import encoder

SEGMENT_IDS = 1 << 18
RANK_BITS = 512
LEVELS = pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("rank", pa.binary())]))
SEGMENT = ("part int, seq int, part_start long, n_ids long, doc_ids array<long>, lengths array<long>, "
           "levels array<struct<chunks: binary, more: binary, rank: binary>>")


def encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
        rank = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4") if len(ones) else ones.astype("<u4")
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "more": bits.tobytes(), "rank": rank.tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def decode(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(levels[0]["chunks"], np.uint8).astype("<u4")
    at = np.arange(len(out))
    for k, level in enumerate(levels[:-1]):
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(at), bitorder="little").astype(bool)
        at = at[more]
        out[at] |= np.frombuffer(levels[k + 1]["chunks"], np.uint8).astype(np.uint32) << np.uint32(8 * (k + 1))
    return out


def access(levels: list[dict[str, bytes]], positions: np.ndarray) -> np.ndarray:
    """The ids at the given positions of a segment, by rank, without decoding others."""
    at = np.asarray(positions, np.int64)
    out, who = np.zeros(len(at), np.uint32), np.arange(len(at))
    for k, level in enumerate(levels):
        out[who] |= np.frombuffer(level["chunks"], np.uint8)[at].astype(np.uint32) << np.uint32(8 * k)
        bits = np.frombuffer(level["more"], np.uint8)
        go = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        who, at = who[go], at[go]
        if not len(at):
            return out
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        block = bits.reshape(-1, RANK_BITS // 8)[at // RANK_BITS]
        before = np.arange(RANK_BITS) < (at % RANK_BITS)[:, None]
        inside = (np.unpackbits(block, axis=1, bitorder="little").astype(bool) & before).sum(axis=1)
        at = np.frombuffer(level["rank"], "<u4")[at // RANK_BITS].astype(np.int64) + inside
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes whole texts (null: empty), appends the end id to each, and writes segments in ascending order of id.

    A null id comes first; rows that repeat an id stand in order of their text's hash and text. One range shuffle of
    (id, text), whose ranges also cut inside a repeated id. Extra columns are ignored; an empty table writes no segment.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        state = {"seq": 0, "start": 0}
        doc_ids: list[int | None] = []
        parts: list[bytes] = []

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = {"part": part, "seq": state["seq"], "part_start": state["start"], "n_ids": len(ids), "doc_ids": list(doc_ids),
                   "lengths": [len(p) // 4 for p in parts], "levels": encode(ids)}
            state["seq"] += 1
            state["start"] += len(ids)
            doc_ids.clear()
            parts.clear()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()),
                                                                       ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("levels", LEVELS)]))
        held = 0
        for batch in batches:
            for piece in slices(batch, "t", 2 << 20):
                for doc, ids in zip(piece.column("i").to_pylist(), enc.raw(piece.column("t").to_pylist())):
                    doc_ids.append(doc)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= segment_ids:
                        held = 0
                        yield segment()
        if parts:
            yield segment()
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"), F.xxhash64(f"`{text_col}`").alias("h"))
    chosen.repartitionByRange("i", "h").sortWithinPartitions("i", "h", "t").select("i", "t").mapInArrow(run, SEGMENT).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of all earlier documents. The directory has one small row for each file, so
    it is sent to the segments, which stay where they are."""
    stored = spark.read.schema(SEGMENT).parquet(path)
    files = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = files.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return stored.join(F.broadcast(before), "part").withColumn("start", F.coalesce("before", F.lit(0)) + F.col("part_start")).drop("before")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary little-endian uint32) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = decode(row["levels"]).tobytes()
                ends = np.cumsum([0, *row["lengths"]])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(ends[:-1] + row["start"]),
                                                  pa.array([raw[4 * a:4 * b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc_id", "start", "ids"])
    return segments(spark, path).select("doc_ids", "lengths", "levels", "start").mapInArrow(run, "doc_id long, start long, ids binary")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """positions(position long) -> (position, token long): random access by global position, each distinct one once.

    Positions outside the archive and null ones give no row. Positions meet segments by stride of ``SEGMENT_IDS``; a
    segment is read once for each 4096 positions asked of it.
    """
    where = segments(spark, path).select("part", "seq", "start", "n_ids")
    stride = F.lit(SEGMENT_IDS)
    cover = where.select("*", F.explode(F.sequence(F.floor(F.col("start") / stride), F.floor((F.col("start") + F.col("n_ids") - 1) / stride))).alias("s"))
    asked = positions.select(F.col("position").cast("long")).where("position >= 0").distinct().withColumn("s", F.floor(F.col("position") / stride))
    inside = asked.join(cover, "s").where("position >= start and position < start + n_ids").select("part", "seq", "start", (F.col("position") - F.col("start")).alias("at"))
    lists = inside.groupBy("part", "seq", "start", F.floor(F.col("at") / 4096).alias("lot")).agg(F.collect_list("at").alias("at"))
    stored = spark.read.schema(SEGMENT).parquet(path).select("part", "seq", "levels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["at"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at + row["start"]), pa.array(access(row["levels"], at).astype(np.int64))], names=["position", "token"])
    return lists.join(stored, ["part", "seq"]).select("start", "at", "levels").mapInArrow(run, "position long, token long")


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read documents."""
    return documents.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
