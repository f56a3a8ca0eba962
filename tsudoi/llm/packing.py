"""Packing tokenised documents into training sequences: first-fit decreasing in randomised groups.

A document is cut into full pieces, each a sequence of its own, and a rest. Documents are dealt to groups by a hash of
their id, so a group is a random sample whatever the order of the input; a group is packed in lots of at most ``lot``
documents, which bounds memory. Within a lot the rests go, longest first, into the first bin with room, found in a
tournament tree whose inner nodes hold the largest room below them. Bins that stay emptier than ``fill`` are taken apart
again and their pieces cut to fill the room of the others, so little padding is left even where the rests don't fit well.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsudoi.llm.common import slices
from tsudoi.llm.tokens import encoder

SEQUENCE, LOT, FILL = 1024, 8192, 0.97
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, filling of each bin). Sizes lie from 1 to room; equal ones keep their order."""
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * leaves)  # node k holds the largest room in the leaves below it
    bins = np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, k = int(sizes[item]), 1
        while k < leaves:
            k = 2 * k if tree[2 * k] >= size else 2 * k + 1
        bins[item] = k - leaves
        tree[k] -= size
        k >>= 1
        while k:
            best = tree[2 * k] if tree[2 * k] >= tree[2 * k + 1] else tree[2 * k + 1]
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1
    used = int(bins.max()) + 1 if n else 0
    return bins, room - np.array(tree[leaves:leaves + used], np.int64)


def pack(sizes: np.ndarray, room: int = SEQUENCE, fill: float = FILL) -> list[tuple[int, int, int, int, int]]:
    """Rows (item, start in item, length, bin, offset in bin) that place every unit of every item once."""
    bins, used = first_fit_decreasing(sizes, room)
    loose = used < fill * room
    if loose.any():  # refill the loosest bins' pieces into the room of all others, the fullest first
        keep = np.argsort(-used, kind="stable")
        spare = np.cumsum(room - used[keep])
        left = used.sum() - np.cumsum(used[keep])
        n = int(np.argmax(spare >= left)) + 1  # so many bins hold everything
        loose = np.zeros(len(used), bool)
        loose[keep[n:]] = True
    filled = np.zeros(len(used), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    number = np.cumsum(~loose) - 1
    for item in np.flatnonzero(~loose[bins]).tolist():
        b = bins[item]
        out.append((item, 0, int(sizes[item]), int(number[b]), int(filled[b])))
        filled[b] += sizes[item]
    open_bins = [(int(number[b]), int(filled[b])) for b in np.flatnonzero(~loose).tolist() if filled[b] < room]
    open_bins.reverse()
    for item in np.flatnonzero(loose[bins]).tolist():
        start, rest = 0, int(sizes[item])
        while rest:
            b, at = open_bins.pop()
            take = min(rest, room - at)
            out.append((item, start, take, b, at))
            start, rest = start + take, rest - take
            if at + take < room:
                open_bins.append((b, at + take))
    return out


def packed(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", room: int = SEQUENCE, lot: int = LOT, fill: float = FILL) -> DataFrame:
    """The pieces of all documents with their ids (binary, little-endian uint32) and places.

    Null and empty texts give the end id alone. Rows without an id are dealt by their text; rows that repeat an id are
    separate documents. Extra columns are ignored; an empty table gives an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        doc_ids: list[int | None] = []
        raws: list[bytes] = []
        state = {"next": 0}

        def flush() -> pa.RecordBatch:
            rows = []
            total = np.array([len(r) // 4 for r in raws], np.int64)
            full = total // room
            for d in np.flatnonzero(full).tolist():
                for k in range(int(full[d])):
                    rows.append((d, k * room, room, state["next"], 0))
                    state["next"] += 1
            rest = np.flatnonzero(total % room)
            bins = 0
            for item, start, length, b, at in pack(total[rest] % room, room, fill) if len(rest) else []:
                d = int(rest[item])
                rows.append((d, int(full[d]) * room + start, length, state["next"] + b, at))
                bins = max(bins, b + 1)
            state["next"] += bins
            d, start, length, seq, at = zip(*rows)
            out = pa.RecordBatch.from_arrays([
                pa.array([doc_ids[x] for x in d], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([raws[x][4 * s:4 * (s + n)] for x, s, n in zip(d, start, length)], pa.binary()), pa.array(total[list(d)]),
                pa.array(np.array(seq, np.int64) + base), pa.array(at, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            doc_ids.clear()
            raws.clear()
            return out
        held = 0
        for batch in batches:
            for piece in slices(batch, "t", 2 << 20):
                for doc, ids in zip(piece.column("i").to_pylist(), enc.raw(piece.column("t").to_pylist())):
                    doc_ids.append(doc)
                    raws.append(ids + end)
                    held += len(ids)
                if len(raws) >= lot or held >= 32 << 20:  # a lot of very long texts ends early
                    held = 0
                    yield flush()
        if raws:
            yield flush()
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    chosen = docs.select(doc_id.alias("i"), text.alias("t"), F.xxhash64(F.lit("packing"), doc_id, F.when(doc_id.isNull(), text)).alias("g"))
    return chosen.repartition("g").sortWithinPartitions("g", "i", "t").select("i", "t").mapInArrow(run, PIECE)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
