"""Helpers of the llm operators: shared folders, Arrow maps, byte-level word tables, fingerprint-safe keys."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsudoi.session import cut_lineage, shared_folder, tune

__all__ = ["checkpointed", "scratch", "stored", "table", "tune", "word_table", "Words", "only", "map_rows"]

checkpointed = cut_lineage


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back, so later jobs start from files."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and nothing else, so extra columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Arrow map by record batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of a slice hold about ``most`` bytes, or are one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_column(batch: pa.RecordBatch, names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    """The batch with further columns, under new names throughout (positions count, names may repeat)."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)


def word_table(letters: bytes) -> np.ndarray:
    """256 flags: which bytes belong to words."""
    flags = np.zeros(256, bool)
    flags[list(letters)] = True
    return flags


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n + n // 8, 1 << 16), base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class Words:
    """Words of the texts of an Arrow string column, lower-cased in A-Z, with a 64-bit hash each.

    start, end: byte offsets in ``data``; row: the row of each word; hash: equal words have equal hashes.
    """

    def __init__(self, column: pa.Array, flags: np.ndarray):
        if pa.types.is_large_string(column.type) or not pa.types.is_string(column.type):
            column = column.cast(pa.string())
        column = column.fill_null("") if column.null_count else column
        n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        # a zero byte between the texts keeps words of neighbours apart; bytes of a row move by its number
        self.data = np.zeros(len(raw) + n, np.uint8)
        row_of_byte = np.repeat(np.arange(n), np.diff(at))
        self.data[np.arange(len(raw)) + row_of_byte] = LOWER[raw]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = flags[self.data]
        inside[1 + at[1:] + np.arange(n)] = 0  # the separators, whatever the flags say
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        text_at = at[:-1] + np.arange(n)
        self.row = np.searchsorted(text_at, self.start, "right") - 1
        self.first = np.searchsorted(self.start, np.append(text_at, len(self.data)), "left")  # first word of each row
        self.n = n
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """sum of byte * BASE**position over a word, divided by BASE**start: prefix sums, no loop."""
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(self.data)), out=total[1:])
            h = (total[self.end] - total[self.start]) * powers(INVERSE, len(self.data) + 1)[self.start]
        return mixed(h)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of every run of k words in one row."""
        if len(self.hash) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        m = len(self.hash) - k + 1
        with np.errstate(over="ignore"):
            h = np.zeros(m, np.uint64)
            for j in range(k):
                h = h * np.uint64(BASE) + self.hash[j:j + m]
        at = np.flatnonzero(self.row[:m] == self.row[k - 1:k - 1 + m])
        return at, mixed(h[at])
