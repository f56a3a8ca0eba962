"""Benchmark decontamination by a prefix-filtered set join.

An item gives one window for each run of ``window`` consecutive words (a shorter item is one window). A window is the set
of its shingles with their positions; it is contained in a document exactly if all of them stand there in order. For exact
containment the necessary prefix is the single rarest shingle, rarity being its count over all documents. A document
shingle that equals some window's prefix gives a candidate start (its position minus the prefix's position in the
window); the length bound asks that the whole window fits into the document from there; the rest of the window's words
are then compared, first by hash and in the end byte by byte.

The prefix index goes to the tasks by broadcast, in blocks of at most ``block_bytes`` of item text: a larger benchmark
takes more passes over the documents and never a larger broadcast.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsudoi.llm.common import Words, checkpointed, fresh, slices, word_table

WINDOW, SHINGLE, BLOCK_BYTES = 10, 3, 4 << 20
LETTERS = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
FLAGS = word_table(LETTERS)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),  # [first word, last word + 1] of each hit stretch
    T.StructField("items", T.ArrayType(T.LongType())),
])
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])


class Windows:
    """The windows of a block of items: words, word hashes, and the items each belongs to."""

    def __init__(self, items: list[tuple[int, str]], window: int, shingle: int):
        self.text: list[bytes] = []
        self.items: list[list[int]] = []
        known: dict[bytes, int] = {}
        for item, text in items:
            words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
            for at in range(max(1, len(words) - window + 1) if words else 0):
                key = b" ".join(words[at:at + window])
                n = known.setdefault(key, len(known))
                if n == len(self.items):
                    self.text.append(key)
                    self.items.append([])
                if item not in self.items[n][-1:]:
                    self.items[n].append(item)
        self.items = [sorted(set(i)) for i in self.items]
        words = Words(pa.array([t.decode("utf-8", "surrogatepass") for t in self.text], pa.string()), FLAGS)
        self.length = np.diff(words.first)
        self.hash = words.hash
        self.first = words.first[:-1]
        # every shingle of every window: size, hash, window, position
        sizes = np.minimum(self.length, shingle)
        size, gram, owner, at = [], [], [], []
        for k in np.unique(sizes).tolist():
            start, h = words.grams(k)
            row = words.row[start]
            mine = sizes[row] == k
            size.append(np.full(mine.sum(), k))
            gram.append(h[mine])
            owner.append(row[mine])
            at.append(start[mine] - words.first[row[mine]])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.size, self.gram, self.owner, self.at = join(size, np.int64), join(gram, np.uint64), join(owner, np.int64), join(at, np.int64)
        self.sizes = sorted(set(self.size.tolist()))

    def prefixes(self, count: dict[int, int]) -> None:
        """Leaves each window its rarest shingle, ties to the earliest."""
        n = np.array([count.get(g, 0) for g in self.gram.view(np.int64).tolist()], np.int64)
        order = np.lexsort((self.at, n, self.owner))
        _, first = np.unique(self.owner[order], return_index=True)
        keep = order[first]
        keep = keep[np.argsort(self.gram[keep], kind="stable")]
        self.size, self.gram, self.owner, self.at = self.size[keep], self.gram[keep], self.owner[keep], self.at[keep]


def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted table; a small bitmap settles most."""
    bits = np.zeros(1 << 20, bool)
    bits[(table & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.searchsorted(table, h[maybe])
    at[at == len(table)] = 0
    return maybe[table[at] == h[maybe]] if len(table) else maybe[:0]


def rarity(docs: DataFrame, text_col: str, index: Windows) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents; as many rows as the block has shingles at most."""
    wanted, sizes = np.unique(index.gram), index.sizes
    sent = docs.sparkSession.sparkContext.broadcast((wanted, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sizes = sent.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                words = Words(part.column("t"), FLAGS)
                for k in sizes:
                    h = words.grams(k)[1]
                    total += np.bincount(np.searchsorted(wanted, h[among(h, wanted)]), minlength=len(wanted))
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(wanted[seen].view(np.int64)), pa.array(total[seen])], names=["gram", "n"])
    counts = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(run, "gram long, n long")
    return {r["gram"]: r["n"] for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator()}


def hits(words: Words, index: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window."""
    starts, owners = [], []
    for k in index.sizes:
        mine = index.size == k
        gram, owner, offset = index.gram[mine], index.owner[mine], index.at[mine]
        at, h = words.grams(k)
        sel = among(h, gram)
        low, high = np.searchsorted(gram, h[sel], "left"), np.searchsorted(gram, h[sel], "right")
        n = high - low
        which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        word = np.repeat(at[sel], n)
        row = words.row[word]
        start, window = word - offset[which], owner[which]
        fits = (start >= words.first[row]) & (start + index.length[window] <= words.first[row + 1])
        start, window = start[fits], window[fits]
        for j in range(int(index.length[window].max()) if len(window) else 0):  # word by word, survivors only
            inside = j < index.length[window]
            same = ~inside
            same[inside] = words.hash[start[inside] + j] == index.hash[index.first[window[inside]] + j]
            start, window = start[same], window[same]
        starts.append(start)
        owners.append(window)
    start, window = (np.concatenate(starts), np.concatenate(owners)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    data = words.data.tobytes() if len(start) else b""
    exact = np.array([b" ".join(data[a:b] for a, b in zip(words.start[s:s + n], words.end[s:s + n])) == index.text[w]
                      for s, n, w in zip(start.tolist(), index.length[window].tolist(), window.tolist())], bool)
    return start[exact], window[exact]


def contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str], result: str, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The given columns of every row of docs and a struct: n_words, n_hit, spans of hit words, ids of items found.

    Null and empty texts have no words. Items without words or id give no windows; rows that repeat an item id count as
    one item. Extra columns are ignored unless named; empty tables give empty or clean results.
    """
    text, state = fresh(docs, "text_"), fresh(docs, "found_")
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("t")).where("item is not null and t is not null")
    items = checkpointed(items.distinct())  # a repeated row would go to one block as often as it stands there
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    now = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias(text))
    names = list(columns)
    for b in range(blocks):
        of_block = [(r["item"], r["t"]) for r in items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).toLocalIterator()]
        index = Windows(sorted(of_block), window, shingle)
        index.prefixes(rarity(docs, text_col, index) if len(index.gram) else {})
        last = b == blocks - 1
        now = scan(now, index, len(names), text, state, carry=b > 0, keep_text=not last)
        if not last:
            now = checkpointed(now)
    return now.withColumnRenamed(state, result)


def scan(now: DataFrame, index: Windows, n_columns: int, text: str, state: str, carry: bool, keep_text: bool) -> DataFrame:
    """One pass. carry: findings of earlier blocks stand in the last column and are added to."""
    sent = now.sparkSession.sparkContext.broadcast(index)
    fields = now.schema.fields[:n_columns + keep_text]
    names = [*(f.name for f in fields), state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(n_columns), FLAGS)
                before = part.column(n_columns + 1).to_pylist() if carry else None
                yield pa.RecordBatch.from_arrays([*part.columns[:n_columns + keep_text], pa.array(per_row(words, index, before), ARROW)], names=names)
    return now.mapInArrow(run, T.StructType([*fields, T.StructField(state, FOUND)]))


def per_row(words: Words, index: Windows, before: list[dict] | None) -> list[dict]:
    start, window = hits(words, index)
    row = words.row[start] if len(start) else start
    rows = [{"n_words": n, "n_hit": 0, "spans": [], "items": []} for n in np.diff(words.first).tolist()]
    touched: dict[int, tuple[list, set]] = {}
    for r, s, w in zip(row.tolist(), start.tolist(), window.tolist()):
        spans, items = touched.setdefault(r, ([], set()))
        spans.append([s - int(words.first[r]), s - int(words.first[r]) + int(index.length[w])])
        items.update(index.items[w])
    for r, old in enumerate(before or []):
        if old["items"]:
            spans, items = touched.setdefault(r, ([], set()))
            spans += old["spans"]
            items.update(old["items"])
    for r, (spans, items) in touched.items():
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        rows[r] |= {"n_hit": sum(b - a for a, b in merged), "spans": merged, "items": sorted(items)}
    return rows


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, contaminated) of every row."""
    c = fresh(docs, "r_")
    found = contamination(docs, benchmark, [id_col], c, **options)
    return found.select(F.col(f"`{id_col}`").alias("doc_id"), f"{c}.*", (F.col(f"{c}.n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with their columns."""
    c = fresh(docs, "r_")
    found = contamination(docs, benchmark, docs.columns, c, **options)
    return found.where(F.col(f"{c}.n_hit") == 0).drop(c)
