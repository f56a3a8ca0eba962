"""Ranked lexical search: exact top-k inner products of sparse vectors under ball trees.

A document is a sparse vector over the terms that any item asks for, with the value weight * impact; an item is the set
of its terms, so a document's score is the sum of its values there, in whole numbers. Documents are read in shards of
bounded size, wherever they lie. A shard is cut into balls, again and again, along the widest of a few random projections;
a ball keeps its centroid, its radius, and the radius along each of its terms. For an item with the terms T in a ball
    score <= sum over T of (centroid + radius along the term)   and   score <= centroid . T + radius * sqrt(|T|),
the smaller of both, widened by more than the rounding of doubles. Balls are opened best first; one in which no item can
reach its k-th best so far is left out with all its documents, the others come down to exact scores at the leaves. What a
task has found in one shard bounds its search of the next, and each task returns k documents an item at most.

Items go out in blocks of at most ``BLOCK_BYTES`` of text; each block reads the documents twice, once to count, once to search.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsudoi.llm.common import Words, checkpointed, slices, word_table

FLAGS = word_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
TOP, BLOCK_BYTES = 10, 4 << 20
SHARD_DOCS, SHARD_ENTRIES, LEAF, FAN, ITEM_ROWS = 4096, 1 << 20, 32, 4, 1024


@dataclass
class Vocabulary:
    """The terms of a block of items: sorted hashes, and the bytes of each, as two terms might share a hash."""
    hash: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def entries(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences) of the known terms, sorted."""
        if not len(self.hash) or not len(words.hash):
            return (np.zeros(0, np.int64),) * 3
        term = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        at = np.flatnonzero(self.hash[term] == words.hash)
        term = term[at]
        length = words.end[at] - words.start[at]
        same = length == self.end[term] - self.start[term]
        at, term, length = at[same], term[same], length[same]
        if len(at):
            inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            differs = words.data[np.repeat(words.start[at], length) + inside] != self.data[np.repeat(self.start[term], length) + inside]
            if differs.any():
                fine = np.add.reduceat(differs, np.cumsum(length) - length) == 0
                at, term = at[fine], term[fine]
        key, tf = np.unique(words.row[at] * len(self.hash) + term, return_counts=True)
        return key // len(self.hash), key % len(self.hash), tf


@dataclass
class Items:
    """A block of items: their terms one after another (``first`` has the offsets), and the vocabulary."""
    ids: list
    first: np.ndarray
    term: np.ndarray
    vocabulary: Vocabulary


def block_of_items(rows: pa.Table) -> Items:
    """Rows (id, text); every item stays, those without terms too."""
    words = Words(rows.column("text").combine_chunks(), FLAGS)
    # equal bytes are one term: group by hash, length and bytes
    hashes, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    text = [words.data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist())]
    if any(text[a] != t for a, t in zip(at[inverse].tolist(), text)):
        raise ValueError("two terms of the items share a hash")
    pair = np.unique(words.row.astype(np.int64) * max(1, len(hashes)) + inverse)
    item, term = pair // max(1, len(hashes)), pair % max(1, len(hashes))
    return Items(rows.column("id").to_pylist(), np.searchsorted(item, np.arange(rows.num_rows + 1)), term,
                 Vocabulary(hashes, words.data, words.start[at], words.end[at]))


def counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int, int]:
    """(documents holding each term, documents with terms, all their terms) over all of docs(id, text)."""
    sent, size = docs.sparkSession.sparkContext.broadcast(items.vocabulary), len(items.vocabulary.hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, filled, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), FLAGS)
                df += np.bincount(sent.value.entries(words)[1], minlength=size)
                n = np.diff(words.first)
                filled, total = filled + int((n > 0).sum()), total + int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], seen))), pa.array(np.concatenate(([filled, total], df[seen])))], names=["term", "n"])
    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the block
    sent.destroy()
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(size, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term == -1].sum()), int(n[term == -2].sum())


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def values(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, total: int) -> np.ndarray:
    """weight * ((1000000000 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total)))


class Shard:
    """Documents as sparse rows, in the order of a tree of balls; ``balls`` are (start, end, children), the roots first."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        rng = np.random.default_rng(len(ids))
        place = rng.standard_normal((int(term.max()) + 1, 6))[term] * value[:, None]
        points = np.stack([np.bincount(row, place[:, j], len(ids)) for j in range(6)] + [np.sqrt(np.bincount(row, value.astype(float) ** 2, len(ids)))], axis=1)
        order: list[np.ndarray] = []
        self.balls: list[tuple[int, int, list[int]]] = []

        def cut(rows: np.ndarray, into: int) -> list[np.ndarray]:
            if into == 1 or len(rows) < 2:
                return [rows]
            mine = points[rows]
            by = rows[np.argsort(mine[:, int(np.argmax(np.ptp(mine, axis=0)))], kind="stable")]
            return cut(by[:len(by) // 2], into // 2) + cut(by[len(by) // 2:], into // 2)

        def ball(rows: np.ndarray, start: int) -> int:
            me = len(self.balls)
            self.balls.append((start, start + len(rows), []))
            if len(rows) <= leaf:
                order.append(rows)
            else:
                for part in cut(rows, fan):
                    self.balls[me][2].append(ball(part, start))
                    start += len(part)
            return me
        ball(np.arange(len(ids)), 0)
        order_all = np.concatenate(order)
        rank = np.empty(len(ids), np.int64)
        rank[order_all] = np.arange(len(ids))
        by = np.argsort(rank[row], kind="stable")
        self.ids, self.row, self.term, self.value = ids[order_all], rank[row][by], term[by], value[by]

    def bounds_of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(terms, centroid, radius along each term, radius) of a ball."""
        start, end, _ = self.balls[n]
        a, b = np.searchsorted(self.row, (start, end))
        order = np.argsort(self.term[a:b], kind="stable")
        t, v = self.term[a:b][order], self.value[a:b][order].astype(float)
        terms, at = np.unique(t, return_index=True)
        size = end - start
        centroid, most = np.add.reduceat(v, at) / size, np.maximum.reduceat(v, at)
        # |x - c|^2 = |c|^2 + sum over the terms of x of (v^2 - 2 v c)
        c = np.repeat(centroid, np.diff(np.append(at, len(t))))
        far = np.bincount(self.row[a:b][order] - start, v * v - 2 * v * c, size) + (centroid ** 2).sum()
        return terms, centroid, most - centroid, math.sqrt(max(float(far.max()), 0.0))

    def leaf(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, terms, values by term and document)."""
        start, end, _ = self.balls[n]
        a, b = np.searchsorted(self.row, (start, end))
        terms, col = np.unique(self.term[a:b], return_inverse=True)
        dense = np.zeros((len(terms), end - start))
        dense[col, self.row[a:b] - start] = self.value[a:b]
        return self.ids[start:end], terms, dense


class Best:
    """The k best of each item so far: scores falling, ties by rising id; score 0 is none."""

    def __init__(self, items: int, k: int):
        self.score, self.id = np.zeros((items, k), np.int64), np.full((items, k), np.iinfo(np.int64).max)

    def add(self, who: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        """s: scores of ids for the items ``who``."""
        k = self.score.shape[1]
        row, col = np.nonzero((s > 0) & (s >= self.score[who, -1][:, None]))
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate((np.repeat(touched, k), row))
        score = np.concatenate((self.score[who[touched]].ravel(), s[row, col]))
        names = np.concatenate((self.id[who[touched]].ravel(), ids[col]))
        order = np.lexsort((names, -score, rows))
        rows, score, names = rows[order], score[order], names[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
        self.score[who[touched]], self.id[who[touched]] = score[keep].reshape(-1, k), names[keep].reshape(-1, k)


def members(items: Items, who: np.ndarray, terms: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the terms each item asks for, as zeros and ones; ``place`` is scratch space as long as the vocabulary."""
    place[terms] = np.arange(len(terms))
    length = items.first[who + 1] - items.first[who]
    at = np.repeat(items.first[who] - np.cumsum(length) + length, length) + np.arange(length.sum())
    col = place[items.term[at]]
    place[terms] = -1
    out = np.zeros((len(who), len(terms)))
    out[np.repeat(np.arange(len(who)), length)[col >= 0], col[col >= 0]] = 1
    return out


def search(shard: Shard, items: Items, best: Best, place: np.ndarray, rows: int = ITEM_ROWS) -> int:
    """Brings ``best`` up to date with the documents of a shard; returns how many products (item, document) were formed."""
    everyone = np.arange(len(items.ids))
    formed = 0

    def bound(n: int, who: np.ndarray) -> np.ndarray:
        terms, centroid, along, radius = shard.bounds_of(n)
        out = np.empty(len(who))
        for at in range(0, len(who), rows):
            m = members(items, who[at:at + rows], terms, place)
            middle = m @ centroid
            out[at:at + rows] = np.minimum(middle + m @ along, middle + radius * np.sqrt(m.sum(axis=1)))
        return out * (1 + 1e-9) + 1  # above what rounding can take away

    first = bound(0, everyone)
    queue = [(-float(first.max(initial=0.0)), 0, everyone, first)]
    while queue:
        _, n, who, most = heapq.heappop(queue)
        open_ = (most >= best.score[who, -1]) & (most > 1)  # a bound of nothing but the margin: no term in common
        who = who[open_]
        if not len(who):
            continue
        children = shard.balls[n][2]
        if children:
            for child in children:
                b = bound(child, who)
                heapq.heappush(queue, (-float(b.max()), child, who, b))
            continue
        ids, terms, dense = shard.leaf(n)
        for at in range(0, len(who), rows):
            part = who[at:at + rows]
            # whole numbers below 2**53 throughout, so the product is exact
            best.add(part, (members(items, part, terms, place) @ dense).astype(np.int64), ids)
            formed += len(part) * len(ids)
    return formed


def searched(docs: DataFrame, items: Items, number: int, k: int, item_type: str) -> DataFrame:
    """(item, item_id, doc_id, score): each task's k best documents of each item; item numbers the item over all blocks."""
    df, documents, total = counts(docs, items)
    weight = weights(df, documents)
    if len(weight) and int(weight.max()) * 1_000_000 * int(np.diff(items.first).max()) >= 1 << 53:
        raise ValueError("an item has too many terms for exact scores")
    sent = docs.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        best, place = Best(len(items.ids), k), np.full(len(weight), -1, np.int64)
        held: list[tuple] = []

        def settle() -> None:
            ids, row, term, value = (np.concatenate(c) for c in zip(*held))
            search(Shard(ids, row, term, value), items, best, place)
        docs_held = entries_held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), FLAGS)
                row, term, tf = items.vocabulary.entries(words)
                value = values(tf, np.diff(words.first)[row], weight[term], documents, total)
                row, term, value = row[value > 0], term[value > 0], value[value > 0]
                have, row = np.unique(row, return_inverse=True)  # documents without any term score nothing
                if len(have):
                    held.append((part.column("id").to_numpy(zero_copy_only=False)[have], row + docs_held, term, value))
                    docs_held, entries_held = docs_held + len(have), entries_held + len(row)
                if docs_held >= SHARD_DOCS or entries_held >= SHARD_ENTRIES:
                    settle()
                    held, docs_held, entries_held = [], 0, 0
        if held:
            settle()
        item, at = np.nonzero(best.score > 0)
        names = pa.array([items.ids[i] for i in item.tolist()], pa_type)
        yield pa.RecordBatch.from_arrays([pa.array(item + (number << 32)), names, pa.array(best.id[item, at]), pa.array(best.score[item, at])], names=["item", "item_id", "doc_id", "score"])
    pa_type = pa.int64() if item_type == "bigint" else pa.int32() if item_type == "int" else pa.string()
    return docs.where("id is not null").mapInArrow(run, f"item long, item_id {item_type}, doc_id long, score long")


def ranked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
           k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by ascending doc_id.

    Items that repeat both id and text are one; an id with two texts is two items. Null and empty texts hold no terms: such
    items find nothing, such documents count nowhere. Documents without an id count in the statistics but aren't returned;
    rows that repeat are documents of their own. Very long texts are read whole. Extra columns are ignored; empty tables
    give an empty one.
    """
    item_type = benchmark.schema[item_id_col].dataType.simpleString()
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = benchmark.select(F.col(f"`{item_id_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow()
        if rows.num_rows:
            found = searched(docs, block_of_items(rows), b, k, item_type)
            parts.append(checkpointed(found) if blocks > 1 else found)
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    return reduce(DataFrame.unionAll, parts).withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
