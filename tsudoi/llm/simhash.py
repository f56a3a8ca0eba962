"""SimHash near-duplicates: fingerprints, BK-trees of shards, components.

Two 64-bit fingerprints that differ in at most R bits agree in at least B - R of B bit blocks. Every distinct fingerprint
is dealt to the shards of all choices of B - R blocks, so each link meets in a shard, whatever the data. A shard's
fingerprints form a BK-tree (children keyed by their Hamming distance to the parent) and each looks itself up, following
only edges within the radius. A shard above ``shard_rows`` is dealt into chunks, and the tree of each chunk is sent to the
tasks of all later chunks: bounded tasks, no pair left out. A task returns a spanning star of the links it found, never
all pairs of a group.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.llm.common import checkpointed, fresh, slices
from tsudoi.llm.components import components
from tsudoi.llm.similar import one_of_each

RADIUS, SHINGLE, SEED = 4, 4, 42
BLOCKS = 6
SHARD_ROWS = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends)), ">u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a bounded piece at a time: long texts
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) of every row; null and empty texts have fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                fps = np.array([fingerprint(t, shingle, seed) for t in part.column("t").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


def shard_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """One key for each choice of ``blocks - radius`` blocks: the number of the choice and the bits of its blocks."""
    cuts = [round(64 * b / blocks) for b in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for b in chosen:
            width = cuts[b + 1] - cuts[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, cuts[b]).bitwiseAND((1 << width) - 1))
        keys.append(key)
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """distinct(fp) -> (a, b): links whose components are those of all pairs within the radius."""
    if not 0 <= radius < blocks:
        raise ValueError("blocks must exceed the radius")
    keyed = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
    chunks = F.coalesce(F.ceil(F.col("n") / shard_rows), F.lit(1)).cast("int")
    dealt = keyed.join(large, "key", "left").select("fp", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"))
    dealt = dealt.select("fp", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") < F.col("other")).alias("first"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            cols = [np.concatenate((k, batch.column(c).to_numpy(zero_copy_only=False))) for c, k in enumerate(kept)] if kept \
                else [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            group = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            last = int(np.argmax(group))  # the last group may go on in the next batch
            kept = [c[last:] for c in cols]
            if last:
                yield found([c[:last] for c in cols], radius)
        if kept:
            yield found(kept, radius)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(run, "a long, b long")


def found(cols: list[np.ndarray], radius: int) -> pa.RecordBatch:
    """Star links of the groups of sorted (key, i, j, first, fp) columns."""
    key, i, j, first, fp = cols
    new = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
    group = np.cumsum(new) - 1
    rows = np.flatnonzero(np.bincount(group)[group] > 1)
    group, side, fp, both = group[rows], first[rows].astype(bool), fp[rows].view(np.uint64), (i == j)[rows]
    label = np.arange(len(rows))
    tree = Tree(fp, group, np.flatnonzero(both | side))
    for q, node in tree.search(np.flatnonzero(both | ~side), radius):
        label = join_labels(label, q, node)
    moved = np.flatnonzero(label != np.arange(len(rows)))
    signed = fp.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], names=["a", "b"])


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component after linking a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (step := label[label]).tobytes() != label.tobytes():
            label = step


class Tree:
    """BK-trees of many groups at once, held as arrays and built level by level."""

    def __init__(self, fp: np.ndarray, group: np.ndarray, members: np.ndarray):
        self.fp, n = fp, len(fp)
        self.root = np.full(int(group.max()) + 1 if len(group) else 0, -1, np.int64)  # by group
        self.group = group
        edges: list[np.ndarray] = []
        roots, at = np.unique(group[members], return_index=True)
        self.root[roots] = members[at]
        rest = np.setdiff1d(members, members[at])
        node = self.root[group[rest]]
        while len(rest):
            d = np.bitwise_count(fp[rest] ^ fp[node]).astype(np.int64)
            slot = node * 128 + d
            slots, at = np.unique(slot, return_index=True)
            child = rest[at]
            edges.append(np.stack((slots, child)))
            node = child[np.searchsorted(slots, slot)]
            go = np.ones(len(rest), bool)
            go[at] = False
            rest, node = rest[go], node[go]
        slots = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        order = np.argsort(slots[0])
        self.slot, self.child = slots[0][order], slots[1][order]  # slot: parent * 128 + distance

    def search(self, queries: np.ndarray, radius: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, a bounded part of the frontier at a time."""
        root = self.root[self.group[queries]]
        stack = [(queries[root >= 0], root[root >= 0])]
        while stack:
            q, node = stack.pop()
            if len(q) > most:
                stack += [(q[most:], node[most:])]
                q, node = q[:most], node[:most]
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.slot, node * 128 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.slot, node * 128 + d + radius, "right")
            count = high - low
            if count.any():
                at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                stack.append((np.repeat(q, count), self.child[at]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED,
                    blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp long, root long, component_id): root names the component, component_id is its smallest doc_id.

    One row for each input row, repeated rows too. Documents without an id take part in components; component_id is null
    only if none of its documents has an id. Extra columns are ignored; an empty table gives an empty one.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, radius, blocks, shard_rows))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member = member.join(smallest, "root").select("fp", "root", "component_id")
    return fps.join(member, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one document left of each component: that with the smallest id, else one without an id.

    Rows that repeat both id and text count as one document, of which one row stays.
    """
    whole = fresh(docs, "id")
    named = docs.withColumn(whole, F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark")))
    members = near_duplicates(named, whole, text_col, **options).select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.mark").alias("mark"), "root")
    return one_of_each(docs, members, id_col, text_col)
