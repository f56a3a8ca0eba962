"""Near copies for stages: word sets with Jaccard similarity of at least 0.8, found by wide fingerprint search.

Texts with the same set of five-word shingles are one node (named by a 64-bit hash of the set). Each node has a 64-bit
SimHash of its set, a second one from other hash values, and an odd sketch of 512 bits. The nodes are dealt into blocks of at most
``block_rows``; the block's shards (nodes next to each other in set size) become BK-trees, the trees go out by broadcast, and every
node looks itself up in the trees of each block: those within ``radius`` bits, and ``both`` bits of the two together, whose set sizes
allow the similarity are candidates. A tree's small branches are kept as buckets. At this radius a search follows nearly all
edges (fingerprints of unrelated texts are 32 bits apart, give or take 4), so what it leaves out are the sizes the node can't be
similar to. Candidates become links only if the sets themselves, read again from the texts, are similar enough.

The search runs twice. The first gives each node its smallest and its nearest candidate of a block, which joins most of a
dense group; the second gives all candidates whose ends are still in different components, so no pair is left out.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsudoi.llm.common import Words, checkpointed, fresh, mixed, slices, word_table
from tsudoi.llm.components import components

SIMILARITY, SHINGLE, RADIUS, BOTH = 0.8, 5, 22, 36
BLOCK_ROWS, TASK_ROWS, SLOTS = 1 << 18, 1 << 12, 1 << 22
SHARD_ROWS, BUCKET = 1 << 13, 1 << 10
ODD = tuple(f"odd{k}" for k in range(8))
FLAGS = word_table(bytes(b for b in range(256) if b not in b" \t\n\r\v\f"))


def sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, no words are none."""
    words = Words(column, FLAGS)
    count = np.diff(words.first)
    rows, hashes = [], []
    for k in [k for k in range(1, shingle) if (count == k).any()] + [shingle]:
        at, h = words.grams(k)
        row = words.row[at]
        mine = count[row] == k if k < shingle else np.ones(len(row), bool)
        rows.append(row[mine])
        hashes.append(h[mine])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    ends = np.searchsorted(np.sort(row), np.arange(words.n + 1))
    h = h[np.argsort(row, kind="stable")]
    return [np.unique(h[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def majority(h: np.ndarray) -> int:
    """SimHash: bit i is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def odd_sketch(h: np.ndarray) -> np.ndarray:
    """Bit i is set if an odd number of the hashes fall into slot i of 512: two sets differ in as many elements as their
    sketches differ in bits, or more."""
    odd = np.bincount((h >> np.uint64(17)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def shapes(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, k, fp, fp2, n, odd0 to odd7) of every row: mark names the text, k its set; then the set's fingerprints, size and sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                found = sets(part.column("t"), shingle)
                k = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
                fp = np.array([majority(s) for s in found], np.uint64).view(np.int64)
                fp2 = np.array([majority(mixed(~s)) for s in found], np.uint64).view(np.int64)
                n = np.array([len(s) for s in found], np.int64)
                odd = np.array([odd_sketch(s) for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(k), pa.array(fp), pa.array(fp2), pa.array(n), *[pa.array(odd[:, c]) for c in range(len(ODD))]],
                                                 names=["doc_id", "mark", "k", "fp", "fp2", "n", *ODD])
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("t")).mapInArrow(run, ", ".join([f"doc_id {kind}, mark long, k long, fp long, fp2 long, n long", *[f"{c} long" for c in ODD]]))


class Block:
    """Nodes in order of (n, k), and the BK-trees of their shards."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, shard_rows: int = SHARD_ROWS, bucket: int = BUCKET):
        k, fp, fp2, n, label = (rows.column(c).to_numpy() for c in ("k", "fp", "fp2", "n", "label"))
        order = np.lexsort((k, n))
        self.k, self.n, self.label = k[order], n[order], label[order]
        self.fp, self.fp2 = fp[order].view(np.uint64), fp2[order].view(np.uint64)
        has = [c for c in ODD if c in rows.schema.names]
        self.odd = np.stack([rows.column(c).to_numpy()[order].view(np.uint64) for c in has], axis=1) if has else np.zeros((len(k), 0), np.uint64)
        self.sizes, self.built = (shard_rows, bucket), None

    def trees(self) -> list[Tree]:
        """Built once, before the block goes out."""
        if self.built is None:
            shard_rows, bucket = self.sizes
            self.built = [Tree(self.fp, low, min(low + shard_rows, len(self.k)), bucket) for low in range(0, len(self.k), shard_rows)]
        return self.built


class Tree:
    """BK-tree of the nodes ``low`` to ``high`` of a block: a branch holds a pivot and, by Hamming distance to it, its children. A branch
    of at most ``bucket`` nodes, or of equal fingerprints, is a bucket of them in order of place."""

    def __init__(self, fp: np.ndarray, low: int, high: int, bucket: int = BUCKET):
        self.low, self.high = low, high
        self.root: list = []
        todo = [(self.root, np.arange(low, high))]
        while todo:  # a slot to fill, and the places that belong there
            slot, at = todo.pop()
            if len(at) <= bucket or (fp[at] == fp[at[0]]).all():
                slot += [at, fp[at]]
                continue
            pivot, rest = at[0], at[1:]
            d = np.bitwise_count(fp[rest] ^ fp[pivot])
            edges = np.unique(d)
            children: list[list] = [[] for _ in edges]
            slot += [pivot, fp[pivot], edges.astype(np.int64), children]
            todo += [(child, rest[d == e]) for child, e in zip(children, edges)]

    def search(self, fp: np.ndarray, radius: int, low: int, high: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(index in fp, place, distance) of all places from low to high within the radius, at most ``most`` places of a bucket at a time."""
        todo = [(self.root, np.arange(len(fp)))]
        while todo:
            slot, q = todo.pop()
            if len(slot) == 2:
                at, own = slot
                first, last = np.searchsorted(at, low), np.searchsorted(at, high)
                for a in range(int(first), int(last), most):
                    d = np.bitwise_count(fp[q][:, None] ^ own[None, a:min(a + most, int(last))])
                    i, x = np.nonzero(d <= radius)
                    if len(i):
                        yield q[i], at[x + a], d[i, x].astype(np.int64)
                continue
            pivot, own, edges, children = slot
            d = np.bitwise_count(fp[q] ^ own).astype(np.int64)
            hit = d <= radius
            if low <= pivot < high and hit.any():
                yield q[hit], np.full(int(hit.sum()), pivot), d[hit]
            for e, child in zip(edges, children):
                go = np.abs(d - e) <= radius
                if go.any():
                    todo.append((child, q[go]))


def near(mine: Block, block: Block, radius: int, both: int, similarity: float, every: bool, rows: int = 256, most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index in mine, index in block) of pairs within the radius, the second before the first in order of (n, k).

    every: all of them that differ in label; otherwise the first and the nearest of each in mine. Sets of that similarity
    differ in (1 - s) / (1 + s) of their sizes at most, so pairs whose sketches differ in more bits are none; this loses nothing.
    """
    share = (1 - similarity) / (1 + similarity)
    for at in range(0, len(mine.k), rows):
        fp, n = mine.fp[at:at + rows], mine.n[at:at + rows]
        low, high = (int(x) for x in (np.searchsorted(block.n, int(similarity * n[0]), "left"), np.searchsorted(block.n, n[-1], "right")))
        first: list[np.ndarray] = []
        for tree in block.trees():
            if tree.low >= high or tree.high <= low:
                continue
            for q, x, d in tree.search(fp, radius, low, high, most):
                q = q + at
                d += np.bitwise_count(mine.fp2[q] ^ block.fp2[x])
                ok = (block.n[x] < mine.n[q]) | ((block.n[x] == mine.n[q]) & (block.k[x] < mine.k[q]))
                ok &= (d <= both) & (block.n[x] >= similarity * mine.n[q]) & (block.label[x] != mine.label[q])
                ok &= np.bitwise_count(mine.odd[q] ^ block.odd[x]).sum(axis=1) <= share * (mine.n[q] + block.n[x]) + 1e-6
                if every:
                    yield q[ok], x[ok]
                elif ok.any():
                    first.append(few(np.stack((q[ok], x[ok], d[ok]))))
        if first:
            q, x, _ = few(np.concatenate(first, axis=1))
            yield q, x


def few(found: np.ndarray) -> np.ndarray:
    """Of (q, x, distance) columns, those with the smallest x and the smallest distance of each q."""
    q, x, d = found
    by_x, by_d = found[:, np.lexsort((x, q))], found[:, np.lexsort((x, d, q))]
    return np.unique(np.concatenate([part[:, np.unique(part[0], return_index=True)[1]] for part in (by_x, by_d)], axis=1), axis=1)


def candidates(nodes: DataFrame, radius: int, both: int, similarity: float, every: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """nodes(k, fp, fp2, n, label) -> (a, b) within the radius; each block is one pass over the nodes."""
    spark, total = nodes.sparkSession, nodes.count()
    blocks = max(1, -(-total // block_rows))
    dealt = nodes.select("k", "fp", "fp2", "n", "label", *ODD).repartition(max(1, -(-total // TASK_ROWS)), "k")
    out = []
    for b in range(blocks):
        block = Block(nodes.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).select("k", "fp", "fp2", "n", "label", *ODD).toArrow())
        block.trees()
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mine = Block(batch)
                for q, x in near(mine, sent.value, radius, both, similarity, every):
                    yield pa.RecordBatch.from_arrays([pa.array(mine.k[q]), pa.array(sent.value.k[x])], names=["a", "b"])
        out.append(checkpointed(dealt.mapInArrow(run, "a long, b long")))
        sent.destroy()
    return reduce(DataFrame.unionAll, out)


def marked(marks: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """A bit for each slot of the marks(m): at most ``slots`` numbers reach the driver, however many marks there are."""
    found = marks.select(F.pmod("m", F.lit(slots)).alias("s")).distinct().toArrow().column("s").to_numpy()
    bits = np.zeros(slots, bool)
    bits[found] = True
    return np.packbits(bits, bitorder="little")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """The pairs whose sets are at least so similar. Sets come from one text of each node that a pair names.

    Texts that surely belong to no such node leave before the shuffle (a bit for each slot of their marks), and the copies of
    one text become one row there, so neither the corpus nor a hot text crosses the network.
    """
    named = pairs.select(F.col("a").alias("k")).unionAll(pairs.select(F.col("b").alias("k"))).distinct()
    marks = checkpointed(nodes.join(named, "k", "left_semi").select("k", F.col("mark").alias("m")))
    sent = docs.sparkSession.sparkContext.broadcast(marked(marks))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("m").to_numpy() % (len(sent.value) * 8)
            yield batch.filter(pa.array(((sent.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([s.view(np.int64) for s in sets(part.column("t"), shingle)], pa.list_(pa.int64()))], names=["k", "s"])
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.xxhash64(text).alias("m"), text.alias("t")).mapInArrow(wanted, "m long, t string").groupBy("m").agg(F.first("t").alias("t"))
    found = checkpointed(texts.join(marks, "m").select("k", "t").mapInArrow(shingled, "k long, s array<long>"))
    sent.destroy()
    both = pairs.join(found.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(found.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("same"))
    return checkpointed(both.where(F.col("same") >= similarity * (F.col("n") - F.col("same"))).select("a", "b"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS,
           both: int = BOTH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, mark, root) of every row: rows with one root are joined by links of similar sets. Texts without words are one set."""
    members = checkpointed(shapes(docs, id_col, text_col, shingle))
    nodes = checkpointed(members.groupBy("k").agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("n").alias("n"), F.min("mark").alias("mark"), *[F.min(c).alias(c) for c in ODD]))
    links = verified(candidates(nodes.withColumn("label", F.col("k")), radius, both, similarity, False, block_rows), nodes, docs, text_col, similarity, shingle)
    roots = components(links)
    labelled = checkpointed(nodes.join(roots, nodes.k == roots.node, "left").select("k", "fp", "fp2", "n", *ODD, F.coalesce("root", "k").alias("label")))
    rest = verified(candidates(labelled, radius, both, similarity, True, block_rows), nodes, docs, text_col, similarity, shingle)
    roots = components(links.unionAll(rest))
    return members.join(roots, members.k == roots.node, "left").select("doc_id", "mark", F.coalesce("root", "k").alias("root"))


def one_of_each(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that stand for a root of members(doc_id, mark, root): smallest id, then no id; one row of (id, text)."""
    best = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("w"))
    kept, key = fresh(docs, "kept"), fresh(docs, "key")
    best = checkpointed(best.select(F.xxhash64("w.doc_id", "w.mark").alias(kept)))
    named = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))))
    return named.join(best, F.col(key) == F.col(kept), "left_semi").dropDuplicates([key]).drop(key)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one document left of each group: that with the smallest id, else one without an id.

    Rows that repeat both id and text count as one document, of which one row stays.
    """
    return one_of_each(docs, groups(docs, id_col, text_col, **options), id_col, text_col)
