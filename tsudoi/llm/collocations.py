"""Phrase collocations of one to four words from a weighted de Bruijn graph of each language.

A node is a run of three words and an edge the run of four that overlaps two nodes. Every word occurrence gives one row:
the edge that starts there, or, near the end of its piece, the shorter run that is left. Only these longest runs are
counted from the texts. Counts of shorter phrases are then node flow: what leaves a node over its edges, plus the pieces
that end in it, so f(3 words) = sum of f(edges out) + ends, and so on down to single words. A run of two or three words
that occurs less often than a phrase must is in no phrase and in no part of one, so longest runs end before it; such runs
are told by counters of hashed runs, which may take a rare one for a frequent one but never the reverse.

Edges that occur often enough form the graph that phrases come from. Chains of edges whose inner nodes pass their whole
flow on (weight in = node flow = weight out) are unary paths; they are compacted by pointer doubling to one row that holds
its words and one weight. Along a path every edge and every inner node has that weight, so their scores and their
being part of a longer phrase are read off the path, and only the ends of paths and branching nodes are looked up.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsudoi.llm.common import BASE, Words, checkpointed, mixed, slices, word_table

BREAKS = b".,;:!?\n\v\f\r"
FLAGS = word_table(bytes(b for b in range(256) if b not in BREAKS + b" \t"))
BREAK = word_table(BREAKS)
LEAST, TOP, SHARE, LONGEST = 30, 2000, 80, 4
COMBINE, BLOCK = 1 << 20, 1 << 16


class Pieces:
    """Words of texts with the language hash of each, and whether a word and the next stand in one piece."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        self.words = words = Words(text, FLAGS)
        piece = np.cumsum(BREAK[words.data])[words.start]
        self.joined = (np.diff(words.row) == 0) & (np.diff(piece) == 0)
        code = lang.dictionary_encode()
        names = np.array([xxhash.xxh64_intdigest(x) for x in code.dictionary.to_pylist()], np.uint64)
        self.lang = names[code.indices.to_numpy()][words.row]

    def grams(self, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the runs of one word more than the filters go, in one piece, whose shorter runs all pass."""
        at, h = np.flatnonzero(self.joined), self.words.hash
        with np.errstate(over="ignore"):
            code = h[at] * np.uint64(BASE) + h[at + 1] + self.lang[at]
            for k, bits in enumerate(filters):
                fine = passes(bits, mixed(code))
                at, code = at[fine], code[fine]
                both = np.flatnonzero(np.diff(at) == 1)  # the run that starts at the next word passes too
                at, code = at[both], code[both] * np.uint64(BASE) + h[at[both] + k + 2]
        return at, mixed(code)


def passes(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    slot = code & np.uint64(len(bits) * 8 - 1)
    return ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def runs(text: pa.Array, lang: pa.Array, filters: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(row, pair, rest) for each word: the run of up to four words that starts there; rest is after the second word.

    A run ends with its piece, and before the word with which its last two or three words don't pass the filters.
    """
    found = Pieces(text, lang)
    words = found.words
    m = len(words.start)
    if not m:
        return words.row, pa.array([], pa.string()), pa.array([], pa.string())
    size = np.ones(m, np.int64)
    pair, code = found.grams([])
    size[pair[passes(filters[0], code)]] = 2
    triple, code = found.grams(filters[:1])
    triple = triple[passes(filters[1], code)]
    size[triple] = 3
    size[triple[:-1][np.diff(triple) == 1]] = 4
    # the words once more, one blank after each: a run is then a stretch of bytes
    length = words.end - words.start
    start = np.cumsum(length + 1) - length - 1
    copy = np.full(int(start[-1] + length[-1]) + 1, 32, np.uint8)
    at = np.repeat(words.start - np.cumsum(length) + length, length) + np.arange(length.sum())
    copy[at + np.repeat(start - words.start, length)] = words.data[at]
    stop, i = start + length, np.arange(m)
    third = start[np.minimum(i + 2, m - 1)]
    return words.row, stretches(copy, start, stop[i + np.minimum(size, 2) - 1]), stretches(copy, third, np.where(size > 2, stop[i + size - 1], third))


def stretches(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The byte ranges of data as strings."""
    length = stop - start
    offsets = np.concatenate(([0], np.cumsum(length)))
    taken = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken))


def prepared(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("t")).where("t is not null")


def often(texts: DataFrame, least: int, filters: list[np.ndarray], slots: int) -> np.ndarray:
    """A bit for each slot of hashed runs of neighbouring words, pairs or, given a filter of pairs, runs of three: set if the
    runs of that slot occur ``least`` times or more.

    A run whose bit isn't set is rarer, and so is every phrase that holds it. Each task counts into an array of bytes that
    stop at ``least``, sent on in blocks; the blocks of all tasks are summed where they meet, and the driver gets one bit a slot.
    """
    if not 1 <= least <= 127:
        raise ValueError("least must be from 1 to 127")
    block = min(slots, BLOCK)
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, rows = np.zeros(slots, np.uint8), [], 0

        def add() -> None:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            seen[slot] = np.minimum(seen[slot] + np.minimum(n, least), least)
        for batch in batches:
            for part in slices(batch, "t"):
                held.append((Pieces(part.column("t"), part.column("lang")).grams(sent.value)[1] & np.uint64(slots - 1)).astype(np.int64))
                rows += len(held[-1])
                if rows >= COMBINE:
                    add()
                    held, rows = [], 0
        if held:
            add()
        for k in np.flatnonzero(seen.reshape(-1, block).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen[k * block:(k + 1) * block].tobytes()])], names=["k", "seen"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()])], names=["k", "bits"])
        for batch in batches:
            for k, seen in zip(batch.column("k").to_pylist(), batch.column("seen")):
                if k != now:
                    if now is not None:
                        yield out()
                    now, sums = k, np.zeros(block, np.uint8)
                sums = np.minimum(sums + np.frombuffer(seen.as_buffer(), np.uint8), least).astype(np.uint8)
        if now is not None:
            yield out()
    found = texts.mapInArrow(count, "k int, seen binary").repartition("k").sortWithinPartitions("k").mapInArrow(total, "k int, bits binary").toArrow()
    bits = np.zeros(slots // 8, np.uint8)
    for k, b in zip(found.column("k").to_pylist(), found.column("bits")):
        bits[k * block // 8:(k + 1) * block // 8] = np.frombuffer(b.as_buffer(), np.uint8)
    sent.destroy()
    return bits


def filters_of(texts: DataFrame, least: int, slots: int | None = None) -> list[np.ndarray]:
    """The filters of pairs and of runs of three. There is a slot for 64 bytes of text, from 2^16 to 2^26 (8 MB of bits): more
    text makes the filters less sharp, never wrong."""
    if slots is None:
        size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        slots = 1 << min(26, max(16, (size // 64).bit_length()))
    pairs = often(texts, least, [], slots)
    return [pairs, often(texts, least, [pairs], slots)]


def longest_runs(texts: DataFrame, least: int, slots: int | None = None) -> DataFrame:
    """(lang, pair, rest, n): the runs of texts(lang, t) with their counts; single words are complete, other runs end where pairs or runs of three are too rare."""
    def combined(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        found = pa.concat_tables(tables).group_by(["lang", "pair", "rest"]).aggregate([("n", "sum")]).rename_columns(["lang", "pair", "rest", "n"])
        yield from found.cast(pa.schema([("lang", pa.string()), ("pair", pa.string()), ("rest", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=1 << 16)
    sent = texts.sparkSession.sparkContext.broadcast(filters_of(texts, least, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, "t"):
                row, pair, rest = runs(part.column("t"), part.column("lang"), sent.value)
                if len(row):
                    held.append(pa.table({"lang": part.column("lang").take(pa.array(row)), "pair": pair, "rest": rest, "n": np.ones(len(row), np.int64)}))
                    rows += len(row)
                if rows >= COMBINE // 4:
                    yield from combined(held)
                    held, rows = [], 0
        if held:
            yield from combined(held)
    return texts.mapInArrow(run, "lang string, pair string, rest string, n long").groupBy("lang", "pair", "rest").agg(F.sum("n").alias("n"))


def first_words(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def counted(runs: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, f): phrases of one to four words with at least ``least`` occurrences, and size 0: all words of a language."""
    often, total = F.col("f") >= least, F.sum("f").alias("f")
    runs = checkpointed(runs.withColumnRenamed("n", "f"))
    nodes = runs.where("rest <> ''").groupBy("lang", "pair", first_words(F.col("rest"), 1).alias("rest")).agg(total)  # edges out, and pieces that end there
    pairs = runs.groupBy("lang", "pair").agg(total)
    words = runs.groupBy("lang", first_words(F.col("pair"), 1).alias("phrase")).agg(total)
    whole = words.groupBy("lang").agg(total).select("lang", F.lit(0).alias("size"), F.lit("").alias("phrase"), "f")
    named = lambda df, k: df.where(often).select("lang", F.lit(k).alias("size"), F.concat_ws(" ", "pair", "rest").alias("phrase"), "f")
    return (named(runs.where(F.contains("rest", F.lit(" "))), 4).unionAll(named(nodes, 3))
            .unionAll(pairs.where(often & F.contains("pair", F.lit(" "))).select("lang", F.lit(2).alias("size"), F.col("pair").alias("phrase"), "f"))
            .unionAll(words.where(often).select("lang", F.lit(1).alias("size"), "phrase", "f")).unionAll(whole))


def paths(counts: DataFrame) -> DataFrame:
    """(lang, words array, f): the edges (phrases of four words), those of a unary path as one row.

    Pointer doubling: each edge points at the one before it over a unary node, then at that one's target, and so on, until
    all point at the head of their path; the rounds are the logarithm of the longest path. A cycle can't be unary, as the
    piece that runs through it has to start somewhere.
    """
    edges = counts.where("size = 4").select("lang", F.col("phrase").alias("e"), first_words(F.col("phrase"), 3).alias("u"), F.substring_index("phrase", " ", -3).alias("v"), "f")
    node = counts.where("size = 3").select("lang", F.col("phrase").alias("v"), F.col("f").alias("flow"))
    into = edges.join(node, ["lang", "v"]).where("f = flow").select("lang", F.col("v").alias("u"), F.col("e").alias("before"), "f")
    now = checkpointed(edges.join(into, ["lang", "u", "f"], "left").select("lang", "e", "f", F.coalesce("before", "e").alias("head"), F.col("before").isNotNull().cast("long").alias("at")))
    while True:
        there = now.select("lang", F.col("e").alias("head"), F.col("head").alias("beyond"), F.col("at").alias("more")).where("more > 0")
        new = checkpointed(now.join(there, ["lang", "head"], "left").select("lang", "e", "f", F.coalesce("beyond", "head").alias("head"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"), F.col("more").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            break
        now = new.drop("moved")
    # a path is as long as one piece at most; the words are those of the head and the last one of each further edge
    each = now.groupBy("lang", "head", "f").agg(F.array_sort(F.collect_list(F.struct("at", F.substring_index("e", " ", -1).alias("w")))).alias("x"))
    return each.select("lang", F.concat(F.slice(F.split("head", " "), 1, 3), F.transform("x", lambda s: s.w)).alias("words"), "f")


def ranked(counts: DataFrame, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The report of ``collocations`` from the counts."""
    path = checkpointed(paths(counts))
    whole = lambda c: c.cast("decimal(38,0)")
    key = lambda k, i: F.array_join(F.slice("words", F.col("i") + i, k), " ")
    # all phrases: edges from the paths; nodes only where they are no inner node of a path, as those lie in an edge of equal count
    step = path.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("words") - 3)))
    inner_before, inner_after = F.col("i") > 1, F.col("i") + 3 < F.size("words")
    edges = step.select("lang", key(4, 0).alias("phrase"), F.col("f").alias("a"), F.when(inner_before, F.col("f")).alias("f3a"), F.when(inner_after, F.col("f")).alias("f3b"))
    inner = path.where(F.size("words") > 4).withColumn("i", F.explode(F.sequence(F.lit(2), F.size("words") - 3))).select("lang", key(3, 0).alias("phrase"))
    shorter = counts.where("size in (2, 3)").select("lang", "phrase", F.col("f").alias("a"), "size")
    # what a longer phrase covers: the largest count of those that hold the phrase
    node = counts.where("size = 3").select("lang", F.col("phrase"), "f")
    p = F.col("phrase")
    mid = lambda a, k: F.substring_index(F.substring_index("phrase", " ", a + k - 1), " ", -k)
    parts4 = F.array(mid(1, 2), mid(2, 2), mid(3, 2), mid(1, 3), mid(2, 3))
    cover = edges.select("lang", "a", F.explode(parts4).alias("phrase")).unionAll(node.select("lang", F.col("f").alias("a"), F.explode(F.array(mid(1, 2), mid(2, 2))).alias("phrase")))
    cover = cover.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    rest = shorter.join(inner, ["lang", "phrase"], "left_anti").join(cover, ["lang", "phrase"], "left")
    rest = rest.where(F.col("most").isNull() | (whole(F.col("most")) * 100 < whole(F.col("a")) * share))
    # cuts: (k, first part, rest), with the count of a part where a path has told it
    none = F.lit(None).cast("long")
    cut = lambda k, n, left=none, right=none: F.struct(F.lit(k).alias("k"), first_words(p, k).alias("x"), left.alias("l"), F.substring_index("phrase", " ", k - n).alias("y"), right.alias("r"))
    cuts = edges.select("lang", "phrase", "a", F.explode(F.array(cut(1, 4, right=F.col("f3b")), cut(2, 4), cut(3, 4, left=F.col("f3a")))).alias("c"))
    cuts = cuts.unionAll(rest.where("size = 3").select("lang", "phrase", "a", F.explode(F.array(cut(1, 3), cut(2, 3))).alias("c")))
    cuts = cuts.unionAll(rest.where("size = 2").select("lang", "phrase", "a", F.explode(F.array(cut(1, 2))).alias("c"))).select("lang", "phrase", "a", "c.*")
    known = counts.where("size between 1 and 3")
    sided = None
    for part, name in (("x", "l"), ("y", "r")):
        source = cuts if sided is None else sided
        have = source.where(F.col(name).isNotNull())
        ask = source.where(F.col(name).isNull()).drop(name).join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
        sided = have.unionByName(ask)
    score = F.expr("cast(2000000 as decimal(38,0)) * a div cast(l + r as decimal(38,0))").cast("long")
    best = sided.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the ``top`` phrases of two to four words that hold together best.

    a: occurrences of the phrase, at least ``least``; l, r: of the two parts of its weakest cut; n: all words of the
    language; score: floor(2000000 a / (l + r)). A phrase goes if a longer one of at least ``least`` occurrences holds it and
    has ``share`` per cent of its count or more. A null language is ``und``; null and empty texts hold no words; repeated
    rows count as often as they stand there; very long texts are read whole. Extra columns are ignored; an empty table gives
    an empty one. Arithmetic is in whole numbers, products in 38 decimal digits.
    """
    return ranked(checkpointed(counted(longest_runs(prepared(docs, text_col, lang_col), least), least)), top, share)
