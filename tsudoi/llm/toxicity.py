"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; everything else is unlabelled, toxic texts included, so the risk of calling an
unlabelled text clean is corrected by the class prior p: R = p * R_P(+) + max(0, R_U(-) - p * R_P(-)). When the bracket
goes below zero the step goes back on it (Kiryo et al. 2017). The model is linear in hashed presence features: words and
word beginnings, so inflected forms share weight. Features are first screened by their contrast between the two samples.

The learning sample is bounded by ``positives`` and ``unlabelled`` ids, chosen by hash of the id, with one text each. The
model holds the ``MOST`` features of clearest contrast at most; counts of features and each text's chosen features are all that
reaches the driver. Scoring reads every whole text in one pass without a shuffle.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsudoi.llm.common import Words, checkpointed, fresh, mixed, slices, word_table

BITS, BEGINNINGS = 20, (4, 5, 6)
FLAGS = word_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
POSITIVES, UNLABELLED, MOST = 4_000, 8_000, 6_000


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct and sorted: hashed words and their first bytes."""
    words = Words(column, FLAGS)
    row, h = [words.row], [words.hash]
    for k, n in enumerate(BEGINNINGS):
        long = np.flatnonzero(words.end - words.start > n)
        head = np.zeros(len(long), np.uint64)
        for j in range(n):
            with np.errstate(over="ignore"):
                head = head * np.uint64(257) + words.data[words.start[long] + j].astype(np.uint64)
        row.append(words.row[long])
        h.append(mixed(head + np.uint64((k + 1) << 60)))
    pair = np.unique((np.concatenate(row).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(h) & np.uint64((1 << BITS) - 1)))
    return (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """A text's logit is bias + the sum of the weights of its features."""
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        row, feature = features(column)
        z = self.bias + np.bincount(row, self.weights[feature], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def screened(feature: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, most: int = MOST, least: int = 3, z: float = 3.5) -> np.ndarray:
    """The features whose shares in the two samples differ by ``z`` standard errors, the ``most`` clearest ones."""
    rate_all = (in_p + in_u) / (n_p + n_u)
    gap = in_p / n_p - in_u / n_u
    contrast = gap / np.sqrt(np.maximum(rate_all * (1 - rate_all), 1e-9) * (1 / n_p + 1 / n_u))
    fine = np.flatnonzero((np.abs(contrast) >= z) & (in_p + in_u >= least))
    fine = fine[np.lexsort((feature[fine], -np.abs(contrast[fine])))[:most]]
    return feature[fine]


def fit(p_rows: list[np.ndarray], u_rows: list[np.ndarray], chosen: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 0.02) -> Model:
    """nnPU with logistic loss, full-batch Adam over the chosen features; rows hold positions in ``chosen``; decay: weight
    decay times positives. No positives: a model that scores all zero."""
    weights = np.zeros(1 << BITS)
    if not p_rows or not u_rows:
        return Model(weights, -30.0)
    n_p, n_u = len(p_rows), len(u_rows)
    if not len(chosen):
        return Model(weights, float(np.log(prior / (1 - prior))))

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    (pr, pc), (ur, uc) = matrix(p_rows), matrix(u_rows)
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    soft = lambda x: np.logaddexp(0, x)
    for step in range(1, steps + 1):
        zp = b + np.bincount(pr, w[pc], minlength=n_p)
        zu = b + np.bincount(ur, w[uc], minlength=n_u)
        negative = soft(zu).mean() - prior * soft(zp).mean()
        # derivative by z of: prior * loss(+) on P; of the bracket on U and on P
        if negative >= 0:
            dp, du = prior * (-sigmoid(-zp) - sigmoid(zp)) / n_p, sigmoid(zu) / n_u
        else:
            dp, du = prior * sigmoid(zp) / n_p, -sigmoid(zu) / n_u
        g = np.append(np.bincount(pc, dp[pr], minlength=len(chosen)) + np.bincount(uc, du[ur], minlength=len(chosen)) + decay / n_p * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[chosen] = w
    return Model(weights, float(b))


def learning_row(id_col: Column, folds: int = 5) -> Column:
    """True for rows that labels may be learned from: crc32 of the id as text, modulo the folds, isn't zero. Null: not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds != 0, F.lit(False))


def sampled(docs: DataFrame, confirmed: DataFrame, anyone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, t, p, u): one text of each chosen id, the smallest of those that repeat it, and which sample it is in."""
    flags = confirmed.select("i", F.lit(1).alias("p"), F.lit(0).alias("u")).unionAll(anyone.select("i", F.lit(0).alias("p"), F.lit(1).alias("u")))
    flags = flags.groupBy("i").agg(F.max("p").alias("p"), F.max("u").alias("u"))  # a bounded set of ids
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null")
    found = texts.join(F.broadcast(flags), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("p").alias("p"), F.max("u").alias("u"))
    return checkpointed(found)


def learned(rows: DataFrame, prior: float) -> Model:
    """Trains on rows(i, t, p, u). Features are counted and screened before rows are collected, so the driver holds one
    count a feature and a few numbers a text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for part in slices(batch, "t"):
                row, feature = features(part.column("t"))
                for k, name in enumerate(("p", "u")):
                    n[k] += np.bincount(feature[part.column(name).to_numpy()[row] > 0], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0][some].astype(np.int64)), pa.array(n[1][some].astype(np.int64))], names=["f", "p", "u"])
    sizes = rows.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("u"), F.lit(0)).alias("u")).first()
    if not sizes["p"] or not sizes["u"]:
        return fit([], [], np.zeros(0, np.int64), prior)
    found = rows.mapInArrow(count, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p + u >= 3").toArrow()
    chosen = np.sort(screened(*(found.column(c).to_numpy() for c in ("f", "p", "u")), sizes["p"], sizes["u"]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                row, feature = features(part.column("t"))
                at = np.minimum(np.searchsorted(chosen, feature), max(0, len(chosen) - 1))
                mine = chosen[at] == feature if len(chosen) else np.zeros(len(feature), bool)
                row, at = row[mine], at[mine]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32()), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("p"), part.column("u"), lists], names=["i", "p", "u", "f"])
    kind = rows.schema["i"].dataType.simpleString()
    got = rows.mapInArrow(pick, f"i {kind}, p int, u int, f array<int>").toArrow().sort_by("i")
    each = [x.values.to_numpy() for chunk in got.column("f").chunks for x in chunk]
    side = lambda name: [each[k] for k in np.flatnonzero(got.column(name).to_numpy())]
    return fit(side("p"), side("u"), chosen, prior)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          positives: int = POSITIVES, unlabelled: int = UNLABELLED, folds: int = 5) -> Model:
    """Trains on at most ``positives`` + ``unlabelled`` texts of the learning rows; the prior is counted over all their labels."""
    mine = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y")).where(learning_row(F.col("i"), folds)).where("y in (0, 1)")
    share = mine.agg(F.avg("y")).first()[0]
    if not share:
        return fit([], [], np.zeros(0, np.int64), 0.0)
    order = F.xxhash64(F.col("i"), F.lit("toxicity"))
    confirmed = mine.where("y = 1").select("i").distinct().orderBy(order, "i").limit(positives)
    anyone = docs.select(F.col(f"`{id_col}`").alias("i")).where(learning_row(F.col("i"), folds)).distinct().orderBy(order, "i").limit(unlabelled)
    return learned(sampled(docs, confirmed, anyone, id_col, text_col), min(share, 0.99))


def scored(docs: DataFrame, model: Model, columns: list[str], score: str, text_col: str = "text") -> DataFrame:
    """The given columns of every row and its score from 0 to 1; null and empty texts score by the bias alone."""
    text = fresh(docs, "text_")
    chosen = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text_col}`").alias(text))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields, n = chosen.schema.fields[:-1], len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(sent.value.scores(part.column(n)))], names=[*columns, score])
    return chosen.mapInArrow(run, T.StructType([*fields, T.StructField(score, T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Rows without an id aren't learned from and count as held out."""
    model = learn(docs, labels, id_col, **options)
    found = scored(docs, model, [id_col], "score", options.get("text_col", "text"))
    return found.select(F.col(f"`{id_col}`").alias("doc_id"), (~learning_row(F.col(f"`{id_col}`"), options.get("folds", 5))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns, extra ones too. Null and empty texts score by the
    bias alone; very long ones are read whole; repeated rows fare alike; without labels nothing goes."""
    score = fresh(docs, "score_")
    model = learn(docs, labels, id_col, **options)
    return scored(docs, model, docs.columns, score, options.get("text_col", "text")).where(F.col(score) < threshold).drop(score)
