"""Rows that every operator must cope with."""
import random

from pyspark.sql import types as T

# extra columns carry names that operators use inside
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     *[T.StructField(n, T.StringType()) for n in ("i", "t", "g", "fp", "root", "kept", "found_", "text_", "score_", "r_", "spans_", "key_", "rules_", "candidate_", "own_", "rest_")]])
EXTRA = ("x",) * 16


def docs(spark, rows):
    """rows: (doc_id, text)."""
    full = [(i, t, None if n % 3 else "en", "src0", None if t is None else len(t), *EXTRA) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, a null id twice."""
    long = words(1, 40_000)
    return [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long + " end"), (6, "Same text here, twice."), (6, "Same text here, twice."), (7, "Same text here, twice."),
            (None, "Same text here, twice."), (None, words(2, 50)), (None, None), (8, "één ñandú ÄÖ 😀 　 x"), (9, "a"), (10, "\x00\x1f control")]
