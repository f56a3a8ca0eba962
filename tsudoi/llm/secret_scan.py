"""Secrets by a trigram inverted index.

Each rule's pattern gives a Boolean trigram query: every text it matches, lower-cased, holds those trigrams. The index has
a posting (trigram, doc_id) for each trigram that some rule asks for; a rule's candidates are the documents whose postings
satisfy its query; its pattern is then run on those alone. A rule without mandatory trigrams runs on every document.
Candidates may be too many, never too few, so ids that repeat or are null cost time and not results.
"""
from __future__ import annotations

from functools import reduce
from re import _constants as c
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.llm.common import fresh, scratch, stored
from tsudoi.llm.spans import SPAN, Pattern, count, redacted, spans_of, written

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Fixed patterns: the three base kinds, then published token formats.
BASE = (
    Pattern("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    Pattern("access", "AKIA[A-Z0-9]{12,}"),  # as AKIA[A-Z0-9]+ of 16 or more: both take a whole run
    Pattern("hex", "[0-9a-f]{32,}"),
)
MORE = (
    Pattern("private_key", "-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----"),
    Pattern("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Pattern("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Pattern("google", "AIza[A-Za-z0-9_-]{35}"),
    Pattern("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
MOST_STRINGS, MOST_LETTERS = 64, 4

# A query is True (no constraint), a trigram, or ("and" | "or", queries).


def join(op: str, parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif True in parts or not parts:
        return True
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def of_strings(strings: set[str]) -> object:
    """Some string of the set is in the text. A string whose trigrams include all of another's adds nothing."""
    each = sorted({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}, key=lambda g: (len(g), sorted(g)))
    least = [g for n, g in enumerate(each) if not any(other <= g for other in each[:n])]
    return join("or", [join("and", sorted(g)) for g in least])


def derive(pattern: str) -> object:
    exact, query = walk(_parser.parse(pattern))
    return join("and", [query, of_strings(exact)]) if exact is not None else query


def walk(nodes) -> tuple[set[str] | None, object]:
    """(the strings a part matches, lower-cased, if they are few; else None, what they must hold)."""
    now, query, whole = {""}, True, True
    for node in nodes:
        strings, inner = step(*node)
        grown = {a + b for a in now for b in strings} if strings is not None else None
        if grown is not None and len(grown) <= MOST_STRINGS:
            now = grown
            query = join("and", [query, inner])
            continue
        query = join("and", [query, of_strings(now), inner, of_strings(strings) if strings is not None else True])
        now, whole = {""}, False
    return (now, query) if whole else (None, join("and", [query, of_strings(now)]))


def step(op, arg) -> tuple[set[str] | None, object]:
    if op is c.LITERAL:
        return {chr(arg).lower()}, True
    if op is c.IN and not any(o is c.NEGATE for o, _ in arg):
        letters: set[str] = set()
        for o, a in arg:
            span = range(a, a + 1) if o is c.LITERAL else range(a[0], a[1] + 1) if o is c.RANGE else range(0)
            if o not in (c.LITERAL, c.RANGE) or len(span) > 2 * MOST_LETTERS:
                return None, True
            letters |= {chr(x).lower() for x in span}
        return (letters, True) if len(letters) <= 2 * MOST_LETTERS else (None, True)
    if op is c.SUBPATTERN:
        return walk(arg[-1])
    if op is c.BRANCH:
        parts = [walk(p) for p in arg[1]]
        if all(s is not None for s, _ in parts) and len(every := set().union(*(s for s, _ in parts))) <= MOST_STRINGS:
            return every, join("or", [q for _, q in parts])
        return None, join("or", [join("and", [q, of_strings(s) if s is not None else True]) for s, q in parts])
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = walk(inner)
        if high == 1 and low == 0 and strings is not None:
            return strings | {""}, True
        if low == 0:
            return None, True
        if strings is not None and len(strings) == 1 and low == high and low <= 64:
            return {next(iter(strings)) * low}, query
        return None, join("and", [query, of_strings(strings) if strings is not None else True])
    if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return {""}, True
    return None, True


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def holds(query: object, grams: Column) -> Column:
    """The query over a document's set of trigrams."""
    if isinstance(query, str):
        return F.array_contains(grams, query)
    op, parts = query
    return reduce(lambda a, b: a & b if op == "and" else a | b, [holds(q, grams) for q in parts])


def postings(docs: DataFrame, wanted: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc_id): the wanted trigrams that a text holds, upper and lower case alike. A null text has none."""
    every = F.array(*[F.lit(t) for t in wanted])
    # the lower-cased text is bound once for all trigrams
    found = F.transform(F.array(F.lower(F.col(f"`{text_col}`"))), lambda low: F.filter(every, lambda t: F.contains(low, t)))[0]
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(found).alias("trigram")).select("trigram", "doc_id")


def scan(docs: DataFrame, columns: list[str], spans: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Pattern, ...] = BASE + MORE,
         path: str | None = None) -> DataFrame:
    """The given columns of every row and its spans; the index is written to ``path``, a new shared folder by default.

    Null and empty texts have no spans. Extra columns are ignored unless named; an empty table gives an empty one.
    """
    queries = {r.kind: derive(r.pattern) for r in rules}
    wanted = sorted(set().union(*(trigrams(q) for q in queries.values())))
    key, text, rules_met = fresh(docs, "key_"), fresh(docs, "text_"), fresh(docs, "rules_")
    chosen = docs.select(*[F.col(f"`{x}`") for x in columns], F.col(f"`{id_col}`").alias(key), F.col(f"`{text_col}`").alias(text))
    asked = {k: q for k, q in queries.items() if q is not True}
    if asked:
        index = stored(postings(docs, wanted, id_col, text_col), path or scratch(docs.sparkSession, "trigrams"))
        grams = index.where(F.col("trigram").isin(wanted)).groupBy("doc_id").agg(F.collect_set("trigram").alias("grams"))
        met = F.filter(F.array(*[F.when(holds(q, F.col("grams")), F.lit(k)) for k, q in asked.items()]), lambda k: k.isNotNull())
        candidates = grams.select(F.col("doc_id").alias(fresh(docs, "candidate_")), met.alias(rules_met)).where(F.size(rules_met) > 0)
        chosen = chosen.join(candidates, F.col(key).eqNullSafe(F.col(fresh(docs, "candidate_"))), "left")
    none = F.array().cast(SPAN)
    each = [spans_of(F.col(text), r, n) if r.kind not in asked else F.when(F.array_contains(rules_met, r.kind), spans_of(F.col(text), r, n)).otherwise(none) for n, r in enumerate(rules)]
    return chosen.select(*[F.col(f"`{x}`") for x in columns], F.concat(*[F.coalesce(e, none) for e in each]).alias(spans))


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, spans): array of start, order of kind, end, kind, text of the match."""
    return scan(docs, [id_col], "spans_", id_col, **options).select(F.col(f"`{id_col}`").alias("doc_id"), F.col("spans_").alias("spans"))


def digests(found: DataFrame, base: tuple[Pattern, ...] = BASE) -> DataFrame:
    kinds = [r.kind for r in base]
    own = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *[count(F.col("spans"), k).alias(f"n_{k}") for k in kinds], F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = "n_chars", **options) -> DataFrame:
    """All rows of docs with their columns; found secrets are replaced in the text, and its length follows if it changed."""
    spans = fresh(docs, "spans_")
    found = scan(docs, docs.columns, spans, id_col, text_col, **options)
    text = F.col(f"`{text_col}`")
    out = {text_col: redacted(text, F.col(spans), mark)}
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out[length_col] = F.when(F.size(spans) > 0, F.length(redacted(text, F.col(spans), mark)).cast(kind)).otherwise(F.col(f"`{length_col}`"))
    return found.select(*[out.get(x, F.col(f"`{x}`")).alias(x) for x in docs.columns])
