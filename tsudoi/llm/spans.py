"""Matches of patterns as spans in code points, by DataFrame functions alone."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,o:int,e:int,kind:string,m:string,before:string,after:string>>"
BLOCK = 256


@dataclass(frozen=True)
class Pattern:
    """pattern: for Spark's regular expressions. valid: of a match's text; others are dropped, without a retry."""
    kind: str
    pattern: str
    valid: Callable[[Column], Column] | None = None


def spans_of(text: Column, rule: Pattern, order: int) -> Column:
    """Leftmost non-overlapping matches: start, order, end, kind, text, and up to 40 characters before and one after, as
    far as the neighbouring matches of the same rule. A null text has none.

    Matches and the gaps between them come from two functions of the same pattern; positions are sums of their lengths.
    The sums are taken in blocks, as an array that grows by one match at a time would be copied for each.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def of_row(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]

        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(gaps[i])
            end = start + F.length(found[i])
            span = F.struct(start.cast("int").alias("s"), F.lit(order).alias("o"), end.cast("int").alias("e"), F.lit(rule.kind).alias("kind"), found[i].alias("m"),
                            F.right(gaps[i], F.lit(40)).alias("before"), F.left(gaps[i + 1], F.lit(1)).alias("after"))
            return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        def block(acc: Column, b: Column) -> Column:
            inner = F.aggregate(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(found)) - 1), F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), add)
            both = F.transform(F.array(inner), lambda y: F.struct(y["at"].alias("at"), F.concat(acc["out"], y["out"]).alias("out")))
            return both[0]
        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
        return F.when(F.size(found) > 0, F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), block, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))
    # matches and gaps are bound once
    spans = F.flatten(F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), of_row))
    if rule.valid is not None:
        spans = F.filter(spans, lambda x: rule.valid(x["m"]))
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPAN))


def written(spans: Column) -> Column:
    """kind:start:end by start, then by the order of kinds, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each stretch of overlapping spans replaced by a mark."""
    def step(acc: Column, x: Column) -> Column:
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate(F.array_sort(spans), first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
