"""Counters and audits."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions.dates import ended, ended_dates, safe_date
from tsudoi.functions.text import blank_to_null, strip


def dashboard(events: DataFrame, dedupe_reviews: DataFrame, field_reviews: DataFrame, today: Column) -> DataFrame:
    """A1. One row of counters. 'ended' here is published with an end day in the past only."""
    is_status = lambda s: F.col("status") == s
    unknown_rights = F.col("image_url").isNotNull() & (F.col("image_usage_status").isNull() | (F.col("image_usage_status") == "unknown"))
    pending = lambda df: df.agg(F.count_if(is_status("pending"))).scalar()
    return events.agg(
        F.count_if(is_status("draft")).alias("draft"), F.count_if(is_status("published")).alias("published"), F.count_if(is_status("hidden")).alias("hidden"),
        F.count_if(is_status("published") & (F.col("end_date") < today)).alias("ended"),
        F.count_if(is_status("published") & unknown_rights).alias("pending_image_unknown")).withColumns(
        {"pending_dedupe": pending(dedupe_reviews), "pending_field": pending(field_reviews)})


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """A2, A5: counts of a grouping, largest first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *columns)


def feed_profile(feed: DataFrame) -> DataFrame:
    """A4. Counts per (lifecycle, filter, area) and how many have several dates."""
    return feed.groupBy("lifecycle", "filter", "area_status").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("date_status").isin("multiple", "partial")).alias("multi_date"))


def municipality_histogram(rows: DataFrame, inferred: str = "inferred_municipality") -> DataFrame:
    """A5. Proposed municipalities by count; rows without one are counted by the reason."""
    label = F.coalesce(F.col(inferred), F.when(blank_to_null(strip(F.col("area"))).isNull(), "(no area)").otherwise("(undecided)"))
    return count_by(rows.withColumn("municipality_slug", label), "municipality_slug")


def completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A6. (field, filled, total, percent) in one pass over the rows."""
    filled = [F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "") & (F.col(f).cast("string") != "[]")).alias(f) for f in fields]
    one = df.agg(F.count(F.lit(1)).alias("total"), *filled)
    long = one.unpivot(["total"], list(fields), "field", "filled")
    return long.withColumn("percent", F.coalesce(F.round(F.col("filled") * 100 / F.greatest("total", F.lit(1))).cast("int"), F.lit(0)))


def unmatched_buckets(rows: DataFrame, buckets: str = "buckets", top: int = 20) -> DataFrame:
    """A7. Bucket histogram of unmatched rows, the largest ``top``, with the share of all unmatched."""
    left = rows.where(F.col("duplicate_status") == "none")
    total = left.agg(F.count(F.lit(1))).scalar()
    return (left.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n") / total).orderBy(F.col("n").desc(), "bucket").limit(top))


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """A14. Rows per reason; rows with none count under '(eligible)'."""
    return rows.select(F.explode_outer(reasons).alias("reason")).groupBy(F.coalesce("reason", F.lit("(eligible)")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A15. Keys used more than once; nulls count as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def review_state_audit(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """A16. Reviews whose event is missing or not published: (issue, id)."""
    status = events.select(F.col("id").alias("event_id"), F.col("status").alias("_s"))
    issue = F.when(F.col("_s").isNull(), "orphan").when(F.col("_s") == "draft", "draft_with_review").when(F.col("_s") != "published", "not_published")
    return reviews.join(status, "event_id", "left").select("id", "event_id", issue.alias("issue")).where(F.col("issue").isNotNull())


def leaking_rows(public: DataFrame, events: DataFrame) -> DataFrame:
    """A16. Ids in a public listing whose event is not published."""
    return public.select("id").join(events.where(F.col("status") == "published").select("id"), "id", "left_anti")


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """A17. (rule, violations) for row rules, in one pass; an undecidable rule is no violation."""
    one = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def unique_violations(df: DataFrame, rules: Mapping[str, tuple[Sequence[str], bool]]) -> DataFrame:
    """A17. (rule, violations): keys used more than once; rules: name -> (columns, nulls count as distinct)."""
    frames = []
    for name, (keys, distinct_nulls) in rules.items():
        rows = df
        for k in keys if distinct_nulls else ():
            rows = rows.where(F.col(k).isNotNull())
        frames.append(duplicate_keys(rows, keys).agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations")))
    return reduce(DataFrame.unionByName, frames)


def orphan_rows(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """A17. Child rows without their parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def tri_state_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """A18. (flag, n_true, n_false, n_null)."""
    stats = [F.struct(F.count_if(F.col(f)).alias("t"), F.count_if(~F.col(f)).alias("f"), F.count_if(F.col(f).isNull()).alias("n")).alias(f) for f in flags]
    long = df.agg(*stats).unpivot([], list(flags), "flag", "c")
    return long.select("flag", F.col("c.t").alias("n_true"), F.col("c.f").alias("n_false"), F.col("c.n").alias("n_null"))


def batch_counts(batch: DataFrame, occurrences: DataFrame, columns: Sequence[str], category: str = "category") -> DataFrame:
    """A18. Of a batch(id, ...): (counter, n) of nulls per column, of rows whose only category is "other", and of the
    occurrences(event_id) that belong to it."""
    only_other = F.coalesce(F.col(category) == F.array(F.lit("other")), F.lit(False))
    one = batch.agg(*[F.count_if(F.col(c).isNull()).alias("null_" + c) for c in columns], F.count_if(only_other).alias("only_other"))
    names = [*["null_" + c for c in columns], "only_other"]
    held = occurrences.join(batch.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_semi").agg(F.lit("occurrences").alias("counter"), F.count(F.lit(1)).alias("n"))
    return one.unpivot([], names, "counter", "n").unionByName(held)


def ended_in_front(ordered: DataFrame, pos: str, today: Column, n: int = 10) -> DataFrame:
    """A20. Rows of a listing with positions that are over and still stand among the first n."""
    return ordered.where((F.col(pos) <= n) & ended_dates(F.col("start_date"), F.col("end_date"), today))


def summary_coverage(events: DataFrame, today: Column) -> DataFrame:
    """A19. Open published events with and without a summary."""
    open_ = events.where((F.col("status") == "published") & ~ended_dates(F.col("start_date"), F.col("end_date"), today))
    filled = F.coalesce(strip(F.col("summary")) != "", F.lit(False))
    return open_.agg(F.count_if(filled).alias("filled"), F.count_if(~filled).alias("empty"))


def date_anomalies(events: DataFrame, today: Column) -> DataFrame:
    """A20. (id, anomaly) over text dates: unreadable dates, ended by start only."""
    start, end = F.col("start_date").cast("string"), F.col("end_date").cast("string")
    bad = lambda c: (strip(c) != "") & safe_date(c).isNull()
    kind = (F.when(F.coalesce(bad(start) | bad(end), F.lit(False)), "unreadable_date")
            .when(F.coalesce(strip(end), F.lit("")).eqNullSafe("") & ended(start, end, today), "ended_by_start_only"))
    return events.select("id", kind.alias("anomaly")).where(F.col("anomaly").isNotNull())


def snapshot_drift(before: DataFrame, after: DataFrame, watched: Sequence[str]) -> DataFrame:
    """A21. (id, changed columns) between two snapshots; rows on one side only list '(row)'."""
    a = before.select("id", F.struct(*watched).alias("_b"), F.lit(True).alias("_in_b"))
    b = after.select("id", F.struct(*watched).alias("_a"), F.lit(True).alias("_in_a"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    cols = F.array_compact(F.array(*[F.when(~F.col(f"_b.{c}").eqNullSafe(F.col(f"_a.{c}")), F.lit(c)) for c in watched]))
    return (a.join(b, "id", "full_outer").select("id", F.when(both, cols).otherwise(F.array(F.lit("(row)"))).alias("changed"))
            .where(F.size("changed") > 0))
