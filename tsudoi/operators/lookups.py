"""Keyed lookups, skips, fills and set checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions.text import strip
from tsudoi.functions.urls import host, id_aliases, normalize_url, url_refusal
from tsudoi.plans.ranking import top_k


def attached_ids(sources: DataFrame) -> DataFrame:
    """Every spelling of the feed ids already attached."""
    both = sources.select(F.explode(F.array_union(id_aliases(F.col("source_event_id")), id_aliases(F.col("source_url")))).alias("alias"))
    return both.distinct()


def already_attached(incoming: DataFrame, sources: DataFrame, key: str = "seq") -> DataFrame:
    """J9. Keys of incoming rows whose feed id is attached in any spelling."""
    aliases = F.array_union(F.coalesce(id_aliases(F.col("source_event_id")), F.array().cast("array<string>")), id_aliases(F.col("source_url")))
    return (incoming.select(key, F.explode(aliases).alias("alias")).join(attached_ids(sources), "alias", "left_semi").select(key).distinct())


def missing_occurrences(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """J10. Incoming sessions that are not stored yet; missing clocks are equal to each other."""
    keys = ["event_id", "start_date", "end_date", "start_time", "end_time"]
    have = stored.select(*[F.col(k).alias("_" + k) for k in keys]).distinct()
    same = None
    for k in keys:
        part = F.col(k) == F.col("_" + k) if k == "event_id" else F.col(k).eqNullSafe(F.col("_" + k))
        same = part if same is None else same & part
    return incoming.select(*keys).distinct().join(have, same, "left_anti")


def fill_dates(details: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """J11. Dates a detail page lacks come from the listing; date_source tells which."""
    l = listing.groupBy(key).agg(F.min_by(F.struct("start_date", "end_date"), "seq").alias("_l"))
    has = F.col("start_date").isNotNull()
    return details.join(l, key, "left").withColumns({
        "date_source": F.when(has, "detail").when(F.col("_l.start_date").isNotNull(), "listing"),
        "end_date": F.when(has, F.col("end_date")).otherwise(F.coalesce("end_date", "_l.end_date")), "start_date": F.coalesce("start_date", "_l.start_date")}).drop("_l")


def feed_for_drafts(feed: DataFrame, drafts: DataFrame, sources: DataFrame, source_name: str) -> DataFrame:
    """J12. (id, feed columns): feed rows of drafts that already carry a source of that feed."""
    linked = sources.where(F.col("source_name") == source_name).select(F.col("event_id").alias("id"), "source_url").distinct()
    mine = drafts.where(F.col("status") == "draft").select("id").join(linked, "id")
    return mine.join(feed, "source_url")


def with_event(reviews: DataFrame, events: DataFrame, key: str = "event_id", columns: Sequence[str] = ("title", "slug")) -> DataFrame:
    """J13. Review, source or candidate rows with the event's title and slug. Catalyst broadcasts the
    narrow event side when it is small enough and shuffles otherwise."""
    names = events.select(F.col("id").alias(key), *[F.col(c).alias("event_" + c) for c in columns])
    return reviews.join(names, key, "left")


def published_translation(events: DataFrame, translations: DataFrame, locale: str) -> DataFrame:
    """J19. Published translation per event; only the title falls back to the original."""
    t = translations.where((F.col("locale") == locale) & (F.col("status") == "published")).select(
        F.col("event_id").alias("id"), F.col("title").alias("_title"), F.col("summary").alias("summary_translated"))
    return events.join(t, "id", "left").select("id", F.coalesce(F.nullif(strip(F.col("_title")), F.lit("")), "title").alias("title"), "summary_translated")


def published_reactions(summaries: DataFrame, translations: DataFrame | None = None, locale: str = "en") -> DataFrame:
    """J19. Published summaries with at least one bullet, with their published translation's bullets."""
    clean = lambda c: F.slice(F.filter(F.transform(c, strip), lambda b: b != ""), 1, 12)
    own = summaries.where(F.col("status") == "published").withColumn("bullets", clean(F.col("bullets"))).where(F.size("bullets") > 0)
    if translations is None:
        return own
    t = translations.where((F.col("locale") == locale) & (F.col("status") == "published")).select(F.col("summary_id").alias("id"), clean(F.col("bullets")).alias("bullets_translated"))
    return own.join(t.where(F.size("bullets_translated") > 0), "id", "left")


def same_set(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0))


def corrections_outcome(rows: DataFrame, corrections: DataFrame, field: str, as_set: bool = False) -> DataFrame:
    """J20. corrections(id, expected, new) judged against the current column: applied, already, conflict or missing."""
    joined = corrections.join(rows.select("id", F.col(field).alias("_cur"), F.lit(True).alias("_hit")), "id", "left")
    eq = same_set if as_set else (lambda a, b: a.eqNullSafe(b))
    outcome = (F.when(F.col("_hit").isNull(), "missing").when(eq(F.col("_cur"), F.col("expected")), "applied")
               .when(eq(F.col("_cur"), F.col("new")), "already").otherwise("conflict"))
    return joined.withColumn("outcome", outcome).drop("_cur", "_hit")


def apply_corrections(rows: DataFrame, corrections: DataFrame, field: str, as_set: bool = False) -> DataFrame:
    """J20. Writes the new value only where the current one is the expected one."""
    ok = corrections_outcome(rows, corrections, field, as_set).where(F.col("outcome") == "applied").select("id", F.col("new").alias("_new"), F.lit(True).alias("_ok"))
    return rows.join(ok, "id", "left").withColumn(field, F.when(F.col("_ok"), F.col("_new")).otherwise(F.col(field))).drop("_new", "_ok")


def candidate_urls(rows: DataFrame, skip_host: str | None = None) -> DataFrame:
    """J21. rows(event_id, role_rank, seq, url): public URLs, one per key, the first role wins."""
    ok = rows.where(url_refusal(F.col("url")).isNull()).withColumn("url_key", normalize_url(F.col("url"))).where(F.col("url_key").isNotNull())
    if skip_host is not None:
        h = host(F.col("url"))
        ok = ok.where(~((h == skip_host) | h.endswith("." + skip_host)))
    best = ok.groupBy("event_id", "url_key").agg(F.min(F.struct("role_rank", "seq", "url")).alias("b"))
    return best.select("event_id", "url_key", "b.role_rank", "b.seq", "b.url")


def allow_list_difference(loaded: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """J22. Ids on one side only; empty when the loaded ids are exactly the expected ones."""
    a, b = loaded.select(key).distinct(), expected.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("unexpected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def assert_allow_list(loaded: DataFrame, expected: DataFrame, key: str) -> None:
    if not allow_list_difference(loaded, expected, key).isEmpty():
        raise ValueError("loaded ids differ from the allow-list")


def pending_queue(reviews: DataFrame, events: DataFrame, status: str = "pending", limit: int = 200) -> DataFrame:
    """W21. Newest reviews of one status, at most ``limit``, with the event they belong to."""
    newest = reviews.where(F.col("status") == status).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return with_event(newest, events)


def queue_by_event(queue: DataFrame) -> DataFrame:
    """W21. The limited queue grouped per event, newest first."""
    return queue.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("review_ids"))


def first_listed(cards: DataFrame, key: str, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """W22. One row per detail URL, the first seen across pages; ``cap`` keeps the first rows."""
    once = top_k(cards, [key], [F.col(c) for c in order], 1, "_f").drop("_f")
    return once if cap is None else once.orderBy(*order).limit(cap)
