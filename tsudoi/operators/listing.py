"""Listings over scheduled events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions.dates import NO_CLOCK, NO_DATE, ended_dates, timing, weekend
from tsudoi.operators import schedule
from tsudoi.plans.ranking import global_position, run_numbers


def published(parents: DataFrame) -> DataFrame:
    return parents.where(F.col("status") == "published")


def explore(parents: DataFrame, sessions: DataFrame, today: Column, *, free=False, kids=False, indoor=False,
            night=False, area: str | None = None, municipality: str | None = None) -> DataFrame:
    """W1-W3. Published events that are not over, with their order keys and global position.

    Undated events stay. Attribute filters run before the sessions are touched."""
    events = published(parents)
    if free:
        events = events.where(F.col("price_type").isin("free", "partially_paid"))
    for wanted, name in ((kids, "is_kids"), (indoor, "is_indoor"), (night, "is_night")):
        if wanted:
            events = events.where(F.col(name))
    if area is not None:
        events = events.where(F.col("area") == area)
    if municipality is not None:
        slug = municipality.strip().lower()
        own = F.lower(F.trim(F.coalesce(F.col("municipality"), F.lit(""))))
        events = events.where((own == slug) | ((own == "") & (F.lower(F.trim(F.col("area"))) == slug)))
    held = schedule.with_schedule(events, sessions, today).where(
        F.coalesce(F.col("schedule_status") != "ended", F.lit(True)))
    timed = schedule.clock_on_day(held, sessions, "next_date")
    status = F.col("schedule_status")
    keyed = timed.select(
        "id", "slug", status, "next_date", "clock",
        F.when(status == "today", 0).when(status == "upcoming", 1).otherwise(2).alias("rank"),
        F.coalesce("next_date", F.lit(NO_DATE)).alias("order_date"), F.coalesce("clock", F.lit(NO_CLOCK)).alias("order_clock"))
    return global_position(keyed, ["rank", "order_date", "order_clock", "id"]).drop("rank", "order_date", "order_clock")


def held_on(parents: DataFrame, sessions: DataFrame, d: Column) -> DataFrame:
    """W4. Events really held on a day, by clock then id."""
    events = published(parents)
    hit = schedule.held_between(events, sessions, d, d).withColumn("day", d)
    timed = schedule.clock_on_day(hit, sessions, "day").withColumn("order_clock", F.coalesce("clock", F.lit(NO_CLOCK)))
    rows = timed.select("id", "slug", "day", "clock", "order_clock")
    return global_position(rows, ["order_clock", "id"]).drop("order_clock")


def held_this_weekend(parents: DataFrame, sessions: DataFrame, today: Column) -> DataFrame:
    """W5. Events held on Saturday or Sunday, by first such day, clock, id."""
    events = published(parents)
    days = weekend(today)
    first = schedule.next_day(events, sessions, days[0]).where(F.col("next_date") <= days[1]).select("id", F.col("next_date").alias("day"))
    timed = schedule.clock_on_day(events.join(first, "id"), sessions, "day").withColumn("order_clock", F.coalesce("clock", F.lit(NO_CLOCK)))
    rows = timed.select("id", "slug", "day", "clock", "order_clock")
    return global_position(rows, ["day", "order_clock", "id"]).drop("order_clock")


def by_slug(parents: DataFrame, slug: str) -> DataFrame:
    """W6."""
    return published(parents).where(F.col("slug") == slug).limit(1)


TIMING_ORDER = ("upcoming", "ongoing", "unknown", "ended")


def operational(parents: DataFrame, today: Column, limit: int = 200, status: str | None = None) -> DataFrame:
    """W7. Operators' order: upcoming soonest first, ongoing and ended latest first, undated by last change. The
    whole table is ordered before it is cut."""
    rows = parents if status is None else parents.where(F.col("status") == status)
    group = timing(F.col("start_date"), F.col("end_date"), today)
    rows = rows.withColumn("timing", group)
    days = F.unix_date(F.when(F.col("timing") == "ended", F.coalesce("end_date", "start_date")).otherwise(F.col("start_date")))
    within = F.when(F.col("timing") == "upcoming", days).when(F.col("timing") == "unknown", -F.unix_seconds("updated_at")).otherwise(-days)
    return (rows.withColumn("_w", within).orderBy(F.array_position(F.array(*[F.lit(t) for t in TIMING_ORDER]), F.col("timing")), F.col("_w").asc_nulls_last(), "id")
            .limit(limit).drop("_w"))


def ended_listing(parents: DataFrame, today: Column, limit: int = 200) -> DataFrame:
    """W7, ended page: published rows whose end day is past, latest end first."""
    return (published(parents).where(F.col("end_date") < today)
            .orderBy(F.col("end_date").desc(), "id").limit(limit))


MOODS = ("all", "today", "weekend", "free", "kids", "indoor", "night")


def mood_pages(parents: DataFrame, sessions: DataFrame, today: Column, mood: str, page_size: int = 24,
               weekend_days: Column | None = None) -> DataFrame:
    """W8. One mood of the explorer: position, page and rows left after that page."""
    flags = {"free": "free", "kids": "kids", "indoor": "indoor", "night": "night"}
    rows = explore(parents, sessions, today, **({flags[mood]: True} if mood in flags else {}))
    if mood in ("today", "weekend"):
        days = F.array(today) if mood == "today" else (weekend(today) if weekend_days is None else weekend_days)
        hit = schedule.held_between(published(parents), sessions, F.array_min(days), F.array_max(days))
        rows = rows.join(hit.select("id"), "id", "left_semi").drop("pos")
        rows = rows.withColumn("rank", F.when(F.col("schedule_status") == "today", 0).otherwise(1)).withColumn(
            "order_clock", F.coalesce("clock", F.lit(NO_CLOCK)))
        rows = global_position(rows, ["rank", "next_date", "order_clock", "id"]).drop("rank", "order_clock")
    total = rows.agg(F.count(F.lit(1)).alias("_total")).scalar()
    page = F.ceil(F.col("pos") / page_size)
    return rows.select("id", "pos", page.alias("page"), F.greatest(total - page * page_size, F.lit(0)).alias("rest"))


def consecutive_groups(rows: DataFrame, key: str, list_cols: list[str], pos: str, out: str = "group_no") -> DataFrame:
    """W9. Number the runs of equal ``key`` along ``pos``, order kept."""
    return run_numbers(rows, list_cols, pos, key, out)
