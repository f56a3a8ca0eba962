"""Schedules: merged session spans and everything read from them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsudoi.functions.dates import NO_CLOCK, clock, day, span_end

_SHIFT = 1 << 30  # makes every day of the calendar positive


def usable_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions with a start day; the end never precedes it."""
    return (sessions.where(F.col("start_date").isNotNull())
            .withColumn("end_date", span_end(F.col("start_date"), F.col("end_date"))))


def merge_spans(sessions: DataFrame, key: str = "event_id") -> DataFrame:
    """T11. Gaps and islands over days: overlapping or adjacent sessions become one span.

    Sessions are first reduced to the longest end per (event, start day) with map-side combine, so
    the window sees at most one row per calendar day of an event however many sessions it has."""
    days = usable_sessions(sessions).groupBy(key, "start_date").agg(F.max("end_date").alias("end_date"))
    w = Window.partitionBy(key).orderBy("start_date")
    reach = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_date") <= F.date_add("_reach", 1), 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    return (days.withColumn("_reach", reach).withColumn("_island", island)
            .groupBy(key, "_island").agg(F.min("start_date").alias("span_start"), F.max("end_date").alias("span_end"))
            .drop("_island"))


def effective_spans(parents: DataFrame, sessions: DataFrame) -> DataFrame:
    """T12. (event_id, span_start, span_end): merged sessions, else the parent's own dates."""
    merged = merge_spans(sessions)
    own = (parents.where(F.col("start_date").isNotNull())
           .select(F.col("id").alias("event_id"), F.col("start_date").alias("span_start"),
                   span_end(F.col("start_date"), F.col("end_date")).alias("span_end")))
    scheduled = usable_sessions(sessions).select("event_id").distinct()
    return merged.join(parents.select(F.col("id").alias("event_id")), "event_id", "left_semi").unionByName(
        own.join(scheduled, "event_id", "left_anti"))


def covers(d: Column) -> Column:
    return (F.col("span_start") <= d) & (d <= F.col("span_end"))


def schedule_facts(spans: DataFrame, today: Column) -> DataFrame:
    """T13 and T15 in one aggregate: schedule status and next attendable day per event. Merged spans and the sessions
    they were merged from give the same, as a merged span has no day that none of its sessions has."""
    open_span = F.col("span_end") >= today
    return spans.groupBy("event_id").agg(
        F.when(F.bool_or(covers(today)), "today").when(F.bool_or(open_span), "upcoming").otherwise("ended").alias("schedule_status"),
        F.min(F.when(open_span, F.greatest("span_start", today))).alias("next_date"))


def as_spans(sessions: DataFrame) -> DataFrame:
    return usable_sessions(sessions).select("event_id", F.col("start_date").alias("span_start"), F.col("end_date").alias("span_end"))


def with_schedule(parents: DataFrame, sessions: DataFrame, today: Column) -> DataFrame:
    """T13, T15 from sessions, or from the parent's own dates where it has none: one map-side aggregate, one join."""
    facts = schedule_facts(as_spans(sessions), today).select(F.col("event_id").alias("id"), F.col("schedule_status").alias("_s"), F.col("next_date").alias("_n"))
    start, end = F.col("start_date"), span_end(F.col("start_date"), F.col("end_date"))
    own = F.when((start <= today) & (today <= end), "today").when(end >= today, "upcoming").when(start.isNotNull(), "ended")
    return parents.join(facts, "id", "left").withColumns({
        "schedule_status": F.coalesce("_s", own), "next_date": F.when(F.col("_s").isNotNull(), F.col("_n")).when(end >= today, F.greatest(start, today))}).drop("_s", "_n")


def next_day(parents: DataFrame, sessions: DataFrame, first: Column) -> DataFrame:
    """The parents with ``next_date``, their first day held on or after ``first``; null if there is none."""
    return with_schedule(parents, sessions, first).drop("schedule_status")


def held_between(parents: DataFrame, sessions: DataFrame, first: Column, last: Column) -> DataFrame:
    """T14 with the day test on the sessions themselves, so that it reaches their scan: parents held on a day from
    ``first`` to ``last``. A parent's own dates count only if it has no usable session."""
    touches = (F.col("start_date") <= last) & ((F.col("end_date") >= first) | (F.col("start_date") >= first))
    ids = lambda df: df.select(F.col("event_id").alias("id"))
    own = parents.where(touches).join(ids(sessions.where(F.col("start_date").isNotNull())), "id", "left_anti")
    return parents.join(ids(sessions.where(touches)).distinct(), "id", "left_semi").unionByName(own)


def on_day(spans: DataFrame, d: Column) -> DataFrame:
    """Events held on a day; days in a gap do not count."""
    return spans.where(covers(d)).select("event_id").distinct()


def on_any_day(spans: DataFrame, days: Column) -> DataFrame:
    """T14 for a short list of days."""
    return spans.where(F.exists(days, covers)).select("event_id").distinct()


def clock_on_day(events: DataFrame, sessions: DataFrame, day_col: str, out: str = "clock") -> DataFrame:
    """T16. Earliest session clock on the event's ``day_col``; the parent's clock only when the
    event has no session rows. Sessions meet the one needed day before they are aggregated."""
    wanted = events.select(F.col("id").alias("event_id"), F.col(day_col).alias("_day"))
    s = sessions.withColumn("_end", span_end(F.col("start_date"), F.col("end_date")))
    covered = (F.col("start_date") <= F.col("_day")) & (F.col("_day") <= F.col("_end"))
    clocks = s.join(wanted, "event_id").groupBy("event_id").agg(
        F.min(F.when(covered, clock(F.col("start_time")))).alias("_clock"), F.lit(True).alias("_has"))
    return (events.join(clocks.withColumnRenamed("event_id", "id"), "id", "left")
            .withColumn(out, F.when(F.col("_has"), F.col("_clock")).when(F.col(day_col).isNotNull(), clock(F.col("start_time"))))
            .drop("_clock", "_has"))


def schedule_gap(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """T17. ``pairs(left_id, right_id)`` with the fewest days between the two schedules, null if one has none.

    The spans of an event travel as two short arrays of days, one span a calendar day at most, so a pair is one row and not a
    row for each of its spans. Each left span looks up the first right span that ends no earlier than it starts, and
    the latest end before that one: a pair costs the sum of its spans and not their product."""
    lists = (spans.where("span_start IS NOT NULL AND span_end IS NOT NULL").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("span_start").alias("s"), F.unix_date("span_end").alias("e")))).alias("x"))
             .select("event_id", F.col("x.s").alias("s"), F.col("x.e").alias("e")))

    def side(n: str, own: str) -> DataFrame:
        return lists.select(F.col("event_id").alias(own), F.col("s").alias(n + "_s"), F.col("e").alias(n + "_e"))

    # shuffled and hashed: a sort would spill the arrays, a broadcast would hold all schedules in the driver
    found = (pairs.join(side("l", "left_id").hint("shuffle_hash"), "left_id", "left").join(side("r", "right_id").hint("shuffle_hash"), "right_id", "left"))
    out = T.StructType([pairs.schema[c] for c in pairs.columns] + [T.StructField("gap_days", T.IntegerType())])
    return found.select(*pairs.columns, "l_s", "l_e", "r_s", "r_e").mapInArrow(_gaps, out)


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the days of two schedules, each in order of starts -> the same rows with the days between the two."""
    for batch in batches:
        arrays = [batch.column(n) for n in ("l_s", "l_e", "r_s", "r_e")]
        both = pc.and_(pc.is_valid(arrays[0]), pc.is_valid(arrays[2]))
        which = np.flatnonzero(both.to_numpy(zero_copy_only=False))
        days = [a.filter(both) for a in arrays]
        # keys: the row above, the day below, so that one search serves all rows
        rows = [np.repeat(np.arange(len(which)), pc.list_value_length(days[n]).to_numpy()) << 32 for n in (0, 2)]
        key = [rows[n // 2] + (days[n].flatten().to_numpy().astype(np.int64) + _SHIFT) for n in range(4)]
        ls, le, rs, re = key
        gap = np.full(len(which), np.iinfo(np.int64).max)
        if len(which):
            reach = np.maximum.accumulate(re)  # a later row's key is above every earlier one's
            at = np.searchsorted(reach, ls)
            row = ls >> 32
            after, before = np.minimum(at, len(rs) - 1), np.maximum(at - 1, 0)
            far = np.iinfo(np.int64).max
            ahead = np.where((at < len(rs)) & (rs[after] >> 32 == row), np.maximum(rs[after] - le, 0), far)
            behind = np.where((at > 0) & (re[before] >> 32 == row), ls - reach[before], far)
            np.minimum.at(gap, row, np.minimum(ahead, behind))
        values = np.zeros(batch.num_rows, np.int32)
        values[which] = gap
        missing = ~both.to_numpy(zero_copy_only=False)
        kept = [c for c in batch.schema.names if c not in ("l_s", "l_e", "r_s", "r_e")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(values, mask=missing)], names=[*kept, "gap_days"])


def timed_groups(sessions: DataFrame, visible: int = 8) -> DataFrame:
    """T22. Sessions grouped per single day with ordered clocks; the first ``visible`` groups, the
    number hidden, and whether the parent's clock may stand in.

    Groups are numbered on distinct (event, group) rows and only the visible ones are gathered."""
    s = usable_sessions(sessions).select(
        "event_id", "start_date", "end_date", F.coalesce(clock(F.col("start_time")), F.lit(NO_CLOCK)).alias("start_clock"),
        clock(F.col("end_time")).alias("end_clock"))
    single = F.col("start_date") == F.col("end_date")
    # multi-day sessions stay apart, so they are counted; equal single days share one group
    slots = s.groupBy("event_id", "start_date", "end_date", "start_clock", "end_clock").agg(F.count(F.lit(1)).alias("copies"))
    groups = slots.groupBy("event_id", "start_date", "end_date").agg(
        F.array_sort(F.collect_list(F.struct("start_clock", "end_clock", "copies"))).alias("clocks"),
        F.sum("copies").alias("n"), F.bool_or((F.col("start_clock") != NO_CLOCK) | F.col("end_clock").isNotNull()).alias("timed"))
    size = F.when(single, 1).otherwise(F.col("n"))
    w = Window.partitionBy("event_id").orderBy("start_date", "end_date")
    groups = groups.withColumn("size", size).withColumn(
        "before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = groups.groupBy("event_id").agg(
        F.sum("size").alias("n_groups"), F.sum("n").alias("n_sessions"), F.bool_or("timed").alias("timed"),
        F.array_sort(F.collect_list(F.when(F.col("before") < visible, F.struct(
            "start_date", "end_date", "clocks", F.least("size", F.lit(visible) - F.col("before")).alias("shown"))))).alias("groups"))
    return totals.select("event_id", "groups", F.greatest(F.col("n_groups") - visible, F.lit(0)).alias("hidden"),
                         F.col("timed").alias("has_clock"), ((~F.col("timed")) & (F.col("n_sessions") <= 1)).alias("parent_clock_ok"))


def visible_spans(spans: DataFrame, visible: int = 8) -> DataFrame:
    """T22 for date-only display (8 on a detail page, 2 on a card): first spans and the hidden count."""
    ranked = spans.withColumn("rn", F.row_number().over(Window.partitionBy("event_id").orderBy("span_start")))
    return ranked.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rn") <= visible, F.struct("span_start", "span_end")))).alias("spans"),
        F.greatest(F.count(F.lit(1)) - visible, F.lit(0)).alias("hidden"))
