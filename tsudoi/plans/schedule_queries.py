"""Schedule and listing queries: parts as events, line items as their sessions."""
from __future__ import annotations

from pyspark.sql import functions as F

from tsudoi.functions import dates
from tsudoi.functions.dates import day
from tsudoi.operators import listing, schedule
from tsudoi.plans.domain import TODAY
from tsudoi.plans.registry import query

D = f"DATE '{TODAY}'"


def clock_sql(col: str) -> str:
    return (f"CASE WHEN try_cast(regexp_extract({col}, '^([0-9]{{1,2}}):([0-9]{{2}})', 1) AS int) <= 23 "
            f"THEN concat(lpad(regexp_extract({col}, '^([0-9]{{1,2}}):([0-9]{{2}})', 1), 2, '0'), ':', "
            f"regexp_extract({col}, '^([0-9]{{1,2}}):([0-9]{{2}})', 2)) END")


MERGED = """
m1 AS (SELECT *, max(end_date) OVER (PARTITION BY event_id ORDER BY start_date, end_date
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sessions),
m2 AS (SELECT *, sum(CASE WHEN start_date <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY event_id ORDER BY start_date, end_date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM m1),
merged AS (SELECT event_id, min(start_date) AS span_start, max(end_date) AS span_end FROM m2 GROUP BY event_id, isl)"""

SPANS = MERGED + """,
spans AS (SELECT event_id, span_start, span_end FROM merged WHERE event_id IN (SELECT id FROM catalogue)
  UNION ALL
  SELECT id, start_date, CASE WHEN end_date >= start_date THEN end_date ELSE start_date END FROM catalogue
  WHERE start_date IS NOT NULL AND id NOT IN (SELECT event_id FROM sessions))"""

FACTS = SPANS + f""",
facts AS (SELECT event_id, CASE WHEN bool_or(span_start <= {D} AND {D} <= span_end) THEN 'today'
    WHEN bool_or(span_end >= {D}) THEN 'upcoming' ELSE 'ended' END AS schedule_status,
  min(CASE WHEN span_end >= {D} THEN greatest(span_start, {D}) END) AS next_date FROM spans GROUP BY event_id)"""


def clocks_sql(source: str, day_col: str) -> str:
    """CTE ``timed``: rows of ``source`` with the clock on their ``day_col``."""
    return f"""
timed AS (SELECT e.*, CASE WHEN c.has THEN c.clk WHEN e.{day_col} IS NOT NULL THEN {clock_sql('e.start_time')} END AS clock
  FROM {source} e LEFT JOIN (
    SELECT s.event_id, true AS has, min(CASE WHEN s.start_date <= w.{day_col} AND w.{day_col} <= s.end_date THEN {clock_sql('s.start_time')} END) AS clk
    FROM sessions s JOIN {source} w ON w.id = s.event_id GROUP BY s.event_id) c ON c.event_id = e.id)"""


def explore_sql(where: str = "true") -> str:
    return f"""{FACTS},
held AS (SELECT c.*, f.schedule_status, f.next_date FROM catalogue c LEFT JOIN facts f ON f.event_id = c.id
  WHERE c.status = 'published' AND ({where}) AND coalesce(f.schedule_status <> 'ended', true)),
{clocks_sql('held', 'next_date')},
listed AS (SELECT id, slug, schedule_status, next_date, clock, row_number() OVER (ORDER BY
  CASE schedule_status WHEN 'today' THEN 0 WHEN 'upcoming' THEN 1 ELSE 2 END,
  coalesce(next_date, DATE '9999-12-31'), coalesce(clock, '99:99'), id) AS pos FROM timed)"""


@query("span_merge", f"WITH {MERGED} SELECT * FROM merged")
def span_merge(t):
    return schedule.merge_spans(t.sessions)


@query("effective_spans", f"WITH {SPANS} SELECT * FROM spans")
def effective_spans(t):
    return schedule.effective_spans(t.catalogue, t.sessions)


@query("schedule_status", f"WITH {FACTS} SELECT c.id, f.schedule_status, f.next_date FROM catalogue c LEFT JOIN facts f ON f.event_id = c.id")
def schedule_status(t):
    return schedule.with_schedule(t.catalogue, t.sessions, day(TODAY)).select("id", "schedule_status", "next_date")


@query("schedule_on_day", f"WITH {SPANS} SELECT DISTINCT event_id FROM spans WHERE {D} BETWEEN span_start AND span_end")
def schedule_on_day(t):
    return schedule.on_day(schedule.effective_spans(t.catalogue, t.sessions), day(TODAY))


@query("schedule_on_any_day", f"""WITH {SPANS} SELECT DISTINCT event_id FROM spans
WHERE {D} BETWEEN span_start AND span_end OR {D} + 1 BETWEEN span_start AND span_end""")
def schedule_on_any_day(t):
    return schedule.on_any_day(schedule.effective_spans(t.catalogue, t.sessions), dates.weekend(day(TODAY)))


@query("start_clock_on_day", f"WITH cd AS (SELECT *, {D} AS d FROM catalogue), {clocks_sql('cd', 'd')} SELECT id, clock FROM timed")
def start_clock_on_day(t):
    return schedule.clock_on_day(t.catalogue.withColumn("d", day(TODAY)), t.sessions, "d").select("id", "clock")


@query("schedule_gap", f"""WITH {SPANS},
pairs AS (SELECT DISTINCT l_partkey AS left_id, l_suppkey AS right_id FROM lineitem)
SELECT p.left_id, p.right_id, min(greatest(0, b.span_start - a.span_end, a.span_start - b.span_end)) AS gap_days
FROM pairs p LEFT JOIN spans a ON a.event_id = p.left_id LEFT JOIN spans b ON b.event_id = p.right_id GROUP BY 1, 2""")
def schedule_gap(t):
    pairs = t.lineitem.select(F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id")).distinct()
    return schedule.schedule_gap(pairs, schedule.effective_spans(t.catalogue, t.sessions))


@query("timed_groups", f"""WITH s AS (SELECT event_id, start_date, end_date, coalesce({clock_sql('start_time')}, '99:99') AS sc, {clock_sql('end_time')} AS ec FROM sessions),
g AS (SELECT event_id, start_date, end_date, CASE WHEN start_date = end_date THEN 1 ELSE count(*) END AS size, count(*) AS n,
      bool_or(sc <> '99:99' OR ec IS NOT NULL) AS timed FROM s GROUP BY 1, 2, 3),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY event_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT event_id, cast(sum(CASE WHEN before < 8 THEN 1 ELSE 0 END) AS bigint) AS shown_rows, min(CASE WHEN before < 8 THEN start_date END) AS first_day,
  max(CASE WHEN before < 8 THEN start_date END) AS last_day, cast(greatest(sum(size) - 8, 0) AS bigint) AS hidden, bool_or(timed) AS has_clock,
  (NOT bool_or(timed)) AND sum(n) <= 1 AS parent_clock_ok FROM r GROUP BY event_id""")
def timed_groups(t):
    g = schedule.timed_groups(t.sessions)
    return g.select("event_id", F.size("groups").cast("long").alias("shown_rows"), F.col("groups")[0]["start_date"].alias("first_day"),
                    F.element_at("groups", -1)["start_date"].alias("last_day"), F.col("hidden").cast("long"), "has_clock", "parent_clock_ok")


@query("card_spans", f"""WITH {SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY span_start) AS rn FROM spans)
SELECT event_id, min(span_start) AS first_start, max(CASE WHEN rn <= 2 THEN span_end END) AS last_end, greatest(count(*) - 2, 0) AS hidden FROM r GROUP BY 1""")
def card_spans(t):
    v = schedule.visible_spans(schedule.effective_spans(t.catalogue, t.sessions), 2)
    return v.select("event_id", F.col("spans")[0]["span_start"].alias("first_start"),
                    F.element_at("spans", -1)["span_end"].alias("last_end"), "hidden")


@query("schedule_today", f"""WITH {SPANS},
hit AS (SELECT *, {D} AS day FROM catalogue WHERE status = 'published' AND id IN (SELECT event_id FROM spans WHERE {D} BETWEEN span_start AND span_end)),
{clocks_sql('hit', 'day')} SELECT id, slug, day, clock, row_number() OVER (ORDER BY coalesce(clock, '99:99'), id) AS pos FROM timed""")
def schedule_today(t):
    return listing.held_on(t.catalogue, t.sessions, day(TODAY))


@query("schedule_weekend", f"""WITH {SPANS},
f AS (SELECT event_id, min(CASE WHEN {D} BETWEEN span_start AND span_end THEN {D} ELSE {D} + 1 END) AS day FROM spans
  WHERE {D} BETWEEN span_start AND span_end OR {D} + 1 BETWEEN span_start AND span_end GROUP BY 1),
hit AS (SELECT c.*, f.day FROM catalogue c JOIN f ON f.event_id = c.id WHERE c.status = 'published'),
{clocks_sql('hit', 'day')} SELECT id, slug, day, clock, row_number() OVER (ORDER BY day, coalesce(clock, '99:99'), id) AS pos FROM timed""")
def schedule_weekend(t):
    return listing.held_this_weekend(t.catalogue, t.sessions, day(TODAY))


@query("explore_listing", f"WITH {explore_sql()} SELECT * FROM listed")
def explore_listing(t):
    return listing.explore(t.catalogue, t.sessions, day(TODAY))


@query("free_listing", f"""WITH {explore_sql("price_type IN ('free', 'partially_paid')")} SELECT * FROM listed""")
def free_listing(t):
    return listing.explore(t.catalogue, t.sessions, day(TODAY), free=True)


@query("kids_indoor_night_listing", f"WITH {explore_sql('is_kids AND is_indoor AND is_night')} SELECT * FROM listed")
def kids_indoor_night_listing(t):
    return listing.explore(t.catalogue, t.sessions, day(TODAY), kids=True, indoor=True, night=True)


@query("kids_indoor_listing", f"WITH {explore_sql('is_kids AND is_indoor')} SELECT * FROM listed")
def kids_indoor_listing(t):
    return listing.explore(t.catalogue, t.sessions, day(TODAY), kids=True, indoor=True)


@query("night_listing", f"WITH {explore_sql('is_night')} SELECT * FROM listed")
def night_listing(t):
    return listing.explore(t.catalogue, t.sessions, day(TODAY), night=True)


@query("area_listing", f"""WITH {explore_sql("area = 'ueno'")} SELECT * FROM listed""")
def area_listing(t):
    return listing.explore(t.catalogue, t.sessions, day(TODAY), area="ueno")


@query("municipality_listing", f"""WITH {explore_sql("lower(trim(coalesce(municipality, ''))) = 'minato' OR (lower(trim(coalesce(municipality, ''))) = '' AND lower(trim(area)) = 'minato')")} SELECT * FROM listed""")
def municipality_listing(t):
    return listing.explore(t.catalogue, t.sessions, day(TODAY), municipality="minato")


@query("slug_lookup", "SELECT id, slug, title FROM catalogue WHERE status = 'published' AND slug = 'feed-42'")
def slug_lookup(t):
    return listing.by_slug(t.catalogue, "feed-42").select("id", "slug", "title")


TIMING = f"""CASE WHEN start_date IS NULL THEN 'unknown' WHEN coalesce(end_date, start_date) < {D} THEN 'ended'
 WHEN start_date > {D} THEN 'upcoming' ELSE 'ongoing' END"""


@query("operational_order", f"""SELECT id, timing FROM (SELECT id, {TIMING} AS timing, start_date, end_date FROM catalogue)
ORDER BY CASE timing WHEN 'upcoming' THEN 0 WHEN 'ongoing' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END,
 CASE timing WHEN 'upcoming' THEN start_date - DATE '1970-01-01' WHEN 'ongoing' THEN DATE '1970-01-01' - start_date
   ELSE DATE '1970-01-01' - coalesce(end_date, start_date) END, id LIMIT 200""")
def operational_order(t):
    return listing.operational(t.catalogue, day(TODAY)).select("id", "timing")


@query("ended_order", f"SELECT id, end_date FROM catalogue WHERE status = 'published' AND end_date < {D} ORDER BY end_date DESC, id LIMIT 200")
def ended_order(t):
    return listing.ended_listing(t.catalogue, day(TODAY)).select("id", "end_date")


@query("timing_and_ended", f"""SELECT id, {TIMING} AS timing, start_date IS NOT NULL AND coalesce(end_date, start_date) < {D} AS ended FROM catalogue""")
def timing_and_ended(t):
    s, e = F.col("start_date"), F.col("end_date")
    return t.catalogue.select("id", dates.timing(s, e, day(TODAY)).alias("timing"),
                              dates.ended(s.cast("string"), e.cast("string"), day(TODAY)).alias("ended"))


@query("weekend_days", """SELECT o_orderkey, sat, sat + 1 AS sun, CASE WHEN dayofweek(d) = 0 THEN d ELSE sat END AS explorer_first FROM (
SELECT o_orderkey, cast(o_orderdate AS date) AS d, CASE WHEN dayofweek(o_orderdate) = 0 THEN cast(o_orderdate AS date) - 1
 ELSE cast(o_orderdate AS date) + cast(6 - dayofweek(o_orderdate) AS int) END AS sat FROM orders)""")
def weekend_days(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", dates.weekend(d)[0].alias("sat"), dates.weekend(d)[1].alias("sun"),
                           dates.weekend_explorer(d)[0].alias("explorer_first"))


@query("mood_pages_all", f"WITH {explore_sql()} SELECT id, pos, cast(ceil(pos / 24.0) AS bigint) AS page, cast(greatest(count(*) OVER () - ceil(pos / 24.0) * 24, 0) AS bigint) AS rest FROM listed")
def mood_pages_all(t):
    return listing.mood_pages(t.catalogue, t.sessions, day(TODAY), "all")


@query("mood_pages_weekend", f"""WITH {explore_sql()},
w AS (SELECT id, row_number() OVER (ORDER BY pos) AS pos FROM listed WHERE id IN (SELECT event_id FROM spans
  WHERE {D} BETWEEN span_start AND span_end OR {D} + 1 BETWEEN span_start AND span_end))
SELECT id, pos, cast(ceil(pos / 24.0) AS bigint) AS page, cast(greatest(count(*) OVER () - ceil(pos / 24.0) * 24, 0) AS bigint) AS rest FROM w""")
def mood_pages_weekend(t):
    return listing.mood_pages(t.catalogue, t.sessions, day(TODAY), "weekend", weekend_days=dates.weekend_explorer(day(TODAY)))


@query("consecutive_groups", f"""WITH {explore_sql()},
k AS (SELECT id, pos, coalesce(schedule_status, 'other') AS key, lag(coalesce(schedule_status, 'other')) OVER (ORDER BY pos) AS prev FROM listed)
SELECT id, pos, key, cast(sum(CASE WHEN prev = key THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS bigint) AS group_no FROM k""")
def consecutive_groups(t):
    rows = listing.explore(t.catalogue, t.sessions, day(TODAY)).select(
        "id", "pos", F.coalesce("schedule_status", F.lit("other")).alias("key"), F.lit(0).alias("list"))
    return listing.consecutive_groups(rows, "key", ["list"], "pos").drop("list")


@query("speaker_runs", """WITH k AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, role, cast(sum(CASE WHEN prev = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS bigint) AS group_no FROM k""")
def speaker_runs(t):
    return listing.consecutive_groups(t.conversations.select("conv_id", "turn", "role"), "role", ["conv_id"], "turn")
