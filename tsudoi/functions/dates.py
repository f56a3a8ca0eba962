"""Calendar expressions: safe dates, clocks, weekends, ended and timing rules."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsudoi.functions.text import blank_to_null, strip

NO_DATE = dt.date(9999, 12, 31)   # sorts after every real day
NO_CLOCK = "99:99"                # sorts after every real clock


def day(value) -> Column:
    return F.lit(value if isinstance(value, dt.date) else dt.date.fromisoformat(value))


def safe_date(c: Column) -> Column:
    """A strict YYYY-MM-DD text as a date; anything else is absent."""
    t = strip(c.cast("string"))
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def ymd(year: Column, month: Column, dom: Column) -> Column:
    """A date from three digit texts, null when the calendar has no such day."""
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(dom, 2, "0")), "yyyy-MM-dd")


def span_end(start: Column, end: Column) -> Column:
    """End of an inclusive span: a missing or earlier end means one day."""
    return F.when(end >= start, end).otherwise(start)


def clock(c: Column) -> Column:
    """HH:MM of a clock text; null when absent or out of range."""
    hour = F.regexp_extract(strip(c), "^([0-9]{1,2}):([0-9]{2})", 1)
    minute = F.regexp_extract(strip(c), "^([0-9]{1,2}):([0-9]{2})", 2)
    return F.when((hour != "") & (hour.try_cast("int") <= 23), F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def clock_minutes(c: Column) -> Column:
    hm = clock(c)
    minute = F.substring(hm, 4, 2).cast("int")
    return F.when(minute <= 59, F.substring(hm, 1, 2).cast("int") * 60 + minute)


CLOCK_FULL = r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?$"
ISO_CLOCK = r"(?i)T([0-9]{2}):([0-9]{2})(?::[0-9]{2})?(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"


def _db_time(h: Column, m: Column) -> Column:
    return F.when((h != "") & (h.try_cast("int") <= 23) & (m.try_cast("int") <= 59),
                  F.concat(F.lpad(h, 2, "0"), F.lit(":"), F.lpad(m, 2, "0"), F.lit(":00")))


def db_time(c: Column) -> Column:
    """H:MM[:SS] as HH:MM:00, out of range is null."""
    t = strip(c)
    seconds = F.regexp_extract(t, CLOCK_FULL, 3)
    ok = (seconds == "") | (seconds.try_cast("int") <= 59)
    return F.when(ok, _db_time(F.regexp_extract(t, CLOCK_FULL, 1), F.regexp_extract(t, CLOCK_FULL, 2)))


def time_of_iso(c: Column) -> Column:
    """Wall clock of an ISO date-time, zone ignored."""
    t = strip(c)
    return _db_time(F.regexp_extract(t, ISO_CLOCK, 1), F.regexp_extract(t, ISO_CLOCK, 2))


def ended(start: Column, end: Column, today: Column) -> Column:
    """End before today; without an end, start before today; no usable date is not ended.

    ``start`` and ``end`` are texts, so an unreadable end differs from an absent one."""
    has_start = F.coalesce(strip(start) != "", F.lit(False))
    end_text = blank_to_null(strip(end))
    last = F.when(end_text.isNotNull(), safe_date(end)).otherwise(safe_date(start))
    return has_start & F.coalesce(last < today, F.lit(False))


def ended_dates(start: Column, end: Column, today: Column) -> Column:
    """T18 where both columns are already dates."""
    return F.coalesce(start.isNotNull() & (F.coalesce(end, start) < today), F.lit(False))


def timing(start: Column, end: Column, today: Column) -> Column:
    """T19 over date columns: ongoing, upcoming, unknown or ended."""
    return (F.when(start.isNull(), "unknown").when(ended_dates(start, end, today), "ended")
            .when(start > today, "upcoming").otherwise("ongoing"))


def weekend(today: Column) -> Column:
    """[Saturday, Sunday] of the current weekend; on a Sunday, yesterday and today."""
    dow = F.dayofweek(today)  # 1 = Sunday
    saturday = F.when(dow == 1, F.date_sub(today, 1)).otherwise(F.date_add(today, 7 - dow))
    return F.array(saturday, F.date_add(saturday, 1))


def weekend_explorer(today: Column) -> Column:
    """As T20, but on a Sunday only that Sunday."""
    return F.when(F.dayofweek(today) == 1, F.array(today)).otherwise(weekend(today))
