"""Dates and hours written in feeds: listing dates, day lists, open-data dates, opening hours."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions.dates import db_time, span_end, ymd
from tsudoi.functions.text import WS, any_match, let, squeeze, strip

DAY = r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日"
SHORT_DAY = r"[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日"
SLASH_DAY = r"[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"
SHORT_SLASH = r"[0-9]{1,2}[/-][0-9]{1,2}"
NOTE = r"(?:\([^)]*\))?"
DASH = r"[〜～\-－—~–]"


def day_token(c: Column) -> Column:
    """One full date (Y年M月D日, Y/M/D or Y-M-D) as a date; anything without a year is null."""
    parts = lambda i: F.regexp_extract(c, r"([0-9]{4})\s*[年/-]\s*([0-9]{1,2})\s*[月/-]\s*([0-9]{1,2})", i)
    return ymd(parts(1), parts(2), parts(3))


def listing_dates(raw: Column, style: str = "kanji") -> Column:
    """T5: struct<start_date, end_date> of a listing's date text.

    An end without a year stays null, as does a start that is not written. ``style`` is 'kanji'
    (Y年M月D日, also 'から') or 'slash' (Y/M/D, notes after ※ ignored)."""
    text = squeeze(raw if style == "kanji" else F.substring_index(raw, "※", 1))
    text = strip(F.regexp_replace(text, "^(開催中|終了間近|終了間際)", ""))
    full, short = (DAY, SHORT_DAY) if style == "kanji" else (SLASH_DAY, SHORT_SLASH)
    first = F.regexp_extract(text, f"({full})", 1)
    range_re = rf"({full}){NOTE}\s*{DASH}\s*({full}){NOTE}"
    short_re = rf"({full}){NOTE}\s*{DASH}\s*({short})"
    open_re = rf"^{DASH}\s*({full}){NOTE}"
    none = F.lit(None).cast("date")

    def pair(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start_date"), end.alias("end_date"))

    rules = (F.when(any_match(text, range_re), pair(day_token(F.regexp_extract(text, range_re, 1)), day_token(F.regexp_extract(text, range_re, 2))))
             .when(any_match(text, short_re), pair(day_token(F.regexp_extract(text, short_re, 1)), none))
             .when(any_match(text, open_re), pair(none, day_token(F.regexp_extract(text, open_re, 1)))))
    if style == "kanji":
        from_re = rf"({full}){NOTE}\s*から"
        rules = rules.when(any_match(text, from_re), pair(day_token(F.regexp_extract(text, from_re, 1)), none))
    return rules.otherwise(pair(day_token(first), day_token(first)))


LISTED_DAY = "(?:(?:([0-9]{4})年)?([0-9]{1,2})月)?([0-9]{1,2})日"
_STATE = "struct<y:int,m:int,d:int,days:array<date>,ok:boolean>"


def discrete_days(period: Column) -> Column:
    """The listed days of 'Y年M月D日・D日・…' in order, or null for a range or a single day.

    Year and month carry over; a day number that falls starts the next month. A day the calendar
    lacks makes the list unreadable. The texts are read once into numbers; the fold only adds."""
    def numbers(part: Column) -> Column:
        return F.struct(*[F.regexp_extract(part, LISTED_DAY, i).try_cast("int").alias(n) for i, n in ((1, "y"), (2, "m"), (3, "d"))])

    def carry(state: Column, part: Column) -> Column:
        falls = part.m.isNull() & F.coalesce(part.d < state.d, F.lit(False))
        month = F.coalesce(part.m, F.when(falls, state.m % 12 + 1).otherwise(state.m))
        year = F.coalesce(part.y, F.when(falls & (state.m == 12), state.y + 1).otherwise(state.y))
        return F.struct(year.alias("y"), month.alias("m"), part.d.alias("d"))

    def step(state: Column, part: Column) -> Column:
        return let(carry(state, part), lambda c: let(ymd(c.y.cast("string"), c.m.cast("string"), c.d.cast("string")), lambda day: F.struct(
            c.y.alias("y"), c.m.alias("m"), c.d.alias("d"), F.concat(state.days, F.array(day)).alias("days"),
            (state.ok & day.isNotNull()).alias("ok")).cast(_STATE)))

    none = F.lit(None).cast("int")
    start = F.struct(none.alias("y"), none.alias("m"), none.alias("d"), F.array().cast("array<date>").alias("days"), F.lit(True).alias("ok")).cast(_STATE)
    text = F.regexp_replace(period, WS, "")
    listed = F.when(F.contains(period, F.lit("・")) & ~any_match(period, "[〜～]"), F.transform(F.split(text, "・"), numbers))
    folded = let(F.aggregate(listed, start, step), lambda s: F.when(s.ok, F.array_sort(F.array_distinct(s.days))))
    return let(folded, lambda d: F.when(F.size(d) >= 2, d))


OCCURRENCE = "array<struct<start_date:date,end_date:date,start_time:string,end_time:string>>"


def schedule_plan(df: DataFrame, today: Column, period: str = "period", start: str = "start_date", end: str = "end_date",
                  start_time: str = "start_time", end_time: str = "end_time", out: str = "plan") -> DataFrame:
    """T7. Adds plan struct<start_date, end_date, occurrences>: listed days with a gap become
    occurrences and the parent is the next of them (the last when all are past)."""
    step = df.withColumn("_days", discrete_days(F.col(period)))
    days = F.col("_days")
    gap = F.exists(F.zip_with(F.slice(days, 1, F.size(days) - 1), F.slice(days, 2, F.size(days) - 1), lambda a, b: F.datediff(b, a)),
                   lambda g: g > 1)
    step = step.withColumn("_split", F.coalesce(F.when(F.size(days) >= 2, gap), F.lit(False)))
    nxt = F.coalesce(F.get(F.filter(days, lambda d: d >= today), F.lit(0)), F.try_element_at(days, F.lit(-1)))
    own_end = span_end(F.col(start), F.col(end))
    occ = F.transform(days, lambda d: F.struct(d.alias("start_date"), d.alias("end_date"), F.col(start_time).alias("start_time"),
                                               F.col(end_time).alias("end_time")))
    plan = F.struct(
        F.when(F.col("_split"), nxt).when(days.isNotNull(), F.get(days, F.lit(0))).otherwise(F.col(start)).alias("start_date"),
        F.when(F.col("_split"), nxt).when(days.isNotNull(), F.try_element_at(days, F.lit(-1))).otherwise(own_end).alias("end_date"),
        F.when(F.col("_split"), occ).otherwise(F.array()).cast(OCCURRENCE).alias("occurrences"))
    return step.withColumn(out, plan).drop("_days", "_split")


OPEN_RANGE = "^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日から([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日$"
OPEN_SINGLE = "^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日$"
REPEATS = "毎週|隔週|毎月"
SPANS = "array<struct<start_date:date,end_date:date>>"


def _open_part(p: Column) -> Column:
    g = lambda pattern, i: F.regexp_extract(p, pattern, i)
    start, end = ymd(g(OPEN_RANGE, 1), g(OPEN_RANGE, 2), g(OPEN_RANGE, 3)), ymd(g(OPEN_RANGE, 4), g(OPEN_RANGE, 5), g(OPEN_RANGE, 6))
    one = ymd(g(OPEN_SINGLE, 1), g(OPEN_SINGLE, 2), g(OPEN_SINGLE, 3))
    return F.when(start <= end, F.struct(start.alias("start_date"), end.alias("end_date"))).when(
        one.isNotNull(), F.struct(one.alias("start_date"), one.alias("end_date")))


def open_data_dates(raw: Column, detail: Column) -> Column:
    """struct<start_date, end_date, occurrences, date_status> of a comma list of days and ranges."""
    parts = F.filter(F.transform(F.split(raw, ","), strip), lambda p: p != "")
    occ = F.array_compact(F.transform(parts, _open_part))
    weekly = any_match(F.concat_ws("\n", raw, detail), REPEATS)
    n, found = F.size(parts), F.size(occ)
    first = F.get(occ, F.lit(0))
    status = (F.when(F.coalesce(strip(raw), F.lit("")) == "", "unparsed").when(weekly, "weekly").when(found == 0, "unparsed")
              .when(n > 1, F.when(found == n, "multiple").otherwise("partial"))
              .when(first.start_date == first.end_date, "single").otherwise("range"))
    lone = status.isin("single", "range")
    return F.struct(F.when(lone, first.start_date).alias("start_date"), F.when(lone, first.end_date).alias("end_date"),
                    F.when(status.isin("unparsed", "weekly"), F.array()).otherwise(occ).cast(SPANS).alias("occurrences"), status.alias("date_status"))


def lifecycle(occurrences: Column, today: Column) -> Column:
    """T9."""
    return (F.when(F.coalesce(F.size(occurrences), F.lit(0)) <= 0, "unknown")
            .when(F.exists(occurrences, lambda o: (o.start_date <= today) & (o.end_date >= today)), "ongoing")
            .when(F.exists(occurrences, lambda o: o.start_date > today), "future")
            .when(F.forall(occurrences, lambda o: o.end_date < today), "ended").otherwise("unknown"))


def is_active(state: Column) -> Column:
    return state.isin("future", "ongoing")


def next_occurrence(occurrences: Column, today: Column) -> Column:
    """The occurrence with the earliest start among those not over; list order breaks ties."""
    open_ones = F.filter(occurrences, lambda o: o.end_date >= today)
    first = F.array_min(F.transform(open_ones, lambda o: o.start_date))
    return F.get(F.filter(open_ones, lambda o: o.start_date == first), F.lit(0))


def parent_dates(occurrences: Column, today: Column) -> Column:
    """Dates the parent row carries: the only, the next, else the first occurrence."""
    return F.coalesce(F.when(F.size(occurrences) > 1, next_occurrence(occurrences, today)), F.get(occurrences, F.lit(0)))


# ---- opening hours --------------------------------------------------------------------------------
CLOCK = r"(?:午前|午後)?[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|(?:午前|午後)?[0-9]{1,2}時(?:[0-9]{1,2}分)?"
CLOCK_DASH = r"[〜～\-~－—–]"
RANGE = rf"({CLOCK})\s*{CLOCK_DASH}\s*({CLOCK})"
JAPANESE_CLOCK = "^(午前|午後)?([0-9]{1,2})時(?:([0-9]{1,2})分)?$"
LABEL_START = rf"(?:開始|開演|開場|スタート)\s*(?:時間)?\s*[:：]?\s*({CLOCK})"
LABEL_END = rf"(?:終了|閉演|閉場|エンド)\s*(?:時間)?\s*[:：]?\s*({CLOCK})"
WEEKDAY_CLOCK = r"(?:平日|土日祝?|土日|祝日|休日)[^\n]{0,20}?(?:[0-9]{1,2}:[0-9]{2}|(?:午前|午後)?[0-9]{1,2}時)"
SESSION_PARTS = r"第\s*[0-9]+\s*部|午前の部|午後の部|夜の部|昼の部"
HOURS_LABEL = r"(?:開催時間|開館時間|営業時間|開催時刻|開始時間|開演時間|開場時間)\s*[:：]?\s*[^\n]{0,80}"


def parse_clock(token: Column) -> Column:
    """A clock token, 10:30 or 午後6時30分, as HH:MM:00."""
    t = F.regexp_replace(token, WS, "")
    half, hour, minute = (F.regexp_extract(t, JAPANESE_CLOCK, i) for i in (1, 2, 3))
    h24 = let(hour.try_cast("int"), lambda h: F.when((half == "午前") & (h == 12), 0).when((half == "午後") & (h < 12), h + 12).otherwise(h))
    japanese = let(h24, lambda h: F.when(h.isNotNull(), F.concat_ws(":", h.cast("string"), F.lpad(minute, 2, "0"))))
    return F.when(F.contains(token, F.lit(":")), db_time(token)).otherwise(let(japanese, db_time))


def _clock_tokens(text: Column) -> Column:
    """Clock values in text order; numbers that read as dates, ages, prices or part numbers are left out."""
    tokens = F.regexp_extract_all(text, F.lit(f"({CLOCK})"), 1)
    pieces = F.flatten(F.zip_with(F.split(text, CLOCK), tokens, lambda s, t: F.array(s, F.coalesce(t, F.lit("")))))

    def judged(token: Column, i: Column) -> Column:
        context = F.struct(F.right(F.array_join(F.slice(pieces, F.lit(1), 2 * i + 1), ""), F.lit(16)).alias("b"),
                           F.left(F.array_join(F.slice(pieces, 2 * i + 3, F.size(pieces)), ""), F.lit(16)).alias("a"))

        def reads_otherwise(c: Column) -> Column:
            near = F.concat(F.right(c.b, F.lit(12)), F.left(c.a, F.lit(12)))
            dated = F.concat(F.right(c.b, F.lit(8)), F.left(c.a, F.lit(4))).rlike("[0-9]{4}[/-年]")
            return (dated | (c.b.rlike(rf"月{WS}*$") & F.contains(c.a, F.lit("日")))
                    | (c.b.rlike(rf"第{WS}*[0-9]+{WS}*$") & c.a.rlike("部|話|章")) | near.rlike("歳|才|円|¥|税|料金|入場料|大人|小人|高校|中学|小学"))

        return F.when(~let(context, reads_otherwise), parse_clock(token))

    return F.when(text.rlike("[0-9]"), F.array_compact(F.transform(tokens, judged))).otherwise(F.array().cast("array<string>"))


def parse_hours(df: DataFrame, col: str, out: str = "hours_parsed") -> DataFrame:
    """T3. Adds out struct<start_time, end_time, action, reason>. Ambiguous wording yields nulls."""
    raw = strip(F.regexp_replace(F.col(col), r"\x{00a0}", " "))
    step = df.withColumn("_raw", raw).withColumn("_main", squeeze(F.substring_index("_raw", "※", 1)))
    main = F.col("_main")
    step = step.withColumns({
        "_clocks": _clock_tokens(main),
        "_ranges": F.array_compact(F.zip_with(F.regexp_extract_all(main, F.lit(RANGE), 1), F.regexp_extract_all(main, F.lit(RANGE), 2),
                                              lambda a, b: let(F.struct(parse_clock(a).alias("s"), parse_clock(b).alias("e")),
                                                                                lambda r: F.when(r.s.isNotNull() & r.e.isNotNull(), r)))),
        "_ls": parse_clock(F.regexp_extract(main, LABEL_START, 1)), "_le": parse_clock(F.regexp_extract(main, LABEL_END, 1)),
        "_weekdays": F.regexp_count(main, F.lit(WEEKDAY_CLOCK))})
    clocks, ranges, ls, le = F.col("_clocks"), F.col("_ranges"), F.col("_ls"), F.col("_le")
    n, distinct = F.size(clocks), F.array_distinct(ranges)
    several = (n >= 2) & ((F.col("_weekdays") >= 2) | (any_match(main, SESSION_PARTS) & (F.size(ranges) >= 2))
                          | any_match(main, "各種|日によって|曜日によって|イベントによって異なります"))
    one = F.get(distinct, F.lit(0))
    beyond = lambda a, b: F.exists(clocks, lambda c: (c != a) & F.coalesce(c != b, F.lit(True)))
    none = F.lit(None).cast("string")

    def result(action: str, reason, start=none, end=none) -> Column:
        return F.struct(start.alias("start_time"), end.alias("end_time"), F.lit(action).alias("action"),
                        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    parsed = (
        F.when(F.coalesce(F.col("_raw"), F.lit("")) == "", result("not_found", "empty"))
        .when(main == "", result("not_found", "empty_after_note_strip"))
        .when(any_match(main, "各種イベントによって異なります|詳細は公式|未定|要確認"), result("keep_null", "non_specific_schedule"))
        .when(several | (F.size(distinct) > 1), result("keep_null", "multiple_time_ranges"))
        .when(any_match(main, "最終日|を除く|ただし") & (n >= 3), result("keep_null", "exception_day_schedule"))
        .when(F.size(distinct) == 1, F.when(beyond(one.s, one.e) & any_match(main, "最終日|を除く|ただし|平日|土日"),
                                            result("keep_null", "multiple_time_ranges")).otherwise(result("parsed", "single_time_range", one.s, one.e)))
        .when(ls.isNotNull(), F.when(beyond(ls, le), result("keep_null", "multiple_time_ranges")).otherwise(
            result("parsed", F.when(le.isNotNull(), "labeled_start_end").otherwise("labeled_start_only"), ls, le)))
        .when((n == 1) & any_match(main, "開始|開演|開場|スタート"), result("parsed", "single_start_only", F.get(clocks, F.lit(0))))
        .when(n == 1, result("keep_null", "single_time_unlabeled")).when(n == 0, result("not_found", "no_clock_token"))
        .otherwise(result("keep_null", "ambiguous_time_text")))
    return step.withColumn(out, parsed).drop("_raw", "_main", "_clocks", "_ranges", "_ls", "_le", "_weekdays")


def labelled_hours(page_text: Column) -> Column:
    """T4: every labelled hours line of a page, joined by ' / '."""
    text = F.regexp_replace(page_text, r"\x{00a0}", " ")
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"({HOURS_LABEL})"), 1), squeeze)
    return F.when(F.size(hits) > 0, F.array_join(hits, " / "))
