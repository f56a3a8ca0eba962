"""Export projections (E1-E4; E3 is functions.place.place_label)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions.dates import clock
from tsudoi.functions.text import WS, blank_to_null, let, nfkc, squeeze, strip
from tsudoi.operators.schedule import merge_spans, usable_sessions

# Tag labels per language.
LABELS = {
    "ja": {"indoor": "屋内", "outdoor": "屋外", "mixed": "屋内・屋外", "family": "家族で楽しむ", "date": "デート向け", "solo": "一人でも行きやすい", "rain": "雨の日OK", "required": "予約必須",
           "not_required": "予約不要", "recommended": "事前予約推奨", "free": "無料", "partially_paid": "一部有料", "paid": "有料", "varies": "内容による", "parking": "駐車場あり",
           "not_available": "専用駐車場なし", "nearby": "周辺駐車場あり", "walk": "駅徒歩{}分"},
    "en": {"indoor": "Indoor", "outdoor": "Outdoor", "mixed": "Indoor / outdoor", "family": "Family-friendly", "date": "Good for dates", "solo": "Solo-friendly", "rain": "Rain-friendly",
           "required": "Reservation required", "not_required": "No reservation required", "recommended": "Reservation recommended", "free": "Free", "partially_paid": "Partially paid", "paid": "Paid",
           "varies": "Varies", "parking": "Parking available", "not_available": "No dedicated parking", "nearby": "Nearby parking", "walk": "{} min walk from station"},
}


def _pick(c: Column, words, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for w in reversed(words):
        out = F.when(c == w, table[w]).otherwise(out)
    return out


def visit_tags(df: DataFrame, locale: str = "ja", out: str = "visit_tags") -> DataFrame:
    """E1. Adds out array<struct<id,label>>: settled facts only; unknown, 'no' and null show nothing."""
    t = LABELS[locale]
    kind = blank_to_null(strip(F.col("venue_type")))
    venue = F.when(kind.isNotNull() & (kind != "unknown"), _pick(kind, ("indoor", "outdoor", "mixed"), t)).when(F.col("is_indoor"), t["indoor"])
    family = F.when(F.col("family_friendly") == "yes", t["family"]).when(F.col("family_friendly").eqNullSafe("no"), None).when(F.col("is_kids"), t["family"])
    yes = lambda c, k: F.when(F.col(c) == "yes", t[k])
    before, after = t["walk"].split("{}")
    walk = F.when(F.col("walk_minutes") >= 0, F.concat(F.lit(before), F.col("walk_minutes").cast("string"), F.lit(after)))
    pairs = (("venue", venue), ("family", family), ("date", yes("date_friendly", "date")), ("solo", yes("solo_friendly", "solo")), ("rain", yes("rain_friendly", "rain")),
             ("reservation", _pick(F.col("reservation_status"), ("required", "not_required"), t)), ("price", _pick(F.col("price_type"), ("free", "partially_paid", "paid", "varies"), t)),
             ("walk", walk), ("parking", F.when(F.col("parking_status") == "available", t["parking"])))
    return df.withColumn(out, F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("id"), v.alias("label"))) for k, v in pairs])))


FREE_ONLY = "^(?:(?:入場|観覧|参加)(?:料(?:金)?)?(?:は|が)?)?無料[。．]?$"


def admission_supplement(price_text: Column) -> Column:
    """What a price text says beyond 'free admission'."""
    body = F.regexp_replace(strip(nfkc(price_text)), rf"^料金[:：]{WS}*", "")
    parts = F.filter(F.split(body, "(?<=[。．])"), lambda p: (strip(p) != "") & ~F.regexp_replace(p, WS, "").rlike(FREE_ONLY))
    return blank_to_null(strip(F.array_join(F.transform(parts, strip), "")))


def _yen(n: Column) -> Column:
    return F.concat(F.format_number(n, 0), F.lit("円"))


def yen_range(low: Column, high: Column) -> Column:
    return (F.when(low == high, _yen(low)).when(low.isNotNull() & high.isNotNull(), F.concat(_yen(low), F.lit("〜"), _yen(high)))
            .when(low.isNotNull(), F.concat(_yen(low), F.lit("〜"))).when(high.isNotNull(), F.concat(F.lit("〜"), _yen(high))))


def beyond_amount(price_text: Column, amount: Column) -> Column:
    """What is left of a price text once one amount is taken out; null when it only repeats the amount."""
    plain, comma = amount.cast("string"), F.format_number(amount, 0)
    compact = F.regexp_replace(nfkc(price_text), WS, "")
    bare = compact
    for p in ("^料金[:：]", "^有料[。．]?", "一般・?当日料金[:：]?"):
        bare = F.regexp_replace(bare, p, "")
    bare = F.regexp_replace(F.replace(F.replace(F.regexp_replace(bare, "^(.*?)一般", "$1"), comma, F.lit("")), plain, F.lit("")), "[円。．，、]", "")
    note = F.regexp_replace(F.regexp_replace(strip(nfkc(price_text)), rf"^料金[:：]{WS}*", ""), rf"^有料[。．]{WS}*", "")
    note = F.replace(F.replace(note, F.concat(comma, F.lit("円")), F.lit("")), F.concat(plain, F.lit("円")), F.lit(""))
    note = strip(F.regexp_replace(note, r"^[。．\s]+", ""))
    return F.when(F.coalesce(bare, F.lit("")) != "", blank_to_null(note))


def visit_facts(df: DataFrame, locale: str = "ja", out: str = "visit_facts") -> DataFrame:
    """E2. Adds out struct: price class, note, card line, access (dropped when it restates station and minutes),
    parking, reservation and duration; null when nothing is known."""
    t = LABELS[locale]
    text = blank_to_null(strip(F.col("price_text")))
    low, high = F.col("price_min"), F.col("price_max")
    amounts = F.when(F.col("price_type") == "paid", yen_range(low, high))
    extra = admission_supplement(F.col("price_text"))
    note = F.when(F.col("price_type") == "free", extra).otherwise(F.coalesce(text, amounts))
    single = (F.col("price_type") == "paid") & (low == high)
    card = (F.when(F.col("price_type") == "free", extra).when(F.coalesce(single, F.lit(False)), F.concat_ws(" ", amounts, beyond_amount(text, low)))
            .otherwise(F.coalesce(text, amounts)))
    tight = lambda c: F.lower(F.regexp_replace(nfkc(c), WS, ""))
    station, access = blank_to_null(strip(F.col("nearest_station"))), blank_to_null(strip(F.col("access_text")))
    restates = (station.isNotNull() & F.col("walk_minutes").isNotNull() & F.contains(tight(access), tight(station))
                & F.contains(tight(access), F.col("walk_minutes").cast("string")) & F.contains(access, F.lit("徒歩")))
    lo, hi = F.col("duration_minutes_min"), F.col("duration_minutes_max")
    duration = (F.when(lo == hi, F.concat(F.lit("約"), lo.cast("string"), F.lit("分"))).when(lo.isNotNull() & hi.isNotNull(), F.concat(lo.cast("string"), F.lit("〜"), hi.cast("string"), F.lit("分")))
                .when(lo.isNotNull(), F.concat(lo.cast("string"), F.lit("分〜"))).when(hi.isNotNull(), F.concat(F.lit("〜"), hi.cast("string"), F.lit("分"))))
    parts = {
        "price_class": _pick(F.col("price_type"), ("free", "partially_paid", "paid", "varies"), t), "admission_note": note, "card_price": card, "nearest_station": station,
        "walk_minutes": F.col("walk_minutes"), "access_text": F.when(~F.coalesce(restates, F.lit(False)), access),
        "parking": F.when(F.col("parking_status") == "available", t["parking"]).otherwise(_pick(F.col("parking_status"), ("not_available", "nearby"), t)),
        "parking_text": blank_to_null(strip(F.col("parking_text"))), "reservation": _pick(F.col("reservation_status"), ("required", "recommended", "not_required"), t),
        "duration": duration, "age_note": blank_to_null(strip(F.col("age_note")))}
    step = df.withColumns({"_f_" + k: v for k, v in parts.items()})
    known = F.lit(False)
    for k in parts:
        known = known | F.col("_f_" + k).isNotNull()
    return step.withColumn(out, F.when(known, F.struct(*[F.col("_f_" + k).alias(k) for k in parts]))).drop(*["_f_" + k for k in parts])


def structured_offers(price_type: Column, low: Column, high: Column, url: Column) -> Column:
    """Offer JSON fields from the structured price only; the price text is never read."""
    free = price_type == "free"
    ranged = (price_type == "paid") & low.isNotNull() & high.isNotNull() & (low != high)
    single = (price_type == "paid") & low.isNotNull() & (high.isNull() | (high == low))
    text = lambda c: c.cast("string")
    return F.when(free | ranged | single, F.struct(
        F.when(ranged, "AggregateOffer").otherwise("Offer").alias("@type"), F.when(free, "0").when(single, text(low)).alias("price"), F.when(ranged, text(low)).alias("lowPrice"),
        F.when(ranged, text(high)).alias("highPrice"), F.lit("JPY").alias("priceCurrency"), blank_to_null(strip(url)).alias("url")))


def schema_org(events: DataFrame, sessions: DataFrame, page_url: Column) -> DataFrame:
    """E4. (id, n_nodes, json_ld): one node per session when any session has a clock, else one per merged span,
    else the parent's own dates with its clocks. Null fields are left out."""
    rows = usable_sessions(sessions)
    has_clock = F.coalesce(strip(F.col("start_time")) != "", F.lit(False)) | F.coalesce(strip(F.col("end_time")) != "", F.lit(False))
    stamp = lambda d, c: F.concat(d.cast("string"), F.coalesce(F.concat(F.lit("T"), clock(c), F.lit(":00+09:00")), F.lit("")))
    span = lambda s, e: F.struct(s.alias("startDate"), e.alias("endDate"))
    timed = rows.groupBy("event_id").agg(F.bool_or(has_clock).alias("_timed"))
    # an event's sessions become one JSON document, which is the unit of the export
    nodes = rows.join(timed.where("_timed"), "event_id").select("event_id", span(stamp(F.col("start_date"), F.col("start_time")), stamp(F.col("end_date"), F.col("end_time"))).alias("n"))
    whole = merge_spans(sessions).join(timed.where(~F.col("_timed")), "event_id").select("event_id", span(F.col("span_start").cast("string"), F.col("span_end").cast("string")).alias("n"))
    lists = nodes.unionByName(whole).groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list("n")).alias("_nodes"))
    end = F.when(F.col("end_date") >= F.col("start_date"), F.col("end_date")).otherwise(F.col("start_date"))
    own = F.when(F.col("start_date").isNotNull(), F.array(span(stamp(F.col("start_date"), F.col("start_time")), stamp(end, F.col("end_time")))))
    step = events.join(lists, "id", "left").withColumn("_nodes", F.coalesce("_nodes", own)).withColumn("_url", page_url)
    step = step.where(F.col("_nodes").isNotNull() & (strip(F.col("title")) != ""))
    venue, address = blank_to_null(strip(F.col("venue"))), blank_to_null(strip(F.col("address")))
    location = F.when(venue.isNotNull() | address.isNotNull(), F.struct(F.lit("Place").alias("@type"), venue.alias("name"), F.when(
        address.isNotNull(), F.struct(F.lit("PostalAddress").alias("@type"), address.alias("streetAddress"))).alias("address")))
    step = step.withColumns({"_loc": location, "_off": structured_offers(F.col("price_type"), F.col("price_min"), F.col("price_max"), F.coalesce(blank_to_null(strip(F.col("official_url"))), "_url"))})
    body = [F.lit("Event").alias("@type"), strip(F.col("title")).alias("name"), F.col("_url").alias("url")]
    tail = [blank_to_null(strip(F.col("summary"))).alias("description"), F.col("_loc").alias("location"), F.col("_off").alias("offers")]
    graph = F.transform("_nodes", lambda n: F.struct(*body, n.startDate.alias("startDate"), n.endDate.alias("endDate"), *tail))
    context = F.lit("https://schema.org").alias("@context")
    one = F.get("_nodes", F.lit(0))
    single = F.to_json(F.struct(context, *body, one.startDate.alias("startDate"), one.endDate.alias("endDate"), *tail))
    many = F.to_json(F.struct(context, graph.alias("@graph")))
    json = F.when(F.size("_nodes") == 1, single).otherwise(many)
    return step.select("id", F.size("_nodes").alias("n_nodes"), F.replace(json, F.lit("<"), F.lit("\\u003c")).alias("json_ld"))
