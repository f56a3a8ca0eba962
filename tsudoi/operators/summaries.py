"""Proposal and summary guards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions.classify import CATEGORIES
from tsudoi.functions.text import WS, any_match, blank_to_null, let, nfkc, squeeze, strip

# Fields a model may propose.
MODEL_FIELDS = ("price_min", "price_max", "price_text", "price_type", "reservation_status", "reservation_url", "nearest_station", "access_text", "walk_minutes", "venue_type",
                "family_friendly", "date_friendly", "solo_friendly", "rain_friendly", "age_note", "duration_minutes_min", "duration_minutes_max", "parking_status", "parking_text")


def guard_model_proposals(proposals: DataFrame, excerpts: DataFrame, key: str = "event_id") -> DataFrame:
    """P11. Model proposals that name an allowed field and quote the excerpt; never more than medium confidence."""
    compact = lambda c: F.regexp_replace(c, f"{WS}+", "")
    rows = proposals.join(excerpts, key)
    ok = (F.col("field").isin(*MODEL_FIELDS) & (strip(F.col("evidence")) != "") & F.contains(compact(F.col("excerpt")), compact(F.col("evidence")))
          & F.col("value").isNotNull() & (F.col("value") != "unknown"))
    capped = F.when(F.col("confidence").isin("medium", "high"), "medium").otherwise("low")
    return rows.where(ok).withColumns({"confidence": capped, "method": F.lit("ai_assist")}).drop("excerpt")


def route_proposals(best: DataFrame, current: DataFrame, key: str = "event_id") -> DataFrame:
    """M17. Adds route to the best proposals: skip_low, skip_same, review, or apply_draft_and_review.
    ``current``: (key, field, value) of the filled fields."""
    cur = current.where(strip(F.col("value")) != "").select(key, "field", F.col("value").alias("_cur"))
    route = (F.when(F.col("confidence") == "low", "skip_low").when(strip(F.col("_cur")) == strip(F.col("value")), "skip_same").when(F.col("_cur").isNotNull(), "review")
             .when(F.col("confidence") == "high", "apply_draft_and_review").otherwise("review"))
    return best.join(cur, [key, "field"], "left").withColumn("route", route).drop("_cur")


def enrichment_merge(events: DataFrame, rules: DataFrame, model: DataFrame) -> DataFrame:
    """M18. Facts stay; a rule value beats a model value; without a model row the rule values remain.
    Adds changed: whether any column would differ from the stored one."""
    r = rules.select("id", *[F.col(c).alias("r_" + c) for c in ("area", "price_type", "is_indoor", "is_kids", "is_night")])
    m = model.select("id", *[F.col(c).alias("m_" + c) for c in ("area", "price_type", "is_indoor", "is_kids", "is_night", "category", "summary")])
    slug = F.lower(strip(F.col("m_area")))
    night = F.when(F.coalesce(F.col("r_is_night"), F.lit(False)), True).when(F.coalesce(F.col("m_is_night"), F.lit(False)), None).otherwise(F.col("m_is_night"))
    tags = F.filter("m_category", lambda c: c.isin(*CATEGORIES))
    merged = {
        "new_area": F.coalesce("r_area", F.when(slug.rlike("^[a-z0-9-]+$"), slug), "area"), "new_price_type": F.coalesce(
            "r_price_type", F.when(F.col("m_price_type").isin("free", "partially_paid", "paid", "varies"), F.col("m_price_type")), "price_type"),
        "new_is_indoor": F.coalesce("r_is_indoor", "m_is_indoor", "is_indoor"), "new_is_kids": F.coalesce("r_is_kids", "m_is_kids", "is_kids"),
        "new_is_night": F.coalesce(night, "is_night"),
        "new_category": F.when(F.size(tags) > 0, tags).when(F.col("m_category").isNotNull(), F.array(F.lit("other"))).otherwise(F.col("category")),
        "new_summary": F.coalesce(blank_to_null(strip(F.col("m_summary"))), "summary")}
    joined = events.join(r, "id", "left").join(m, "id", "left").withColumns(merged)
    changed = F.lit(False)
    for c in ("area", "price_type", "is_indoor", "is_kids", "is_night", "category", "summary"):
        changed = changed | ~F.col("new_" + c).eqNullSafe(F.col(c))
    return joined.select(*events.columns, *merged, changed.alias("changed"))


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "(?<=[。．])"), strip), lambda s: s != "")


def _intro_free(c: Column) -> Column:
    return F.regexp_replace(squeeze(nfkc(c)), rf"^.*?のイベント情報です。{WS}*", "")


def summary_material(c: Column) -> Column:
    """Complete sentences about the event; null when fewer than 24 characters remain."""
    text = _intro_free(c)
    for pattern in ("東京都の天気[^。．]*[。．]?", rf"本日[0-9]+{WS}*℃[^。．]*[。．]?", rf"明日[0-9]+{WS}*℃[^。．]*[。．]?"):
        text = F.regexp_replace(text, pattern, "")
    dropped = rf"天気|℃|^(?:料金|入場料|参加費|費用)|^(?:アクセス|会場|開催場所|所在地)|^\[?地図\]?$|\.{{3}}|…"
    kept = F.filter(_sentences(text), lambda s: ~F.regexp_replace(s, WS, "").rlike(dropped) & s.rlike(r"[。．]$"))
    return let(strip(F.array_join(kept, "")), lambda m: F.when(F.char_length(m) >= 24, m))


def incomplete_notes(c: Column) -> Column:
    """The cut-off sentences."""
    return F.coalesce(F.array_join(F.filter(_sentences(_intro_free(c)), lambda s: s.rlike(r"\.{3}|…") | ~s.rlike(r"[。．]$")), ""), F.lit(""))


# Promotional and audience phrases a summary must not add.
ADDED_PHRASES = ("友人や家族", "友人と", "家族と", "デート", "子どもと", "誰でも", "初心者", "特別なひととき", "特別な時間", "特別な空間", "素敵な時間", "素敵な", "おすすめ", "オススメ",
                 "必見", "リラックス", "思い出", "ぜひ", "提案", "身近", "示さ")
REQUIRED_FACTS = ("敷居が高い", "開館")
AUDIENCE_WORDS = ("友人", "家族", "デート", "子ども", "kids", "誰でも", "初心者", "カップル", "親子", "恋人", "一人で", "みんなで")
PROMO_WORDS = ADDED_PHRASES + ("最高", "絶品", "人気", "話題", "お見逃し", "癒や", "癒し", "非日常", "特別な")
LATIN_NAME = r"([A-Z][A-Za-z0-9'’.,]*(?:\s+[A-Za-z0-9'’.,]+){2,})"
QUOTE, QUOTE_STEP = 24, 8


def _tight(c: Column) -> Column:
    return F.regexp_replace(c, WS, "")


def _long_quote(summary: Column, material: Column) -> Column:
    """A 24-character stretch of the material repeated at a step of eight; long katakana names do not count."""
    bare = lambda c: _tight(F.regexp_replace(c, "[ァ-ヶー・]{8,}", ""))
    return let(F.struct(bare(summary).alias("l"), bare(material).alias("r")), lambda s: F.when(F.char_length(s.l) < QUOTE, False).otherwise(F.exists(
        F.sequence(F.lit(1), F.greatest(F.char_length(s.l) - QUOTE + 1, F.lit(1)), F.lit(QUOTE_STEP)), lambda i: F.contains(s.r, F.substring(s.l, i, F.lit(QUOTE))))))


def _first_phrase(phrases, cond) -> Column:
    return F.coalesce(*[F.when(cond(p), F.lit(p)) for p in phrases])


def summary_refusal(summary: Column, material: Column, title: Column) -> Column:
    """Why a model summary is refused, null when accepted."""
    text, source = _tight(summary), _tight(material)
    n = F.char_length(summary)
    added = _first_phrase(ADDED_PHRASES, lambda p: F.contains(text, F.lit(p)) & ~F.contains(source, F.lit(p)))
    missing = _first_phrase(REQUIRED_FACTS, lambda p: F.contains(source, F.lit(p)) & ~F.contains(text, F.lit(p)))
    subject = _tight(F.regexp_extract(material, "([^。．]{2,40})は", 1))
    claimed = F.regexp_extract(text, "^(.+?)は", 1)
    shifted = ((F.char_length(subject) >= 4) & (claimed != "") & ~F.contains(claimed, subject) & ~F.contains(subject, claimed)
               & ~F.contains(text, F.concat(subject, F.lit("は"))) & ~F.contains(text, F.concat(subject, F.lit("が"))) & F.contains(text, subject))
    name = F.regexp_extract(title, LATIN_NAME, 1)
    return (F.when(n > 140, F.concat(F.lit("length "), n.cast("string"))).when(added.isNotNull(), F.concat(F.lit("added:"), added))
            .when(missing.isNotNull(), F.concat(F.lit("missing:"), missing)).when(shifted, "subject_shift")
            .when((name != "") & ~F.contains(summary, name), F.concat(F.lit("name:"), name)).when(_long_quote(summary, material), "too_close_to_source"))


def review_flags(title: Column, material: Column, dropped: Column, summary: Column) -> Column:
    """Everything a reviewer should look at: length, copies, added audience, promotion, numbers, names, quotes, cut-off parts."""
    s = strip(summary)
    text, source = _tight(s), _tight(material)
    corpus, cut = _tight(F.concat_ws("\n", title, material)), _tight(dropped)
    new = lambda label, words: [F.when(F.contains(text, F.lit(w)) & ~F.contains(corpus, F.lit(w)), F.lit(f"{label}:{w}")) for w in words]
    found = lambda pattern: F.regexp_extract_all(s, F.lit(f"({pattern})"), 1)
    tokens = lambda label, pattern, known: F.transform(F.filter(found(pattern), lambda x: ~known(x)), lambda x: F.concat(F.lit(label + ":"), x))
    in_corpus = lambda x: F.contains(corpus, x)
    quotes = F.transform(F.filter(F.regexp_extract_all(s, F.lit("「([^」]{2,})」"), 1), lambda x: ~F.contains(corpus, _tight(x))), lambda x: F.concat(F.lit("quote:"), x))
    pieces = F.concat(found("[ァ-ヶー]{3,}"), found("[0-9]+"), found("[A-Za-z][A-Za-z0-9]{2,}"))
    truncated = F.transform(F.filter(pieces, lambda x: F.contains(cut, x) & ~in_corpus(x)), lambda x: F.concat(F.lit("truncated:"), x))
    fixed = F.array_compact(F.array(
        F.when(F.char_length(s) > 140, F.concat(F.lit("over_140:"), F.char_length(s).cast("string"))),
        F.when((F.char_length(text) >= 20) & F.contains(source, text), "verbatim"), F.when(_long_quote(s, material), "long_copy"),
        *new("audience", AUDIENCE_WORDS), *new("promo", PROMO_WORDS)))
    return F.array_distinct(F.concat(fixed, tokens("number", "[0-9]+", in_corpus), tokens("name", "[ァ-ヶー]{3,}", in_corpus),
                                     tokens("name", r"[A-Za-z][A-Za-z0-9&'.-]{1,}", lambda x: F.contains(F.lower(corpus), F.lower(x))), quotes, truncated))


# Words a grounded summary may use only when the source does.
GROUNDED_WORDS = ("無料", "有料", "夜間", "ナイト", "屋内", "屋外", "夜")


def grounded_summary(summary: Column, corpus: Column, body: Column, limit: int = 140) -> Column:
    """The summary when every checked word is in the corpus, else the head of the body."""
    s = F.coalesce(strip(summary), F.lit(""))
    unsupported = F.lit(False)
    for w in GROUNDED_WORDS:
        unsupported = unsupported | (F.contains(s, F.lit(w)) & ~F.contains(F.coalesce(corpus, F.lit("")), F.lit(w)))
    b = blank_to_null(squeeze(body))
    head = F.when(F.char_length(b) > limit, F.concat(F.substring(b, 1, limit), F.lit("…"))).otherwise(b)
    return F.when((s != "") & ~unsupported, s).otherwise(head)


def body_summary(body: Column) -> Column:
    """A feed description as summary, at most 200 characters."""
    b = blank_to_null(squeeze(body))
    return F.when(F.char_length(b) > 200, F.concat(F.substring(b, 1, 197), F.lit("…"))).otherwise(b)
