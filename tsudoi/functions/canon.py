"""Canonical field values, canonical JSON, proposal hashes, slugs, review warnings."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsudoi.functions.dates import db_time
from tsudoi.functions.place import clean_address
from tsudoi.functions.text import blank_to_null, nfkc, normalize_text, squeeze, strip, venue_key
from tsudoi.functions.urls import normalize_url

# Allowed words of the enum fields.
PRICE_TYPES = ("free", "partially_paid", "paid", "varies")
RESERVATION_STATUSES = ("required", "recommended", "not_required", "unknown")
VENUE_TYPES = ("indoor", "outdoor", "mixed", "unknown")
FRIENDLY = ("yes", "no", "unknown")
PARKING_STATUSES = ("available", "not_available", "nearby", "unknown")

# The reviewable fields and the kind of value each holds.
FIELD_KINDS = {
    "start_date": "date", "end_date": "date", "start_time": "time", "end_time": "time", "venue": "venue", "area": "slug", "address": "address",
    "price_text": "text", "summary": "text", "price_type": PRICE_TYPES, "is_kids": "bool", "is_indoor": "bool", "is_night": "bool",
    "price_min": "int", "price_max": "int", "category": "tags", "official_url": "url", "reservation_status": RESERVATION_STATUSES,
    "reservation_url": "url", "nearest_station": "text", "access_text": "text", "walk_minutes": "int", "latitude": "number", "longitude": "number",
    "venue_type": VENUE_TYPES, "family_friendly": FRIENDLY, "date_friendly": FRIENDLY, "solo_friendly": FRIENDLY, "rain_friendly": FRIENDLY,
    "age_note": "text", "duration_minutes_min": "int", "duration_minutes_max": "int", "parking_status": PARKING_STATUSES, "parking_text": "text",
}
REVIEWABLE = tuple(FIELD_KINDS)


def tidy_lines(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t\x{00a0}]+", " ")
    return blank_to_null(strip(F.regexp_replace(text, "\n{3,}", "\n\n")))


def canonical(field: str, value: Column, form: str) -> Column:
    """One field's value in the 'store' or the 'compare' form (both typed, null when unusable)."""
    kind = FIELD_KINDS[field]
    text = value if kind == "tags" else value.cast("string")
    if isinstance(kind, tuple):
        word = strip(text)
        return F.when(word.isin(*kind), word)
    if kind == "date":
        return F.try_to_date(F.regexp_extract(strip(text), "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd").cast("string")
    if kind == "time":
        return db_time(text)
    if kind == "venue":
        return blank_to_null(venue_key(normalize_text(text)) if form == "compare" else squeeze(nfkc(text)))
    if kind == "slug":
        return blank_to_null(F.lower(strip(text)))
    if kind == "address":
        clean = clean_address(text)
        return F.lower(clean) if form == "compare" else clean
    if kind == "text":
        return tidy_lines(text)
    if kind == "bool":
        return text.try_cast("boolean")
    if kind == "int":
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.cast("long"))
    if kind == "number":
        return text.try_cast("double")
    if kind == "tags":
        tags = F.array_sort(F.array_distinct(F.filter(F.transform(value, strip), lambda t: t != "")))
        return F.when(F.size(tags) > 0, tags)
    return normalize_url(text) if form == "compare" else blank_to_null(strip(text))


def canonical_json(field: str, value: Column) -> Column:
    """A canonical value as JSON text; null stays null."""
    kind = FIELD_KINDS[field]
    if kind in ("bool", "int"):
        return value.cast("string")
    if kind == "number":
        return F.regexp_replace(value.cast("string"), r"\.0$", "")
    if kind == "tags":
        return F.to_json(value)
    # a one-field struct quotes and escapes the text; the wrapper is cut off again
    return F.when(value.isNotNull(), F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1"))


def proposal_hash(field: str | Column, compare_json: Column) -> Column:
    """SHA-256 of 'field:json'."""
    name = F.lit(field) if isinstance(field, str) else field
    return F.sha2(F.concat(name, F.lit(":"), F.coalesce(compare_json, F.lit("null"))), 256)


def draft_slug(source: Column, event_id: Column, title: Column, start: Column, url: Column, seed: str = "review") -> Column:
    """{source}-{feed id}-{year}, else a SHA-1 prefix of the title."""
    year = F.year(start).cast("string")
    digest = F.substring(F.sha1(F.concat_ws(":", F.lit(seed), source, F.lower(strip(nfkc(title))), year, url)), 1, 12)
    return F.concat_ws("-", source, F.coalesce(event_id, digest), year)


def suffixed_slug(slug: Column, url: Column, seed: str = "slug") -> Column:
    """The slug used when another URL already owns the plain one."""
    return F.concat(slug, F.lit("-"), F.substring(F.sha1(F.concat(F.lit(seed + ":"), url)), 1, 8))


# Fields whose change is always flagged.
SENSITIVE = ("title", "start_date", "end_date", "official_url", "category", "price_type", "reservation_status", "family_friendly",
             "venue_type", "latitude", "longitude")


def review_warnings(field: Column, current_json: Column, proposed_json: Column) -> Column:
    """Codes of the warnings shown beside a proposal."""
    tags = lambda c: F.filter(F.transform(F.from_json(c, "array<string>"), strip), lambda t: t != "")
    words = lambda c: F.coalesce(strip(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")), F.lit(""))
    cur, new = F.when(field == "category", tags(current_json)), F.when(field == "category", tags(proposed_json))
    same = (F.size(F.array_except(cur, new)) == 0) & (F.size(F.array_except(new, cur)) == 0)
    replaced = (F.size(cur) > 0) & (F.size(new) > 0) & ~same & ((F.size(new) <= F.size(cur)) | (F.size(F.array_except(cur, new)) > 0))
    lc, ln = F.char_length(words(current_json)), F.char_length(words(proposed_json))
    shorter = (lc >= 8) & (ln > 0) & (ln < lc) & (ln < lc * 0.65)
    return F.array_compact(F.array(F.when(field.isin(*SENSITIVE), "sensitive_field"),
                                   F.when((field == "category") & replaced, "category_replaced"),
                                   F.when((field == "price_text") & shorter, "price_text_shortened")))
