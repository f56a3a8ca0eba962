"""Text keys: normalised text, title keys, venue key, bigrams, Dice, excerpts."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white-space set of the source system (spelled so Java and RE2 both read it).
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# Title spelling variants, applied in this order.
KANJI_VARIANTS = (("元氣", "元気"), ("氣", "気"), ("龍神", "竜神"))
# Marks dropped from title keys.
TITLE_QUOTES = "[\"'“”‘’]"
TITLE_DOTS = "[・･·]"
TITLE_BRACKETS = r"[（）()【】\[\]「」『』〈〉<>]"
TITLE_MARKS = r"[!！?？:：;；,，.。/／\\|〜~－—–_-]"
YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"
EDITION = r"第\s*([0-9]+)\s*回"
# Words that do not tell venues apart.
VENUE_BRACKETS = r"[（）()【】\[\]]"
VENUE_NOISE = r"(?i)(周辺|付近|一帯|エリア|会場|駅前|駅周辺|jr|地下鉄|徒歩[0-9]+分)"
VENUE_SEPARATORS = r"[・･·/／、,]"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def nfkc(c: Column) -> Column:
    """Compatibility normal form; Spark has no built-in for it, so one Arrow batch call."""
    return _nfkc(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_text(c: Column) -> Column:
    """Squeezed text, empty becomes null."""
    return blank_to_null(squeeze(c))


def normalize_text(c: Column, ascii_only: bool = False) -> Column:
    """N1. ``ascii_only`` skips the Arrow call where the column is known to hold plain ASCII."""
    out = F.lower(squeeze(c if ascii_only else nfkc(c)))
    for old, new in KANJI_VARIANTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.coalesce(out, F.lit(""))


def title_exact_key(norm: Column) -> Column:
    """N3 over N1 text."""
    out = norm
    for marks in (TITLE_QUOTES, TITLE_DOTS, TITLE_BRACKETS, TITLE_MARKS, WS):
        out = F.regexp_replace(out, marks, "")
    return out


def title_year(norm: Column) -> Column:
    return blank_to_null(F.regexp_extract(norm, YEAR, 1))


def title_edition(norm: Column) -> Column:
    return blank_to_null(F.regexp_extract(norm, EDITION, 1))


def title_core(norm: Column) -> Column:
    """N4 core over N1 text."""
    out = F.regexp_replace(F.regexp_replace(norm, EDITION, " "), "(?:19|20)[0-9]{2}", " ")
    for marks in (TITLE_QUOTES, TITLE_DOTS, TITLE_BRACKETS, TITLE_MARKS, WS):
        out = F.regexp_replace(out, marks, "")
    return out


def venue_key(norm: Column) -> Column:
    """N5 over N1 text."""
    out = F.regexp_replace(norm, VENUE_BRACKETS, " ")
    out = F.regexp_replace(out, VENUE_NOISE, " ")
    out = F.regexp_replace(out, VENUE_SEPARATORS, " ")
    return F.regexp_replace(out, WS, "")


def bigrams(c: Column) -> Column:
    """Bigrams of a text, each followed by how often it occurred before, so the multiset is a set."""
    n = F.char_length(c)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                                       lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    # the occurrence number, read from the prefix before each gram
    return let(grams, lambda all_: F.transform(all_, lambda g, i: F.concat(
        g, F.size(F.filter(F.slice(all_, F.lit(1), i), lambda x: x == g)).cast("string"))))


def string_similarity(a: Column, b: Column, grams_a: Column | None = None, grams_b: Column | None = None) -> Column:
    """J5 on two keys: 1 if equal, containment shortcut, else Dice over bigrams."""
    la, lb = F.char_length(a), F.char_length(b)
    short, long = F.when(la <= lb, a).otherwise(b), F.when(la <= lb, b).otherwise(a)
    ls, ll = F.least(la, lb), F.greatest(la, lb)
    ga = bigrams(a) if grams_a is None else grams_a
    gb = bigrams(b) if grams_b is None else grams_b
    dice = 2.0 * F.size(F.array_intersect(ga, gb)) / (F.size(ga) + F.size(gb))
    return (F.when((la == 0) & (lb == 0), 1.0).when((la == 0) | (lb == 0), 0.0).when(a == b, 1.0)
            .when((ls >= 4) & F.contains(long, short), F.least(F.lit(1.0), 0.88 + ls / ll * 0.12))
            .when(ls < 2, 0.0).otherwise(dice))


def similarity_penalty(year_a: Column, year_b: Column, ed_a: Column, ed_b: Column) -> Column:
    differs = lambda x, y: F.coalesce(x != y, F.lit(False))
    return F.when(differs(ed_a, ed_b), 0.85).otherwise(1.0) * F.when(differs(year_a, year_b), 0.9).otherwise(1.0)


def truncate(c: Column, limit: int) -> Column:
    """Squeezed text of at most ``limit`` characters, the last one an ellipsis when cut."""
    text = squeeze(c)
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def preview(c: Column, limit: int = 40) -> Column:
    text = squeeze(c)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("…")))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for bodies that name it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_match(c: Column, pattern: str) -> Column:
    """Two-valued regex test: a null text never matches."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def first_rule(c: Column, rules) -> Column:
    """Value of the first (pattern, value) whose pattern is found in the text."""
    out = None
    for pattern, value in rules:
        hit = any_match(c, pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out
