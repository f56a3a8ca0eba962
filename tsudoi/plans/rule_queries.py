"""Rule columns over the catalogue, the posts and the pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from tsudoi.functions import canon, classify, dates, feeddates, images, place, text, urls
from tsudoi.functions.dates import day
from tsudoi.plans import sqltext as q
from tsudoi.plans.domain import TODAY
from tsudoi.plans.registry import query

FEED_TODAY = "2026-08-05"
C = F.col


def tags(col: str = "tags"):
    return F.split(C(col), ",")


# ---- keys -----------------------------------------------------------------------------------------
@query("text_keys", f"""SELECT id, {q.norm('title')} AS norm, {q.title_key('title')} AS exact_key, {q.title_core('title')} AS core,
 {q.title_year('title')} AS year, {q.title_edition('title')} AS edition, {q.venue_key('venue')} AS venue_key FROM catalogue""")
def text_keys(t):
    df = t.catalogue.withColumns({"norm": text.normalize_text(C("title")), "nv": text.normalize_text(C("venue"))})
    n = C("norm")
    return df.select("id", "norm", text.title_exact_key(n).alias("exact_key"), text.title_core(n).alias("core"), text.title_year(n).alias("year"),
                     text.title_edition(n).alias("edition"), text.venue_key(C("nv")).alias("venue_key"))


@query("page_url_keys", f"SELECT page_id, {q.url_key('url')} AS url_key FROM pages")
def page_url_keys(t):
    return t.pages.select("page_id", urls.normalize_url(C("url")).alias("url_key"))


@query("source_event_ids", """SELECT seq, coalesce(nullif(regexp_extract(source_url, '/event/ar[0-9]+e([0-9]+)', 1), ''),
 nullif(regexp_extract(source_url, '/event/([0-9]+)/?', 1), '')) AS source_event_id,
 list_filter([nullif(regexp_extract(source_url, '/event/(ar[0-9]+e[0-9]+)/?', 1), ''), nullif(regexp_extract(source_url, '/event/ar[0-9]+e([0-9]+)', 1), '')],
   lambda x: x IS NOT NULL) AS aliases FROM incoming""")
def source_event_ids(t):
    return t.incoming.select("seq", urls.source_event_id(C("source_url")).alias("source_event_id"), urls.id_aliases(C("source_url")).alias("aliases"))


@query("draft_slugs", f"""SELECT seq, concat_ws('-', source_name, coalesce(eid, substr(sha1(concat_ws(':', 'review', source_name, lower(trim({q.nfkc('title')})), yr, source_url)), 1, 12)), yr) AS slug,
 concat('s-', substr(sha1('slug:' || source_url), 1, 8)) AS suffixed
FROM (SELECT *, cast(year(start_date) AS string) AS yr, nullif(regexp_extract(source_url, '/event/ar[0-9]+e([0-9]+)', 1), '') AS eid FROM incoming)""")
def draft_slugs(t):
    return t.incoming.select("seq", canon.draft_slug(C("source_name"), urls.area_event_number(C("source_url")), C("title"), C("start_date"), C("source_url")).alias("slug"),
                             canon.suffixed_slug(F.lit("s"), C("source_url")).alias("suffixed"))


@query("reaction_keys", f"""SELECT post_id, CASE WHEN urls <> '' THEN concat(cast(event_id AS string), '::', {q.url_key('urls')}) END AS reaction_key,
 nullif(regexp_extract(concat('https://x.example.com/u/status/', cast(post_id AS string)), '/status(?:es)?/([0-9]+)', 1), '') AS xid FROM posts""")
def reaction_keys(t):
    return t.posts.select("post_id", urls.reaction_key(C("event_id"), C("urls")).alias("reaction_key"),
                          urls.post_id(F.concat(F.lit("https://x.example.com/u/status/"), C("post_id").cast("string"))).alias("xid"))


@query("excerpts", r"""SELECT doc_id, CASE WHEN length(s) <= 320 THEN s ELSE substr(s, 1, 319) || '…' END AS excerpt,
 CASE WHEN length(s) <= 40 THEN s ELSE substr(s, 1, 40) || '…' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x{00a0}\x{3000}]+', ' ', 'g')) AS s FROM documents)""")
def excerpts(t):
    return t.documents.select("doc_id", text.truncate(C("text"), 320).alias("excerpt"), text.preview(C("text")).alias("preview"))


@query("field_canonical_hash", f"""SELECT id, lower(nullif(trim(area), '')) AS area, trim(regexp_replace({q.nfkc('venue')}, '\\s+', ' ', 'g')) AS venue_store,
 sha256('price_text:' || coalesce('"' || price_text || '"', 'null')) AS price_hash, sha256('is_kids:' || coalesce(cast(is_kids AS string), 'null')) AS kids_hash,
 sha256('category:' || coalesce('[' || list_aggregate(['"' || x || '"' for x in list_sort(list_distinct([trim(y) for y in string_split(category, ',') if trim(y) <> '']))], 'string_agg', ',') || ']', 'null')) AS category_hash
FROM catalogue""")
def field_canonical_hash(t):
    df = t.catalogue.withColumn("tags_", F.split("category", ","))
    h = lambda f, c: canon.proposal_hash(f, canon.canonical_json(f, canon.canonical(f, C(c), "compare")))
    return df.select("id", canon.canonical("area", C("area"), "compare").alias("area"), canon.canonical("venue", C("venue"), "store").alias("venue_store"),
                     h("price_text", "price_text").alias("price_hash"), h("is_kids", "is_kids").alias("kids_hash"), h("category", "tags_").alias("category_hash"))


# ---- place ----------------------------------------------------------------------------------------
H, A, V = (f"coalesce(trim({q.nfkc(c)}), '')" for c in ("area", "address", "venue"))
TOKEN = r"nullif(regexp_extract(a, '(?:東京都|神奈川県|埼玉県|千葉県)?([^\s0-9]{1,10}?[市区])', 1), '')"


def area_sql(named: str) -> str:
    every = f"trim({named} || ' ' || a)"
    return (f"coalesce({q.first(named, place.NEIGHBOURHOODS)}, {q.first('a', place.NEIGHBOURHOODS)}, {q.first(every, place.NEIGHBOURHOODS)}, "
            f"{q.first(named, place.WARDS)}, {q.first(TOKEN, place.WARDS)}, {q.first('a', place.WARDS)})")


def names_sql(col: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {q.has(col, p)} THEN '{s}' END" for p, s in place.EXPLICIT) + "], lambda x: x IS NOT NULL)"


def of_area_sql(col: str) -> str:
    key = f"lower(trim({col}))"
    return f"CASE WHEN {key} = 'tama' THEN NULL WHEN {key} IN ({q.quoted(place.PARENT)}) THEN {q.mapping(key, place.PARENT)} WHEN {key} IN ({q.quoted(place.MUNICIPALITIES)}) THEN {key} END"


INFER = "CASE WHEN len(an) > 0 THEN CASE WHEN len(an) = 1 THEN an[1] END WHEN len(vn) > 0 THEN CASE WHEN len(vn) = 1 THEN vn[1] END ELSE {area} END"
PLACE_CTE = f"""p0 AS (SELECT id, area, {H} AS h, {A} AS a, {V} AS v FROM catalogue),
p1 AS (SELECT *, {names_sql('a')} AS an, {names_sql('v')} AS vn, {TOKEN} AS token,
  CASE WHEN lower(h) IN ({q.quoted(place.AREA_LABELS)}) THEN lower(h) ELSE {area_sql("trim(h || ' ' || v)")} END AS legacy, {area_sql('v')} AS byv FROM p0),
p2 AS (SELECT *, coalesce(CASE WHEN byv IN ({q.quoted(place.PARENT)}) THEN byv END, CASE WHEN legacy IN ({q.quoted(place.PARENT)}) THEN legacy END) AS town,
  coalesce(CASE WHEN byv IN ({q.quoted(place.REVIEW_AREAS)}) THEN byv END, CASE WHEN legacy IN ({q.quoted(place.REVIEW_AREAS)}) THEN legacy END) AS rev FROM p1),
p3 AS (SELECT *, {INFER.format(area=of_area_sql('coalesce(town, legacy, byv)'))} AS m FROM p2)"""


@query("place_rules", f"""WITH {PLACE_CTE} SELECT id, token, m AS municipality, legacy AS legacy_area,
 CASE WHEN town IS NOT NULL THEN CASE WHEN m = {q.mapping('town', place.PARENT)} THEN town END ELSE rev END AS area FROM p3""")
def place_rules(t):
    return place.with_place(t.catalogue).select("id", "place.token", "place.municipality", "place.legacy_area", "place.area")


@query("explicit_municipality", f"""WITH p0 AS (SELECT id, {A} AS a FROM catalogue) SELECT id, len({names_sql('a')}) AS n_named, CASE WHEN len({names_sql('a')}) = 1 THEN ({names_sql('a')})[1] END AS only_named FROM p0""")
def explicit_municipality(t):
    names = place.explicit_municipalities(place.lookup_text(C("address")))
    df = t.catalogue.select("id", names.alias("n"))
    return df.select("id", F.size("n").alias("n_named"), F.when(F.size("n") == 1, C("n")[0]).alias("only_named"))


@query("clean_addresses", """WITH c AS (SELECT id, address AS t, regexp_extract(address, '^(.*?)[・･]\\s*(?:JR|地下鉄|都営|東京メトロ|メトロ|徒歩|京王|小田急|東急|西武|東武|京成|りんかい|ゆりかもめ|つくばエクスプレス|TX)', 1) AS head FROM catalogue)
SELECT id, CASE WHEN head <> '' AND length(head) >= 8 AND regexp_matches(head, '[都道府県市区町村0-9]') AND length(head) >= least(15.0, length(t) * 0.4) THEN head ELSE t END AS address FROM c""")
def clean_addresses(t):
    return t.catalogue.select("id", place.clean_address(C("address")).alias("address"))


def label_sql(col: str) -> str:
    return f"coalesce({q.mapping(f'lower(trim({col}))', place.PLACE_LABELS)}, nullif(trim({col}), ''))"


@query("place_labels", f"""SELECT id, CASE WHEN {label_sql('municipality')} IS NOT NULL AND {label_sql('area')} IS NOT NULL AND {label_sql('municipality')} <> {label_sql('area')}
 THEN {label_sql('municipality')} || '・' || {label_sql('area')} ELSE coalesce({label_sql('municipality')}, {label_sql('area')}) END AS label FROM catalogue""")
def place_labels(t):
    return t.catalogue.select("id", place.place_label(C("municipality"), C("area")).alias("label"))


# ---- price, audience, category ------------------------------------------------------------------
def price_sql(col: str) -> str:
    c = f"regexp_replace({q.nfkc(col)}, '\\s+', '', 'g')"
    free_parts = f"[x for x in string_split_regex(regexp_replace({c}, '^料金[:：]', ''), '[。．]') if x <> '']"
    all_free = f"(len({free_parts}) > 0 AND len([x for x in {free_parts} if NOT regexp_matches(x, '{classify.PRICE_FREE_PART}')]) = 0)"
    yen, paid = q.has(c, classify.PRICE_YEN), q.has(c, "有料")
    side = f"(NOT {q.has(c, classify.PRICE_ENTRY_AMOUNT)} AND ({q.has(c, 'サポーターズシート')} OR {q.has(c, classify.PRICE_SIDE_FEE)}))"
    base = q.has(c, classify.PRICE_FREE_BASE)
    return f"""CASE WHEN coalesce({c}, '') = '' THEN NULL WHEN {q.has(c, classify.PRICE_VARIES)} THEN 'varies' WHEN {q.has(c, '一部有料')} THEN 'partially_paid'
 WHEN {base} AND ({paid} OR {yen} OR {q.has(c, '別途')}) THEN 'partially_paid' WHEN {base} OR {all_free} THEN 'free'
 WHEN {q.has(c, '無料ではな|無料じゃな')} THEN 'paid' WHEN {yen} AND {q.has(c, '内容により異')} THEN NULL WHEN {side} THEN NULL WHEN {yen} OR {paid} THEN 'paid' END"""


@query("price_types", f"SELECT id, {price_sql('price_text')} AS price_type FROM catalogue")
def price_types(t):
    return t.catalogue.select("id", classify.price_type(classify.price_compact(C("price_text"))).alias("price_type"))


def minutes_sql(col: str) -> str:
    h = f"try_cast(regexp_extract({col}, '^([0-9]{{1,2}}):([0-9]{{2}})', 1) AS int)"
    m = f"try_cast(regexp_extract({col}, '^([0-9]{{1,2}}):([0-9]{{2}})', 2) AS int)"
    return f"CASE WHEN {h} <= 23 AND {m} <= 59 THEN {h} * 60 + {m} END"


NIGHT_TEXT = f"regexp_replace(coalesce({q.nfkc('title_ja')}, ''), 'グッドナイト|暗闇', '', 'g')"
NIGHT = f"CASE WHEN {q.has(NIGHT_TEXT, classify.NIGHT_WORDS)} OR coalesce({minutes_sql('start_time')} >= 1020, false) THEN true END"


@query("night_rule", f"""SELECT id, rule AS inferred, CASE WHEN coalesce(rule, false) THEN true WHEN coalesce(is_night, false) THEN NULL ELSE is_night END AS resolved
FROM (SELECT id, is_night, {NIGHT} AS rule FROM catalogue)""")
def night_rule(t):
    df = t.catalogue.withColumn("rule", classify.is_night(text.nfkc(C("title_ja")), C("start_time")))
    return df.select("id", C("rule").alias("inferred"), classify.resolve_night(C("rule"), C("is_night")).alias("resolved"))


def kids_sql(col: str) -> str:
    return (f"CASE WHEN {q.has(col, classify.KIDS_EXCLUDED)} THEN false WHEN "
            f"{q.has(f'regexp_replace({col}, {chr(39)}{classify.KIDS_PRICE}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})', classify.KIDS_TARGETED)} THEN true END")


COMPANION_SQL = "regexp_matches(x, '^(?:(?:子供と|子どもと|こどもと|お子様と|お子さまと|恋人と|夫婦で|友達と|友人と|一人で|両親と|家族で|仲間と)[/／・,、\\s]*)+$')"


@query("kids_rule", f"""WITH j AS (SELECT id, {kids_sql('audience')} AS from_text,
  list_concat([{kids_sql('x')} for x in string_split(tags, ',') if trim(x) <> '' AND NOT {COMPANION_SQL}], [{kids_sql('audience')}]) AS judged FROM catalogue)
SELECT id, from_text, CASE WHEN list_contains(judged, true) THEN true WHEN list_contains(judged, false) THEN false END AS from_tags FROM j""")
def kids_rule(t):
    return t.catalogue.select("id", classify.kids_from_text(C("audience")).alias("from_text"), classify.kids_from_tags(tags(), C("audience")).alias("from_tags"))


@query("indoor_rule", f"""SELECT id, CASE WHEN i <> o THEN i END AS is_indoor FROM (SELECT id, {q.has('venue', classify.INDOOR)} AS i, {q.has('venue', classify.OUTDOOR)} AS o FROM catalogue)""")
def indoor_rule(t):
    return t.catalogue.select("id", classify.is_indoor(C("venue")).alias("is_indoor"))


TAG_LIST = "[trim(x) for x in string_split(tags, ',') if trim(x) <> '']"
MAPPED = f"[x for x in [CASE WHEN {COMPANION_SQL} THEN NULL ELSE {q.first('x', classify.TAG_RULES)} END for x in {TAG_LIST}] if x IS NOT NULL]"


@query("category_mapping", f"""SELECT id, CASE WHEN len(m) = 0 THEN 'other' ELSE list_aggregate(list_sort(list_distinct(m)), 'string_agg', ',') END AS mapped FROM (SELECT id, {MAPPED} AS m FROM catalogue)""")
def category_mapping(t):
    return t.catalogue.select("id", F.array_join(F.array_sort(classify.map_categories(tags())), ",").alias("mapped"))


JOINED = "replace(tags, ',', ' ') || ' ' || coalesce(title_ja, '')"
BUCKETS = "[" + ", ".join(f"CASE WHEN {q.has(JOINED, p)} THEN '{b}' END" for p, b in classify.BUCKETS) + "]"
PRIMARY = f"[x for x in string_split(tags, ',') if x IN ({q.quoted(classify.KNOWN_GENRES)})][1]"


@query("category_buckets", f"""SELECT id, CASE WHEN len(b) > 0 THEN list_aggregate(b, 'string_agg', ',') ELSE {q.first('p', classify.GENRE_FALLBACK, repr('other'))} END AS buckets
FROM (SELECT id, [x for x in {BUCKETS} if x IS NOT NULL] AS b, {PRIMARY} AS p FROM catalogue)""")
def category_buckets(t):
    return t.catalogue.select("id", F.array_join(classify.category_buckets(tags(), C("title_ja")), ",").alias("buckets"))


@query("tag_cleanup", f"""SELECT id, list_aggregate([x for x in list_concat({TAG_LIST}, [trim(x) for x in string_split(municipality || ',港区,8月', ',')])
 if x <> '' AND length(x) <= 40 AND x NOT IN ({q.quoted(classify.TAG_BLOCKLIST)}) AND NOT regexp_matches(x, '^[0-9]+月$')], 'string_agg', '|') AS tags FROM catalogue""")
def tag_cleanup(t):
    extra = F.split(F.concat(C("municipality"), F.lit(",港区,8月")), ",")
    return t.catalogue.select("id", F.nullif(F.array_join(classify.clean_tags(tags(), extra), "|"), F.lit("")).alias("tags"))


# ---- open-data feed --------------------------------------------------------------------------------
HEAD, BLOB = "concat_ws(chr(10), coalesce(title_ja, ''), tags, coalesce(audience, ''))", "concat_ws(chr(10), coalesce(title_ja, ''), tags, coalesce(audience, ''), coalesce(summary, ''))"
CAFE, HARD, INC = q.has(HEAD, "カフェ"), q.has(HEAD, classify.OUTING_HARD_EXCLUDE), q.has(HEAD, classify.OUTING_INCLUDE)
CULT = q.has(HEAD, classify.CAFE_CULTURE)
OUTING = f"""CASE WHEN {CAFE} AND {q.has(BLOB, classify.CAFE_SUPPORT)} THEN 'exclude/support_cafe'
 WHEN {HARD} OR {q.has(BLOB, classify.OUTING_BODY_EXCLUDE)} THEN 'exclude/consultation_or_recruiting'
 WHEN {q.has('title_ja', '相談')} AND NOT {q.has('title_ja', classify.OUTING_INCLUDE)} THEN 'exclude/consultation_title'
 WHEN {CAFE} AND NOT {CULT} THEN 'review/cafe_only' WHEN {q.has(HEAD, '見学')} AND NOT {q.has(HEAD, classify.VISIT_OK)} THEN 'review/visit_only'
 WHEN {CAFE} THEN 'include/culture_cafe' WHEN {q.has(BLOB, classify.OUTING_HARD_EXCLUDE)} AND {INC} THEN 'review/mixed_words'
 WHEN {INC} THEN 'include/outing_words' ELSE 'review/undecided' END"""
FAR, NEAR = "|".join(classify.OUTSIDE_PLACES), "|".join(classify.INSIDE_PLACES)
PLACE_TXT = "concat_ws(chr(10), coalesce(venue, ''), coalesce(summary, ''))"
STATUS = f"""CASE WHEN {q.has(PLACE_TXT, FAR)} THEN 'outside_minato' WHEN {q.has('title_ja', FAR)} AND {q.has(f"concat_ws(chr(10), title_ja, {PLACE_TXT})", NEAR)} THEN 'unknown'
 WHEN {q.has('title_ja', FAR)} THEN 'outside_minato' WHEN {q.has(f"concat_ws(chr(10), title_ja, {PLACE_TXT})", NEAR)} THEN 'minato' ELSE 'unknown' END"""
OUT_W, WEL_W = q.has(BLOB, classify.PUBLISH_WORDS), q.has(BLOB, classify.WELFARE_WORDS)


@query("open_data_rules", f"""SELECT id, {OUTING} AS filter, area_status, CASE WHEN area_status = 'outside_minato' THEN 'outside' WHEN {OUT_W} AND {WEL_W} THEN 'mixed_words'
 WHEN {WEL_W} THEN 'welfare_words' WHEN {OUT_W} AND area_status = 'unknown' THEN 'outing_place_unknown' WHEN {OUT_W} THEN 'outing' ELSE 'undecided' END AS publish_rule
FROM (SELECT *, {STATUS} AS area_status FROM catalogue)""")
def open_data_rules(t):
    df = t.catalogue.withColumns({"f": classify.outing_filter(C("title_ja"), C("tags"), C("audience"), C("summary")),
                                  "area_status": classify.area_status(C("title_ja"), C("venue"), C("summary"))})
    body = F.concat_ws("\n", F.coalesce("audience", F.lit("")), F.coalesce("summary", F.lit("")))
    return df.select("id", F.concat_ws("/", "f.status", "f.rule").alias("filter"), "area_status",
                     classify.publish_candidate(C("area_status"), C("title_ja"), C("tags"), body)["rule"].alias("publish_rule"))


@query("draft_validation", """SELECT seq, CASE WHEN trim(coalesce(title, '')) = '' THEN 'title is required' WHEN trim(coalesce(source_url, '')) = '' THEN 'source_url is required'
 WHEN start_date IS NULL THEN 'start_date is required' WHEN end_date < start_date THEN 'end before start' END AS reason FROM incoming""")
def draft_validation(t):
    from tsudoi.operators.importing import draft_refusal
    return t.incoming.select("seq", draft_refusal(C("title"), C("source_url"), C("start_date").cast("string"), C("end_date").cast("string")).alias("reason"))


# ---- dates of feeds ---------------------------------------------------------------------------------
@query("db_times", """SELECT id, CASE WHEN try_cast(regexp_extract(start_time, '^([0-9]{1,2}):([0-9]{2})(?::[0-9]{2})?$', 1) AS int) <= 23
 THEN lpad(regexp_extract(start_time, '^([0-9]{1,2}):([0-9]{2})(?::[0-9]{2})?$', 1), 2, '0') || ':' || regexp_extract(start_time, '^([0-9]{1,2}):([0-9]{2})', 2) || ':00' END AS start_time,
 strftime(updated_at, '%H:%M:00') AS iso_time FROM catalogue""")
def db_times(t):
    iso = F.concat(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    return t.catalogue.select("id", dates.db_time(C("start_time")).alias("start_time"), dates.time_of_iso(iso).alias("iso_time"))


def expected(col: str, table: dict[str | None, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {col} IS NOT DISTINCT FROM {'NULL' if k is None else repr(k)} THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"


HOURS_EXPECTED = {
    "10:00〜18:00": "'10:00:00/18:00:00/parsed/single_time_range'", "開演 18:30": "'18:30:00/-/parsed/labeled_start_only'",
    "午前10時～午後5時30分": "'10:00:00/17:30:00/parsed/single_time_range'", "平日 10:00〜18:00 土日 9:00〜20:00": "'-/-/keep_null/multiple_time_ranges'",
    None: "'-/-/not_found/empty'", "未定": "'-/-/keep_null/non_specific_schedule'",
    "第1部 10:00〜12:00 第2部 14:00〜16:00": "'-/-/keep_null/multiple_time_ranges'", "10:00 集合": "'-/-/keep_null/single_time_unlabeled'",
    "開始 9:00 終了 17:00": "'09:00:00/17:00:00/parsed/labeled_start_end'",
    "10:00〜18:00（最終日は10:00〜15:00）※荒天中止": "'-/-/keep_null/multiple_time_ranges'", "入場料500円 11:00": "'-/-/not_found/no_clock_token'",
    "9時30分から": "'-/-/keep_null/single_time_unlabeled'",
}


@query("opening_hours", f"SELECT id, {expected('hours', HOURS_EXPECTED)} AS parsed FROM catalogue")
def opening_hours(t):
    df = feeddates.parse_hours(t.catalogue, "hours")
    dash = lambda f: F.coalesce(C(f"hours_parsed.{f}"), F.lit("-"))
    return df.select("id", F.concat_ws("/", dash("start_time"), dash("end_time"), dash("action"), dash("reason")).alias("parsed"))


@query("labelled_hours", r"""SELECT id, list_aggregate([trim(regexp_replace(x, '\s+', ' ', 'g')) for x in regexp_extract_all('開館時間: ' || hours || chr(10) || '開催時刻 ' || hours,
 '(?:開催時間|開館時間|営業時間|開催時刻|開始時間|開演時間|開場時間)\s*[:：]?\s*[^\n]{0,80}')], 'string_agg', ' / ') AS raw FROM catalogue""")
def labelled_hours(t):
    page = F.concat(F.lit("開館時間: "), C("hours"), F.lit("\n開催時刻 "), C("hours"))
    return t.catalogue.select("id", feeddates.labelled_hours(page).alias("raw"))


def md(col: str, i: int) -> str:
    return f"list_extract(regexp_extract_all({col}, '([0-9]{{4}})年([0-9]{{1,2}})月([0-9]{{1,2}})日'), {i})"


def to_day(col: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN cast(try_strptime({col}, '%Y年%m月%d日') AS date) END"


@query("listing_dates", f"""SELECT id, CASE WHEN list_date LIKE '〜%' THEN NULL ELSE {to_day(md('list_date', 1))} END AS start_date,
 CASE WHEN list_date LIKE '〜%' THEN {to_day(md('list_date', 1))} WHEN list_date LIKE '%から' THEN NULL WHEN {md('list_date', 2)} IS NOT NULL THEN {to_day(md('list_date', 2))}
  WHEN list_date LIKE '%〜%' THEN NULL ELSE {to_day(md('list_date', 1))} END AS end_date FROM catalogue""")
def listing_dates(t):
    df = t.catalogue.select("id", feeddates.listing_dates(C("list_date")).alias("d"))
    return df.select("id", "d.start_date", "d.end_date")


PERIOD_DAYS = {"2026年8月1日・2日・9日": "'2026-08-01,2026-08-02,2026-08-09'", "2026年7月30日・31日・1日": "'2026-07-30,2026-07-31,2026-08-01'",
               "2026年8月1日・2日・3日": "'2026-08-01,2026-08-02,2026-08-03'", "2026年12月30日・2日": "'2026-12-30,2027-01-02'",
               "2026年5月3日・6月4日・10日": "'2026-05-03,2026-06-04,2026-06-10'"}
SPLIT_PERIODS = {"2026年8月1日・2日・9日": "DATE '2026-08-09'", "2026年12月30日・2日": "DATE '2026-12-30'", "2026年5月3日・6月4日・10日": "DATE '2026-06-10'"}
JOINED_START = {"2026年7月30日・31日・1日": "DATE '2026-07-30'", "2026年8月1日・2日・3日": "DATE '2026-08-01'"}
JOINED_END = {"2026年7月30日・31日・1日": "DATE '2026-08-01'", "2026年8月1日・2日・3日": "DATE '2026-08-03'"}


@query("schedule_plans", f"""SELECT id, {expected('period', PERIOD_DAYS)} AS days, {expected('period', {**SPLIT_PERIODS, **JOINED_START}, 'start_date')} AS plan_start,
 {expected('period', {**SPLIT_PERIODS, **JOINED_END}, 'CASE WHEN end_date >= start_date THEN end_date ELSE start_date END')} AS plan_end,
 {expected('period', {'2026年8月1日・2日・9日': '3', '2026年12月30日・2日': '2', '2026年5月3日・6月4日・10日': '3'}, '0')} AS n_occurrences FROM catalogue""")
def schedule_plans(t):
    df = feeddates.schedule_plan(t.catalogue, day(FEED_TODAY)).withColumn("days", feeddates.discrete_days(C("period")))
    return df.select("id", F.array_join(F.transform("days", lambda d: d.cast("string")), ",").alias("days"), C("plan.start_date").alias("plan_start"),
                     C("plan.end_date").alias("plan_end"), F.size("plan.occurrences").alias("n_occurrences"))


ODAY = f"DATE '{FEED_TODAY}'"


@query("open_data_dates", f"""WITH parts AS (SELECT id, open_date, len([x for x in string_split(open_date, ',') if trim(x) <> '']) AS n, [x for x in [
  CASE WHEN regexp_full_match(trim(x), '[0-9]{{4}}年[0-9]+月[0-9]+日') THEN CASE WHEN try_strptime(trim(x), '%Y年%m月%d日') IS NOT NULL THEN {{'s': cast(try_strptime(trim(x), '%Y年%m月%d日') AS date), 'e': cast(try_strptime(trim(x), '%Y年%m月%d日') AS date)}} END
       WHEN contains(x, 'から') AND try_strptime(split_part(trim(x), 'から', 1), '%Y年%m月%d日') <= try_strptime(split_part(trim(x), 'から', 2), '%Y年%m月%d日')
         THEN {{'s': cast(try_strptime(split_part(trim(x), 'から', 1), '%Y年%m月%d日') AS date), 'e': cast(try_strptime(split_part(trim(x), 'から', 2), '%Y年%m月%d日') AS date)}} END
  for x in string_split(open_date, ',')] if x IS NOT NULL] AS occ FROM catalogue),
st AS (SELECT *, CASE WHEN open_date IS NULL OR len(occ) = 0 THEN 'unparsed' WHEN n > 1 THEN CASE WHEN len(occ) = n THEN 'multiple' ELSE 'partial' END
  WHEN occ[1].s = occ[1].e THEN 'single' ELSE 'range' END AS date_status FROM parts)
SELECT id, date_status, CASE WHEN date_status IN ('single', 'range') THEN occ[1].s END AS start_date, CASE WHEN date_status IN ('single', 'range') THEN occ[1].e END AS end_date,
 CASE WHEN date_status = 'unparsed' THEN 'unknown' WHEN len([x for x in occ if x.s <= {ODAY} AND x.e >= {ODAY}]) > 0 THEN 'ongoing' WHEN len([x for x in occ if x.s > {ODAY}]) > 0 THEN 'future' ELSE 'ended' END AS lifecycle,
 CASE WHEN date_status <> 'unparsed' THEN list_min([x.s for x in occ if x.e >= {ODAY}]) END AS next_start,
 CASE WHEN date_status <> 'unparsed' THEN CASE WHEN len(occ) = 1 THEN occ[1].s ELSE coalesce(list_min([x.s for x in occ if x.e >= {ODAY}]), occ[1].s) END END AS parent_start FROM st""")
def open_data_dates(t):
    df = t.catalogue.select("id", feeddates.open_data_dates(C("open_date"), F.lit(None).cast("string")).alias("d"))
    occ = C("d.occurrences")
    return df.select("id", "d.date_status", "d.start_date", "d.end_date", feeddates.lifecycle(occ, day(FEED_TODAY)).alias("lifecycle"),
                     feeddates.next_occurrence(occ, day(FEED_TODAY))["start_date"].alias("next_start"),
                     feeddates.parent_dates(occ, day(FEED_TODAY))["start_date"].alias("parent_start"))


# ---- reactions --------------------------------------------------------------------------------------
POST_CLASS = f"""CASE WHEN {q.has('text', classify.POST_EXPERIENCE)} THEN 'experience'
 WHEN {q.has('text', classify.POST_OFFICIAL)} OR {q.has('lower(username)', 'official|公式|staff|主催|_pr$|_info$')} THEN 'official'
 WHEN {q.has('text', classify.MEDIA_WORDS)} OR {q.has('urls', classify.MEDIA_HOSTS)} THEN 'media' ELSE 'other' END"""


@query("post_classes", f"""SELECT post_id, {POST_CLASS} AS class, NOT {q.has('text', classify.POST_EXPERIENCE)} AND {q.has('text', classify.ANNOUNCEMENT)} AS announcement FROM posts""")
def post_classes(t):
    return t.posts.select("post_id", classify.post_class(C("text"), C("username"), F.split("urls", ",")).alias("class"),
                          classify.announcement_heavy(C("text")).alias("announcement"))


EXC = f"""CASE WHEN {q.has('text', classify.EXCERPT_EXPERIENCE)} THEN 'experience'
 WHEN event_type IN ('official_web', 'press_release') OR {q.has('text', classify.EXCERPT_OFFICIAL)} OR {q.has('lower(username)', classify.OFFICIAL_NAMES)} THEN 'official'
 WHEN event_type IN ('news', 'rss') OR {q.has('text', classify.MEDIA_WORDS)} OR {q.has('lower(username)', classify.MEDIA_NAMES)} THEN 'media' ELSE 'other' END"""


@query("excerpt_classes", f"SELECT post_id, {EXC} AS class FROM posts")
def excerpt_classes(t):
    return t.posts.select("post_id", classify.excerpt_class(C("event_type"), C("text"), C("username")).alias("class"))


PERI = f"({q.has('text', classify.PERIPHERAL)} AND NOT {q.has('text', classify.VISIT_CRITICAL)})"
STRIPPED = f"regexp_replace(text, '{classify.TRAVEL_CLAUSES}', '', 'g')"
JOY = f"({q.has('text', classify.BODY_ENJOYMENT)} AND (NOT {PERI} OR {q.has(STRIPPED, classify.BODY_ENJOYMENT)}))"
THEME = (f"CASE WHEN {PERI} OR ({q.has('text', classify.EXCLUDED_TOPICS)} AND NOT {q.has('text', classify.VISIT_CRITICAL)}) THEN 'other' "
         + " ".join(f"WHEN {q.has('text', classify.THEMES[k])} THEN '{k}'" for k in classify.SPECIFIC_THEMES) + f" WHEN {JOY} THEN 'enjoyment' ELSE 'other' END")


@query("reaction_themes", f"SELECT post_id, {PERI} AS peripheral, {JOY} AS enjoyment, {THEME} AS theme FROM posts")
def reaction_themes(t):
    return t.posts.select("post_id", classify.is_peripheral(C("text")).alias("peripheral"), classify.valid_enjoyment(C("text")).alias("enjoyment"),
                          classify.bullet_theme(C("text")).alias("theme"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"


@query("page_source_types", rf"""SELECT page_id, kind, CASE WHEN kind = 'press' THEN 'press_release' WHEN kind = 'rss' THEN 'rss'
 WHEN regexp_matches({HOST}, '{classify.NEWS_HOSTS}') OR kind = 'blog_news' THEN CASE WHEN regexp_matches({HOST}, 'blog|note\.com|medium\.com') THEN 'blog' ELSE 'news' END
 WHEN regexp_matches({HOST}, 'blog|note\.com|medium\.com|hatena') THEN 'blog' WHEN regexp_matches({HOST}, 'press|prtimes|newsrelease') OR regexp_matches(lower(url), '/press/') THEN 'press_release' ELSE 'other_web' END AS source_type
FROM (SELECT *, CASE WHEN regexp_matches(lower(url), '(\.xml|/feed/?|/rss/?|atom)') THEN 'rss' WHEN regexp_matches(lower(url), 'press|prtimes|newsrelease') THEN 'press'
 WHEN regexp_matches(lower(url), 'blog|note\.com|medium\.com') THEN 'blog_news' ELSE 'extra_url' END AS kind FROM pages)""")
def page_source_types(t):
    df = t.pages.withColumn("kind", classify.candidate_kind(C("url")))
    return df.select("page_id", "kind", classify.web_source_type(C("url"), C("kind"), F.lit("html"), F.lit(False)).alias("source_type"))


# ---- URLs and images ------------------------------------------------------------------------------
@query("page_url_safety", r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'invalid_url' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme_not_http(s)'
 WHEN regexp_matches(url, '^[a-z]+://[^/?#]*@') THEN 'userinfo_not_allowed' WHEN regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1) = '' THEN 'missing_host'
 WHEN lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) IN ('localhost', 'metadata', 'metadata.google.internal') THEN 'blocked_hostname'
 WHEN regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '\.(local|internal|localhost)$') THEN 'blocked_hostname_tld' END AS refusal,
 coalesce(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '') LIKE '%example.com', false) AS same_site FROM pages""")
def page_url_safety(t):
    return t.pages.select("page_id", urls.url_refusal(C("url")).alias("refusal"), urls.same_site(C("url"), F.lit("https://example.com/a")).alias("same_site"))


@query("image_urls", r"""SELECT id, CASE WHEN image_url IS NULL THEN NULL WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN NULL WHEN id % 5 = 2 THEN image_url
 WHEN id % 5 = 3 THEN 'https://feed.example.com/pics/' || cast(id AS string) || '.png' ELSE 'https://cdn.example.com/' || cast(id AS string) END AS image FROM catalogue""")
def image_urls(t):
    raw = (F.when(C("image_url").isNull(), None).when(C("id") % 5 == 0, F.concat(F.lit("/assets/img/logo/"), C("id").cast("string"), F.lit(".png")))
           .when(C("id") % 5 == 1, F.concat(F.lit("https://img.example.com/"), C("id").cast("string"), F.lit(".svg"))).when(C("id") % 5 == 2, C("image_url"))
           .when(C("id") % 5 == 3, F.concat(F.lit("/pics/"), C("id").cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("//cdn.example.com/"), C("id").cast("string"))))
    return t.catalogue.select("id", images.meta_image(raw, C("source_url")).alias("image"))


ALIASES = {n: s for s, names in images.IMAGE_SLUGS.items() for n in names}
SLUGS = f"[{q.mapping('lower(trim(x))', ALIASES)} for x in string_split(category, ',')]"
BEST = "CASE " + " ".join(f"WHEN list_contains(s, '{p}') THEN '{p}'" for p in images.SLUG_PRIORITY) + " ELSE 'generic' END"
COUNT = f"cast({q.mapping('slug_', images.VARIANTS, repr('1'))} AS int)"


@query("display_images", f"""SELECT id, kind, CASE kind WHEN 'external' THEN image_url WHEN 'generated' THEN generated_image_url ELSE '/images/event-categories/' || slug_ ||
 CASE WHEN id % {COUNT} > 0 THEN '-' || cast(id % {COUNT} + 1 AS string) ELSE '' END || '.webp' END AS src,
 CASE WHEN image_usage_status IN ('licensed', 'organizer_granted', 'own') THEN image_url END AS public_image
FROM (SELECT *, {BEST} AS slug_, CASE WHEN image_usage_status IN ('licensed', 'organizer_granted', 'own') AND image_url IS NOT NULL THEN 'external'
 WHEN generated_image_status = 'approved' AND generated_image_url <> '' THEN 'generated' WHEN {BEST} = 'generic' THEN 'generic' ELSE 'category' END AS kind
FROM (SELECT *, {SLUGS} AS s FROM catalogue))""")
def display_images(t):
    df = t.catalogue.withColumn("img", images.display_image(C("id"), C("image_url"), C("image_usage_status"), C("generated_image_url"),
                                                            C("generated_image_status"), F.split("category", ",")))
    return df.select("id", "img.kind", "img.src", images.public_image(C("image_url"), C("image_usage_status")).alias("public_image"))


@query("review_warnings", """SELECT id, CASE WHEN category = '' OR n <= 0 THEN false ELSE true END AS category_replaced,
 length(price_text) >= 8 AND 2 < length(price_text) * 0.65 AS price_shortened
FROM (SELECT id, category, price_text, len([x for x in list_distinct([trim(y) for y in string_split(category, ',') if trim(y) <> '']) if x <> 'food']) AS n FROM catalogue)""")
def review_warnings(t):
    j = lambda c: F.to_json(F.filter(F.split(c, ","), lambda x: x != ""))
    df = t.catalogue.select("id", F.array_contains(canon.review_warnings(F.lit("category"), j("category"), F.lit('["food"]')), "category_replaced").alias("category_replaced"),
                            F.when(C("price_text").isNotNull(), F.array_contains(canon.review_warnings(
                                F.lit("price_text"), F.concat(F.lit('"'), C("price_text"), F.lit('"')), F.lit('"有料"')), "price_text_shortened")).alias("price_shortened"))
    return df


@query("english_titles", r"""SELECT doc_id, t, length(t) BETWEEN 3 AND 200 AND len(regexp_extract_all(t, '[A-Za-z]')) >= 4
 AND len(regexp_extract_all(t, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]')) <= greatest(2, floor(len(regexp_extract_all(t, '[A-Za-z]')) * 0.35)) AS english
FROM (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[\s\x{00a0}\x{3000}]+', ' ', 'g')) AS t FROM documents)""")
def english_titles(t):
    line = F.substring_index("text", "\n", 1)
    return t.documents.select("doc_id", text.squeeze(line).alias("t"), classify.looks_english(line).alias("english"))
