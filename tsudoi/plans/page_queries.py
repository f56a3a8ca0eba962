"""Page jobs over the raw pages and over detail pages built from the catalogue."""
from __future__ import annotations

from pyspark.sql import functions as F

from tsudoi.functions import classify
from tsudoi.operators import lookups, pages, reactions, summaries
from tsudoi.plans import sqltext as q
from tsudoi.plans.registry import query
from tsudoi.plans.rule_queries import md, to_day

C = F.col
TAGLESS = r'''trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
 '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{{00a0}}\x{{3000}}]+', ' ', 'g'))'''


@query("page_plain_text", f"SELECT page_id, {TAGLESS.format(h='html')} AS text FROM pages")
def page_plain_text(t):
    return t.pages.select("page_id", pages.strip_tags(C("html")).alias("text"))


TITLE = TAGLESS.format(h=r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")
BODY = TAGLESS.format(h=r"regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)")


@query("page_metadata", f"""SELECT page_id, nullif(title, '') AS title, CASE WHEN length(b) <= 400 THEN b ELSE substr(b, 1, 399) || '…' END AS excerpt
FROM (SELECT page_id, {TITLE} AS title, coalesce(nullif({BODY}, ''), {TITLE}) AS b FROM pages)""")
def page_metadata(t):
    return pages.page_metadata(t.pages).select("page_id", "title", "excerpt")


@query("event_page_metadata", """SELECT id AS page_id, CASE WHEN id % 3 = 0 THEN title ELSE title || ' | Feed' END AS title, summary AS description, 'https://feed.example.com/event/' || cast(id AS string) AS canonical FROM catalogue""")
def event_page_metadata(t):
    return pages.page_metadata(t.event_pages).select("page_id", "title", "description", "canonical")


@query("json_ld_nodes", "SELECT id AS page_id, cast(CASE WHEN id % 4 = 3 THEN 2 ELSE 1 END AS bigint) AS n, title AS first_event FROM catalogue WHERE id % 4 <> 0")
def json_ld_nodes(t):
    nodes = pages.json_ld_nodes(t.event_pages)
    ev = pages.event_nodes(nodes).select("page_id", F.try_variant_get("node", "$.name", "string").alias("first_event"))
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).join(ev, "page_id")


PRICED = "CASE WHEN size % 3 = 0 THEN NULL WHEN size % 7 = 0 THEN cast(size * 100 AS string) || ' USD' ELSE cast(size * 100 AS string) || '円' END"


@query("json_ld_fields", f"""SELECT id AS page_id, title, start_date, end_date, '10:00:00' AS start_time, venue, nullif(trim(address), '') AS address, {PRICED} AS price_text, image_url FROM catalogue WHERE id % 4 <> 0""")
def json_ld_fields(t):
    f = pages.json_ld_fields(pages.json_ld_nodes(t.event_pages), t.event_pages)
    return f.select("page_id", "title", "start_date", "end_date", "start_time", "venue", "address", "price_text", "image_url")


PRICE_OK = rf"regexp_matches(price_text, '{pages.PRICE_VALUE}') AND length(price_text) BETWEEN 2 AND 180"


@query("labelled_facts", f"""SELECT id AS page_id, 'price' AS field, price_text AS value FROM catalogue WHERE {PRICE_OK}
UNION ALL SELECT id, 'address', trim('〒100-0001 ' || coalesce(address, '')) FROM catalogue UNION ALL SELECT id, 'period', list_date FROM catalogue WHERE list_date IS NOT NULL""")
def labelled_facts(t):
    return pages.labelled_facts(pages.labelled_pairs(t.event_pages)).select("page_id", "field", "value")


LD_OK = "id % 4 <> 0"
LSTART = f"CASE WHEN list_date LIKE '〜%' THEN NULL ELSE {to_day(md('list_date', 1))} END"


@query("detail_records", f"""SELECT id AS page_id, CASE WHEN {LD_OK} THEN title ELSE title_ja END AS title, cast(CASE WHEN {LD_OK} THEN start_date ELSE {LSTART} END AS string) AS start_date,
 CASE WHEN {LD_OK} THEN coalesce({PRICED}, CASE WHEN {PRICE_OK} THEN price_text END) ELSE CASE WHEN {PRICE_OK} THEN price_text END END AS price_text,
 CASE WHEN {LD_OK} THEN 'jsonld.title' ELSE 'h1.title' END AS title_source FROM catalogue""")
def detail_records(t):
    d = pages.detail_records(t.event_pages)
    return d.select("page_id", "title", "start_date", "price_text", F.try_element_at("field_sources", F.lit("title")).alias("title_source"))


@query("listing_cards", f"""SELECT id, title, 'https://feed.example.com/event/ar1e' || cast(id AS string) || '/' AS detail_url, nullif(trim(area), '') AS area, {LSTART} AS start_date FROM catalogue""")
def listing_cards(t):
    # the cards of one brand make up one list page
    page = t.event_cards.select(C("id").alias("page_id"), F.lit("https://feed.example.com/list/").alias("url"), F.concat(F.lit("<html><body><ul>"), "card", "card", F.lit("</ul></body></html>")).alias("html"))
    cards = pages.listing_cards(page, r"/event/ar\d+e\d+")
    return cards.select(C("page_id").alias("id"), "title", "detail_url", "area", "start_date")


@query("listing_dedup", "SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def listing_dedup(t):
    p = t.pages.withColumn("u", F.substring_index("url", "?", 1))
    return lookups.first_listed(p, "u", ["page_id"]).select("url", "page_id")


@query("html_images", """SELECT id AS page_id, 'https://feed.example.com/spot/ex' || cast(id AS string) || '/a.jpg' AS image_url, 10 + 50 + 10 + 5 + CASE WHEN size * 10 >= 200 THEN 15 WHEN size * 10 >= 100 THEN 5 ELSE 0 END AS score
FROM catalogue WHERE size * 10 >= 48""")
def html_images(t):
    return pages.best_html_image(t.event_pages).select("page_id", "image_url", "score")


@query("event_images", """SELECT id AS page_id, CASE WHEN id % 4 <> 0 AND image_url IS NOT NULL THEN image_url WHEN id % 5 = 0 THEN 'https://feed.example.com/ogp/' || cast(id AS string) || '.png'
 WHEN size * 10 >= 48 THEN 'https://feed.example.com/spot/ex' || cast(id AS string) || '/a.jpg' END AS image_url,
 CASE WHEN id % 4 <> 0 AND image_url IS NOT NULL THEN 'jsonld' WHEN id % 5 = 0 THEN 'og:image' WHEN size * 10 >= 48 THEN 'html' END AS source FROM catalogue""")
def event_images(t):
    return pages.event_images(t.event_pages)


H1 = TAGLESS.format(h=r"regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")
CLEAN = r"trim(regexp_replace({x}, '\s*[|｜–—].*$', ''))"


@query("english_title_choice", None)
def english_title_choice(t):
    return reactions.english_title_choice(pages.english_title_candidates(t.pages)).select("page_id", "title", "source")


PROPS = """SELECT id, 'price_type' AS field, CASE WHEN size % 3 = 0 THEN 'free' ELSE 'paid' END AS value FROM o UNION ALL SELECT id, 'price_min', CASE WHEN size % 3 = 0 THEN '0' ELSE cast(size * 100 AS string) END FROM o
UNION ALL SELECT id, 'price_max', CASE WHEN size % 3 = 0 THEN '0' ELSE cast(size * 100 AS string) END FROM o UNION ALL SELECT id, 'reservation_url', 'https://tickets.example.com/' || cast(id AS string) FROM o"""


@query("visit_facts_json_ld", f"WITH o AS (SELECT id, size FROM catalogue WHERE id % 4 <> 0 AND size % 7 <> 0) SELECT id AS page_id, field, value FROM ({PROPS})")
def visit_facts_json_ld(t):
    p = pages.visit_facts_json_ld(pages.json_ld_nodes(t.event_pages))
    return p.select("page_id", "field", "value")


VISIT = """SELECT id, 'venue_type' AS field, CASE size % 4 WHEN 0 THEN 'indoor' WHEN 1 THEN 'outdoor' ELSE 'mixed' END AS value, 'high' AS confidence FROM v WHERE size % 4 < 3
UNION ALL SELECT id, 'price_type', CASE size % 3 WHEN 0 THEN 'free' ELSE 'paid' END, 'high' FROM v WHERE size % 3 = 0 OR (size % 3 = 1 AND size * 100 >= 100)
UNION ALL SELECT id, 'price_min', CASE WHEN size % 3 = 0 THEN '0' WHEN size * 50 >= 100 THEN cast(size * 50 AS string) ELSE cast(size * 100 AS string) END, CASE WHEN size % 3 = 0 THEN 'high' ELSE 'medium' END FROM v WHERE size % 3 < 2
UNION ALL SELECT id, 'price_max', CASE WHEN size % 3 = 0 THEN '0' ELSE cast(size * 100 AS string) END, CASE WHEN size % 3 = 0 THEN 'high' ELSE 'medium' END FROM v WHERE size % 3 < 2
UNION ALL SELECT id, 'reservation_status', CASE size % 5 WHEN 0 THEN 'required' WHEN 1 THEN 'not_required' ELSE 'recommended' END, 'high' FROM v WHERE size % 5 < 3
UNION ALL SELECT id, 'nearest_station', CASE size % 4 WHEN 1 THEN '上野駅' ELSE '銀座駅' END, CASE size % 4 WHEN 1 THEN 'medium' ELSE 'high' END FROM v WHERE size % 4 IN (1, 2)
UNION ALL SELECT id, 'walk_minutes', cast(size AS string), 'high' FROM v WHERE size % 4 IN (1, 2)
UNION ALL SELECT id, 'rain_friendly', CASE size % 6 WHEN 0 THEN 'no' ELSE 'yes' END, CASE size % 6 WHEN 0 THEN 'high' ELSE 'medium' END FROM v WHERE size % 6 = 0 OR (size % 6 = 1 AND size % 4 = 0)
UNION ALL SELECT id, 'duration_minutes_min', cast(size AS string), 'high' FROM v WHERE size % 7 < 2 UNION ALL SELECT id, 'duration_minutes_max', cast(CASE size % 7 WHEN 0 THEN size * 2 ELSE size END AS string), 'high' FROM v WHERE size % 7 < 2
UNION ALL SELECT id, 'parking_status', CASE size % 8 WHEN 0 THEN 'not_available' WHEN 1 THEN 'available' ELSE 'nearby' END, 'high' FROM v WHERE size % 8 < 3
UNION ALL SELECT id, 'family_friendly', 'yes', CASE size % 9 WHEN 0 THEN 'high' ELSE 'medium' END FROM v WHERE size % 9 < 2 UNION ALL SELECT id, 'date_friendly', 'yes', 'high' FROM v WHERE size % 9 = 2"""
VFIELDS = ("venue_type", "price_type", "price_min", "price_max", "reservation_status", "nearest_station", "walk_minutes", "rain_friendly", "duration_minutes_min", "duration_minutes_max",
           "parking_status", "family_friendly", "date_friendly")


@query("visit_facts_text", f"WITH v AS (SELECT id, size FROM visit_texts) SELECT * FROM ({VISIT})")
def visit_facts_text(t):
    return pages.visit_facts_text(t.visit_texts, "id").where(C("field").isin(*VFIELDS)).select("id", "field", "value", "confidence")


@query("evidence_excerpts", f"""SELECT id, list_aggregate(list_slice(CASE WHEN len(h) > 0 THEN h ELSE f END, 1, 80), 'string_agg', chr(10)) AS excerpt FROM (SELECT id, f, [x for x in f if regexp_matches(x, '{pages.EVIDENCE_WORDS}')] AS h
 FROM (SELECT id, [trim(x) for x in string_split(text, chr(10)) if length(trim(x)) BETWEEN 4 AND 240] AS f FROM visit_texts))""")
def evidence_excerpts(t):
    return t.visit_texts.select("id", F.nullif(pages.evidence_excerpt(C("text")), F.lit("")).alias("excerpt"))


@query("model_proposal_guard", """SELECT id AS event_id, 'reservation_status' AS field, CASE WHEN size % 3 = 0 THEN 'low' ELSE 'medium' END AS confidence FROM visit_texts WHERE contains(text, '予約優先')""")
def model_proposal_guard(t):
    v = t.visit_texts.select(C("id").alias("event_id"), C("text").alias("excerpt"), "size")
    props = v.select("event_id", F.explode(F.array(
        F.struct(F.lit("reservation_status").alias("field"), F.lit("recommended").alias("value"), F.lit("予約 優先").alias("evidence")),
        F.struct(F.lit("title").alias("field"), F.lit("x").alias("value"), F.lit("イベント").alias("evidence")),
        F.struct(F.lit("venue_type").alias("field"), F.lit("unknown").alias("value"), F.lit("イベント").alias("evidence")))).alias("p"),
        F.when(C("size") % 3 == 0, "odd").when(C("size") % 3 == 1, "high").otherwise("medium").alias("confidence")).select("event_id", "p.*", "confidence")
    return summaries.guard_model_proposals(props, v.select("event_id", "excerpt")).select("event_id", "field", "confidence")


@query("summary_material", """SELECT id, CASE WHEN length(m) >= 24 THEN m END AS material, c AS incomplete FROM (SELECT id, title_ja || 'を楽しめる' || coalesce(audience, '催し') || '。毎年多くの方が訪れる恒例の行事です。' AS m,
 CASE WHEN size % 2 = 0 THEN '続きは公式...' ELSE '' END AS c FROM catalogue)""")
def summary_material(t):
    body = F.concat(C("title"), F.lit("のイベント情報です。 "), C("title_ja"), F.lit("を楽しめる"), F.coalesce("audience", F.lit("催し")), F.lit("。東京都の天気は晴れ。料金は無料です。毎年多くの方が訪れる恒例の行事です。"),
                    F.when(C("size") % 2 == 0, "続きは公式…").otherwise(""))
    return t.catalogue.select("id", summaries.summary_material(body).alias("material"), summaries.incomplete_notes(body).alias("incomplete"))


@query("summary_acceptance", """SELECT id, CASE id % 5 WHEN 0 THEN 'added:おすすめ' WHEN 1 THEN 'missing:開館' WHEN 2 THEN NULL WHEN 3 THEN 'length ' || cast(len AS string) ELSE 'too_close_to_source' END AS reason
FROM (SELECT id, 145 + length(title_ja) AS len FROM catalogue)""")
def summary_acceptance(t):
    material = F.concat(C("title_ja"), F.when(C("id") % 5 == 1, "開館記念").otherwise(""), F.lit("の催しを会場全体で行い、来場者が順番に作品を見て回る行事です。"))
    summary = (F.when(C("id") % 5 == 0, "おすすめの行事").when(C("id") % 5 == 1, "記念の行事").when(C("id") % 5 == 2, F.concat("title_ja", F.lit("を紹介")))
               .when(C("id") % 5 == 3, F.concat("title_ja", F.repeat(F.lit("あ"), 145))).otherwise(material))
    return t.catalogue.select("id", summaries.summary_refusal(summary, material, F.lit("題")).alias("reason"))


@query("summary_review_flags", """SELECT id, list_aggregate(list_sort(CASE id % 3 WHEN 0 THEN ['number:' || cast(size + 100 AS string), 'promo:人気'] WHEN 1 THEN ['audience:家族', 'promo:必見'] ELSE ['quote:夜空', 'name:ABC'] END), 'string_agg', '|') AS flags FROM catalogue""")
def summary_review_flags(t):
    s = (F.when(C("id") % 3 == 0, F.concat(F.lit("人気の催し"), (C("size") + 100).cast("string"))).when(C("id") % 3 == 1, "必見、家族の催し").otherwise("「夜空」とABC"))
    flags = summaries.review_flags(F.lit("題"), F.lit("催しです。"), F.lit(""), s)
    return t.catalogue.select("id", F.array_join(F.array_sort(flags), "|").alias("flags"))


@query("grounded_summaries", """SELECT id, CASE WHEN title_ja LIKE '%ナイト%' THEN 'ナイトの催し' ELSE summary END AS grounded, CASE WHEN length(summary) > 200 THEN substr(summary, 1, 197) || '…' ELSE summary END AS body FROM catalogue""")
def grounded_summaries(t):
    return t.catalogue.select("id", summaries.grounded_summary(F.lit("ナイトの催し"), C("title_ja"), C("summary")).alias("grounded"), summaries.body_summary(C("summary")).alias("body"))


@query("proposal_routing", """WITH p AS (SELECT l_orderkey AS event_id, l_returnflag AS field, arg_max(l_quantity, l_linenumber * 1000000 + l_partkey) AS value, max(l_discount) AS d FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_orderkey AS event_id, l_returnflag AS field, arg_min(l_quantity, l_linenumber * 1000000 + l_partkey) AS cur FROM lineitem WHERE l_tax > 0.02 GROUP BY 1, 2)
SELECT event_id, field, CASE WHEN d < 0.03 THEN 'skip_low' WHEN cur = value THEN 'skip_same' WHEN cur IS NOT NULL THEN 'review' WHEN d >= 0.06 THEN 'apply_draft_and_review' ELSE 'review' END AS route FROM p LEFT JOIN c USING (event_id, field)""")
def proposal_routing(t):
    # of line items with one number the first of the file counts, as in the SQL's aggregates
    seq, place = C("l_linenumber") * 1000000 + C("l_partkey"), ("_metadata.file_name", "_metadata.row_index")
    li = t.lineitem.select("*", *place).withColumnsRenamed({"l_orderkey": "event_id", "l_returnflag": "field"})
    first = lambda order: F.min_by(C("l_quantity"), F.when(order.isNotNull() & C("l_quantity").isNotNull(), F.struct(order.alias("o"), "file_name", "row_index"))).cast("string").alias("value")
    best = li.groupBy("event_id", "field").agg(first(-seq), F.max("l_discount").alias("d")).withColumn(
        "confidence", F.when(C("d") < 0.03, "low").when(C("d") >= 0.06, "high").otherwise("medium"))
    cur = li.where(C("l_tax") > 0.02).groupBy("event_id", "field").agg(first(seq))
    return summaries.route_proposals(best, cur).select("event_id", "field", "route")
