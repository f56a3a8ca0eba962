"""Exports, feeds, reaction guard and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from tsudoi.functions import classify
from tsudoi.operators import export, guard, lookups, reactions, state
from tsudoi.plans.registry import query
from tsudoi.plans.schedule_queries import clock_sql
from tsudoi.sources import readers

C = F.col


def pick(col, *values):
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(C(col) % len(values) == i, v).otherwise(out)
    return out


def attributes(t):
    """Catalogue rows with visit attributes picked by size."""
    return t.catalogue.withColumns({
        "venue_type": pick("size", "indoor", "outdoor", None, "unknown", "mixed"), "family_friendly": pick("size", "yes", "no", None, "unknown"), "date_friendly": pick("size", "yes", None, "no"),
        "solo_friendly": pick("size", None, "yes"), "rain_friendly": pick("size", "unknown", "yes", None, "no"), "reservation_status": pick("size", "required", "recommended", "not_required", "unknown", None),
        "walk_minutes": F.when(C("size") % 3 != 0, C("size") % 20), "parking_status": pick("size", "available", "not_available", "nearby", None), "price_min": F.when(C("size") % 4 != 0, C("size") * 100),
        "price_max": F.when(C("size") % 4 > 1, C("size") * 100 * (C("size") % 2 + 1)), "nearest_station": F.when(C("size") % 2 == 0, "上野駅"),
        "access_text": F.when(C("size") % 5 == 0, "バス停すぐ").otherwise(F.concat(F.lit("上野駅から徒歩約"), (C("size") % 20).cast("string"), F.lit("分"))), "parking_text": F.lit(None).cast("string"),
        "duration_minutes_min": F.when(C("size") % 2 == 0, C("size")), "duration_minutes_max": F.when(C("size") % 3 == 0, C("size") * 2), "age_note": F.lit(" ")})


def case(*values):
    return f"CASE size % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


ATTR = f"""att AS (SELECT *, {case('indoor', 'outdoor', None, 'unknown', 'mixed')} AS venue_type, {case('yes', 'no', None, 'unknown')} AS ff, {case('yes', None, 'no')} AS df, {case(None, 'yes')} AS sf, {case('unknown', 'yes', None, 'no')} AS rf,
 {case('required', 'recommended', 'not_required', 'unknown', None)} AS rs, CASE WHEN size % 3 <> 0 THEN size % 20 END AS wm, {case('available', 'not_available', 'nearby', None)} AS ps, CASE WHEN size % 4 <> 0 THEN size * 100 END AS pmin,
 CASE WHEN size % 4 > 1 THEN size * 100 * (size % 2 + 1) END AS pmax FROM catalogue)"""
TAGS = """[x for x in [CASE WHEN venue_type IN ('indoor', 'outdoor', 'mixed') THEN CASE venue_type WHEN 'indoor' THEN '屋内' WHEN 'outdoor' THEN '屋外' ELSE '屋内・屋外' END WHEN is_indoor THEN '屋内' END,
 CASE WHEN ff = 'yes' THEN '家族で楽しむ' WHEN ff = 'no' THEN NULL WHEN is_kids THEN '家族で楽しむ' END, CASE WHEN df = 'yes' THEN 'デート向け' END, CASE WHEN sf = 'yes' THEN '一人でも行きやすい' END, CASE WHEN rf = 'yes' THEN '雨の日OK' END,
 CASE rs WHEN 'required' THEN '予約必須' WHEN 'not_required' THEN '予約不要' END, CASE price_type WHEN 'free' THEN '無料' WHEN 'partially_paid' THEN '一部有料' WHEN 'paid' THEN '有料' WHEN 'varies' THEN '内容による' END,
 '駅徒歩' || cast(wm AS string) || '分', CASE WHEN ps = 'available' THEN '駐車場あり' END] if x IS NOT NULL]"""


@query("visit_tags", f"WITH {ATTR} SELECT id, coalesce(list_aggregate({TAGS}, 'string_agg', '|'), '') AS tags FROM att")
def visit_tags(t):
    return export.visit_tags(attributes(t)).select("id", F.array_join(F.transform("visit_tags", lambda x: x.label), "|").alias("tags"))


YEN = "CASE WHEN pmin = pmax THEN format('{:,}', pmin) || '円' WHEN pmin IS NOT NULL AND pmax IS NOT NULL THEN format('{:,}', pmin) || '円〜' || format('{:,}', pmax) || '円' WHEN pmin IS NOT NULL THEN format('{:,}', pmin) || '円〜' WHEN pmax IS NOT NULL THEN '〜' || format('{:,}', pmax) || '円' END"
FREE_NOTE = "CASE WHEN price_text IN ('入場無料', '無料') OR price_text IS NULL THEN NULL WHEN price_text = '料金：入場は無料。' THEN NULL ELSE translate(price_text, '（）：', '():') END"


@query("visit_facts", f"""WITH {ATTR} SELECT id, CASE price_type WHEN 'free' THEN '無料' WHEN 'partially_paid' THEN '一部有料' WHEN 'paid' THEN '有料' WHEN 'varies' THEN '内容による' END AS price_class,
 CASE WHEN price_type = 'free' THEN {FREE_NOTE} WHEN price_text IS NOT NULL THEN price_text WHEN price_type = 'paid' THEN {YEN} END AS admission_note,
 CASE WHEN size % 5 = 0 THEN 'バス停すぐ' WHEN size % 2 = 0 AND wm IS NOT NULL THEN NULL ELSE '上野駅から徒歩約' || cast(size % 20 AS string) || '分' END AS access_text,
 CASE WHEN size % 6 = 0 THEN cast(size AS string) || '〜' || cast(size * 2 AS string) || '分' WHEN size % 2 = 0 THEN cast(size AS string) || '分〜' WHEN size % 3 = 0 THEN '〜' || cast(size * 2 AS string) || '分' END AS duration FROM att""")
def visit_facts(t):
    return export.visit_facts(attributes(t)).select("id", "visit_facts.price_class", "visit_facts.admission_note", "visit_facts.access_text", "visit_facts.duration")


@query("schema_org", f"""WITH s AS (SELECT event_id, bool_or(coalesce(start_time, end_time) IS NOT NULL) AS timed, count(*) AS n FROM sessions GROUP BY 1)
SELECT c.id, n AS n_nodes, CASE WHEN n = 1 THEN NULL ELSE n END AS graph_size, c.title AS name FROM catalogue c JOIN s ON s.event_id = c.id WHERE timed
UNION ALL SELECT c.id, 1, NULL, c.title FROM catalogue c WHERE id NOT IN (SELECT event_id FROM sessions)""")
def schema_org(t):
    df = export.schema_org(attributes(t), t.sessions, F.concat(F.lit("https://e.example.com/"), "slug"))
    v = F.parse_json("json_ld")
    graph = F.try_variant_get(v, '$["@graph"]', "array<variant>")
    name = F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, '$["@graph"][0].name', "string"))
    return df.select("id", F.col("n_nodes").cast("long").alias("n_nodes"), F.size(graph).cast("long").alias("graph_size"), name.alias("name"))


XML = """SELECT brand, concat('<rss version="2.0"><channel><title>', brand, ' news</title>', string_agg(item, '' ORDER BY id), '</channel></rss>')"""


def rss(t):
    """One RSS file per event: a channel with three items."""
    item = lambda n: F.concat(F.lit("<item><title>"), "title", F.lit(f" {n}</title><link>/news/"), C("id").cast("string"), F.lit(f"/{n}</link><pubDate>2026-01-0{n}</pubDate><description><![CDATA[<p>"), "title_ja", F.lit("</p>]]></description></item>"))
    return t.catalogue.select(C("id").alias("page_id"), F.lit("https://feed.example.com/rss").alias("url"), F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), "brand", F.lit("</title>"), item(1), item(2), item(3), F.lit("</channel></rss>")).alias("xml"))


@query("feed_items", """SELECT id AS page_id, n - 1 AS pos, 'rss' AS kind, brand AS feed_title, title || ' ' || cast(n AS string) AS title, 'https://feed.example.com/news/' || cast(id AS string) || '/' || cast(n AS string) AS link,
 '2026-01-0' || cast(n AS string) AS published, title || ' ' || cast(n AS string) || ' — ' || title_ja AS excerpt FROM catalogue, (SELECT unnest([1, 2, 3]) AS n)""")
def feed_items(t):
    return readers.feed_items(rss(t))


@query("catalogue_scan", "SELECT p_partkey, p_retailprice FROM part WHERE p_brand = 'Brand#2'")
def catalogue_scan(t):
    return readers.read_catalogue(t.spark, f"{t.folder}/part.parquet").where(C("p_brand") == "Brand#2").select("p_partkey", "p_retailprice")


@query("raw_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def raw_pages(t):
    return readers.read_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", "url", F.char_length("html").alias("n"))


@query("keyed_upsert", """SELECT coalesce(c.c_custkey, u.k) AS c_custkey, CASE WHEN u.k IS NOT NULL AND (c.c_custkey IS NULL OR c.c_mktsegment = 'HOUSEHOLD') THEN u.v ELSE c.c_acctbal END AS c_acctbal
FROM customer c FULL JOIN (SELECT o_custkey * 2 AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) u ON u.k = c.c_custkey""")
def keyed_upsert(t):
    u = t.orders.groupBy((C("o_custkey") * 2).alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return state.upsert(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), u, ["c_custkey"], guard=C("c_mktsegment") == "HOUSEHOLD").select("c_custkey", "c_acctbal")


@query("proposal_sets", """SELECT event_id, 'a' AS src FROM (SELECT DISTINCT l_partkey AS event_id FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.09 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT * FROM (SELECT DISTINCT l_partkey, 'b' FROM lineitem WHERE l_returnflag = 'N' AND l_tax > 0.07)""")
def proposal_sets(t):
    li = t.lineitem
    a = li.where((C("l_returnflag") == "A") & (C("l_discount") > 0.09)).select(C("l_partkey").alias("event_id")).distinct()
    b = li.where((C("l_returnflag") == "N") & (C("l_tax") > 0.07)).select(C("l_partkey").alias("event_id")).distinct()
    gone = t.orders.where(C("o_orderstatus") == "P").select(C("o_custkey").alias("event_id")).distinct()
    return a.exceptAll(gone).withColumn("src", F.lit("a")).unionByName(b.withColumn("src", F.lit("b")))


@query("review_list", "SELECT o_orderkey AS id, c.title AS event_title, c.slug AS event_slug FROM orders LEFT JOIN catalogue c ON c.id = o_custkey")
def review_list(t):
    return lookups.with_event(t.orders.select(C("o_orderkey").alias("id"), C("o_custkey").alias("event_id")), t.catalogue).select("id", "event_title", "event_slug")


@query("queue_by_event", "WITH r AS (SELECT o_orderkey AS id, o_custkey AS event_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) SELECT event_id, count(*) AS n FROM r GROUP BY 1")
def queue_by_event(t):
    r = t.orders.select(C("o_orderkey").alias("id"), C("o_custkey").alias("event_id"), F.when(C("o_orderstatus") == "F", "accepted").otherwise("x").alias("status"), C("o_orderdate").alias("created_at"))
    return lookups.queue_by_event(lookups.pending_queue(r, t.catalogue, "accepted")).select("event_id", "n")


@query("published_reactions", "SELECT id, CASE WHEN size % 3 = 0 THEN 2 ELSE 1 END AS n_bullets, size % 4 = 0 AND size % 5 <> 0 AS translated FROM catalogue WHERE status = 'published' AND size % 2 = 0")
def published_reactions(t):
    c = t.catalogue
    s = c.select("id", "status", F.when(C("size") % 2 == 1, F.array(F.lit(" "))).when(C("size") % 3 == 0, F.array(F.lit("a"), F.lit(""), F.lit("b "))).otherwise(F.array(F.lit("a"))).alias("bullets"))
    tr = c.where(C("size") % 4 == 0).select(C("id").alias("summary_id"), F.lit("en").alias("locale"), F.lit("published").alias("status"), F.when(C("size") % 5 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("x"))).alias("bullets"))
    return lookups.published_reactions(s, tr).select("id", F.size("bullets").alias("n_bullets"), C("bullets_translated").isNotNull().alias("translated"))


def model_output(t):
    """A model summary per event with posts: bullets from two of its posts and one made-up theme."""
    b = lambda text, theme, n: F.struct(text.alias("text"), F.lit(theme).alias("theme"), F.lit(n).alias("evidence_count"), F.array().cast("array<string>").alias("cited"))
    return t.posts.groupBy("event_id").agg(F.min("text").alias("a"), F.max("text").alias("z")).select(
        "event_id", F.array(b(C("a"), "enjoyment", 9), b(C("z"), "crowd", 1), b(F.lit("待ち時間は短めという声があります"), "wait_time", 3), b(F.lit("屋内で快適"), "other", 1)).alias("bullets"),
        F.create_map(F.lit("crowd"), F.lit("positive"), F.lit("rain"), F.lit("unknown"), F.lit("family"), F.lit("negative")).alias("signals"), F.lit("平日の午前").alias("recommended_time"),
        F.lit(5).alias("recommended_evidence"), F.lit("high").alias("confidence"))


def recent_twenty(t):
    s = t.posts.select(C("post_id").alias("id"), "event_id", C("event_type").alias("source_type"), C("created_at").alias("observed_at"), "created_at", C("text").alias("excerpt"), C("username").alias("source_name"))
    return reactions.recent_sources(s).select("event_id", F.explode("sources").alias("x")).select("event_id", "x.excerpt", "x.class")


@query("reaction_guard")
def reaction_guard(t):
    g = guard.guard_summaries(model_output(t), recent_twenty(t))
    return g.select("event_id", F.array_join("themes", ",").alias("themes"), F.array_join("bullets", "|").alias("bullets"), C("signals")["crowd"].alias("crowd"), C("signals")["rain"].alias("rain"), "recommended_time", "confidence")


@query("reaction_guard_log")
def reaction_guard_log(t):
    return guard.guard_actions(model_output(t), recent_twenty(t)).select("event_id", "step", "action", "n")


@query("stored_signals", """SELECT id, CASE size % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' END AS crowd_level, CASE size % 5 WHEN 0 THEN true WHEN 1 THEN false END AS family, CASE size % 5 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'medium' END AS wait_time,
 CASE size % 5 WHEN 0 THEN '混雑傾向|家族で楽しむ|待ち時間短め' WHEN 1 THEN '比較的ゆったり|待ち時間長め' WHEN 2 THEN 'やや混雑|待ち時間あり' ELSE '' END AS labels FROM catalogue""")
def stored_signals(t):
    p = pick("size", "positive", "negative", "mixed", "neutral", "unknown")
    s = guard.stored_signals(F.create_map(F.lit("crowd"), p, F.lit("family"), p, F.lit("wait_time"), p))
    df = t.catalogue.select("id", s.alias("s"))
    return df.select("id", "s.crowd_level", "s.family", "s.wait_time", F.array_join(guard.signal_labels(guard.parse_signals(F.to_json("s"))), "|").alias("labels"))


@query("one_per_theme", """WITH b AS (SELECT event_id AS pos, user_id AS event_id, event_type, CASE event_type WHEN 'click' THEN 'enjoyment' WHEN 'view' THEN 'crowd' WHEN 'error' THEN 'photo' ELSE 'other' END AS theme, cast(floor(value) AS int) AS evidence FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY event_id, theme ORDER BY evidence DESC, pos) AS rn FROM b)
SELECT event_id, theme, pos, row_number() OVER (PARTITION BY event_id ORDER BY CASE theme WHEN 'enjoyment' THEN 1 WHEN 'crowd' THEN 2 WHEN 'photo' THEN 5 ELSE 10 END) AS slot FROM t WHERE rn = 1""")
def one_per_theme(t):
    b = t.events.select(C("event_id").alias("pos"), C("user_id").alias("event_id"), F.when(C("event_type") == "click", "enjoyment").when(C("event_type") == "view", "crowd").when(C("event_type") == "error", "photo").otherwise("other").alias("theme"),
                        F.floor("value").cast("int").alias("evidence"))
    return guard.one_per_theme(b).select("event_id", "theme", "pos", "slot")
