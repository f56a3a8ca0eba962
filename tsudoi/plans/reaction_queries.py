"""Reactions: event-stream rows as posts about the catalogue."""
from __future__ import annotations

from pyspark.sql import functions as F

from tsudoi.functions import classify
from tsudoi.operators import reactions, related
from tsudoi.operators import schedule
from tsudoi.plans import sqltext as q
from tsudoi.plans.domain import TODAY
from tsudoi.plans.registry import query
from tsudoi.plans.rule_queries import JOY, POST_CLASS
from tsudoi.plans.schedule_queries import FACTS
from tsudoi.functions.dates import day

C = F.col
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def events_of(t):
    """Catalogue rows dated so that the posts fall around them."""
    return t.catalogue.withColumns({"start_date": F.date_add(F.to_date(F.lit("2024-01-01")), (C("id") % 40).cast("int")),
                                    "end_date": F.date_add(F.to_date(F.lit("2024-01-01")), (C("id") % 40 + C("size") % 7).cast("int"))})


def posts_of(t):
    """Posts that name their event in part: the text carries the title for some, its venue for others."""
    titles = t.catalogue.select(C("id").alias("event_id"), C("title").alias("tt"), C("venue").alias("vv"))
    text = F.concat_ws(" ", "text", F.when(C("post_id") % 3 == 0, C("tt")).when(C("post_id") % 3 == 1, F.split("tt", " ")[0]),
                       F.when(C("post_id") % 4 == 0, C("vv")))
    return t.posts.join(titles, "event_id").withColumns({"text": text, "urls": F.filter(F.split("urls", ","), lambda u: u != "")}).drop("tt", "vv")


EV = """ev AS (SELECT id, title, venue, area, official_url, source_url, DATE '2024-01-01' + cast(id % 40 AS int) AS sd, DATE '2024-01-01' + cast(id % 40 + size % 7 AS int) AS ed FROM catalogue),
px AS (SELECT p.post_id, p.event_id, p.created_at, p.username, p.urls, p.event_type, e.title, e.venue, e.area, e.official_url, e.source_url, e.sd, e.ed,
  concat_ws(' ', p.text, CASE p.post_id % 3 WHEN 0 THEN e.title WHEN 1 THEN split_part(e.title, ' ', 1) END, CASE WHEN p.post_id % 4 = 0 THEN e.venue END) AS text
  FROM posts p JOIN ev e ON e.id = p.event_id)"""
HOSTOF = r"regexp_replace(lower(regexp_extract({c}, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"
WORDS = r"[x for x in string_split(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}#]+', ' ', 'g'), ' ') if length(x) >= 2]"
TW = f"[x for x in list_distinct({WORDS.format(c='title')}) if NOT regexp_matches(x, '^[0-9]{{4}}$')]"
KEYT, KEYX = q.title_key("title"), q.title_key("text")
REL = f"""{EV},
r1 AS (SELECT *, CASE WHEN {KEYT} <> '' AND {KEYX} <> '' AND (contains({KEYX}, {KEYT}) OR contains({KEYT}, {KEYX})) THEN 1.0
   WHEN length(trim(title)) >= 4 AND contains(lower(text), lower(trim(title))) THEN 0.95
   WHEN len({TW}) > 0 THEN len([x for x in {WORDS.format(c='text')} if list_contains({TW}, x)])::double / len({TW}) ELSE 0.0 END AS overlap,
  coalesce(length({q.venue_key('venue')}) >= 2 AND (contains({q.venue_key('text')}, {q.venue_key('venue')}) OR contains(text, trim(venue))), false) AS hv,
  coalesce(area <> '' AND contains(text, area), false) AS ha,
  coalesce(urls <> '' AND ({HOSTOF.format(c='urls')} = {HOSTOF.format(c='official_url')} OR {HOSTOF.format(c='urls')} = {HOSTOF.format(c='source_url')}), false) AS hl,
  created_at BETWEEN sd - INTERVAL 14 DAYS AND ed + INTERVAL 7 DAYS AS hd FROM px),
r2 AS (SELECT *, overlap * 0.6 + CASE WHEN hv THEN 0.25 ELSE 0.0 END + CASE WHEN ha THEN 0.1 ELSE 0.0 END + CASE WHEN hl THEN 0.35 ELSE 0.0 END + CASE WHEN hd THEN 0.05 ELSE 0.0 END AS rel_score,
  (overlap >= 0.4)::int + hv::int + ha::int + hl::int + hd::int AS n_reasons, {POST_CLASS} AS class, NOT {q.has('text', classify.POST_EXPERIENCE)} AND {q.has('text', classify.ANNOUNCEMENT)} AS ann FROM r1),
r3 AS (SELECT *, CASE WHEN overlap >= 0.99 OR rel_score >= 0.75 THEN 'exact' WHEN rel_score >= 0.35 OR (overlap >= 0.35 AND n_reasons >= 2) THEN 'likely'
  WHEN rel_score >= 0.15 OR overlap >= 0.2 THEN 'weak' ELSE 'irrelevant' END AS relevance FROM r2),
r4 AS (SELECT *, rel_score * 10 + CASE WHEN relevance = 'exact' THEN 3 ELSE 0 END + CASE class WHEN 'experience' THEN 8 WHEN 'official' THEN 2 WHEN 'media' THEN 2 ELSE 0 END
  - CASE WHEN ann THEN 6 ELSE 0 END + CASE WHEN overlap >= 0.99 THEN 4 ELSE 0 END + CASE WHEN hv THEN 2 ELSE 0 END + CASE WHEN hl THEN 2 ELSE 0 END
  + greatest(0.0, 2 - ((epoch_us({NOW}) - epoch_us(created_at)) / 86400000000.0) / 3.5) AS score FROM r3)"""


def scored(t):
    rel = reactions.post_relevance(posts_of(t), events_of(t))
    cls = rel.withColumns({"class": classify.post_class(C("text"), C("username"), C("urls")), "announcement": classify.announcement_heavy(C("text"))})
    return cls.withColumn("score", reactions.selection_score(C("rel_score"), C("relevance"), C("rel_reasons"), C("class"), C("announcement"), C("created_at"),
                                                             F.to_timestamp(F.lit("2024-01-31 00:00:00"))))


@query("post_relevance", f"WITH {REL} SELECT post_id, overlap, round(rel_score, 6) AS rel_score, relevance, n_reasons, class FROM r3")
def post_relevance(t):
    return scored(t).select("post_id", "overlap", F.round("rel_score", 6).alias("rel_score"), "relevance", F.size("rel_reasons").alias("n_reasons"), "class")


@query("selection_scores", f"WITH {REL} SELECT post_id, round(score, 5) AS score FROM r4")
def selection_scores(t):
    return scored(t).select("post_id", F.round("score", 5).alias("score"))


EXISTING = "ex AS (SELECT user_id AS event_id, event_id AS post_id FROM events WHERE value > 30)"
SELECTED = f"""{REL}, {EXISTING},
s1 AS (SELECT r.*, greatest(20 - coalesce(n, 0), 0) AS slots, x.post_id IS NOT NULL AS seen FROM r4 r LEFT JOIN (SELECT event_id, count(*) AS n FROM ex GROUP BY 1) c USING (event_id) LEFT JOIN ex x USING (event_id, post_id)),
s2 AS (SELECT *, row_number() OVER (PARTITION BY event_id, class ORDER BY score DESC, post_id) AS cr FROM s1 WHERE relevance IN ('exact', 'likely') AND NOT seen AND slots > 0),
s3 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE class WHEN 'experience' THEN 1 WHEN 'official' THEN 2 WHEN 'media' THEN 3 ELSE 4 END, cr) AS pr FROM s2
  WHERE cr <= CASE class WHEN 'experience' THEN 12 WHEN 'official' THEN 2 WHEN 'media' THEN 2 ELSE 4 END)"""


@query("quota_selection", f"""WITH {SELECTED} SELECT s1.post_id, CASE WHEN relevance NOT IN ('exact', 'likely') THEN 'skip_irrelevant' WHEN seen THEN 'skip_duplicate' WHEN slots <= 0 THEN 'skip_cap'
 WHEN w.post_id IS NOT NULL THEN 'save' ELSE 'skip_quota' END AS decision FROM s1 LEFT JOIN (SELECT post_id FROM s3 WHERE pr <= slots) w USING (post_id)""")
def quota_selection(t):
    stored = t.events.where(C("value") > 30).select(C("user_id").alias("event_id"), C("event_id").alias("post_id"))
    return reactions.select_posts(scored(t), stored).select("post_id", "decision")


@query("read_window", f"""WITH {REL}, w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, post_id) AS rn FROM r3),
n AS (SELECT event_id, sum(CASE WHEN rn <= 20 AND relevance IN ('exact', 'likely') THEN 1 ELSE 0 END) AS valid FROM w GROUP BY 1)
SELECT post_id, rn AS read_pos FROM w JOIN n USING (event_id) WHERE rn <= 20 OR (rn <= 30 AND valid < 10)""")
def read_window(t):
    return reactions.read_window(scored(t), [C("created_at").desc(), C("post_id")], reactions.saveable(C("relevance"))).select("post_id", "read_pos")


@query("save_cap", """WITH d AS (SELECT event_id AS row_id, user_id AS run, ts, CASE WHEN value > 10 THEN 'save' ELSE 'skip_irrelevant' END AS decision FROM events)
SELECT row_id, CASE WHEN decision = 'save' AND sum(CASE WHEN decision = 'save' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts, row_id) > 3 THEN 'skip_max_write' ELSE decision END AS decision FROM d""")
def save_cap(t):
    d = t.events.select(C("event_id").alias("row_id"), C("user_id").alias("run"), "ts", F.when(C("value") > 10, "save").otherwise("skip_irrelevant").alias("decision"))
    return reactions.cap_saves(d, ["run"], "ts").select("row_id", "decision")


@query("not_collected_posts", "SELECT event_id AS post_id, user_id AS event_id FROM events WHERE NOT value > 30")
def not_collected_posts(t):
    p = t.events.select(C("event_id").alias("post_id"), C("user_id").alias("event_id"))
    stored = t.events.where(C("value") > 30).select(C("event_id").alias("post_id"), C("user_id").alias("event_id"))
    return reactions.not_collected(p, stored, ["event_id", "post_id"])


SRC = f"""src AS (SELECT post_id AS id, event_id, event_type AS source_type, created_at AS observed_at, CASE WHEN post_id % 7 = 0 THEN '' ELSE text END AS excerpt, username AS source_name FROM posts)"""


def sources_of(t):
    return t.posts.select(C("post_id").alias("id"), "event_id", C("event_type").alias("source_type"), C("created_at").alias("observed_at"), "created_at",
                          F.when(C("post_id") % 7 == 0, "").otherwise(C("text")).alias("excerpt"), C("username").alias("source_name"))


@query("recent_sources", f"""WITH {SRC}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY observed_at DESC, id) AS rn FROM src),
f AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rn) AS p FROM r WHERE rn <= 40 AND excerpt <> '')
SELECT event_id, count(*) AS n_sources, arg_min(excerpt, p) AS newest, arg_max(excerpt, p) AS oldest FROM f WHERE p <= 20 GROUP BY 1 HAVING count(*) >= 3""")
def recent_sources(t):
    r = reactions.recent_sources(sources_of(t))
    return r.select("event_id", "n_sources", F.get("sources", F.lit(0))["excerpt"].alias("newest"), F.element_at("sources", -1)["excerpt"].alias("oldest"))


def classed(t):
    return t.posts.select("event_id", C("text").alias("excerpt"), C("event_type").alias("source_type"),
                          classify.post_class(C("text"), C("username"), F.split("urls", ",")).alias("class"))


PC = f"pc AS (SELECT post_id, event_id, event_type, text, {POST_CLASS} AS class FROM posts)"


@query("source_class_counts", f"WITH {PC} SELECT event_id, event_type AS source_type, class, count(*) AS n FROM pc GROUP BY 1, 2, 3")
def source_class_counts(t):
    return reactions.source_counts(classed(t))


@query("relevance_report", f"""WITH {REL} SELECT event_id, count(*) FILTER (relevance = 'exact') AS exact, count(*) FILTER (relevance = 'likely') AS likely, count(*) FILTER (relevance = 'weak') AS weak,
 count(*) FILTER (relevance = 'irrelevant') AS irrelevant, count(*) FILTER (class = 'experience') AS class_experience, count(*) FILTER (class = 'official') AS class_official,
 count(*) FILTER (class = 'media') AS class_media, count(*) FILTER (class = 'other') AS class_other, count(*) FILTER (relevance IN ('exact', 'likely')) AS valid, round(count(*) * 0.005, 4) AS cost_usd FROM r3 GROUP BY 1""")
def relevance_report(t):
    return reactions.relevance_report(scored(t)).withColumn("cost_usd", F.round("cost_usd", 4))


THEME_ROWS = " UNION ALL ".join(f"SELECT event_id, class, text, '{k}' AS theme FROM pc WHERE {q.has('text', p)}" + (f" AND {JOY}" if k == "enjoyment" else "")
                                for k, p in classify.THEMES.items())


@query("theme_evidence", f"""WITH {PC}, th AS ({THEME_ROWS}) SELECT event_id, theme, count(*) FILTER (class = 'experience') AS experience, count(*) FILTER (class = 'official') AS official,
 count(*) FILTER (class = 'media') AS media, count(*) FILTER (class = 'other') AS other FROM th GROUP BY 1, 2""")
def theme_evidence(t):
    return reactions.theme_evidence(classed(t))


POS = "CASE theme " + " ".join(f"WHEN '{k}' THEN {q.has('text', p)}" for k, p in reactions.POSITIVE.items()) + " END"
NEG = "CASE theme " + " ".join(f"WHEN '{k}' THEN {q.has('text', p)}" for k, p in reactions.NEGATIVE.items()) + " END"


@query("theme_polarity", f"""WITH {PC}, th AS ({THEME_ROWS}), c AS (SELECT event_id, theme, count(*) AS n, count(*) FILTER ({POS}) AS pos, count(*) FILTER ({NEG}) AS neg FROM th
 WHERE class = 'experience' AND theme IN ({q.quoted(reactions.SIGNALS)}) GROUP BY 1, 2)
SELECT event_id, theme, n, pos, neg, CASE WHEN n < 2 THEN 'unknown' WHEN pos >= 1 AND neg >= 1 THEN 'mixed' WHEN pos >= 1 THEN 'positive' WHEN neg >= 1 THEN 'negative' ELSE 'neutral' END AS polarity FROM c""")
def theme_polarity(t):
    return reactions.theme_polarity(classed(t)).select("event_id", "theme", "n", "pos", "neg", "polarity")


@query("confidence_caps", f"""WITH {PC}, c AS (SELECT event_id, count(*) AS n, count(*) FILTER (class = 'experience') AS e FROM pc GROUP BY 1)
SELECT event_id, CASE WHEN n < 5 OR e < 3 THEN 'low' WHEN n < 10 OR e < 5 THEN 'medium' ELSE CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END END AS confidence FROM c""")
def confidence_caps(t):
    c = classed(t).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("class") == "experience").alias("e"))
    model = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (C("event_id") % 3 + 1).cast("int"))
    return c.select("event_id", reactions.confidence_cap(model, C("n"), C("e")).alias("confidence"))


@query("source_recount", "SELECT id, (SELECT count(*) FROM events e WHERE e.user_id = c.id) AS source_count FROM catalogue c")
def source_recount(t):
    return reactions.recount(t.catalogue.select("id"), t.events.select(C("user_id").alias("summary_id")))


@query("robots_filter", r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#:]*)', 1)) AS o, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS p FROM pages),
r AS (SELECT DISTINCT o AS origin, 'disallow' AS kind, '/' || split_part(p, '/', 2) AS prefix FROM u WHERE page_id % 3 = 0 UNION SELECT DISTINCT o, 'allow', p FROM u WHERE page_id % 5 = 0)
SELECT page_id, coalesce(max(CASE WHEN kind = 'disallow' THEN length(prefix) END), -1) < 0 OR coalesce(max(CASE WHEN kind = 'allow' THEN length(prefix) END), -1) > max(CASE WHEN kind = 'disallow' THEN length(prefix) END) AS allowed
FROM u LEFT JOIN r ON r.origin = u.o AND starts_with(u.p, r.prefix) GROUP BY page_id""")
def robots_filter(t):
    from tsudoi.functions.urls import host, path, scheme
    u = t.pages.select("page_id", "url", F.concat(scheme(C("url")), F.lit("://"), host(C("url"))).alias("origin"), path(C("url")).alias("p"))
    rules = u.where(C("page_id") % 3 == 0).select("origin", F.lit("disallow").alias("kind"), F.concat(F.lit("/"), F.get(F.split("p", "/"), F.lit(1))).alias("prefix")).unionByName(
        u.where(C("page_id") % 5 == 0).select("origin", F.lit("allow").alias("kind"), C("p").alias("prefix")))
    return reactions.robots_allowed(t.pages.select("page_id", "url"), rules).select("page_id", "allowed")


@query("page_relevance", None)
def page_relevance(t):
    from tsudoi.operators.pages import page_metadata
    meta = page_metadata(t.pages.select("page_id", "url", "html"))
    linked = meta.select(C("page_id").alias("event_id"), F.concat_ws(" ", "title", "description", "excerpt").alias("page_text"), C("url").alias("page_url"),
                         F.lit(None).cast("timestamp").alias("published_at"))
    return reactions.page_relevance(linked, t.catalogue).select("event_id", F.round("rel_score", 6).alias("rel_score"), "relevance")


@query("best_proposals", """WITH p AS (SELECT l_orderkey AS event_id, l_returnflag AS field, l_linenumber * 1000000 + l_partkey AS seq, cast(l_quantity AS string) AS value,
  CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN l_linestatus = 'O' THEN 'jsonld' WHEN l_tax > 0.04 THEN 'deterministic' ELSE 'ai_assist' END AS method FROM lineitem)
SELECT event_id, field, seq, confidence, method FROM (SELECT *, row_number() OVER (PARTITION BY event_id, field ORDER BY CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END * 10
 + CASE method WHEN 'jsonld' THEN 3 WHEN 'deterministic' THEN 2 ELSE 1 END DESC, seq) AS rn FROM p) WHERE rn = 1""")
def best_proposals(t):
    p = t.lineitem.select(C("l_orderkey").alias("event_id"), C("l_returnflag").alias("field"), (C("l_linenumber") * 1000000 + C("l_partkey")).alias("seq"),
                          C("l_quantity").cast("string").alias("value"), F.when(C("l_quantity") < 17, "low").when(C("l_quantity") < 34, "medium").otherwise("high").alias("confidence"),
                          F.when(C("l_linestatus") == "O", "jsonld").when(C("l_tax") > 0.04, "deterministic").otherwise("ai_assist").alias("method"))
    return reactions.best_proposals(p).select("event_id", "field", "seq", "confidence", "method")


CATS = "list_distinct([x for x in [lower(trim(y)) for y in string_split(category, ',')] if x <> '' AND x <> 'other'])"


@query("related_events", f"""WITH {FACTS},
op AS (SELECT c.id, nullif(lower(trim(area)), '') AS a, nullif(lower(trim(municipality)), '') AS m, {CATS} AS cats FROM catalogue c LEFT JOIN facts f ON f.event_id = c.id
  WHERE c.status = 'published' AND coalesce(f.schedule_status <> 'ended', true)),
gp AS (SELECT a.event_id AS s, b.event_id AS t, min(greatest(0, b.span_start - a.span_end, a.span_start - b.span_end)) AS gap
  FROM spans a JOIN op oa ON oa.id = a.event_id CROSS JOIN spans b JOIN op ob ON ob.id = b.event_id WHERE a.event_id <> b.event_id GROUP BY 1, 2),
pr AS (SELECT s.id AS source_id, t.id AS related_id, list_has_any(s.cats, t.cats) AS shares_category, CASE WHEN s.a = t.a THEN 1 WHEN s.m = t.m THEN 2 WHEN list_has_any(s.cats, t.cats) THEN 3 ELSE 4 END AS tier
  FROM op s JOIN op t ON s.id <> t.id),
rk AS (SELECT pr.*, gap AS gap_days, row_number() OVER (PARTITION BY source_id ORDER BY tier, shares_category DESC, gap ASC NULLS LAST, related_id) AS rank FROM pr LEFT JOIN gp ON gp.s = source_id AND gp.t = related_id)
SELECT source_id, related_id, tier, shares_category, gap_days, rank FROM rk WHERE rank <= 4""")
def related_events(t):
    cat = t.catalogue.where(C("status") == "published")
    held = schedule.with_schedule(cat, t.sessions, day(TODAY)).where(F.coalesce(C("schedule_status") != "ended", F.lit(True)))
    pool = held.select("id", "area", "municipality", F.split("category", ",").alias("category"))
    spans = schedule.effective_spans(cat, t.sessions)
    return related.related_events(pool, pool, spans)
