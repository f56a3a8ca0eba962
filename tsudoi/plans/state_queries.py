"""State merges and lookups over reviews, sources and decisions taken from orders and line items."""
from __future__ import annotations

from pyspark.sql import functions as F

from tsudoi.functions import canon, place
from tsudoi.functions.dates import day
from tsudoi.operators import audit, importing, lookups, state, summaries
from tsudoi.operators import match as matching
from tsudoi.operators import schedule
from tsudoi.functions import classify, images
from tsudoi.plans import sqltext as q
from tsudoi.plans.domain import TODAY
from tsudoi.plans.match_queries import DECISION
from tsudoi.plans.registry import query
from tsudoi.plans.rule_queries import INFER, PLACE_CTE, of_area_sql, price_sql
from tsudoi.plans.schedule_queries import D, FACTS

C = F.col
NAMES = ("guide", "magazine", "opendata")


def name_of(col):
    return F.when(C(col) % 3 == 0, "guide").when(C(col) % 3 == 1, "magazine").otherwise("opendata")


# sources already attached: suppliers of the line items; attaches: orders
STORED = "SELECT DISTINCT l_partkey AS event_id, CASE l_suppkey % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'magazine' ELSE 'opendata' END AS source_name, 'https://s.example.com/' || cast(l_suppkey % 5 AS string) AS source_url FROM lineitem WHERE l_returnflag = 'A'"
WANTED = "SELECT o_orderkey AS seq, o_custkey AS event_id, CASE o_orderkey % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'magazine' ELSE 'opendata' END AS source_name, 'https://s.example.com/' || cast(o_orderkey % 5 AS string) AS source_url, o_orderpriority AS official_url FROM orders"


def stored_sources(t):
    s = t.lineitem.where(C("l_returnflag") == "A").select(C("l_partkey").alias("event_id"), name_of("l_suppkey").alias("source_name"),
                                                         F.concat(F.lit("https://s.example.com/"), (C("l_suppkey") % 5).cast("string")).alias("source_url")).distinct()
    return s.withColumns({"source_event_id": F.lit(None).cast("string"), "official_url": F.lit("old"), "last_checked_at": F.lit(None).cast("timestamp")})


def wanted_sources(t):
    return t.orders.select(C("o_orderkey").alias("seq"), C("o_custkey").alias("event_id"), name_of("o_orderkey").alias("source_name"),
                           F.concat(F.lit("https://s.example.com/"), (C("o_orderkey") % 5).cast("string")).alias("source_url"), F.lit(None).cast("string").alias("source_event_id"),
                           C("o_orderpriority").alias("official_url"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("last_checked_at"))


@query("source_attach", f"""WITH st AS ({STORED}), w AS ({WANTED}), l AS (SELECT event_id, source_name, source_url, arg_max(official_url, seq) AS official_url FROM w GROUP BY 1, 2, 3)
SELECT coalesce(st.event_id, l.event_id) AS event_id, coalesce(st.source_name, l.source_name) AS source_name, coalesce(st.source_url, l.source_url) AS source_url,
 CASE WHEN l.event_id IS NOT NULL THEN l.official_url ELSE 'old' END AS official_url FROM st FULL JOIN l ON st.event_id = l.event_id AND st.source_name = l.source_name AND st.source_url = l.source_url""")
def source_attach(t):
    return state.attach_sources(stored_sources(t), wanted_sources(t)).select("event_id", "source_name", "source_url", "official_url")


@query("source_attach_outcome", f"""WITH st AS ({STORED}), w AS (SELECT DISTINCT event_id, source_name, source_url FROM ({WANTED}))
SELECT w.*, CASE WHEN st.event_id IS NULL THEN 'new_source' ELSE 'already_attached' END AS outcome FROM w LEFT JOIN st USING (event_id, source_name, source_url)""")
def source_attach_outcome(t):
    return state.attach_outcome(stored_sources(t), wanted_sources(t))


@query("already_attached", """SELECT o_orderkey AS seq FROM orders WHERE cast(o_custkey AS string) IN (SELECT cast(l_partkey AS string) FROM lineitem WHERE l_returnflag = 'R')""")
def already_attached(t):
    stored = t.lineitem.where(C("l_returnflag") == "R").select(F.concat(F.lit("ar1e"), C("l_partkey").cast("string")).alias("source_event_id"),
                                                              F.concat(F.lit("https://f.example.com/event/ar1e"), C("l_partkey").cast("string"), F.lit("/")).alias("source_url"))
    inc = t.orders.select(C("o_orderkey").alias("seq"), C("o_custkey").cast("string").alias("source_event_id"),
                          F.concat(F.lit("https://f.example.com/event/ar2e"), C("o_custkey").cast("string")).alias("source_url"))
    return lookups.already_attached(inc, stored)


@query("missing_occurrences", """WITH a AS (SELECT DISTINCT event_id, start_date, end_date, start_time, end_time FROM sessions), b AS (SELECT DISTINCT event_id, start_date, end_date, start_time, end_time FROM sessions WHERE start_date < DATE '1999-01-01')
SELECT * FROM a EXCEPT SELECT * FROM b""")
def missing_occurrences(t):
    return lookups.missing_occurrences(t.sessions, t.sessions.where(C("start_date") < F.lit("1999-01-01").cast("date")))


@query("occurrence_fill", """WITH open AS (SELECT id FROM catalogue WHERE status = 'draft'), old AS (SELECT event_id, start_date, end_date, start_time, end_time FROM sessions WHERE start_date < DATE '1999-01-01')
SELECT event_id, count(*) AS n FROM (SELECT * FROM old UNION ALL (SELECT event_id, start_date, end_date, start_time, end_time FROM sessions WHERE event_id IN (SELECT id FROM open) EXCEPT SELECT * FROM old)) GROUP BY 1""")
def occurrence_fill(t):
    old = t.sessions.where(C("start_date") < F.lit("1999-01-01").cast("date"))
    return state.fill_occurrences(old, t.sessions, t.catalogue).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("listing_date_fill", """SELECT c.id, coalesce(CASE WHEN size % 2 = 0 THEN c.start_date END, l.start_date) AS start_date, CASE WHEN size % 2 = 0 THEN c.end_date ELSE coalesce(c.end_date, l.end_date) END AS end_date,
 CASE WHEN size % 2 = 0 THEN 'detail' WHEN l.start_date IS NOT NULL THEN 'listing' END AS date_source FROM catalogue c LEFT JOIN (SELECT custkey AS id, arg_min(start_date, seq) AS start_date, min_by({'e': end_date}, seq).e AS end_date FROM incoming GROUP BY 1) l ON l.id = c.id""")
def listing_date_fill(t):
    details = t.catalogue.select("id", F.when(C("size") % 2 == 0, C("start_date")).alias("start_date"), "end_date")
    return lookups.fill_dates(details, t.incoming.select(C("custkey").alias("id"), "seq", "start_date", "end_date"), "id")


@query("feed_for_drafts", """SELECT DISTINCT c.id, i.seq FROM catalogue c JOIN incoming i ON i.custkey = c.id WHERE c.status = 'draft' AND i.source_name = 'magazine'""")
def feed_for_drafts(t):
    sources = t.incoming.select(C("custkey").alias("event_id"), "source_name", F.concat(F.lit("u"), C("custkey").cast("string")).alias("source_url"))
    feed = t.incoming.where(C("source_name") == "magazine").select("seq", F.concat(F.lit("u"), C("custkey").cast("string")).alias("source_url"))
    return lookups.feed_for_drafts(feed, t.catalogue, sources, "magazine").select("id", "seq")


# dedupe reviews: one stored review per order line of some orders
REV = """rev AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'linked' ELSE 'rejected' END AS status, CASE o_custkey % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'magazine' ELSE 'opendata' END AS source_name,
 'https://r.example.com/' || cast(o_custkey AS string) AS source_url, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 7 END AS candidate_event_id FROM orders),
inc AS (SELECT c_custkey AS seq, CASE c_custkey % 3 WHEN 0 THEN 'guide' WHEN 1 THEN 'magazine' ELSE 'opendata' END AS source_name, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'https://r.example.com/' || cast(c_custkey AS string) END AS source_url,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 7 END AS candidate_event_id, CASE c_nationkey % 3 WHEN 0 THEN 'likely' WHEN 1 THEN 'ambiguous' ELSE 'exact' END AS duplicate_status FROM customer),
bst AS (SELECT source_name, source_url, candidate_event_id, min(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS o FROM rev GROUP BY 1, 2, 3),
oc AS (SELECT inc.*, CASE WHEN inc.source_url = '' OR duplicate_status = 'exact' THEN 'skipped_invalid' WHEN o = 0 THEN 'skipped_resolved' WHEN o = 1 THEN 'updated_pending' ELSE 'inserted' END AS outcome
 FROM inc LEFT JOIN bst ON inc.source_name = bst.source_name AND inc.source_url = bst.source_url AND inc.candidate_event_id IS NOT DISTINCT FROM bst.candidate_event_id)"""


def stored_reviews(t):
    o = t.orders
    return o.select(C("o_orderkey").alias("id"), F.when(C("o_orderstatus") == "P", "pending").when(C("o_orderstatus") == "F", "linked").otherwise("rejected").alias("status"),
                    name_of("o_custkey").alias("source_name"), F.concat(F.lit("https://r.example.com/"), C("o_custkey").cast("string")).alias("source_url"),
                    F.when(C("o_custkey") % 5 != 0, C("o_custkey") % 7).alias("candidate_event_id"), F.lit("likely").alias("duplicate_status"), F.lit("old").alias("reason"),
                    F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("scores"))


def incoming_reviews(t):
    c = t.customer
    return c.select(C("c_custkey").alias("seq"), name_of("c_custkey").alias("source_name"),
                    F.when(C("c_custkey") % 50 == 0, "").otherwise(F.concat(F.lit("https://r.example.com/"), C("c_custkey").cast("string"))).alias("source_url"),
                    F.when(C("c_custkey") % 5 != 0, C("c_custkey") % 7).alias("candidate_event_id"),
                    F.when(C("c_nationkey") % 3 == 0, "likely").when(C("c_nationkey") % 3 == 1, "ambiguous").otherwise("exact").alias("duplicate_status"), F.lit("new").alias("reason"),
                    C("c_name").alias("payload"), F.lit(None).cast("string").alias("scores"))


@query("dedupe_review_outcome", f"WITH {REV} SELECT seq, outcome FROM oc")
def dedupe_review_outcome(t):
    return state.dedupe_review_outcome(stored_reviews(t), incoming_reviews(t)).select("seq", "outcome")


@query("dedupe_review_upsert", f"""WITH {REV}, ins AS (SELECT DISTINCT source_name, source_url, candidate_event_id FROM oc WHERE outcome = 'inserted'),
upd AS (SELECT DISTINCT source_name, source_url, candidate_event_id FROM oc WHERE outcome = 'updated_pending'),
one AS (SELECT min(id) AS id FROM rev WHERE status = 'pending' GROUP BY source_name, source_url, candidate_event_id)
SELECT 'pending' AS status, 'new' AS reason, (SELECT count(*) FROM ins) + (SELECT count(*) FROM upd) AS n UNION ALL
SELECT status, 'old', count(*) - CASE WHEN status = 'pending' THEN (SELECT count(*) FROM upd) ELSE 0 END FROM rev GROUP BY 1""")
def dedupe_review_upsert(t):
    return state.upsert_dedupe_reviews(stored_reviews(t), incoming_reviews(t)).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("import_routing", f"""{DECISION} SELECT i.seq, CASE WHEN tier BETWEEN 4 AND 7 THEN 'review' WHEN tier <= 3 THEN CASE WHEN c.status IN ('published', 'hidden') THEN 'attach_and_diff' ELSE 'attach' END
 WHEN s.status = 'draft' THEN 'draft_update' WHEN s.status IS NOT NULL THEN 'slug_protected' ELSE 'create_draft' END AS action
FROM incoming i JOIN final f ON f.seq = i.seq LEFT JOIN catalogue c ON c.id = f.matched_id LEFT JOIN catalogue s ON s.slug = 'feed-' || cast(i.custkey AS string)""")
def import_routing(t):
    inc = t.incoming.withColumn("slug", F.concat(F.lit("feed-"), C("custkey").cast("string")))
    return state.route_import(inc, matching.decide(t.incoming, matching.match_pool(t.catalogue)), t.catalogue).select("seq", "action")


# proposals: each order proposes venue, price text and dates for the catalogue row of its customer
def proposals(t):
    return t.incoming.select("seq", C("custkey").alias("event_id"), "source_name", "source_url", "price_text", "area", F.col("start_date"), F.lit(None).cast("string").alias("venue"))


PROP = """pr AS (SELECT i.seq, i.custkey AS event_id, i.source_name, i.price_text, i.area, i.start_date, c.price_text AS cp, c.area AS ca, c.start_date AS cs, c.status FROM incoming i JOIN catalogue c ON c.id = i.custkey),
df AS (SELECT seq, event_id, source_name, status, 'price_text' AS field_name, '"' || price_text || '"' AS proposed_value, cp IS NULL AS fresh FROM pr WHERE price_text IS NOT NULL AND price_text IS DISTINCT FROM cp
 UNION ALL SELECT seq, event_id, source_name, status, 'area', '"' || lower(trim(area)) || '"', ca IS NULL FROM pr WHERE area IS NOT NULL AND lower(trim(area)) IS DISTINCT FROM lower(trim(ca))
 UNION ALL SELECT seq, event_id, source_name, status, 'start_date', '"' || cast(start_date AS string) || '"', cs IS NULL FROM pr WHERE start_date IS DISTINCT FROM cs)"""


@query("field_diffs", f"WITH {PROP} SELECT seq, event_id, field_name, proposed_value, sha256(field_name || ':' || proposed_value) AS proposal_hash, field_name || CASE WHEN fresh THEN ': null → value' ELSE ': value changed' END AS reason FROM df")
def field_diffs(t):
    return state.field_diffs(proposals(t), t.catalogue).select("seq", "event_id", "field_name", "proposed_value", "proposal_hash", "reason")


FREV = """, h AS (SELECT *, sha256(field_name || ':' || proposed_value) AS proposal_hash FROM df),
fr AS (SELECT min(seq) AS id, event_id, source_name, field_name, proposal_hash, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'pending' END AS status FROM h WHERE seq % 2 = 0 GROUP BY 2, 3, 4, 5),
ho AS (SELECT h.*, CASE WHEN fr.status IN ('accepted', 'rejected') THEN 'already_' || fr.status WHEN fr.status = 'pending' THEN 'updated' ELSE 'created' END AS outcome FROM h LEFT JOIN fr USING (event_id, source_name, field_name, proposal_hash) WHERE h.status IN ('published', 'hidden'))"""


def stored_field_reviews(t, diffs):
    """Earlier proposals: those of even order keys, some already decided."""
    d = diffs.where(C("seq") % 2 == 0).groupBy("event_id", "source_name", "field_name", "proposal_hash").agg(F.min("seq").alias("id"), F.min_by("proposed_value", "seq").alias("proposed_value"))
    return d.select("id", "event_id", "source_name", "field_name", "proposal_hash", F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("current_value"), "proposed_value",
                    F.lit("old").alias("reason"), F.when(C("event_id") % 4 == 1, "accepted").when(C("event_id") % 4 == 2, "rejected").otherwise("pending").alias("status"))


@query("field_review_outcome", f"WITH {PROP}{FREV} SELECT seq, event_id, field_name, outcome FROM ho")
def field_review_outcome(t):
    d = state.field_diffs(proposals(t), t.catalogue)
    return state.field_review_outcome(stored_field_reviews(t, d), d, t.catalogue).select("seq", "event_id", "field_name", "outcome")


@query("field_review_sync", f"""WITH {PROP}{FREV}, cr AS (SELECT event_id, source_name, field_name, proposal_hash, max(seq) AS seq FROM ho WHERE outcome = 'created' GROUP BY 1, 2, 3, 4),
wn AS (SELECT event_id, source_name, field_name, arg_max(proposal_hash, seq) AS win FROM cr GROUP BY 1, 2, 3),
allr AS (SELECT event_id, field_name, CASE WHEN fr.status = 'pending' AND win IS NOT NULL AND win <> proposal_hash THEN 'expired' ELSE fr.status END AS status FROM fr LEFT JOIN wn USING (event_id, source_name, field_name)
 UNION ALL SELECT event_id, field_name, CASE WHEN proposal_hash = win THEN 'pending' ELSE 'expired' END FROM cr JOIN wn USING (event_id, source_name, field_name))
SELECT event_id, field_name, status, count(*) AS n FROM allr GROUP BY 1, 2, 3""")
def field_review_sync(t):
    d = state.field_diffs(proposals(t), t.catalogue)
    return state.sync_field_reviews(stored_field_reviews(t, d), d, t.catalogue).groupBy("event_id", "field_name", "status").agg(F.count(F.lit(1)).alias("n"))


@query("draft_update", """SELECT c.id, CASE WHEN c.status = 'draft' AND u.id IS NOT NULL THEN u.title ELSE c.title END AS title, CASE WHEN c.status = 'draft' AND u.id IS NOT NULL THEN coalesce(u.price_text, c.price_text) ELSE c.price_text END AS price_text,
 CASE WHEN c.status = 'draft' AND u.id IS NOT NULL AND c.image_url IS NOT NULL THEN 'unknown' ELSE c.image_usage_status END AS image_usage_status
FROM catalogue c LEFT JOIN (SELECT custkey AS id, arg_max(title, seq) AS title, max_by({'p': price_text}, seq).p AS price_text FROM incoming GROUP BY 1) u ON u.id = c.id""")
def draft_update(t):
    u = t.incoming.groupBy(C("custkey").alias("id")).agg(F.max_by(F.struct("title", "price_text"), "seq").alias("x")).select("id", "x.title", "x.price_text", F.lit(None).cast("string").alias("image_url"))
    return state.update_drafts(t.catalogue, u).select("id", "title", "price_text", "image_usage_status")


DEC = """rv AS (SELECT seq AS id, CASE WHEN orderstatus = 'P' THEN 'linked' ELSE 'pending' END AS status, source_name, source_url, custkey + 400 AS candidate_event_id, title, start_date FROM incoming),
dc AS (SELECT seq, seq - seq % 2 AS review_id, CASE custkey % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'create' ELSE 'reject' END AS intent FROM incoming),
ev AS (SELECT id FROM catalogue), so AS (SELECT DISTINCT source_name, source_url FROM incoming WHERE seq % 20 = 0),
jn AS (SELECT dc.*, rv.status, rv.candidate_event_id, rv.source_name, rv.source_url, min(dc.seq) OVER (PARTITION BY review_id) AS fst, so.source_url IS NOT NULL AS att, ev.id IS NOT NULL AS cand,
  concat_ws('-', rv.source_name, coalesce(nullif(regexp_extract(rv.source_url, '/event/ar[0-9]+e([0-9]+)', 1), ''), nullif(regexp_extract(rv.source_url, '/event/([0-9]+)/?', 1), '')), cast(year(rv.start_date) AS string)) AS slug
  FROM dc LEFT JOIN rv ON rv.id = dc.review_id LEFT JOIN ev ON ev.id = rv.candidate_event_id LEFT JOIN so ON so.source_name = rv.source_name AND so.source_url = rv.source_url),
e1 AS (SELECT *, CASE WHEN status IS NULL THEN 'review_not_found' WHEN status <> 'pending' OR seq <> fst THEN 'review_not_pending' WHEN intent = 'link' AND NOT cand THEN 'candidate_missing' WHEN intent = 'create' AND att THEN 'url_already_attached' END AS err FROM jn),
e2 AS (SELECT *, CASE WHEN err IS NULL AND intent = 'create' AND seq > min(CASE WHEN err IS NULL AND intent IN ('create', 'link') THEN seq END) OVER (PARTITION BY source_name, source_url) THEN 'url_already_attached'
  WHEN err IS NULL AND intent = 'create' AND seq > min(CASE WHEN err IS NULL AND intent = 'create' THEN seq END) OVER (PARTITION BY slug) THEN 'slug_exists' ELSE err END AS error FROM e1)"""


def dedupe_case(t):
    inc = t.incoming
    reviews = inc.select(C("seq").alias("id"), F.when(C("orderstatus") == "P", "linked").otherwise("pending").alias("status"), "source_name", "source_url", (C("custkey") + 400).alias("candidate_event_id"), "title",
                         "start_date", "end_date", F.lit(None).cast("long").alias("resolved_event_id"))
    decisions = inc.select("seq", (C("seq") - C("seq") % 2).alias("review_id"), F.when(C("custkey") % 3 == 0, "link").when(C("custkey") % 3 == 1, "create").otherwise("reject").alias("intent"))
    sources = inc.where(C("seq") % 20 == 0).select(C("custkey").alias("event_id"), "source_name", "source_url", F.lit(None).cast("string").alias("source_event_id"),
                                                  F.lit(None).cast("string").alias("official_url"), F.lit(None).cast("timestamp").alias("last_checked_at"))
    return decisions, reviews, sources


@query("dedupe_decisions", f"WITH {DEC} SELECT seq, CASE WHEN error IS NOT NULL THEN 'error' WHEN intent = 'link' THEN 'linked' WHEN intent = 'create' THEN 'created' ELSE 'rejected' END AS outcome, error FROM e2")
def dedupe_decisions(t):
    decisions, reviews, sources = dedupe_case(t)
    return state.dedupe_decision_outcome(decisions, reviews, t.catalogue, sources).select("seq", "outcome", "error")


@query("dedupe_decisions_applied", f"""WITH {DEC} SELECT rv.id, CASE WHEN o.review_id IS NULL THEN rv.status WHEN intent = 'link' THEN 'linked' WHEN intent = 'create' THEN 'created' ELSE 'rejected' END AS status,
 CASE WHEN intent = 'link' THEN o.candidate_event_id WHEN intent = 'create' THEN (SELECT max(id) FROM catalogue) + o.seq END AS resolved_event_id FROM rv LEFT JOIN (SELECT * FROM e2 WHERE error IS NULL) o ON o.review_id = rv.id""")
def dedupe_decisions_applied(t):
    decisions, reviews, sources = dedupe_case(t)
    out = state.dedupe_decision_outcome(decisions, reviews, t.catalogue, sources)
    new_reviews, _, _ = state.apply_dedupe_decisions(out, reviews, t.catalogue, sources, F.lit("2026-01-01").cast("timestamp"))
    return new_reviews.select("id", "status", "resolved_event_id")


FD = """fd AS (SELECT seq AS id, custkey AS event_id, CASE seq % 4 WHEN 0 THEN 'price_text' WHEN 1 THEN 'area' WHEN 2 THEN 'title' ELSE 'venue' END AS field_name, CASE orderstatus WHEN 'P' THEN 'accepted' ELSE 'pending' END AS status, source_name FROM incoming),
o AS (SELECT fd.*, CASE WHEN fd.id % 3 = 0 THEN 'reject' ELSE 'accept' END AS intent, c.status AS es FROM fd LEFT JOIN catalogue c ON c.id = fd.event_id),
x AS (SELECT *, CASE WHEN status <> 'pending' THEN 'review_not_pending' WHEN intent = 'accept' AND field_name = 'title' THEN 'field_not_allowed' WHEN intent = 'accept' AND es IS DISTINCT FROM 'published' THEN 'event_not_published'
  WHEN intent = 'accept' THEN 'accepted' ELSE 'rejected' END AS outcome FROM o)"""


def field_case(t):
    r = t.incoming.select(C("seq").alias("id"), C("custkey").alias("event_id"), F.when(C("seq") % 4 == 0, "price_text").when(C("seq") % 4 == 1, "area").when(C("seq") % 4 == 2, "title").otherwise("venue").alias("field_name"),
                          F.concat(F.lit('"'), "source_name", F.lit('"')).alias("proposed_value"), F.when(C("orderstatus") == "P", "accepted").otherwise("pending").alias("status"))
    d = r.select(C("id").alias("seq"), C("id").alias("review_id"), F.when(C("id") % 3 == 0, "reject").otherwise("accept").alias("intent"))
    return d, r


@query("field_decisions", f"WITH {FD} SELECT id AS review_id, outcome FROM x")
def field_decisions(t):
    d, r = field_case(t)
    return state.field_decision_outcome(d, r, t.catalogue).select("review_id", "outcome")


@query("field_decisions_applied", f"""WITH {FD}, v AS (SELECT event_id, field_name, arg_max(source_name, id) AS val FROM x WHERE outcome = 'accepted' GROUP BY 1, 2)
SELECT c.id, coalesce(p.val, c.price_text) AS price_text, coalesce(a.val, c.area) AS area, coalesce(w.val, c.venue) AS venue FROM catalogue c LEFT JOIN v p ON p.event_id = c.id AND p.field_name = 'price_text'
 LEFT JOIN v a ON a.event_id = c.id AND a.field_name = 'area' LEFT JOIN v w ON w.event_id = c.id AND w.field_name = 'venue'""")
def field_decisions_applied(t):
    d, r = field_case(t)
    return state.apply_field_decisions(state.field_decision_outcome(d, r, t.catalogue), r, t.catalogue)[1].select("id", "price_text", "area", "venue")


INTENT = "CASE o_orderkey % 4 WHEN 0 THEN 'publish' WHEN 1 THEN 'hide' WHEN 2 THEN 'unhide' ELSE 'delete' END"


@query("status_transitions", f"""WITH r AS (SELECT id, arg_min(intent, seq) AS intent FROM (SELECT o_orderkey AS seq, o_custkey AS id, {INTENT} AS intent FROM orders) GROUP BY 1)
SELECT c.id, CASE WHEN intent = 'publish' AND c.status = 'draft' THEN 'published' WHEN intent = 'hide' AND c.status = 'published' THEN 'hidden' WHEN intent = 'unhide' AND c.status = 'hidden' THEN 'published' ELSE c.status END AS status
FROM catalogue c LEFT JOIN r USING (id) WHERE intent IS DISTINCT FROM 'delete'""")
def status_transitions(t):
    i = C("o_orderkey") % 4
    req = t.orders.select(C("o_orderkey").alias("seq"), C("o_custkey").alias("id"), F.when(i == 0, "publish").when(i == 1, "hide").when(i == 2, "unhide").otherwise("delete").alias("intent"))
    return state.apply_status(req, t.catalogue).select("id", "status")


@query("cascade_delete", "SELECT event_id, count(*) AS n FROM sessions WHERE event_id NOT IN (SELECT id FROM catalogue WHERE status = 'hidden') GROUP BY 1")
def cascade_delete(t):
    return state.cascade_delete(t.sessions, t.catalogue.where(C("status") == "hidden")).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("image_rights", "SELECT id, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'licensed' ELSE image_usage_status END AS image_usage_status, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN '(c) x' ELSE 'old' END AS image_credit FROM catalogue")
def image_rights(t):
    ids = t.orders.where(C("o_orderstatus") == "F").select(C("o_custkey").alias("id"))
    return state.set_image_rights(t.catalogue.withColumn("image_credit", F.lit("old")), ids, "licensed", "(c) x").select("id", "image_usage_status", "image_credit")


@query("image_approvals", "SELECT o_orderkey AS seq, o_custkey AS id, coalesce(c.generated_image_status = 'pending' AND c.generated_image_url <> '', false) AS approved FROM orders LEFT JOIN catalogue c ON c.id = o_custkey")
def image_approvals(t):
    return state.classify_approvals(t.orders.select(C("o_orderkey").alias("seq"), C("o_custkey").alias("id")), t.catalogue)


@query("summary_saves", """SELECT c.id AS event_id, CASE WHEN intent = 'save' THEN CASE WHEN s.status IN ('published', 'hidden') AND c.size % 5 <> 0 THEN 'refused_protected' WHEN s.event_id IS NULL THEN 'created_draft' ELSE 'saved_draft' END
 WHEN intent = 'publish' THEN CASE WHEN c.size % 2 = 1 THEN 'refused_no_bullets' ELSE 'published' END WHEN s.event_id IS NULL THEN 'refused_missing' ELSE 'hidden' END AS outcome
FROM (SELECT *, CASE size % 3 WHEN 0 THEN 'save' WHEN 1 THEN 'publish' ELSE 'hide' END AS intent FROM catalogue) c LEFT JOIN (SELECT id AS event_id, status FROM catalogue WHERE size > 5) s ON s.event_id = c.id""")
def summary_saves(t):
    c = t.catalogue
    stored = c.where(C("size") > 5).select(C("id").alias("event_id"), "status", F.array(F.lit("x")).alias("bullets"))
    saves = c.select(C("id").alias("seq"), C("id").alias("event_id"), F.when(C("size") % 3 == 0, "save").when(C("size") % 3 == 1, "publish").otherwise("hide").alias("intent"),
                     F.when(C("size") % 2 == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit("b"))).alias("bullets"), (C("size") % 5 == 0).alias("forced"))
    return state.summary_save_outcome(stored, saves).select("event_id", "outcome")


@query("translation_saves", """SELECT id AS event_id, CASE WHEN size > 30 AND size % 5 <> 0 THEN 'published' ELSE 'draft' END AS status, CASE WHEN size > 30 AND size % 5 <> 0 THEN 'old' WHEN summary IS NULL THEN NULL ELSE 'new' END AS summary FROM catalogue""")
def translation_saves(t):
    c = t.catalogue
    stored = c.where(C("size") > 30).select(C("id").alias("event_id"), F.lit("en").alias("locale"), F.lit("published").alias("status"), F.lit("old").alias("title"), F.lit("old").alias("summary"))
    drafts = c.select(C("id").alias("seq"), C("id").alias("event_id"), F.lit("en").alias("locale"), F.lit("new").alias("title"), F.lit("new").alias("summary"), (C("size") % 5 == 0).alias("forced"))
    return state.save_translations(stored, drafts, c).select("event_id", "status", "summary")


def _reaction_tables(t):
    """Translations, drafts, summaries and stored reaction translations; who has which comes from sizes and linked sessions."""
    c, one = t.catalogue, F.lit("en")
    tr = c.where(C("size") > 30).select(C("id").alias("event_id"), one.alias("locale"), F.when(C("size") % 2 == 0, "published").otherwise("draft").alias("status"), "title", "summary")
    # every order announces a translation of its customer's event; later orders come later
    drafts = t.incoming.select("seq", C("custkey").alias("event_id"), one.alias("locale"), (C("orderstatus") == "P").alias("forced"), (C("priority") != "5-LOW").alias("with_reaction"),
                               F.array(C("title"), F.lit(" "), C("venue")).alias("bullets"))
    summaries = c.where(C("size") % 4 != 0).select((C("id") + 1000000).alias("id"), C("id").alias("event_id"), "status", F.when(C("size") % 7 != 0, F.array(C("title_ja"))).alias("bullets"))
    stored = c.where(C("size") % 3 == 0).select((C("id") + 1000000).alias("summary_id"), one.alias("locale"), F.when(C("size") % 2 == 0, "hidden").otherwise("draft").alias("status"), F.array(F.lit("old")).alias("bullets"))
    return tr, drafts, c, summaries, stored


REACTION_DRAFTS = """WITH d AS (SELECT i.seq, i.custkey AS event_id, orderstatus = 'P' AS forced, i.title, i.venue, CASE WHEN priority = '5-LOW' THEN 'not_asked'
 WHEN c.size > 30 AND c.size % 2 = 0 AND orderstatus <> 'P' THEN 'event_translation_refused' WHEN c.status <> 'published' OR c.size % 4 = 0 THEN 'no_published_summary'
 WHEN c.size % 6 = 0 AND orderstatus <> 'P' THEN 'refused_protected' WHEN c.size % 7 = 0 THEN 'no_bullets' WHEN c.size % 3 = 0 THEN 'saved_draft' ELSE 'created_draft' END AS outcome
 FROM incoming i JOIN catalogue c ON c.id = i.custkey)"""


@query("reaction_translation_outcome", f"{REACTION_DRAFTS} SELECT seq, outcome FROM d")
def reaction_translation_outcome(t):
    return state.reaction_translation_outcome(*_reaction_tables(t)).select("seq", "outcome")


@query("reaction_translation_saves", f"""{REACTION_DRAFTS}, last AS (SELECT event_id, arg_max(title, seq) AS title, arg_max(coalesce(venue, ''), seq) AS venue FROM d WHERE outcome IN ('saved_draft', 'created_draft') GROUP BY 1)
SELECT coalesce(l.event_id, c.id) + 1000000 AS summary_id, CASE WHEN l.event_id IS NOT NULL OR c.size % 2 = 1 THEN 'draft' ELSE 'hidden' END AS status,
 CASE WHEN l.event_id IS NULL THEN 'old' WHEN l.venue = '' THEN trim(l.title) ELSE trim(l.title) || '|' || trim(l.venue) END AS bullets
FROM (SELECT * FROM catalogue WHERE size % 3 = 0) c FULL JOIN last l ON l.event_id = c.id""")
def reaction_translation_saves(t):
    return state.save_reaction_translations(*_reaction_tables(t)).select("summary_id", "status", F.array_join("bullets", "|").alias("bullets"))


@query("published_translation", "SELECT id, CASE WHEN size > 20 AND size % 4 <> 0 THEN 'T' || cast(id AS string) ELSE title END AS title, CASE WHEN size > 20 THEN 's' END AS summary_translated FROM catalogue")
def published_translation(t):
    c = t.catalogue
    tr = c.select(C("id").alias("event_id"), F.lit("en").alias("locale"), F.when(C("size") > 20, "published").otherwise("draft").alias("status"),
                  F.when(C("size") % 4 != 0, F.concat(F.lit("T"), C("id").cast("string"))).otherwise(" ").alias("title"), F.lit("s").alias("summary"))
    return lookups.published_translation(c, tr, "en")


@query("municipality_backfill", f"""WITH {PLACE_CTE}, mm AS (SELECT id, {INFER.format(area=of_area_sql('area'))} AS inf FROM p1)
SELECT c.id, CASE WHEN status = 'published' AND nullif(trim(municipality), '') IS NULL THEN coalesce(inf, municipality) ELSE municipality END AS municipality FROM catalogue c JOIN mm USING (id)""")
def municipality_backfill(t):
    return state.backfill_municipality(t.catalogue).select("id", "municipality")


@query("municipality_histogram", f"""WITH {PLACE_CTE}, mm AS (SELECT {INFER.format(area=of_area_sql('area'))} AS inf, area FROM p1)
SELECT coalesce(inf, CASE WHEN nullif(trim(area), '') IS NULL THEN '(no area)' ELSE '(undecided)' END) AS municipality_slug, count(*) AS n FROM mm GROUP BY 1""")
def municipality_histogram(t):
    return audit.municipality_histogram(place.with_municipality(t.catalogue))


@query("area_cleanup", "SELECT id, CASE WHEN status = 'published' AND area = municipality THEN NULL ELSE area END AS area, CASE WHEN image_url <> '' AND image_usage_status IS NULL THEN 'feed' END AS image_source FROM catalogue")
def area_cleanup(t):
    return state.backfill_image_source(state.clear_duplicate_area(t.catalogue), {"%img.example.com%": "feed"}).select("id", "area", "image_source")


@query("guarded_corrections", "SELECT id, CASE WHEN price_type = 'free' THEN 'paid' ELSE price_type END AS price_type FROM catalogue")
def guarded_corrections(t):
    fix = t.catalogue.select("id", F.lit("free").alias("expected"), F.lit("paid").alias("new"))
    return state_fix(t, fix).select("id", "price_type")


def state_fix(t, fix):
    return lookups.apply_corrections(t.catalogue, fix, "price_type")


@query("correction_outcomes", "SELECT p_partkey + 500 AS id, CASE WHEN c.id IS NULL THEN 'missing' WHEN c.price_type = 'free' THEN 'applied' WHEN c.price_type = 'paid' THEN 'already' ELSE 'conflict' END AS outcome FROM part LEFT JOIN catalogue c ON c.id = p_partkey + 500")
def correction_outcomes(t):
    fix = t.part.select((C("p_partkey") + 500).alias("id"), F.lit("free").alias("expected"), F.lit("paid").alias("new"))
    return lookups.corrections_outcome(t.catalogue, fix, "price_type").select("id", "outcome")


@query("candidate_urls", f"""WITH u AS (SELECT id AS event_id, 0 AS role_rank, 0 AS seq, official_url AS url FROM catalogue UNION ALL SELECT id, 1, 0, source_url FROM catalogue UNION ALL SELECT custkey, 2, seq, source_url FROM incoming),
k AS (SELECT *, {q.url_key('url')} AS url_key FROM u WHERE url IS NOT NULL) SELECT event_id, url_key, role_rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, url_key ORDER BY role_rank, seq, url) AS rn FROM k WHERE url_key NOT LIKE 'https://other.example.com%') WHERE rn = 1""")
def candidate_urls(t):
    rows = t.catalogue.select(C("id").alias("event_id"), F.lit(0).alias("role_rank"), F.lit(0).cast("long").alias("seq"), C("official_url").alias("url")).unionByName(
        t.catalogue.select(C("id").alias("event_id"), F.lit(1).alias("role_rank"), F.lit(0).cast("long").alias("seq"), C("source_url").alias("url"))).unionByName(
        t.incoming.select(C("custkey").alias("event_id"), F.lit(2).alias("role_rank"), "seq", C("source_url").alias("url")))
    return lookups.candidate_urls(rows, "other.example.com").select("event_id", "url_key", "role_rank")


@query("allow_list", "SELECT item_id, 'missing' AS side FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def allow_list(t):
    return lookups.allow_list_difference(t.labels.select(C("doc_id").alias("item_id")), t.benchmark, "item_id")


@query("pending_queue", "SELECT o_orderkey AS id, c.title AS event_title FROM orders LEFT JOIN catalogue c ON c.id = o_custkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200")
def pending_queue(t):
    r = t.orders.select(C("o_orderkey").alias("id"), C("o_custkey").alias("event_id"), F.when(C("o_orderstatus") == "P", "pending").otherwise("accepted").alias("status"), C("o_orderdate").alias("created_at"))
    return lookups.pending_queue(r, t.catalogue).select("id", "event_title")


@query("summary_fill", f"SELECT c.id, CASE WHEN summary IS NOT NULL THEN 'skip_filled' WHEN status = 'draft' THEN 'write' WHEN status = 'published' THEN 'review' ELSE 'skip_status' END AS route FROM catalogue c WHERE id IN (SELECT event_id FROM ({STORED}) WHERE source_name = 'magazine')")
def summary_fill(t):
    return state.summary_fill_route(t.catalogue.select("id", F.lit("s").alias("proposal")), t.catalogue, stored_sources(t), "magazine").select("id", "route")


@query("batch_plan", f"""{DECISION}, b AS (SELECT i.*, tier FROM incoming i JOIN final f USING (seq))
SELECT seq, CASE WHEN tier IS NOT NULL THEN 'reclassified' WHEN coalesce(CASE WHEN end_date >= start_date THEN end_date ELSE start_date END >= {D}, false) THEN 'insert' ELSE 'skip' END AS action, {price_sql('price_text')} AS price_type FROM b""")
def batch_plan(t):
    inc = t.incoming.withColumns({"source_event_id": F.lit(None).cast("string"), "period": F.lit(None).cast("string"), "start_time": F.lit(None).cast("string"), "end_time": F.lit(None).cast("string"),
                                  "tags": F.array(F.lit("祭り")), "address": F.lit(None).cast("string")})
    none = t.incoming.where(F.lit(False)).select(F.lit(None).cast("string").alias("source_event_id"), "source_url")
    return state.plan_batch(inc, none, matching.decide(t.incoming, matching.match_pool(t.catalogue)), day(TODAY)).select("seq", "action", "price_type")


@query("enrichment_merge", f"""SELECT id, coalesce({price_sql('price_text')}, CASE WHEN size % 2 = 0 THEN 'paid' END, price_type) AS new_price_type,
 CASE WHEN size % 2 = 0 THEN coalesce(is_kids, true) ELSE is_kids END AS new_is_kids FROM (SELECT id, size, price_text, price_type, CASE WHEN size % 7 = 0 THEN is_kids END AS is_kids FROM catalogue)""")
def enrichment_merge(t):
    ev = t.catalogue.withColumns({"category": F.split("category", ","), "is_kids": F.when(C("size") % 7 == 0, C("is_kids"))})
    null = lambda ty: F.lit(None).cast(ty)
    rules = ev.select("id", null("string").alias("area"), classify.price_type(classify.price_compact(C("price_text"))).alias("price_type"), null("boolean").alias("is_indoor"), C("is_kids"), null("boolean").alias("is_night"))
    model = ev.where(C("size") % 2 == 0).select("id", F.lit("Bad Area!").alias("area"), F.lit("paid").alias("price_type"), null("boolean").alias("is_indoor"), F.lit(True).alias("is_kids"), F.lit(True).alias("is_night"),
                                               F.array(F.lit("food"), F.lit("zzz")).alias("category"), F.lit(" ").alias("summary"))
    return summaries.enrichment_merge(ev, rules, model).select("id", "new_price_type", "new_is_kids")


# ---- audits ------------------------------------------------------------------------------------------
@query("dashboard", f"""SELECT count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'hidden') AS hidden, count(*) FILTER (status = 'published' AND end_date < {D}) AS ended,
 count(*) FILTER (status = 'published' AND image_url IS NOT NULL AND coalesce(image_usage_status, 'unknown') = 'unknown') AS pending_image_unknown, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_dedupe,
 (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS pending_field FROM catalogue""")
def dashboard(t):
    a = t.orders.select(F.when(C("o_orderstatus") == "P", "pending").otherwise("linked").alias("status"))
    b = t.lineitem.select(F.when(C("l_linestatus") == "O", "pending").otherwise("accepted").alias("status"))
    return audit.dashboard(t.catalogue, a, b, day(TODAY))


@query("count_by_status", "SELECT status, count(*) AS n FROM catalogue GROUP BY 1")
def count_by_status(t):
    return audit.count_by(t.catalogue, "status")


@query("feed_profile", None)
def feed_profile(t):
    from tsudoi.functions import feeddates
    df = t.catalogue.select(feeddates.open_data_dates(C("open_date"), F.lit(None).cast("string")).alias("d"), classify.outing_filter(C("title_ja"), C("tags"), C("audience"), C("summary"))["status"].alias("filter"),
                            classify.area_status(C("title_ja"), C("venue"), C("summary")).alias("area_status"))
    return audit.feed_profile(df.select(feeddates.lifecycle(C("d.occurrences"), day("2026-08-05")).alias("lifecycle"), "filter", "area_status", C("d.date_status").alias("date_status")))


FIELDS = ("start_date", "end_date", "start_time", "end_time", "venue", "address", "price_text", "official_url", "image_url", "category")


@query("field_completeness", " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (cast({f} AS string) <> '') AS filled, count(*) AS total, cast(round(count(*) FILTER (cast({f} AS string) <> '') * 100.0 / count(*)) AS int) AS percent FROM catalogue" for f in FIELDS))
def field_completeness(t):
    return audit.completeness(t.catalogue, FIELDS)


@query("unmatched_buckets", """WITH b AS (SELECT unnest(string_split(category, ',')) AS bucket, count(*) OVER () AS x FROM catalogue WHERE size % 3 = 0), n AS (SELECT count(*) AS tot FROM catalogue WHERE size % 3 = 0)
SELECT bucket, count(*) AS n, round(count(*) / max(tot), 6) AS share FROM b, n GROUP BY 1 ORDER BY n DESC, bucket LIMIT 20""")
def unmatched_buckets(t):
    rows = t.catalogue.select(F.split("category", ",").alias("buckets"), F.when(C("size") % 3 == 0, "none").otherwise("exact").alias("duplicate_status"))
    return audit.unmatched_buckets(rows).withColumn("share", F.round("share", 6))


REASONS = f"""[x for x in [CASE WHEN status <> 'published' OR schedule_status IS NULL OR schedule_status = 'ended' THEN 'not_active' END, CASE WHEN coalesce(generated_image_status, 'none') <> 'none' THEN 'generated_status' END,
 CASE WHEN generated_image_url <> '' THEN 'generated_url' END, CASE WHEN image_url IS NOT NULL AND image_usage_status IN ('licensed', 'organizer_granted', 'own') THEN 'official_image' END, CASE WHEN image_usage_status = 'forbidden' THEN 'image_forbidden' END] if x IS NOT NULL]"""


def image_reasons(t):
    ev = schedule.with_schedule(t.catalogue, t.sessions, day(TODAY))
    null = F.lit(None).cast("string")
    return ev.select("id", images.exclusion_reasons(C("status"), C("schedule_status"), C("generated_image_status"), C("generated_image_url"), null, null, C("image_url"), C("image_usage_status")).alias("reasons"))


@query("image_exclusions", f"WITH {FACTS}, x AS (SELECT c.*, f.schedule_status FROM catalogue c LEFT JOIN facts f ON f.event_id = c.id) SELECT id, coalesce(list_aggregate({REASONS}, 'string_agg', ','), '') AS reasons FROM x")
def image_exclusions(t):
    return image_reasons(t).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("exclusion_counts", f"""WITH {FACTS}, x AS (SELECT c.*, f.schedule_status FROM catalogue c LEFT JOIN facts f ON f.event_id = c.id), r AS (SELECT {REASONS} AS rs FROM x)
SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(rs) = 0 THEN ['(eligible)'] ELSE rs END) AS reason FROM r) GROUP BY 1""")
def exclusion_counts(t):
    return audit.reason_counts(image_reasons(t), "reasons")


@query("duplicate_proposals", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_proposals(t):
    return audit.duplicate_keys(t.lineitem, ["l_orderkey", "l_partkey"])


@query("review_state_audit", "SELECT o_orderkey AS id, CASE WHEN c.id IS NULL THEN 'orphan' WHEN c.status = 'draft' THEN 'draft_with_review' ELSE 'not_published' END AS issue FROM orders LEFT JOIN catalogue c ON c.id = o_custkey + 900 WHERE c.status IS DISTINCT FROM 'published'")
def review_state_audit(t):
    return audit.review_state_audit(t.orders.select(C("o_orderkey").alias("id"), (C("o_custkey") + 900).alias("event_id")), t.catalogue).select("id", "issue")


@query("leaking_rows", "SELECT id FROM catalogue WHERE size > 10 AND status <> 'published'")
def leaking_rows(t):
    return audit.leaking_rows(t.catalogue.where(C("size") > 10), t.catalogue)


@query("constraint_audit", """SELECT 'end_after_start' AS rule, count(*) FILTER (end_date < start_date) AS violations FROM catalogue UNION ALL SELECT 'price_type_known', count(*) FILTER (price_type NOT IN ('free', 'paid')) FROM catalogue
UNION ALL SELECT 'orphan_sessions', count(*) FILTER (event_id NOT IN (SELECT id FROM catalogue WHERE status <> 'draft')) FROM sessions""")
def constraint_audit(t):
    rules = {"end_after_start": C("end_date") >= C("start_date"), "price_type_known": C("price_type").isin("free", "paid")}
    orphans = audit.orphan_rows(t.sessions, t.catalogue.where(C("status") != "draft"), "event_id").agg(F.lit("orphan_sessions").alias("rule"), F.count(F.lit(1)).alias("violations"))
    return audit.rule_violations(t.catalogue, rules).unionByName(orphans)


@query("unique_audit", """SELECT 'slug' AS rule, count(*) AS violations FROM (SELECT slug FROM catalogue WHERE slug IS NOT NULL GROUP BY slug HAVING count(*) > 1)
UNION ALL SELECT 'title_start', count(*) FROM (SELECT title, start_date FROM catalogue GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'session', count(*) FROM (SELECT event_id, start_date FROM sessions WHERE event_id IS NOT NULL AND start_date IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)""")
def unique_audit(t):
    return audit.unique_violations(t.catalogue, {"slug": (["slug"], True), "title_start": (["title", "start_date"], False)}).unionByName(
        audit.unique_violations(t.sessions, {"session": (["event_id", "start_date"], True)}))


@query("batch_counts", """SELECT 'null_venue' AS counter, count(*) FILTER (venue IS NULL) AS n FROM catalogue UNION ALL SELECT 'null_is_night', count(*) FILTER (is_night IS NULL) FROM catalogue
UNION ALL SELECT 'only_other', count(*) FILTER (category = 'other') FROM catalogue UNION ALL SELECT 'occurrences', count(*) FROM sessions WHERE event_id IN (SELECT id FROM catalogue)""")
def batch_counts(t):
    return audit.batch_counts(t.catalogue.withColumn("category", F.split("category", ",")), t.sessions, ["venue", "is_night"])


@query("settled_slugs", """WITH d AS (SELECT o_orderkey AS seq, 'part-' || o_custkey AS slug, 'https://s.example.com/' || o_orderkey AS source_url FROM orders),
tk AS (SELECT 'part-' || s_suppkey AS slug, 'https://s.example.com/' || s_suppkey AS source_url FROM supplier),
f AS (SELECT d.*, seq = min(seq) OVER (PARTITION BY slug) AND slug NOT IN (SELECT tk.slug FROM tk WHERE tk.source_url <> d.source_url) AS plain FROM d)
SELECT seq, CASE WHEN plain THEN slug ELSE slug || '-' || substr(sha1('slug:' || source_url), 1, 8) END AS final_slug FROM f""")
def settled_slugs(t):
    url = lambda c: F.concat(F.lit("https://s.example.com/"), C(c).cast("string"))
    drafts = t.orders.select(C("o_orderkey").alias("seq"), F.concat(F.lit("part-"), C("o_custkey").cast("string")).alias("slug"), url("o_orderkey").alias("source_url"))
    taken = t.supplier.select(F.concat(F.lit("part-"), C("s_suppkey").cast("string")).alias("slug"), url("s_suppkey").alias("source_url"))
    return importing.settle_slugs(drafts, taken).select("seq", "final_slug")


@query("tri_state_counts", " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS n_true, count(*) FILTER (NOT {f}) AS n_false, count(*) FILTER ({f} IS NULL) AS n_null FROM catalogue" for f in ("is_kids", "is_indoor", "is_night")))
def tri_state_counts(t):
    return audit.tri_state_counts(t.catalogue, ["is_kids", "is_indoor", "is_night"])


@query("summary_coverage", f"SELECT count(*) FILTER (summary <> '') AS filled, count(*) FILTER (coalesce(summary, '') = '') AS empty FROM catalogue WHERE status = 'published' AND NOT coalesce(coalesce(end_date, start_date) < {D}, false)")
def summary_coverage(t):
    return audit.summary_coverage(t.catalogue, day(TODAY))


@query("date_anomalies", f"SELECT id, 'ended_by_start_only' AS anomaly FROM catalogue WHERE end_date IS NULL AND start_date < {D}")
def date_anomalies(t):
    return audit.date_anomalies(t.catalogue, day(TODAY))


@query("snapshot_drift", "SELECT id, CASE WHEN size <= 2 THEN '(row)' WHEN venue IS NULL THEN 'area' ELSE 'venue,area' END AS changed FROM catalogue")
def snapshot_drift(t):
    after = t.catalogue.where(C("size") > 2).withColumns({"venue": F.concat("venue", F.lit("x")), "area": F.concat(F.coalesce("area", F.lit("")), F.lit("!"))})
    return audit.snapshot_drift(t.catalogue, after, ["title", "venue", "area"]).select("id", F.array_join("changed", ",").alias("changed"))
