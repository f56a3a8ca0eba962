"""Matching the second feed (orders) against the catalogue (parts)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tsudoi.operators import match
from tsudoi.plans import sqltext as q
from tsudoi.plans.registry import query
from tsudoi.session import cut_lineage

C = F.col

KEYS = (f"{q.title_key('title')} AS title_key, {q.title_core('title')} AS core, {q.title_year('title')} AS year, {q.title_edition('title')} AS edition, "
        f"coalesce({q.venue_key('venue')}, '') AS venue_key, coalesce(venue <> '', false) AS has_venue, nullif(lower(trim(area)), '') AS area_key, "
        f"{q.url_key('official_url')} AS official_key, {q.url_key('source_url')} AS source_key, coalesce(end_date, start_date) AS span_last")
BASE = f"""pool AS (SELECT id, start_date, {KEYS} FROM catalogue), cand AS (SELECT seq, start_date, {KEYS} FROM incoming),
hits AS (SELECT seq, 1 AS tier, id FROM cand JOIN (SELECT official_key, min(id) AS id FROM pool WHERE official_key IS NOT NULL GROUP BY 1) p USING (official_key)
 UNION ALL SELECT seq, 2, id FROM cand JOIN (SELECT source_key, min(id) AS id FROM pool WHERE source_key IS NOT NULL GROUP BY 1) p USING (source_key)
 UNION ALL SELECT seq, 3, id FROM cand JOIN (SELECT title_key, start_date, min(id) AS id FROM pool WHERE title_key <> '' GROUP BY 1, 2) p USING (title_key, start_date)),
exact AS (SELECT seq, arg_min(tier, tier::bigint * 1000000000 + id) AS tier, arg_min(id, tier::bigint * 1000000000 + id) AS id FROM hits GROUP BY seq)"""


def grams(x: str) -> str:
    return f"[substr({x}, i, 2) for i in range(1, greatest(length({x}), 1))]"


def dice(a: str, b: str) -> str:
    shared = f"list_sum([least(len([y for y in {grams(a)} if y = g]), len([y for y in {grams(b)} if y = g])) for g in list_distinct({grams(a)})])"
    return (f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 WHEN {a} = {b} THEN 1.0 "
            f"WHEN least(length({a}), length({b})) >= 4 AND (contains({a}, {b}) OR contains({b}, {a})) THEN least(1.0, 0.88 + least(length({a}), length({b}))::double / greatest(length({a}), length({b})) * 0.12) "
            f"WHEN least(length({a}), length({b})) < 2 THEN 0.0 ELSE 2.0 * coalesce({shared}, 0) / (length({a}) + length({b}) - 2) END")


def venue_sim(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {dice(a, b)} END"


TITLES = f"""lt AS (SELECT DISTINCT title_key, core, year, edition FROM cand), rt AS (SELECT DISTINCT title_key, core, year, edition FROM pool),
cp AS (SELECT a.core AS ac, b.core AS bc, {dice('a.core', 'b.core')} AS s FROM (SELECT DISTINCT core FROM lt) a CROSS JOIN (SELECT DISTINCT core FROM rt) b),
tp AS (SELECT a.title_key AS ak, a.year AS ay, a.edition AS ae, b.title_key AS bk, b.year AS by_, b.edition AS be,
  CASE WHEN a.title_key = b.title_key THEN 1.0 ELSE least(1.0, s * CASE WHEN a.edition <> b.edition THEN 0.85 ELSE 1 END * CASE WHEN a.year <> b.year THEN 0.9 ELSE 1 END) END AS sim
  FROM lt a JOIN cp ON cp.ac = a.core JOIN rt b ON b.core = cp.bc)"""


@query("exact_match", f"WITH {BASE} SELECT seq, tier, id FROM exact")
def exact_match(t):
    return match.exact_matches(match.with_match_keys(t.incoming), match.match_pool(t.catalogue))


@query("match_pool_urls", f"""SELECT c.id, cast(count(DISTINCT u) AS bigint) AS n_urls FROM catalogue c LEFT JOIN (SELECT id, {q.url_key('source_url')} AS u FROM catalogue
 UNION SELECT custkey, {q.url_key('source_url')} FROM incoming) x ON x.id = c.id GROUP BY 1""")
def match_pool_urls(t):
    sources = t.incoming.select(C("custkey").alias("event_id"), "source_url")
    return match.match_pool(t.catalogue, sources).select("id", F.size("source_keys").cast("long").alias("n_urls"))


@query("similar_titles", f"WITH {BASE}, {TITLES} SELECT ak AS a_title_key, bk AS b_title_key, round(sim, 6) AS title_sim FROM tp WHERE sim >= 0.72")
def similar_titles(t):
    pairs = match.similar_titles(cut_lineage(match.title_keys(t.incoming)), cut_lineage(match.title_keys(t.catalogue)))
    return pairs.select("a_title_key", "b_title_key", F.round("title_sim", 6).alias("title_sim"))


DECISION = f"""WITH {BASE}, {TITLES},
st AS (SELECT * FROM tp WHERE sim >= 0.72),
ce AS (SELECT DISTINCT title_key, year, edition, start_date, span_last, venue_key, has_venue, area_key FROM cand WHERE seq NOT IN (SELECT seq FROM exact)),
vs AS (SELECT a, b, {venue_sim('a', 'b')} AS v FROM (SELECT DISTINCT venue_key AS a FROM cand) CROSS JOIN (SELECT DISTINCT venue_key AS b FROM pool)),
sc AS (SELECT c.*, p.id, st.sim, p.has_venue AS ehv, c.area_key = p.area_key AS am, vs.v, p.start_date AS es,
  CASE WHEN greatest(c.start_date, p.start_date) <= least(c.span_last, p.span_last) THEN greatest(1, least(c.span_last, p.span_last) - greatest(c.start_date, p.start_date) + 1)::double
    / least(greatest(1, c.span_last - c.start_date + 1), greatest(1, p.span_last - p.start_date + 1)) ELSE 0.0 END AS r
  FROM ce c JOIN st ON st.ak = c.title_key AND st.ay IS NOT DISTINCT FROM c.year AND st.ae IS NOT DISTINCT FROM c.edition
  JOIN pool p ON p.title_key = st.bk AND p.year IS NOT DISTINCT FROM st.by_ AND p.edition IS NOT DISTINCT FROM st.be JOIN vs ON vs.a = c.venue_key AND vs.b = p.venue_key),
tiers AS (SELECT *, CASE WHEN sim >= 0.82 AND (start_date = es OR r >= 0.5) THEN CASE WHEN v >= 0.75 THEN 4 WHEN NOT has_venue OR NOT ehv OR v >= 0.55 THEN 5 ELSE 6 END ELSE 7 END AS tier FROM sc),
top7 AS (SELECT *, row_number() OVER (PARTITION BY title_key, year, edition, start_date, span_last, venue_key, has_venue, area_key ORDER BY sim DESC, id) AS r7 FROM tiers),
ranked AS (SELECT *, row_number() OVER (PARTITION BY title_key, year, edition, start_date, span_last, venue_key, has_venue, area_key ORDER BY tier,
  CASE tier WHEN 4 THEN -(sim * 0.4 + r * 0.28 + v * 0.22 + CASE WHEN am THEN 0.1 ELSE 0.0 END) ELSE -sim END, CASE tier WHEN 5 THEN -r ELSE 0.0 END, id) AS rk FROM top7 WHERE tier < 7 OR r7 = 1),
best AS (SELECT * FROM ranked WHERE rk = 1),
fz AS (SELECT c.seq, b.tier, b.id, b.sim, b.r, b.v, b.am, b.start_date = b.es OR b.r >= 0.5 AS strong FROM cand c JOIN best b ON b.title_key = c.title_key AND b.year IS NOT DISTINCT FROM c.year AND b.edition IS NOT DISTINCT FROM c.edition
  AND b.start_date IS NOT DISTINCT FROM c.start_date AND b.span_last IS NOT DISTINCT FROM c.span_last AND b.venue_key = c.venue_key AND b.has_venue = c.has_venue AND b.area_key IS NOT DISTINCT FROM c.area_key
  WHERE c.seq NOT IN (SELECT seq FROM exact)),
final AS (SELECT c.seq, coalesce(e.tier, f.tier) AS tier, coalesce(e.id, f.id) AS matched_id, f.sim, f.r, f.v, f.am, f.strong
  FROM cand c LEFT JOIN exact e ON e.seq = c.seq LEFT JOIN fz f ON f.seq = c.seq)"""


@query("match_decisions", f"""{DECISION} SELECT seq, matched_id, tier, CASE WHEN tier <= 3 THEN 'exact' WHEN tier <= 5 THEN 'likely' WHEN tier <= 7 THEN 'ambiguous' ELSE 'none' END AS duplicate_status,
 CASE WHEN tier <= 3 THEN 'attach_source_only' WHEN tier IS NOT NULL THEN 'review_required' ELSE 'create_draft' END AS action,
 cast(floor(round(CASE WHEN tier <= 2 THEN 1.0 WHEN tier = 3 THEN 0.98 WHEN tier = 4 THEN least(0.95, 0.55 + sim * 0.2 + r * 0.12 + v * 0.1 + CASE WHEN am THEN 0.03 ELSE 0.0 END)
  WHEN tier = 5 THEN least(0.9, 0.5 + sim * 0.25 + r * 0.1) WHEN tier = 6 THEN 0.45 + sim * 0.2 WHEN tier = 7 THEN 0.35 + sim * 0.2 + CASE WHEN strong THEN 0.05 ELSE 0.0 END ELSE 0.0 END, 3) * 100 + 0.000001) AS bigint) AS confidence FROM final""")
def match_decisions(t):
    d = match.decide(t.incoming, match.match_pool(t.catalogue))
    return d.select("seq", "matched_id", "tier", "duplicate_status", "action", F.floor(C("confidence") * 100 + 0.000001).alias("confidence"))


@query("match_summary", f"{DECISION} SELECT CASE WHEN tier <= 3 THEN 'exact' WHEN tier <= 5 THEN 'likely' WHEN tier <= 7 THEN 'ambiguous' ELSE 'none' END AS duplicate_status, count(*) AS n FROM final GROUP BY 1")
def match_summary(t):
    return match.outcome_summary(match.decide(t.incoming, match.match_pool(t.catalogue)))


@query("date_overlap", """SELECT s.event_id, s.start_date, s.end_date, max(CASE WHEN greatest(s.start_date, c.start_date) <= least(s.end_date, coalesce(c.end_date, c.start_date))
 THEN (least(s.end_date, coalesce(c.end_date, c.start_date)) - greatest(s.start_date, c.start_date) + 1)::double / least(s.end_date - s.start_date + 1, coalesce(c.end_date, c.start_date) - c.start_date + 1) ELSE 0.0 END) AS ratio
FROM sessions s JOIN catalogue c ON c.id = s.event_id GROUP BY 1, 2, 3""")
def date_overlap(t):
    c = t.catalogue.select(C("id").alias("event_id"), C("start_date").alias("cs"), F.coalesce("end_date", "start_date").alias("ce"))
    r = match.overlap_ratio(C("start_date"), C("end_date"), C("cs"), C("ce"))
    return t.sessions.join(c, "event_id").groupBy("event_id", "start_date", "end_date").agg(F.max(r).alias("ratio"))


CONFIDENCE = """cast(floor(round(CASE WHEN tier <= 2 THEN 1.0 WHEN tier = 3 THEN 0.98 WHEN tier = 4 THEN least(0.95, 0.55 + sim * 0.2 + r * 0.12 + v * 0.1 + CASE WHEN am THEN 0.03 ELSE 0.0 END)
  WHEN tier = 5 THEN least(0.9, 0.5 + sim * 0.25 + r * 0.1) WHEN tier = 6 THEN 0.45 + sim * 0.2 WHEN tier = 7 THEN 0.35 + sim * 0.2 + CASE WHEN strong THEN 0.05 ELSE 0.0 END ELSE 0.0 END, 3) * 100 + 0.000001) AS bigint)"""

# rows are settled as soon as all rows before them that could stand in their way are; nobody is compared with rows after it
IN_BATCH = f"""WITH RECURSIVE cand0 AS MATERIALIZED (SELECT seq, start_date, {KEYS} FROM incoming),
lt AS MATERIALIZED (SELECT *, row_number() OVER () AS tid FROM (SELECT DISTINCT title_key, core, year, edition FROM cand0)),
cand AS MATERIALIZED (SELECT c.*, lt.tid FROM cand0 c JOIN lt ON lt.title_key = c.title_key AND lt.core = c.core AND lt.year IS NOT DISTINCT FROM c.year AND lt.edition IS NOT DISTINCT FROM c.edition),
cores AS MATERIALIZED (SELECT DISTINCT core FROM lt),
half AS MATERIALIZED (SELECT ac, bc, {dice('ac', 'bc')} AS s FROM (SELECT a.core AS ac, b.core AS bc FROM cores a JOIN cores b ON a.core <= b.core
  AND (least(length(a.core), length(b.core)) >= 0.55 * greatest(length(a.core), length(b.core)) OR contains(a.core, b.core) OR contains(b.core, a.core)))),
cp AS (SELECT ac, bc, s FROM half WHERE s >= 0.72 UNION SELECT bc, ac, s FROM half WHERE s >= 0.72),
alike AS MATERIALIZED (SELECT * FROM (SELECT a.tid AS ta, b.tid AS tb, CASE WHEN a.title_key = b.title_key THEN 1.0
  ELSE least(1.0, s * CASE WHEN a.edition <> b.edition THEN 0.85 ELSE 1 END * CASE WHEN a.year <> b.year THEN 0.9 ELSE 1 END) END AS sim
  FROM lt a JOIN cp ON cp.ac = a.core JOIN lt b ON b.core = cp.bc) WHERE sim >= 0.72),
keyed AS MATERIALIZED (SELECT seq, 1 AS tier, official_key AS k FROM cand WHERE official_key IS NOT NULL UNION ALL SELECT seq, 2, source_key FROM cand WHERE source_key IS NOT NULL
  UNION ALL SELECT seq, 3, start_date || '|' || title_key FROM cand WHERE title_key <> '' AND start_date IS NOT NULL),
met AS MATERIALIZED (SELECT a.seq AS a, b.seq AS b, a.tier, NULL::DOUBLE AS sim FROM keyed a JOIN keyed b ON a.tier = b.tier AND a.k = b.k AND b.seq < a.seq
  UNION ALL SELECT a.seq, b.seq, 7, sim FROM cand a JOIN alike ON ta = a.tid JOIN cand b ON b.tid = tb AND b.seq < a.seq),
rivals AS MATERIALIZED (SELECT DISTINCT a, b FROM met),
state(seq, won) USING KEY (seq) AS (SELECT seq, true FROM cand WHERE seq NOT IN (SELECT a FROM rivals)
  UNION SELECT x.a, NOT bool_or(coalesce(s.won, false)) FROM rivals x LEFT JOIN recurring.state s ON s.seq = x.b WHERE x.a NOT IN (SELECT seq FROM recurring.state)
  GROUP BY x.a HAVING bool_or(coalesce(s.won, false)) OR count(s.seq) = count(*)),
pairs AS (SELECT m.*, c.start_date = e.start_date OR coalesce(CASE WHEN greatest(c.start_date, e.start_date) <= least(c.span_last, e.span_last) THEN greatest(1, least(c.span_last, e.span_last) - greatest(c.start_date, e.start_date) + 1)::double
    / least(greatest(1, c.span_last - c.start_date + 1), greatest(1, e.span_last - e.start_date + 1)) END, 0.0) >= 0.5 AS strong,
  coalesce(CASE WHEN greatest(c.start_date, e.start_date) <= least(c.span_last, e.span_last) THEN greatest(1, least(c.span_last, e.span_last) - greatest(c.start_date, e.start_date) + 1)::double
    / least(greatest(1, c.span_last - c.start_date + 1), greatest(1, e.span_last - e.start_date + 1)) END, 0.0) AS r,
  {venue_sim('c.venue_key', 'e.venue_key')} AS v, c.area_key = e.area_key AS am, c.has_venue AND e.has_venue AS placed
  FROM met m JOIN state w ON w.seq = m.b AND w.won JOIN state l ON l.seq = m.a AND NOT l.won JOIN cand c ON c.seq = m.a JOIN cand e ON e.seq = m.b),
tiers AS (SELECT * REPLACE (CASE WHEN tier < 7 THEN tier WHEN sim >= 0.82 AND strong THEN CASE WHEN v >= 0.75 THEN 4 WHEN NOT placed OR v >= 0.55 THEN 5 ELSE 6 END ELSE 7 END AS tier) FROM pairs),
best AS (SELECT * FROM tiers QUALIFY row_number() OVER (PARTITION BY a ORDER BY tier, CASE tier WHEN 4 THEN -(sim * 0.4 + r * 0.28 + v * 0.22 + CASE WHEN am THEN 0.1 ELSE 0.0 END) WHEN 5 THEN -sim WHEN 6 THEN -sim WHEN 7 THEN -sim ELSE 0.0 END,
  CASE tier WHEN 5 THEN -r ELSE 0.0 END, b) = 1),
final AS (SELECT a AS seq, b AS leader, tier, sim, r, v, am, strong FROM best UNION ALL SELECT seq, seq, NULL, NULL, NULL, NULL, NULL, NULL FROM state WHERE won)
SELECT seq, leader, tier, CASE WHEN tier <= 3 THEN 'exact' WHEN tier <= 5 THEN 'likely' WHEN tier <= 7 THEN 'ambiguous' ELSE 'none' END AS duplicate_status,
 CASE WHEN tier <= 3 THEN 'attach_source_only' WHEN tier IS NOT NULL THEN 'review_required' ELSE 'create_draft' END AS action, {CONFIDENCE} AS confidence FROM final"""


@query("in_batch_leaders", IN_BATCH)
def in_batch_leaders(t):
    # the first import: nothing is in the catalogue yet
    found = match.attach_within_batch(t.incoming, keyed=False)
    return found.select("seq", "leader", "tier", "duplicate_status", "action", F.floor(C("confidence") * 100 + 0.000001).alias("confidence"))
