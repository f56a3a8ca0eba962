"""One query for each operator, over its whole table, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsudoi.llm import ann, balltree, collocations, dac, decontaminate, license_scan, packing, pii, secret_scan, simhash, toxicity, voronoi, warc
from tsudoi.llm.common import scratch, table
from tsudoi.llm.tokens import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"))


@query
def op2_directly_addressable_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tokens")
    dac.write(table(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return dac.digests(dac.read(spark, path))


@query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.packed(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0))


@query
def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.report(table(spark, folder, "documents")))


@query
def op7_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.report(table(spark, folder, "documents"))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"), "unmatched")


@query
def op8_content_addressed_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, folder, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_weakly_supervised_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.report(table(spark, folder, "documents")))


@query
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


WORDS4 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLES["op4_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {WORDS4} AS w FROM documents),
b AS (SELECT item_id, {WORDS4} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t
        FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM d, sizes, unnest(generate_series(1, greatest(len(w) - n + 1, 0))) AS g(i) WHERE i + n - 1 <= len(w)),
occ AS (SELECT DISTINCT doc_id, item_id, pos.n, i FROM pos JOIN win ON win.n = pos.n AND win.t = pos.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(generate_series(i, i + n - 1)) AS g(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


SHA1_BITS = "('0x' || substr(sha1(p), {at}, 10))::BIGINT"
BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
DIGEST = " || ".join(f"substr({BASE32}, 1 + (({SHA1_BITS.format(at=1 + 10 * part)} >> {35 - 5 * k}) & 31)::INT, 1)" for part in range(4) for k in range(8))
ORACLES["op8_content_addressed_warc"] = f"""
WITH r AS (SELECT page_id, coalesce(html, '') AS p FROM pages), f AS (SELECT page_id, p, min(page_id) OVER (PARTITION BY p) AS first FROM r)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, {DIGEST} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def span_sql(kinds: list[tuple[str, str, str]], base: list[str]) -> str:
    """SQL for spans: (kind, pattern, condition on the match m). Positions are sums of the lengths of gaps and matches."""
    each = " UNION ALL ".join(f"""
SELECT doc_id, {n} AS o, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i],
       's': coalesce(list_sum(list_transform(g[:i], lambda y: length(y))), 0)::BIGINT + coalesce(list_sum(list_transform(m[:i - 1], lambda y: length(y))), 0)::BIGINT}})) AS x
FROM (SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_split_to_array(t, {pattern}) AS g FROM d)""" for n, (kind, pattern, _) in enumerate(kinds))
    valid = " OR ".join(f"(kind = '{kind}' AND {test})" for kind, _, test in kinds)
    names = ", ".join(f"'{k}'" for k in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS ({each}),
s AS (SELECT doc_id, o, kind, x.s AS s, x.s + length(x.m) AS e FROM (SELECT doc_id, o, kind, x, x.m AS m FROM raw) WHERE {valid}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)},
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (kind IN ({names})) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?"
ORACLES["op6_secret_scans"] = span_sql([
    ("assign", f"'{ASSIGN}[A-Za-z0-9+/_.=-]+'", f"length(regexp_replace(m, '^{ASSIGN}', '')) >= 8"),
    ("access", "'AKIA[A-Z0-9]+'", "length(m) >= 16"), ("hex", "'[0-9a-f]+'", "length(m) >= 32"),
    ("private_key", "'-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----'", "true"), ("github", "'gh[pousr]_[A-Za-z0-9]{36,}'", "true"),
    ("slack", "'xox[abprs]-[A-Za-z0-9-]{10,}'", "true"), ("google", "'AIza[A-Za-z0-9_-]{35}'", "true"),
    ("jwt", "'eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}'", "true"),
], ["assign", "access", "hex"])


def license_sql() -> str:
    """Segments between hard breaks, as lists of what stands between soft ones; of the known sentences that start at a place the
    longest counts, and the next may start after it. Each rule replaces what it matches in the text of identifiers."""
    known = ", ".join(f"('{t}', '{i}')" for i, every in license_scan.SENTENCES.items() for t in every)
    most = max(len(t.split()) for every in license_scan.SENTENCES.values() for t in every)
    steps, left, found = "", "q", []
    for n, (name, ids) in enumerate(license_scan.RULES):
        p = license_scan.pattern(ids)
        steps += f", r{n} AS (SELECT *, replace({left}, '{p}', '#') AS q{n}, CASE WHEN contains({left}, '{p}') THEN '{name}' END AS l{n} FROM {'ids' if not n else f'r{n - 1}'})"
        left = f"q{n}"
        found.append((name, n))
    # a licence stands where its first matching rule stands
    pairs = ", ".join(f"l{n}" for _, n in found)
    return f"""
WITH RECURSIVE known(t, id) AS (VALUES {known}), d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, lower(coalesce(text, '')) AS t FROM documents),
seg AS (SELECT rn, s, x[s] AS raw FROM (SELECT rn, regexp_split_to_array(t, '[.!?;][\\s\\x0B]+|\\n[\\s\\x0B*#/]*\\n') AS x FROM d), unnest(generate_series(1, len(x))) AS g(s)),
atom AS MATERIALIZED (SELECT rn, s, list_filter(list_transform(regexp_split_to_array(raw, ':[\\s\\x0B]+|\\n'), lambda y: trim(regexp_replace(y, '[^a-z0-9+]+', ' ', 'g'))), lambda y: y <> '') AS a FROM seg),
run AS (SELECT rn, s, i, i + k AS j, array_to_string(a[i:i + k], ' ') AS t FROM atom, unnest(generate_series(1, len(a))) AS g(i), unnest(generate_series(0, least({most}, len(a) - i))) AS h(k) WHERE len(a) > 0),
best AS MATERIALIZED (SELECT rn, s, i, j, id FROM run JOIN known ON known.t = run.t QUALIFY row_number() OVER (PARTITION BY rn, s, i ORDER BY j DESC) = 1),
pick AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY rn, s ORDER BY i) = 1
 UNION ALL SELECT * FROM (SELECT b.* FROM pick p JOIN best b ON b.rn = p.rn AND b.s = p.s AND b.i > p.j QUALIFY row_number() OVER (PARTITION BY b.rn, b.s ORDER BY b.i) = 1)),
ids AS (SELECT d.rn, any_value(doc_id) AS doc_id, string_agg(id, ',' ORDER BY s, i) AS sentences, coalesce(string_agg('<' || id || '>', '' ORDER BY s, i), '') AS q FROM d LEFT JOIN pick ON d.rn = pick.rn GROUP BY d.rn)
{steps}
SELECT doc_id, coalesce(sentences, '') AS sentences, array_to_string(list_transform(list_filter([{pairs}], lambda x, i: x IS NOT NULL AND list_position([{pairs}], x) = i), lambda x: x), ',') AS licenses,
       CAST(len(regexp_extract_all({left}, '<')) AS BIGINT) AS unmatched FROM r{len(license_scan.RULES) - 1}
"""


ORACLES["op7_license_scans"] = license_sql()


# The exact answer: at this size the approximate one must not differ from it.
ORACLES["op1_projected_neighbours"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query
def op13_de_bruijn_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def collocation_sql(least: int = 30, top: int = 2000) -> str:
    """Counts every run of one to four words directly."""
    runs = " UNION ALL ".join(f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS p FROM words" for m in (1, 2, 3, 4))
    part = "array_to_string(w[{}:{}], ' ')".format
    cuts = " UNION ALL ".join(f"SELECT lang, p, a, {k} AS k, {part(1, k)} AS x, {part(k + 1, 4)} AS y FROM kept WHERE m > {k}" for k in (1, 2, 3))
    subs = " UNION ALL ".join(f"SELECT lang, {part(i, i + m - 1)} AS p, a FROM cand WHERE m > {m} AND m >= {i + m - 1}" for m in (2, 3) for i in (1, 2, 3) if i + m <= 5)
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM d),
words AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(s, '[\\x20\\x09]+'), lambda y: y <> '') AS w FROM pieces),
f AS MATERIALIZED (SELECT lang, m, p, count(*) AS a FROM ({runs}) GROUP BY lang, m, p),
total AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM f WHERE a >= {least}),
cand AS MATERIALIZED (SELECT *, string_split(p, ' ') AS w FROM often WHERE m > 1),
subs AS ({subs}),
cover AS (SELECT lang, p, max(a) AS most FROM subs GROUP BY lang, p),
kept AS MATERIALIZED (SELECT c.* FROM cand c LEFT JOIN cover v ON c.lang = v.lang AND c.p = v.p WHERE v.most IS NULL OR 100 * v.most < 80 * c.a),
cuts AS ({cuts}),
scored AS (SELECT c.lang, c.p, c.a, c.k, fx.a AS l, fy.a AS r, (2000000::HUGEINT * c.a) // (fx.a + fy.a) AS score FROM cuts c JOIN often fx ON fx.lang = c.lang AND fx.p = c.x JOIN often fy ON fy.lang = c.lang AND fy.p = c.y),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM weakest)
SELECT placed.lang, CAST(rank AS BIGINT) AS rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM placed JOIN total ON total.lang = placed.lang WHERE rank <= {top}
"""


ORACLES["op13_de_bruijn_collocations"] = collocation_sql()


@query
def op11_voronoi_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return voronoi.nearest(table(spark, folder, "embeddings"))


ORACLES["op11_voronoi_top_k"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
             WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER () AS rn FROM v),
s AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM n q JOIN n c ON c.rn <> q.rn WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query
def op12_ball_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op12_ball_tree_search"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rn, doc_id, {TERMS} AS w FROM documents),
size AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
item AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS MATERIALIZED (SELECT DISTINCT i, item_id, t FROM (SELECT i, item_id, unnest({TERMS}) AS t FROM item)),
occ AS (SELECT rn, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
tf AS MATERIALIZED (SELECT rn, doc_id, n, t, count(*)::BIGINT AS tf FROM occ WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY t, docs),
x AS (SELECT rn, doc_id, tf.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS v FROM tf JOIN weight ON weight.t = tf.t, size),
s AS (SELECT i, item_id, rn, doc_id, sum(v)::BIGINT AS score FROM asked JOIN x ON x.t = asked.t GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE doc_id IS NOT NULL) WHERE rank <= 10
"""
