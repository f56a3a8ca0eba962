"""Reactions: relevance, selection under quotas, source windows, evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsudoi.functions import classify
from tsudoi.functions.text import WS, any_match, normalize_text, strip, title_exact_key, venue_key
from tsudoi.functions.urls import bare_host, host, path, same_site, scheme
from tsudoi.plans.ranking import top_k

# ---- relevance ------------------------------------------------------------------------------------


def word_tokens(c: Column, keep: str = "#") -> Column:
    parts = F.split(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}{keep}]+", " "), " ")
    return F.filter(parts, lambda t: F.char_length(t) >= 2)


def relevance_facts(events: DataFrame) -> DataFrame:
    """Per event, once: the forms of title and venue that every post or page is compared with."""
    step = events.withColumns({"_t": normalize_text(F.col("title")), "_v": normalize_text(F.col("venue"))})
    return step.select(
        F.col("id").alias("event_id"), F.col("title").alias("ev_title"), title_exact_key(F.col("_t")).alias("ev_exact"),
        F.array_distinct(word_tokens(F.col("title"), "")).alias("ev_words_page"),
        F.array_distinct(F.filter(word_tokens(F.col("title")), lambda t: ~t.rlike("^[0-9]{4}$"))).alias("ev_words"),
        F.col("venue").alias("ev_venue"), venue_key(F.col("_v")).alias("ev_venue_key"), F.col("area").alias("ev_area"),
        F.col("official_url").alias("ev_official"), F.col("source_url").alias("ev_source"),
        F.col("start_date").cast("timestamp").alias("ev_start"), F.coalesce("end_date", "start_date").cast("timestamp").alias("ev_end"))


def _overlap(text_tokens: Column, words: Column) -> Column:
    """Share of the title's words met in the text; repeats in the text count each time."""
    hits = F.size(F.filter(text_tokens, lambda t: F.array_contains(words, t)))
    return F.when((F.size(words) > 0) & (F.size(text_tokens) > 0), hits / F.size(words)).otherwise(0.0)


def _exact(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b))


def post_relevance(posts: DataFrame, events: DataFrame) -> DataFrame:
    """J14. Adds overlap, rel_score, relevance, rel_reasons to posts(event_id, text, created_at, urls array)."""
    step = posts.join(relevance_facts(events), "event_id").withColumns({
        "_n": normalize_text(F.col("text")), "_tok": word_tokens(F.col("text")), "_raw": strip(F.col("ev_title"))})
    step = step.withColumns({"_x": title_exact_key(F.col("_n")), "_pv": venue_key(F.col("_n"))})
    raw_hit = (F.char_length("_raw") >= 4) & F.contains(F.lower("text"), F.lower("_raw"))
    overlap = F.when(_exact(F.col("ev_exact"), F.col("_x")), 1.0).when(raw_hit, 0.95).otherwise(_overlap(F.col("_tok"), F.col("ev_words")))
    venue = (F.char_length("ev_venue_key") >= 2) & (F.contains("_pv", F.col("ev_venue_key")) | F.contains("text", strip(F.col("ev_venue"))))
    area = (F.col("ev_area") != "") & F.contains("text", F.col("ev_area"))
    hosts = F.array_compact(F.array(bare_host(F.col("ev_official")), bare_host(F.col("ev_source"))))
    link = F.exists("urls", lambda u: F.array_contains(hosts, bare_host(u)))
    dated = F.col("created_at").isNull() | F.col("ev_start").isNull() | F.col("created_at").between(
        F.col("ev_start") - F.expr("INTERVAL 14 DAYS"), F.col("ev_end") + F.expr("INTERVAL 7 DAYS"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    step = step.withColumns({"overlap": overlap, "_venue": yes(venue), "_area": yes(area), "_link": yes(link), "_dated": yes(dated)})
    score = (F.col("overlap") * 0.6 + F.when(F.col("_venue"), 0.25).otherwise(0.0) + F.when(F.col("_area"), 0.1).otherwise(0.0)
             + F.when(F.col("_link"), 0.35).otherwise(0.0) + F.when(F.col("_dated"), 0.05).otherwise(0.0))
    reasons = F.array_compact(F.array(F.when(F.col("overlap") >= 0.99, "title_exact").when(F.col("overlap") >= 0.4, "title_overlap"),
                                      F.when(F.col("_venue"), "venue"), F.when(F.col("_area"), "area"), F.when(F.col("_link"), "url_mention"), F.when(F.col("_dated"), "date_ok")))
    step = step.withColumns({"rel_score": score, "rel_reasons": reasons})
    s, o = F.col("rel_score"), F.col("overlap")
    level = (F.when((o >= 0.99) | (s >= 0.75), "exact").when((s >= 0.35) | ((o >= 0.35) & (F.size("rel_reasons") >= 2)), "likely")
             .when((s >= 0.15) | (o >= 0.2), "weak").otherwise("irrelevant"))
    return step.withColumn("relevance", level).select(*posts.columns, "overlap", "rel_score", "rel_reasons", "relevance")


def page_relevance(pages: DataFrame, events: DataFrame) -> DataFrame:
    """J15. Adds overlap, rel_score, relevance to pages(event_id, page_text, page_url, published_at)."""
    step = pages.join(relevance_facts(events), "event_id").withColumns({"_n": normalize_text(F.col("page_text")), "_tok": word_tokens(F.col("page_text"), "")})
    step = step.withColumns({"_x": title_exact_key(F.col("_n")), "_pv": venue_key(F.col("_n"))})
    overlap = F.when(_exact(F.col("ev_exact"), F.col("_x")), 1.0).otherwise(_overlap(F.col("_tok"), F.col("ev_words_page")))
    venue = (F.char_length("ev_venue_key") >= 2) & (F.col("_pv") != "") & (F.contains("_pv", F.col("ev_venue_key")) | F.contains("ev_venue_key", F.col("_pv")))
    dated = F.col("published_at").between(F.col("ev_start") - F.expr("INTERVAL 180 DAYS"), F.col("ev_end") + F.expr("INTERVAL 30 DAYS"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    step = step.withColumns({"overlap": overlap, "_venue": yes(venue), "_dated": yes(dated),
                             "_own": same_site(F.col("ev_official"), F.col("page_url")), "_src": same_site(F.col("ev_source"), F.col("page_url"))})
    score = (F.when(F.col("_own"), 0.55).otherwise(0.0) + F.when(F.col("_src"), 0.35).otherwise(0.0) + F.col("overlap") * 0.5
             + F.when(F.col("_venue"), 0.2).otherwise(0.0) + F.when(F.col("_dated"), 0.1).otherwise(0.0))
    s, o = score, F.col("overlap")
    any_reason = F.col("_own") | F.col("_src") | (o >= 0.4) | F.col("_venue") | F.col("_dated")
    level = (F.when(F.col("_own") | (o >= 0.99) | (s >= 0.75), "exact").when((s >= 0.35) | ((o >= 0.35) & any_reason), "likely")
             .when((s >= 0.15) | (o >= 0.2), "weak").otherwise("irrelevant"))
    return step.withColumns({"rel_score": score, "relevance": level}).select(*pages.columns, "overlap", "rel_score", "relevance")


def saveable(relevance: Column) -> Column:
    return relevance.isin("exact", "likely")


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """J16. Adds allowed: the longest matching prefix wins, a tie forbids, no rule allows.

    ``rules(origin, kind allow|disallow, prefix)``. A path is cut into those of its own prefixes whose lengths its origin
    has rules of, and these meet the rules by equality, one row a (origin, prefix): an origin with a third of all rules or
    all URLs is split like any other, and no list of rules is ever gathered. Each (origin, path) is judged once.
    """
    size = F.char_length("prefix")
    known = rules.where(size > 0).groupBy("origin", "prefix").agg(F.bool_or(F.col("kind") == "allow").alias("_allow"), F.bool_or(F.col("kind") == "disallow").alias("_forbid"))
    lengths = known.groupBy("origin").agg(F.collect_set(size).alias("_sizes"))  # numbers up to the longest prefix
    rows = urls.withColumns({"_origin": F.concat(scheme(F.col(url)), F.lit("://"), host(F.col(url))), "_path": path(F.col(url))})
    paths = rows.where(F.col("_path").isNotNull()).select(F.col("_origin").alias("origin"), "_path").distinct().join(lengths, "origin")
    own = F.transform(F.filter("_sizes", lambda n: n <= F.char_length("_path")), lambda n: F.substring("_path", F.lit(1), n))
    met = paths.select("origin", "_path", F.explode(own).alias("prefix")).join(known, ["origin", "prefix"])
    longest = lambda c: F.coalesce(F.max(F.when(F.col(c), size)), F.lit(-1))
    judged = met.groupBy(F.col("origin").alias("_origin"), "_path").agg(longest("_allow").alias("_a"), longest("_forbid").alias("_f"))
    fine = F.col("_f").isNull() | (F.col("_f") < 0) | (F.col("_a") > F.col("_f"))
    return rows.join(judged, ["_origin", "_path"], "left").withColumn("allowed", F.col("_path").isNotNull() & fine).select(*urls.columns, "allowed")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """J16. (origin, kind, prefix) of robots files(origin, text): the rules of the first group that names a part of the
    agent's name, else of the first group for everyone. Lines of a file are numbered; a line that names an agent starts a
    group unless it follows another such line; fields other than allow and disallow don't end the names."""
    line = strip(F.regexp_replace("line", "#.*$", ""))
    lines = files.select("origin", F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).where(F.contains(line, F.lit(":")))
    cut = lines.select("origin", "n", F.lower(strip(F.substring_index(line, ":", 1))).alias("field"), strip(F.regexp_replace(line, "^[^:]*:", "")).alias("value"))
    cut = cut.where(F.col("field").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("origin").orderBy("n")  # the lines of one file
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    grouped = cut.withColumn("_opens", opens.cast("int")).withColumn("_group", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_group > 0")
    name = F.lower("value")
    named = grouped.where("field = 'user-agent'").groupBy("origin").agg(
        F.min(F.when((name != "*") & F.contains(F.lit(agent.lower()), name), F.col("_group"))).alias("_own"), F.min(F.when(name == "*", F.col("_group"))).alias("_any"))
    mine = named.select("origin", F.coalesce("_own", "_any").alias("_group"))
    return grouped.where("field <> 'user-agent'").join(mine, ["origin", "_group"]).select("origin", F.col("field").alias("kind"), F.col("value").alias("prefix"))


def not_collected(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """J17."""
    return rows.join(stored.select(*keys).distinct(), keys, "left_anti")


# ---- selection ------------------------------------------------------------------------------------
# Stored posts per event, quota and order of the classes, read window of a run.
MAX_POSTS, QUOTAS = 20, {"experience": 12, "official": 2, "media": 2, "other": 4}
FIRST_READ, SECOND_READ, ENOUGH_VALID = 20, 10, 10
POST_COST = 0.005


def selection_score(rel_score: Column, relevance: Column, reasons: Column, cls: Column, announcement: Column, created_at: Column, now: Column) -> Column:
    """W11."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))) / 86_400_000_000.0
    has = lambda r: F.array_contains(reasons, r)
    return (rel_score * 10 + F.when(relevance == "exact", 3).otherwise(0) + F.when(cls == "experience", 8).when(cls.isin("official", "media"), 2).otherwise(0)
            - F.when(announcement, 6).otherwise(0) + F.when(has("title_exact"), 4).otherwise(0) + F.when(has("venue"), 2).otherwise(0)
            + F.when(has("url_mention"), 2).otherwise(0) + F.coalesce(F.greatest(F.lit(0.0), 2 - age / 3.5), F.lit(0.0)))


def read_window(posts: DataFrame, order: list[Column], valid: Column) -> DataFrame:
    """W13. The first 20 posts per event, and ten more only where fewer than ten of them are valid."""
    rows = top_k(posts.withColumn("_ok", valid), ["event_id"], order, FIRST_READ + SECOND_READ, "read_pos")
    enough = F.sum(F.when((F.col("read_pos") <= FIRST_READ) & F.col("_ok"), 1).otherwise(0)).over(Window.partitionBy("event_id"))
    return rows.withColumn("_n", enough).where((F.col("read_pos") <= FIRST_READ) | (F.col("_n") < ENOUGH_VALID)).drop("_n", "_ok")


def select_posts(scored: DataFrame, existing: DataFrame) -> DataFrame:
    """W12. Adds decision to scored(event_id, post_id, class, relevance, score).

    ``existing(event_id, post_id)`` are posts already stored; they use up slots. Winners are found with two
    limited ranks; the labels then come from a left join, so no event is gathered in one task."""
    have = existing.groupBy("event_id").agg(F.count(F.lit(1)).alias("_have"))
    seen = existing.select("event_id", "post_id", F.lit(True).alias("_seen")).distinct()
    rows = scored.join(seen, ["event_id", "post_id"], "left").join(have, "event_id", "left").withColumn(
        "_slots", F.greatest(F.lit(MAX_POSTS) - F.coalesce("_have", F.lit(0)), F.lit(0)))
    open_rows = rows.where(saveable(F.col("relevance")) & F.col("_seen").isNull() & (F.col("_slots") > 0))
    by_score = [F.col("score").desc(), F.col("post_id")]
    quota = F.create_map(*[F.lit(x) for kv in QUOTAS.items() for x in kv])
    order = F.array_position(F.array(*[F.lit(c) for c in QUOTAS]), F.col("class"))
    classed = top_k(open_rows, ["event_id", "class"], by_score, max(QUOTAS.values()), "_c").where(F.col("_c") <= quota[F.col("class")])
    picked = top_k(classed, ["event_id"], [order, F.col("_c")], MAX_POSTS, "_p").where(F.col("_p") <= F.col("_slots"))
    win = picked.select("event_id", "post_id", F.lit(True).alias("_win"))
    decision = (F.when(~saveable(F.col("relevance")), "skip_irrelevant").when(F.col("_seen"), "skip_duplicate").when(F.col("_slots") <= 0, "skip_cap")
                .when(F.col("_win"), "save").otherwise("skip_quota"))
    return rows.join(win, ["event_id", "post_id"], "left").withColumn("decision", decision).select(*scored.columns, "decision")


def cap_saves(rows: DataFrame, group: list[str], order: str, cap: int = 3, key: str = "row_id") -> DataFrame:
    """W14. Only the first ``cap`` 'save' rows of a run stay; the rest become skip_max_write."""
    kept = top_k(rows.where(F.col("decision") == "save"), group, [F.col(order), F.col(key)], cap, "_k").select(key, F.lit(True).alias("_kept"))
    return rows.join(kept, key, "left").withColumn("decision", F.when((F.col("decision") == "save") & F.col("_kept").isNull(), "skip_max_write")
                                                   .otherwise(F.col("decision"))).drop("_kept")


def recent_sources(sources: DataFrame, newest: int = 40, used: int = 20, minimum: int = 3, key: str = "id") -> DataFrame:
    """W15. Per event the newest sources, the first ``used`` with text, only where at least ``minimum`` remain:
    (event_id, n_sources, sources array in order)."""
    rows = top_k(sources, ["event_id"], [F.col("observed_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col(key)], newest, "_r")
    filled = top_k(rows.where(strip(F.col("excerpt")) != ""), ["event_id"], [F.col("_r")], used, "pos")
    return (filled.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_sort(F.collect_list(F.struct(
        "pos", "source_type", "observed_at", F.substring(strip(F.col("excerpt")), 1, 500).alias("excerpt"),
        classify.excerpt_class(F.col("source_type"), strip(F.col("excerpt")), F.col("source_name")).alias("class")))).alias("sources"))
        .where(F.col("n_sources") >= minimum))


def best_proposals(proposals: DataFrame) -> DataFrame:
    """W10. Per (event, field) the proposal with the best confidence and method; the first of equals."""
    rank = lambda c, words: F.array_position(F.array(*[F.lit(w) for w in words]), c)
    score = rank(F.col("confidence"), ("low", "medium", "high")) * 10 + rank(F.col("method"), ("ai_assist", "deterministic", "jsonld"))
    filled = proposals.where(strip(F.col("value")) != "")
    return top_k(filled.withColumn("_s", score), ["event_id", "field"], [F.col("_s").desc(), F.col("seq")], 1, "_r").drop("_s", "_r")


# Rank of the places an English title was found in.
TITLE_SOURCES = (("^en_alternate", 0), ("^og:title$", 1), ("^json-ld", 2), ("^twitter:title$", 3), ("^h1$", 4))


def english_title_choice(found: DataFrame, keep: int = 8) -> DataFrame:
    """W20. found(page_id, seq, source, value): English titles ranked by source; the best and the first eight."""
    rows = found.withColumn("value", classify.clean_title(F.col("value")))
    rows = rows.where(classify.looks_english(F.col("value"))).withColumn("_k", F.lower("value"))
    once = top_k(rows, ["page_id", "_k"], [F.col("seq")], 1, "_f")
    rank = F.lit(5)
    for pattern, r in reversed(TITLE_SOURCES):
        rank = F.when(F.col("source").rlike(pattern), r).otherwise(rank)
    best = top_k(once.withColumn("_rank", rank), ["page_id"], [F.col("_rank"), F.col("seq")], keep, "pos")
    return best.groupBy("page_id").agg(F.min_by("value", "pos").alias("title"), F.min_by("source", "pos").alias("source"),
                                       F.array_sort(F.collect_list(F.struct("pos", "value", "source"))).alias("candidates"))


# ---- evidence -------------------------------------------------------------------------------------
def relevance_report(scored: DataFrame) -> DataFrame:
    """A8. Per event: relevance and class counts, valid posts, cost of the posts read."""
    counts = [F.count_if(F.col("relevance") == r).alias(r) for r in ("exact", "likely", "weak", "irrelevant")]
    counts += [F.count_if(F.col("class") == c).alias("class_" + c) for c in QUOTAS]
    return scored.groupBy("event_id").agg(*counts, F.count_if(saveable(F.col("relevance"))).alias("valid"), (F.count(F.lit(1)) * POST_COST).alias("cost_usd"))


def source_counts(sources: DataFrame) -> DataFrame:
    """A9."""
    return sources.groupBy("event_id", "source_type", "class").agg(F.count(F.lit(1)).alias("n"))


CLASSES = ("experience", "official", "media", "other")


def theme_evidence(sources: DataFrame) -> DataFrame:
    """A10. (event_id, theme, experience, official, media, other) over sources(event_id, excerpt, class).

    The nine theme tests are flags of one row; only (event, theme, class) counts are shuffled."""
    hits = F.array_compact(F.array(*[F.when(classify.theme_counts_as_evidence(F.col("excerpt"), t), F.lit(t)) for t in classify.THEMES]))
    return sources.select("event_id", "class", F.explode(hits).alias("theme")).groupBy("event_id", "theme").agg(
        *[F.count_if(F.col("class") == c).alias(c) for c in CLASSES])


# Wording that makes a theme good or bad.
POSITIVE = {"crowd": "空いて|すいて|閑散|ゆったり|少人数|混んでいなかった", "wait_time": "待ち(が)?短|すぐ入れ|並ばず|スムーズ",
            "rain": "雨.*(楽し|大丈夫|問題ない)|雨天でも楽し|濡れず", "family": "子ども|子供|子連れ|家族.*(楽し|おすすめ)|親子",
            "photo": "写真.*(楽|撮|映)|撮れた|映え|撮影.*楽", "solo": "一人で.*(楽し|行け)|ソロ.*(楽し|おすすめ)|ひとりで.*(楽し)",
            "date": "デート.*(楽し|おすすめ)|カップル.*(楽し)"}
NEGATIVE = {"crowd": "混雑|混んで|人が多|人多|狭い|押し", "wait_time": "待ち(が)?長|長蛇|並んだ|行列|待った", "rain": "雨.*(残念|中止|厳し|濡れ)|雨で",
            "family": "子ども.*(向かない|厳しい)|子連れ.*(厳しい|難しい)", "photo": "撮れない|撮影禁止|写真.*(ダメ|禁止)", "solo": "一人.*(寂しい|向かない)",
            "date": "デート.*(向かない|微妙)"}
SIGNALS = ("crowd", "family", "date", "solo", "photo", "rain", "wait_time")


def theme_polarity(sources: DataFrame) -> DataFrame:
    """A11. (event_id, theme, polarity, n, pos, neg) from first-hand sources; fewer than two say nothing."""
    text = F.col("excerpt")
    flags = F.array_compact(F.array(*[F.when(any_match(text, classify.THEMES[t]), F.struct(
        F.lit(t).alias("theme"), any_match(text, POSITIVE[t]).cast("int").alias("pos"), any_match(text, NEGATIVE[t]).cast("int").alias("neg"))) for t in SIGNALS]))
    counts = (sources.where(F.col("class") == "experience").select("event_id", F.explode(flags).alias("f")).groupBy("event_id", F.col("f.theme").alias("theme"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("f.pos").alias("pos"), F.sum("f.neg").alias("neg")))
    n, pos, neg = F.col("n"), F.col("pos"), F.col("neg")
    polarity = (F.when(n < 2, "unknown").when((pos >= 1) & (neg >= 1), "mixed").when(pos >= 1, "positive").when(neg >= 1, "negative").otherwise("neutral"))
    return counts.withColumn("polarity", polarity)


CONFIDENCE = ("low", "medium", "high")


def confidence_cap(model: Column, n_sources: Column, n_experience: Column) -> Column:
    """The model's confidence, at most what the number of sources allows."""
    bound = F.when((n_sources < 5) | (n_experience < 3), 1).when((n_sources < 10) | (n_experience < 5), 2).otherwise(3)
    words = F.array(*[F.lit(c) for c in CONFIDENCE])
    return F.element_at(words, F.least(F.array_position(words, model).cast("int"), bound))


def recount(summaries: DataFrame, sources: DataFrame) -> DataFrame:
    """A13. source_count of every summary from the source rows."""
    n = sources.groupBy(F.col("summary_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return summaries.join(n, "id", "left").withColumn("source_count", F.coalesce("_n", F.lit(0))).drop("_n")
