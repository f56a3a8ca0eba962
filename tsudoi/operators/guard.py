"""Guard of model-written reaction summaries.

Bullets are rows (at most ten per event), evidence comes from the theme counts of the sources, and
every rule is a column. Only the last step, dropping near-copies among at most five kept bullets,
folds a small array per event.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions import classify
from tsudoi.functions.text import WS, any_match, let, strip
from tsudoi.operators.reactions import SIGNALS, confidence_cap, theme_evidence, theme_polarity
from tsudoi.plans.ranking import top_k
from tsudoi.session import cut_lineage

FEW_SOURCES, MAX_BULLETS, MAX_MODEL_BULLETS, NEAR_COPY = 10, 5, 10, 0.48
PRIORITY = ("enjoyment", "crowd", "wait_time", "family", "photo", "rain", "solo", "date", "recommended_time", "other")
# Wording the guard looks for.
WRAP_UP = "全体的に(は)?好意的|評判が良い|人気が高い|多くの人が楽し|好意的な反応が多い|参考情報として|満足度が高い"
VAGUE = "外出できなかった|外出は難し|もう一度訪れたい|日常|関係ない|ついでの話"
INDOOR_OUTDOOR = "室内|屋内|屋外|野外"
STRONG = ("全体的に|評判が良い|評判がいい|評判の良い|評判のいい|好評|人気|混雑している|混雑は少なめ|混雑は少ない|空いている|する人が多い|人が多い|来場者が多い|投稿が多い|"
          "という傾向がある|という傾向が見られる|傾向が見られます|傾向があります|多くの人(が|は)|みんな|必ず|絶対|推測される|はずです|に違いない|満足度が高い")
# Softer wording used while sources are few, applied in this order.
SOFTER = (("全体的に(は)?", "一部の投稿では"), ("評判が良い|評判がいい|評判の良い|評判のいい", "好意的な声もある"), ("好評(だ|です|との)?", "好意的な声がある"), ("人気(が高い|がある)?", "関心する声がある"),
          ("満足度が高い", "満足したという声がある"), ("混雑している", "混雑に触れた投稿がある"), ("混雑は少なめ|混雑は少ない", "混雑について触れた投稿がある"), ("空いている", "空いていたという投稿がある"),
          ("(する)?人が多い|来場者が多い|投稿が多い", "という投稿がある"), ("多くの人(が|は)", "一部の投稿では"), ("みんな(が|は)?", "一部では"),
          ("という傾向がある|という傾向が見られる|傾向が見られます|傾向があります", "という声が見られます"), ("推測される|はずです|に違いない", "という声があります"), ("多い", "ある"), ("というという", "という"))
JOY_ONE, JOY_SOME, JOY_TREND = "イベントを楽しめたという投稿があります。", "イベントを楽しんだという声が複数見られます。", "イベントを楽しめたという傾向が見られます。"
PHOTO_ONE, PHOTO_SOME = "写真撮影を楽しんだという投稿があります。", "写真撮影を楽しんだという声が複数見られます。"
RAIN_ONE, RAIN_SOME, RAIN_BAD = "雨天の体験に触れた投稿があります。", "雨天でも楽しめたという体験談があります。", "雨天の影響に触れた投稿が複数見られます。"
LOW_SOURCE_NOTE = "投稿数がまだ限られているため、参考情報としてご覧ください。"
# Spellings treated alike when near-copies are looked for.
ALIKE = (("[、。．！？!?\\s　・「」『』（）()]", ""), ("雨天(時|でも|にも関わらず)?|大雨|天気に関係なく|にも関わらず", "雨"), ("楽しめた|楽しんでいる|楽しん|楽しむ|楽しみ", "楽"),
         ("見られ|あります|ある|です|との|意見|体験談", ""), ("という|一部の|投稿|声|複数", ""))


def _replaced(c: Column, pairs) -> Column:
    for pattern, new in pairs:
        c = F.regexp_replace(c, pattern, new)
    return c


def soften(text: Column, n_sources: Column) -> Column:
    return F.when(n_sources >= FEW_SOURCES, text).otherwise(strip(_replaced(text, SOFTER)))


def rewrite(text: Column, evidence: Column, n_sources: Column, theme: Column) -> Column:
    """Wording that fits the number of first-hand sources behind a bullet."""
    few, joyful = n_sources < FEW_SOURCES, "楽し|面白|満足"

    def joy(s: Column) -> Column:
        bare = strip(F.regexp_replace(F.regexp_replace(s, "好評|評判が良い|全体的に満足", ""), f"{WS}+", " "))
        return let(bare, lambda b: F.when((evidence <= 1) & ~b.rlike("投稿があります|声が見られます|体験談") & b.rlike(joyful), JOY_ONE)
                   .when((evidence >= 2) & b.rlike(joyful) & text.rlike("多い|全体"), JOY_SOME).otherwise(b))

    def counted(s: Column) -> Column:
        single = _replaced(s, (("声が複数見られます", "投稿があります"), ("傾向が見られます", "投稿があります"), ("が多い", "がある")))
        several = F.when(few, F.regexp_replace(s, "傾向が見られます|傾向がある", "声が複数見られます")).otherwise(s)
        several = let(several, lambda v: F.when((evidence >= 2) & ~v.rlike("複数"), F.regexp_replace(v, "という投稿があります", "という声が複数見られます")).otherwise(v))
        return F.when(evidence <= 1, F.when(s.rlike("声が複数|傾向|が多い|多く"), single).otherwise(s)).when((evidence <= 4) | few, several).otherwise(s)

    first = let(soften(text, n_sources), lambda s: F.when((theme == "enjoyment") & few, joy(s)).otherwise(s))
    return F.substring(let(first, counted), 1, 120)


def near_copy_fold(bullets: Column) -> Column:
    """Keeps a bullet unless its bigram set is too close (Jaccard) to one already kept. For short arrays."""
    def grams(text: Column) -> Column:
        return let(_replaced(F.lower(text), ALIKE), lambda t: let(F.when(F.char_length(t) < 2, F.concat(t, F.lit("_"))).otherwise(t), lambda u: F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(u) - 1, F.lit(1))), lambda i: F.substring(u, i, F.lit(2))))))

    def close(a: Column, b: Column) -> Column:
        inter = F.size(F.array_intersect(a, b))
        return (F.size(a) > 0) & (F.size(b) > 0) & (inter / (F.size(a) + F.size(b) - inter) >= NEAR_COPY)

    withg = F.transform(bullets, lambda b: F.struct(b.alias("b"), grams(b.text).alias("g")))
    empty = F.filter(withg, lambda x: F.lit(False))
    kept = F.aggregate(withg, empty, lambda acc, x: F.when(F.exists(acc, lambda k: close(k.g, x.g)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: x.b)


def one_per_theme(bullets: DataFrame, limit: int = MAX_BULLETS) -> DataFrame:
    """Per event and theme the bullet with most evidence, then at most ``limit`` in theme priority."""
    best = top_k(bullets, ["event_id", "theme"], [F.col("evidence").desc(), F.col("pos")], 1, "_t").drop("_t")
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("theme"))
    return top_k(best.withColumn("_p", rank), ["event_id"], [F.col("_p")], limit, "slot").drop("_p")


def evidence_of(sources: DataFrame) -> DataFrame:
    """Per event: number of sources, first-hand sources, first-hand count per theme, indoor/outdoor mention, rain polarity."""
    base = sources.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(F.col("class") == "experience").alias("n_experience"),
                                           F.bool_or(any_match(F.col("excerpt"), INDOOR_OUTDOOR)).alias("mentions_room"))
    themes = theme_evidence(sources).groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("theme", "experience"))).alias("exp"))
    polarity = theme_polarity(sources).groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("theme", "polarity"))).alias("polarity"))
    return base.join(themes, "event_id", "left").join(polarity, "event_id", "left")


def judged_bullets(model: DataFrame, facts: DataFrame) -> DataFrame:
    """Model bullets with reconciled theme, evidence and drop reason (null = kept). ``cited`` holds excerpts the
    model pointed at, if any."""
    listed = F.slice(F.filter("bullets", lambda b: strip(b.text) != ""), 1, MAX_MODEL_BULLETS)
    rows = model.join(facts, "event_id", "left").select("event_id", "n_sources", "exp", "mentions_room", F.posexplode(listed).alias("pos", "b"))
    rows = rows.withColumns({"text": F.substring(strip(F.col("b.text")), 1, 120), "n_sources": F.coalesce("n_sources", F.lit(0))})
    rows = rows.withColumns({"inferred": classify.bullet_theme(F.col("text")), "given": F.col("b.theme")})
    theme = F.when(~F.coalesce(F.col("given").isin(*classify.THEME_ORDER), F.lit(False)), F.col("inferred")).otherwise(F.col("given"))
    rows = rows.withColumns({"theme": theme, "_base": theme})
    specific = (F.col("inferred") != "other") & F.col("theme").isin("other", "enjoyment")
    rows = rows.withColumn("theme", F.when(specific, F.col("inferred")).otherwise(F.col("theme")))
    exp = F.coalesce(F.col("exp")[F.col("theme")], F.lit(0))
    said = F.coalesce(F.when(F.col("b.evidence_count") > 0, F.col("b.evidence_count").cast("int")), F.lit(1))
    rows = rows.withColumns({"first_hand": exp, "_said": said.cast("int"), "evidence": F.when((F.col("theme") != "other") & (exp > 0), exp).otherwise(said).cast("int")})
    t, th, few = F.col("text"), F.col("theme"), F.col("n_sources") < FEW_SOURCES
    cited = F.coalesce(F.col("b.cited"), F.array().cast("array<string>"))
    reason = (F.when(few & any_match(t, WRAP_UP), "wrap_up").when(any_match(t, VAGUE) | classify.is_peripheral(t), "peripheral")
              .when(any_match(t, classify.EXCLUDED_TOPICS) & ~any_match(t, classify.VISIT_CRITICAL), "excluded_topic")
              .when((th == "enjoyment") & ~classify.valid_enjoyment(t), "peripheral")
              .when((F.size(cited) > 0) & F.forall(cited, classify.is_peripheral), "peripheral")
              .when((th == "other") & ~any_match(t, classify.VISIT_CRITICAL), "other")
              .when(any_match(t, INDOOR_OUTDOOR) & ~F.coalesce("mentions_room", F.lit(False)), "room_not_in_sources")
              .when(~th.isin("other", "recommended_time") & (F.col("first_hand") < 1), "no_first_hand"))
    rows = rows.withColumns({"drop_reason": reason, "_raw": t})
    rows = rows.withColumn("text", F.when(F.col("drop_reason").isNull(), rewrite(t, F.col("evidence"), F.col("n_sources"), th)).otherwise(t))
    some = F.col("evidence") >= 2
    no_photo_words = F.regexp_replace("text", "写真|フォト|撮っ|撮影", "")
    normal = (F.when((th == "photo") & any_match(F.col("text"), classify.THEMES["rain"]), F.when(some, PHOTO_SOME).otherwise(PHOTO_ONE))
              .when((th == "rain") & any_match(F.col("text"), classify.THEMES["photo"]) & ~any_match(no_photo_words, classify.THEMES["rain"]), F.when(some, RAIN_SOME).otherwise(RAIN_ONE))
              .otherwise(F.col("text")))
    rows = rows.withColumns({"_soft": F.col("text"), "text": F.when(F.col("drop_reason").isNull(), normal).otherwise(F.col("text"))})
    strong = F.col("drop_reason").isNull() & few & any_match(F.col("text"), STRONG)
    open_, known = F.col("drop_reason").isNull(), th != "other"
    step = lambda n, cond, *words: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("step"), F.concat(*[w if isinstance(w, Column) else F.lit(w) for w in words]).alias("action")))
    log = F.array_compact(F.array(
        step(1, (F.col("_base") == "enjoyment") & (th != "enjoyment"), "theme_reconcile_", F.col("_base"), "_to_", th),
        step(2, known & (F.col("first_hand") > 0) & (F.col("_said") > F.col("first_hand")), "evidence_capped_", th),
        step(2, known & (F.col("first_hand") > 0) & (F.col("_said") < F.col("first_hand")), "evidence_raised_", th),
        step(2, known & (F.col("first_hand") == 0) & (th != "enjoyment"), "no_experience_evidence_", th),
        step(3, ~open_, "drop_", F.col("drop_reason")), step(4, open_ & (F.col("_soft") != F.col("_raw")), "soften_bullet"),
        step(5, open_ & (F.col("text") != F.col("_soft")), "normalize_", th, "_bullet"), step(6, strong, "drop_strong_phrase")))
    rows = rows.withColumn("log", log)
    return rows.withColumn("drop_reason", F.when(strong, "strong_phrase").otherwise(F.col("drop_reason"))).select("event_id", "pos", "text", "theme", "evidence", "drop_reason", "log")


def _injected(model: DataFrame, facts: DataFrame, kept: DataFrame) -> DataFrame:
    """Plain bullets for enjoyment, rain and photo where first-hand sources support them and none is left."""
    have = kept.groupBy("event_id").agg(F.collect_set("theme").alias("_have"))
    rows = model.select("event_id").join(facts, "event_id").join(have, "event_id", "left")
    lacks = lambda t: ~F.array_contains(F.coalesce("_have", F.array().cast("array<string>")), t)
    n = lambda t: F.coalesce(F.col("exp")[t], F.lit(0))
    joy = F.when(n("enjoyment") >= 2, F.when(F.col("n_sources") < FEW_SOURCES, JOY_SOME).otherwise(JOY_TREND)).when(n("enjoyment") == 1, JOY_ONE)
    rain = F.when(n("rain") >= 2, F.when(F.coalesce(F.col("polarity")["rain"], F.lit("")) == "negative", RAIN_BAD).otherwise(RAIN_SOME))
    photo = F.when(n("photo") >= 2, PHOTO_SOME).when(n("photo") == 1, PHOTO_ONE)
    items = [F.when(lacks(t) & text.isNotNull(), F.struct(F.lit(100 + i).alias("pos"), text.alias("text"), F.lit(t).alias("theme"), n(t).cast("int").alias("evidence")))
             for i, (t, text) in enumerate((("enjoyment", joy), ("rain", rain), ("photo", photo)))]
    return rows.select("event_id", F.explode(F.array_compact(F.array(*items))).alias("x")).select("event_id", "x.*")


def _signal(key: str) -> tuple[Column, Column, Column]:
    """What the model said of a signal, the first-hand posts on it, and the polarity of the sources."""
    said = F.coalesce(F.when(F.col("signals")[key].isin("positive", "negative", "mixed", "neutral", "unknown"), F.col("signals")[key]), F.lit("unknown"))
    return said, F.coalesce(F.col("exp")[key], F.lit(0)), F.coalesce(F.col("polarity")[key], F.lit("unknown"))


def _opposite(said: Column, derived: Column) -> Column:
    return ((said == "positive") & (derived == "negative")) | ((said == "negative") & (derived == "positive"))


def _aligned(key: str) -> Column:
    """One signal: model polarity against first-hand evidence."""
    said, n, derived = _signal(key)
    clear = said.isin("positive", "negative", "mixed")
    return (F.when(n < 2, F.when(clear | (n < 1), "unknown").otherwise(said)).when(said == "unknown", F.when(derived == "unknown", "neutral").otherwise(derived))
            .when(clear & (_opposite(said, derived) | (derived == "mixed")), "mixed").otherwise(said))


def _guarded(model: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M19. The judged bullets, the pool that one bullet a theme is chosen from, and a row for each event with the chosen
    bullets (_b), those left after near copies went (_clean), the evidence for the recommended time (_rec) and the facts."""
    # both are read several times below and are small: a row per event, at most ten bullets each
    facts = cut_lineage(evidence_of(sources))
    judged = cut_lineage(judged_bullets(model, facts))
    kept = judged.where(F.col("drop_reason").isNull()).drop("drop_reason", "log")
    pool = kept.unionByName(_injected(model, facts, kept))
    lists = one_per_theme(pool).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("slot", "text", "theme", "evidence"))).alias("_b"))
    out = model.join(facts, "event_id", "left").join(lists, "event_id", "left")
    rec_first = F.coalesce(F.col("exp")["recommended_time"], F.lit(0))
    none = F.array().cast("array<struct<slot:int,text:string,theme:string,evidence:int>>")
    out = out.withColumns({"_b": F.coalesce("_b", none), "_rec": F.least(rec_first, F.coalesce("recommended_evidence", rec_first))})
    return judged, pool, out.withColumn("_clean", near_copy_fold(F.col("_b")))


def _confidence() -> tuple[Column, Column]:
    given = F.when(F.col("confidence").isin("low", "medium", "high"), F.col("confidence")).otherwise("low")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return given, confidence_cap(given, zero(F.col("n_sources")), zero(F.col("n_experience")))


def guard_summaries(model: DataFrame, sources: DataFrame) -> DataFrame:
    """M19. model(event_id, bullets array<struct<text,theme,evidence_count,cited>>, signals map, recommended_time,
    recommended_evidence, confidence) checked against sources(event_id, excerpt, class)."""
    _, _, out = _guarded(model, sources)
    note = F.array(F.struct(F.lit(1).alias("slot"), F.lit(LOW_SOURCE_NOTE).alias("text"), F.lit("other").alias("theme"), F.lit(0).alias("evidence")))
    out = out.withColumn("_kept", F.when(F.size("_clean") > 0, F.col("_clean")).otherwise(note))
    bullets = F.filter("_kept", lambda b: (F.col("_rec") >= 2) | (b.theme != "recommended_time"))
    return out.select(
        "event_id", F.transform(bullets, lambda b: b.text).alias("bullets"), F.transform(bullets, lambda b: b.theme).alias("themes"),
        F.create_map(*[x for k in SIGNALS for x in (F.lit(k), _aligned(k))]).alias("signals"),
        F.when(F.col("_rec") >= 2, F.nullif(F.substring(strip(F.col("recommended_time")), 1, 40), F.lit(""))).alias("recommended_time"),
        _confidence()[1].alias("confidence"))


def guard_actions(model: DataFrame, sources: DataFrame) -> DataFrame:
    """M19. (event_id, step, action, n): what the guard did to a summary, in order of its steps, each action once with how
    often it was taken: 1 theme, 2 evidence, 3 drop, 4 soften, 5 normalise, 6 strong phrase, 7 inject, 8 one bullet a theme,
    9 near copies, 10 low-source note, 11 signals, 12 recommended time, 13 confidence."""
    judged, pool, out = _guarded(model, sources)
    told = judged.select("event_id", F.explode("log").alias("x")).select("event_id", "x.step", "x.action")
    injected = pool.where("pos >= 100").select("event_id", F.lit(7).alias("step"), F.concat(F.lit("inject_"), "theme", F.lit("_bullet"), F.when(F.col("evidence") == 1, "_single").otherwise("")).alias("action"))
    doubles = pool.groupBy("event_id", "theme").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    doubles = doubles.select("event_id", F.lit(8).alias("step"), F.concat(F.lit("drop_duplicate_theme_"), "theme").alias("action"), F.explode(F.sequence(F.lit(2), "_n"))).drop("col")
    item = lambda n, cond, action: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("step"), action.alias("action")))
    items = [item(10, F.size("_clean") == 0, F.lit("fallback_low_source_note"))]
    for key in SIGNALS:
        said, n, derived = _signal(key)
        clear, enough = said.isin("positive", "negative", "mixed"), n >= 2
        name = lambda end: F.concat(F.lit(f"signal_{key}_"), end)
        items += [item(11, ~enough & clear, name(F.concat(F.lit("cleared_low_experience_"), n.cast("string")))), item(11, enough & (said == "unknown"), name(F.lit("aligned_from_evidence"))),
                  item(11, enough & _opposite(said, derived), name(F.lit("conflict_mixed"))), item(11, enough & said.isin("positive", "negative") & (derived == "mixed"), name(F.lit("aligned_mixed")))]
    thin, (given, capped) = F.col("_rec") < 2, _confidence()
    shown = F.coalesce(F.nullif(strip(F.col("recommended_time")), F.lit("")).isNotNull(), F.lit(False))
    items += [item(12, thin & shown, F.lit("recommended_time_cleared")), item(12, thin & F.exists("_clean", lambda b: b.theme == "recommended_time"), F.lit("drop_recommended_time_bullet")),
              item(13, given != capped, F.concat(F.lit("confidence_capped_"), given, F.lit("_to_"), capped))]
    copies = F.transform(F.sequence(F.lit(1), F.size("_b") - F.size("_clean")), lambda _: F.struct(F.lit(9).alias("step"), F.lit("dedupe_bullets").alias("action")))
    every = F.concat(F.array_compact(F.array(*items)), F.when(F.size("_b") > F.size("_clean"), copies).otherwise(F.array().cast("array<struct<step:int,action:string>>")))
    whole = out.select("event_id", F.explode(every).alias("x")).select("event_id", "x.step", "x.action")
    return told.unionByName(injected).unionByName(doubles).unionByName(whole).groupBy("event_id", "step", "action").agg(F.count(F.lit(1)).alias("n"))


# Polarity to stored signal; the crowd mapping is the source system's own.
CROWD_LEVEL = {"positive": "high", "negative": "low", "mixed": "medium"}
WAIT_LEVEL = {"positive": "short", "negative": "long", "mixed": "medium"}


def stored_signals(signals: Column, crowd: dict = CROWD_LEVEL, wait: dict = WAIT_LEVEL) -> Column:
    """Polarity map to the stored struct."""
    table = lambda t, k: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])[signals[k]]
    flag = lambda k: F.when(signals[k] == "positive", True).when(signals[k] == "negative", False)
    return F.struct(table(crowd, "crowd").alias("crowd_level"), *[flag(k).alias(k) for k in ("family", "date", "solo", "photo", "rain")], table(wait, "wait_time").alias("wait_time"))


SIGNAL_SCHEMA = "struct<crowd_level:string,family:boolean,date:boolean,solo:boolean,photo:boolean,rain:boolean,wait_time:string,recommended_time:string>"


def parse_signals(json: Column) -> Column:
    """Stored JSON to the struct; unknown words and wrong types become null."""
    s = F.from_json(json, SIGNAL_SCHEMA)
    return F.struct(F.when(s.crowd_level.isin("high", "medium", "low"), s.crowd_level).alias("crowd_level"), s.family.alias("family"), s.date.alias("date"), s.solo.alias("solo"),
                    s.photo.alias("photo"), s.rain.alias("rain"), F.when(s.wait_time.isin("long", "medium", "short"), s.wait_time).alias("wait_time"),
                    F.nullif(F.substring(strip(s.recommended_time), 1, 40), F.lit("")).alias("recommended_time"))


# Public labels of the stored signals.
SIGNAL_LABELS = (("crowd_level", "high", "混雑傾向"), ("crowd_level", "medium", "やや混雑"), ("crowd_level", "low", "比較的ゆったり"), ("family", True, "家族で楽しむ"), ("date", True, "デート"),
                 ("solo", True, "一人でも"), ("photo", True, "写真"), ("rain", True, "雨の日"), ("wait_time", "long", "待ち時間長め"), ("wait_time", "medium", "待ち時間あり"), ("wait_time", "short", "待ち時間短め"))


def signal_labels(s: Column) -> Column:
    """Labels shown to readers; unknown and negative facts show nothing."""
    return F.array_compact(F.array(*[F.when(s[k] == F.lit(v), F.lit(label)) for k, v, label in SIGNAL_LABELS]))
