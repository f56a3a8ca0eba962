"""Schedules, matching and related events against brute force and hand-made cases."""
import datetime as dt
import random

from pyspark.sql import functions as F

from tsudoi.functions.dates import day
from tsudoi.operators import listing, match, related, schedule
from tsudoi.plans.ranking import global_position, run_numbers

C = F.col
D = dt.date
SESSION = "event_id long, start_date date, end_date date, start_time string, end_time string"
PARENT = "id long, slug string, status string, start_date date, end_date date, start_time string, area string, municipality string, category array<string>"


def parents(spark, rows):
    return spark.createDataFrame([(i, f"s{i}", st, s, e, t, a, m, c) for i, st, s, e, t, a, m, c in rows], PARENT)


def test_merge_and_status(spark):
    s = spark.createDataFrame([(1, D(2026, 8, 1), D(2026, 8, 2), None, None), (1, D(2026, 8, 3), None, "9:00", None), (1, D(2026, 8, 10), D(2026, 8, 9), "10:00", None),
                               (2, D(2026, 8, 1), D(2026, 8, 20), None, None), (2, D(2026, 8, 5), D(2026, 8, 6), None, None), (4, None, D(2026, 8, 6), None, None)], SESSION)
    got = {(r.event_id, str(r.span_start), str(r.span_end)) for r in schedule.merge_spans(s).collect()}
    assert got == {(1, "2026-08-01", "2026-08-03"), (1, "2026-08-10", "2026-08-10"), (2, "2026-08-01", "2026-08-20")}
    p = parents(spark, [(i, "published", D(2026, 7, 1), D(2026, 9, 1), "18:00", None, None, None) for i in (1, 2, 3, 4)] + [(5, "published", None, None, None, None, None, None)])
    facts = {r.id: (r.schedule_status, str(r.next_date)) for r in schedule.with_schedule(p, s, day("2026-08-05")).collect()}
    # 1 is in a gap, 3 and 4 fall back to the parent (4 has only an unusable session), 5 has no dates
    assert facts == {1: ("upcoming", "2026-08-10"), 2: ("today", "2026-08-05"), 3: ("today", "2026-08-05"), 4: ("today", "2026-08-05"), 5: (None, "None")}
    clocks = {r.id: r.clock for r in schedule.clock_on_day(p.withColumn("d", day("2026-08-03")), s, "d").collect()}
    assert clocks == {1: "09:00", 2: None, 3: "18:00", 4: None, 5: None}
    order = [r.id for r in listing.explore(p, s, day("2026-08-05")).orderBy("pos").collect()]
    assert order == [3, 2, 4, 1, 5]


def test_timed_groups(spark):
    rows = [(1, D(2026, 8, d), D(2026, 8, d), t, None) for d in range(1, 11) for t in ("10:00", "9:00")] + [(2, D(2026, 8, 1), D(2026, 8, 3), None, None)] * 2
    got = {r.event_id: r for r in schedule.timed_groups(spark.createDataFrame(rows, SESSION)).collect()}
    assert (len(got[1].groups), got[1].hidden, got[1].has_clock, got[1].parent_clock_ok) == (8, 2, True, False)
    assert [c.start_clock for c in got[1].groups[0].clocks] == ["09:00", "10:00"]
    assert (got[2].groups[0].shown, got[2].hidden, got[2].parent_clock_ok) == (2, 0, False)


def test_positions_by_ranges(spark):
    """A third of the rows on one day, ids a million apart: every range stays small."""
    rows = [(i * 1_000_003, "hot" if i % 3 == 0 else f"d{i % 50:02d}", None if i % 7 == 0 else i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, day string, h int")
    out = global_position(df, ["day", "h", "id"], parts=8)
    got = {r.id: r.pos for r in out.collect()}
    assert got == {i: n + 1 for n, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[0])))}
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 2 * len(rows) / 8 and out.columns == ["id", "day", "h", "pos"]
    assert global_position(df.limit(0), ["day", "id"]).count() == 0


def test_positions_survive_hot_groups(spark):
    rows = [(i, "a" if i % 3 else "b", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, h int")
    got = {r.id: r.pos for r in global_position(df, ["g", "h", "id"], parts=7).collect()}
    assert got == {i: n + 1 for n, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))}
    keys = [random.Random(1).choice("xy") for _ in range(100)]
    runs = run_numbers(spark.createDataFrame([(0, i, k) for i, k in enumerate(keys)], "l int, pos long, k string"), ["l"], "pos", "k", "n", block=9)
    n, want = 0, []
    for i, k in enumerate(keys):
        n += i == 0 or k != keys[i - 1]
        want.append(n)
    assert [r.n for r in runs.orderBy("pos").collect()] == want


CAND = "seq long, title string, start_date date, end_date date, venue string, area string, official_url string, source_url string"
POOL = "id long, title string, start_date date, end_date date, venue string, area string, official_url string, source_url string"


def test_match_cascade(spark):
    d = lambda m, x: D(2026, m, x)
    park = "国営昭和記念公園"
    pool = [(1, "「ユマニチュード®」家族介護者向け講座", d(10, 3), d(10, 3), "介護予防総合センター（みなとパーク芝浦2階）", "minato", "https://e.com/1", "https://s.com/1"),
            (2, "語り部ガイド養成講座", d(9, 27), None, "芝区民協働スペース", "shibuya", "https://e.com/2", "https://s.com/2"),
            (3, "オクトーバーフェストin東京スカイツリータウン 2026", d(9, 19), d(10, 26), "東京スカイツリータウン", "sumida", "https://e.com/3", "https://s.com/3"),
            (4, "コスモスまつり2026", d(9, 12), d(10, 26), park, "minato", "https://www.e.com/4/", "https://s.com/4")]
    cand = [(10, "第37回フランス料理昼食会", d(11, 12), d(11, 12), "介護予防総合センター（みなとパーク芝浦2階）", "minato", "https://c.com/10", "https://t.com/10"),
            (11, "スマホ講座", d(10, 1), None, "芝区民協働スペース", "minato", None, "https://t.com/11"),
            (12, "オクトーバーフェストin東京スカイツリータウン 2026", d(9, 19), d(10, 26), "東京スカイツリータウン", "sumida", None, None),
            (13, "コスモスまつり2026 秋の特別版", d(9, 12), d(10, 26), park, None, None, None), (14, "コスモスまつり2026", d(11, 1), d(11, 3), park, None, None, None),
            (15, "コスモスまつり2026", d(9, 12), d(10, 26), "別の公園", None, None, None), (16, "コスモスまつり2026 秋の特別版", d(9, 12), d(10, 26), "別の公園", None, None, None),
            (17, "別の名前", None, None, None, None, "http://e.com/4?utm_source=x", None), (18, "別の名前", None, None, None, None, None, "https://s.com/2/"), (19, "コスモスまつり2026 秋の特別版", d(9, 12), None, None, None, None, None)]
    out = {r.seq: r for r in match.decide(spark.createDataFrame(cand, CAND), match.match_pool(spark.createDataFrame(pool, POOL))).collect()}
    status = {k: (r.duplicate_status, r.matched_id, r.tier) for k, r in out.items()}
    assert status == {10: ("none", None, None), 11: ("none", None, None), 12: ("exact", 3, 3), 13: ("likely", 4, 4), 14: ("ambiguous", 4, 7), 15: ("exact", 4, 3), 16: ("ambiguous", 4, 6),
                      17: ("exact", 4, 1), 18: ("exact", 2, 2), 19: ("likely", 4, 5)}
    assert out[14].action == "review_required" and out[12].confidence == 0.98


def test_blocking_loses_no_pair(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("あいうえおabcde") for _ in range(rnd.randint(1, 14))) for _ in range(60)]
    def edit(s):
        i = rnd.randrange(len(s) + 1)
        return rnd.choice((s[:i] + rnd.choice("xyz") + s[i:], s[:i] + s[i + 1:], s + " 夏", s[: max(1, len(s) // 2)], s))
    left, right = sorted(set(base) | {edit(s) for s in base}), sorted({edit(s) for s in base} | set(base[:20]))
    frame = lambda xs: spark.createDataFrame([(x.strip(),) for x in xs if x.strip()], "key string").distinct()
    got = {(r.a, r.b): round(r.sim, 9) for r in match.similar_keys(frame(left), frame(right)).collect()}
    from tsudoi.functions.text import string_similarity
    pairs = frame(left).select(C("key").alias("a")).join(frame(right).select(C("key").alias("b")), F.lit(True))
    want = {(r.a, r.b): round(r.s, 9) for r in pairs.withColumn("s", string_similarity(C("a"), C("b"))).where("s >= 0.72").collect()}
    assert got == want and len(want) > 60


KEYED = "seq long, title_key string, start_date date, official_key string, source_key string, core string, year string, edition string"


def in_batch(spark, rows):
    df = spark.createDataFrame([(*r, r[1], None, None) for r in rows], KEYED)
    dec = df.select("seq", F.lit("none").alias("duplicate_status"))
    return {r.seq: (r.leader, r.tier) for r in match.attach_within_batch(df, dec).collect()}


def test_in_batch_leaders(spark):
    rows = [(1, "aaa", D(2026, 1, 1), "o1", "s1"), (2, "bbb", D(2026, 1, 2), None, "s1"), (3, "bbb", D(2026, 1, 2), None, "s3"), (4, "ccc", None, None, "s4"), (5, "ddd", D(2026, 1, 5), "o1", None)]
    # 3 matches only 2, which is no draft
    assert in_batch(spark, rows) == {1: (1, None), 2: (1, 2), 3: (3, None), 4: (4, None), 5: (1, 1)}


def test_in_batch_chain_and_hot_key(spark):
    chain = [(i, f"t{i:03d}x{i * 7919 % 1000:03d}", None, f"k{i}", None) for i in range(1, 61)]
    chain = [(i, title, None, o, f"s{i}") for i, title, _, o, _ in chain]
    links = [(i, title, None, f"k{(i + 1) // 2}" if i % 2 else f"k{i // 2}", f"s{i // 2}") for i, title, _, _, _ in chain]  # 1-2 by official, 2-3 by source, 3-4 by official, ...
    got = in_batch(spark, links)
    assert all(got[i][0] == (i if i % 2 else i - 1) for i in got)
    hot = in_batch(spark, [(i, f"q{i * 7919 % 10007}", None, "same", None) for i in range(1, 200)])
    assert all(leader == 1 for leader, _ in hot.values())


def test_in_batch_similar_titles(spark):
    got = in_batch(spark, [(1, "summer festival tokyo", D(2026, 1, 1), None, None), (2, "summer festival tokyoo", D(2026, 3, 1), None, None), (3, "winter market", None, None, None), (4, "summer festivall tokyoo", None, None, None)])
    assert got == {1: (1, None), 2: (1, 7), 3: (3, None), 4: (1, 7)}


def in_turn(rows, sim):
    """The plain loop: each row against the drafts made so far; without venues, alike titles on one day are likely (5)."""
    drafts, out = [], {}
    for seq, title, start, o, s in rows:
        hits = [(t, score, d[0]) for d in drafts for t, score, same in (
            (1, 0, o and d[3] == o), (2, 0, s and d[4] == s), (3, 0, start and d[2] == start and d[1] == title),
            (5, -sim[title, d[1]], start and d[2] == start and sim[title, d[1]] >= 0.82), (7, -sim[title, d[1]], sim[title, d[1]] >= 0.72)) if same]
        out[seq] = (min(hits)[2], min(hits)[0]) if hits else (seq, None)
        if not hits:
            drafts.append((seq, title, start, o, s))
    return out


def test_in_batch_equals_loop(spark):
    from tsudoi.functions.text import string_similarity
    r = random.Random(11)
    words = ["quartz hall", "umbrella", "fjord trip", "zigzag", "melody", "oxygen bar", "pyramids", "kiwi fruit", "quartz halls", "melodys", "fjord trips"]
    for _ in range(2):
        rows = [(i, r.choice(words) + r.choice(["", "", f" {chr(97 + i % 26) * 9}"]), r.choice([None, D(2026, 1, r.randrange(1, 5))]), r.choice([None, None, f"o{r.randrange(25)}"]),
                 r.choice([None, None, f"s{r.randrange(25)}"])) for i in range(1, 60)]
        titles = spark.createDataFrame([(t,) for t in sorted({x[1] for x in rows})], "a string")
        pairs = titles.join(titles.select(C("a").alias("b")), F.lit(True)).withColumn("s", string_similarity(C("a"), C("b"))).collect()
        sim = {(p.a, p.b): 1.0 if p.a == p.b else p.s for p in pairs}
        assert in_batch(spark, rows) == in_turn(rows, sim)


def test_gap_before_1970(spark):
    start = D(1970, 1, 1)
    ev = spark.createDataFrame([(1, "a", None, ["x"]), (2, "a", None, ["x"])], "id long, area string, municipality string, category array<string>")
    for first in (-3655, 3653):
        sp = spark.createDataFrame([(1, start + dt.timedelta(first), start + dt.timedelta(first)), (2, start + dt.timedelta(first + 2), start + dt.timedelta(first + 2))], "event_id long, span_start date, span_end date")
        assert {(r.source_id, r.gap_days) for r in related.related_events(ev, ev, sp, limit=6).collect()} == {(1, 2), (2, 2)}


def test_held_between_equals_merged_spans(spark):
    r = random.Random(2)
    ev = spark.createDataFrame([(i, D(2026, 1, r.randrange(1, 28)) if i % 3 else None, None if i % 4 else D(2026, 1, 28)) for i in range(40)], "id long, start_date date, end_date date")
    se = spark.createDataFrame([(r.randrange(30), D(2026, 1, r.randrange(1, 28)) if r.random() < 0.9 else None, D(2026, 1, r.randrange(1, 28)) if r.random() < 0.6 else None) for _ in range(90)],
                               "event_id long, start_date date, end_date date")
    spans = schedule.effective_spans(ev, se)
    for d in (1, 9, 20):
        today = F.lit(D(2026, 1, d))
        assert sorted(x.id for x in schedule.held_between(ev, se, today, today).collect()) == sorted(x.event_id for x in schedule.on_day(spans, today).collect())
        want = {x.event_id: (x.schedule_status, x.next_date) for x in schedule.schedule_facts(spans, today).collect()}
        assert {x.id: (x.schedule_status, x.next_date) for x in schedule.with_schedule(ev, se, today).collect() if x.schedule_status} == want


def test_related_equals_brute_force(spark):
    rnd = random.Random(9)
    events = [(i, rnd.choice(["ueno", "ginza", None]), rnd.choice(["taito", "chuo", None]), rnd.sample(["food", "kids", "music", "other"], rnd.randint(0, 2))) for i in range(1, 61)]
    spans = [(i, D(2026, 1, 1) + dt.timedelta(days=s), D(2026, 1, 1) + dt.timedelta(days=s + rnd.choice([0, 0, 1, 3, 20]))) for i, *_ in events if i % 9 for s in rnd.sample(range(120), rnd.randint(1, 3))]
    by = {}
    for i, s, e in spans:
        by.setdefault(i, []).append((s, e))

    def gap(a, b):
        vals = [max(0, (b0 - a1).days, (a0 - b1).days) for a0, a1 in by.get(a, []) for b0, b1 in by.get(b, [])]
        return min(vals) if vals else None

    want = {}
    for i, a, m, c in events:
        rows = []
        for j, a2, m2, c2 in events:
            if i == j: continue
            share = bool((set(c) & set(c2)) - {"other"})
            tier = 1 if a and a == a2 else 2 if m and m == m2 else 3 if share else 4
            g = gap(i, j)
            rows.append((tier, not share, 10**9 if g is None else g, j))
        want[i] = [r[3] for r in sorted(rows)[:4]]
    ev = spark.createDataFrame(events, "id long, area string, municipality string, category array<string>")
    sp = spark.createDataFrame(spans, "event_id long, span_start date, span_end date")
    got = {}
    for r in related.related_events(ev, ev, sp).orderBy("source_id", "rank").collect():
        got.setdefault(r.source_id, []).append(r.related_id)
    assert got == want


def test_schedule_gap_moves_no_row_for_each_span(spark):
    """Gaps as by brute force, also from overlapping spans, and a plan whose pairs aren't multiplied by spans."""
    rng = random.Random(7)
    spans = []
    for event in range(40):
        for _ in range(rng.randrange(0, 9)):
            start = dt.date(2026, 1, 1) + dt.timedelta(rng.randrange(0, 400))
            spans.append((event, start, start + dt.timedelta(rng.randrange(0, 12))))
    pairs = [(a, b) for a in range(42) for b in range(42)]
    df = schedule.schedule_gap(spark.createDataFrame(pairs, "left_id long, right_id long"),
                               spark.createDataFrame(spans, "event_id long, span_start date, span_end date"))
    got = {(r.left_id, r.right_id): r.gap_days for r in df.collect()}
    of = lambda i: [s for s in spans if s[0] == i]
    want = {(a, b): min((max(0, (y[1] - x[2]).days, (x[1] - y[2]).days) for x in of(a) for y in of(b)), default=None) for a, b in pairs}
    assert got == want
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_matching_sends_no_catalogue_side_through_the_driver(spark):
    """Sides that grow with the catalogue are dealt over the tasks, whatever their files' size lets Spark expect."""
    from tsudoi.operators import state
    events = spark.createDataFrame([(1, "a", "draft"), (2, "b", "published")], "id long, slug string, status string")
    incoming = spark.createDataFrame([(1, "a", "t", "u", "2026-01-01", None)], "seq long, slug string, title string, source_url string, start_date string, end_date string")
    decisions = spark.createDataFrame([(1, "none", None)], "seq long, duplicate_status string, matched_id long")
    routed = state.route_import(incoming, decisions, events)
    keyed = "{0} long, official_key string, source_key string, source_keys array<string>, title_key string, start_date date"
    exact = match.exact_matches(spark.createDataFrame([(1, "o", "s", [], "t", D(2026, 1, 1))], keyed.format("seq")),
                                spark.createDataFrame([(5, "o", "s", ["s"], "t", D(2026, 1, 1))], keyed.format("id")))
    for df, hinted in ((routed, 2), (exact, 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("strategy=shuffle_hash") == hinted
    assert [r.action for r in routed.collect()] == ["draft_update"] and [tuple(r) for r in exact.collect()] == [(1, 1, 5)]


def test_a_full_list_ends_what_a_related_source_reads(spark):
    """Forty events of one place and category with equal spans: one list each is read, the lists behind it aren't."""
    ev = spark.createDataFrame([(i, "ueno", "taito", ["food"]) for i in range(40)] + [(50, "ginza", None, ["food"])], "id long, area string, municipality string, category array<string>")
    lists = related._lists(ev)
    needed = related._needed(lists, lists.select("id", "list").distinct(), 4).collect()
    assert {(r.id, r.list) for r in needed if r.id < 40} == {(i, "1|ueno|food") for i in range(40)}
    assert {r.list for r in needed if r.id == 50} == {"1|ginza", "1|ginza|food", "3|food"}
    days = [(i, D(2026, 1, 1 + d), D(2026, 1, 1 + d)) for i in [*range(40), 50] for d in (0, 5, 5)]
    sp = spark.createDataFrame(days, "event_id long, span_start date, span_end date")
    got = {}
    for r in related.related_events(ev, ev, sp).orderBy("source_id", "rank").collect():
        got.setdefault(r.source_id, []).append((r.related_id, r.tier, r.shares_category, r.gap_days))
    assert got == {i: [(j, 3 if i == 50 else 1, True, 0) for j in range(41) if j != i][:4] for i in [*range(40), 50]}


def test_a_title_is_taken_apart_once(spark):
    df = spark.createDataFrame([("夏まつり 第3回 2026",), ("夏まつり 第3回 2026",), ("夏まつり！ 第3回 2026",), ("ABC abc",), (None,), ("",)], "title string")
    full = match.with_match_keys(df.selectExpr("title", *[f"cast(null as {k}) as {c}" for c, k in (("start_date", "date"), ("end_date", "date"), ("venue", "string"), ("area", "string"), ("official_url", "string"), ("source_url", "string"))]))
    got = match.title_keys(df)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, full.select(*match.TITLE).distinct().collect()), key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [title" in plan.split("EvalPython")[-1]  # equal titles become one row before they are normalised


def test_decisions_move_no_texts(spark, monkeypatch):
    d = lambda m, x: D(2026, m, x)
    pool = [(i, t, d(8, i), d(8, i + 3), v, a, f"https://e.com/{i}", None) for i, (t, v, a) in enumerate(
        [("夏まつり大会 2026", "上野公園", "ueno"), ("夏まつり大会", None, None), ("現代アート展示会", "六本木ヒルズ", "minato"), ("夏まつり大会", "上野公園前", "ueno")], 1)]
    cand = [(10 + k, t, None if k == 5 else d(8, 1 + k % 5), None if k % 2 else d(8, 6), v, a, None, None) for k, (t, v, a) in enumerate(
        [("夏まつり大会！", "上野公園", "ueno"), ("夏まつり大会の会", "上野公園", None), ("現代アート展示", None, "minato"), ("現代アート展示会", "", "minato"), (None, None, None), ("夏まつり大会", "別", "x"), ("", "", "")] * 2)]
    moved, cut = [], match.cut_lineage
    monkeypatch.setattr(match, "cut_lineage", lambda df: moved.append(df.columns) or cut(df))
    sides = lambda: (spark.createDataFrame(cand, CAND), match.match_pool(spark.createDataFrame(pool, POOL)))
    few = sorted(map(tuple, match.decide(*sides()).collect()), key=repr)
    assert not any({"seq", "core"} <= set(c) or {"rep", "venue_key"} <= set(c) or {"seq", "title"} <= set(c) for c in moved)
    monkeypatch.setattr(match, "PAIRED_PLACES", 0)
    assert sorted(map(tuple, match.decide(*sides()).collect()), key=repr) == few and {r[1] for r in few} >= {"likely", "none"}
