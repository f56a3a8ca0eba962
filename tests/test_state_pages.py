"""State merges (rerun changes nothing), readers, pages, guard and streaming."""
import datetime as dt
import json

from pyspark.sql import functions as F

from tsudoi.functions import dates
from tsudoi.functions.dates import day
from tsudoi.operators import guard, lookups, pages, reactions, state, summaries
from tsudoi.sources import readers
from tsudoi.streaming import ingest

C = F.col
D = dt.date
TS = dt.datetime(2026, 1, 1)
SRC = "event_id long, source_name string, source_url string, source_event_id string, official_url string, last_checked_at timestamp"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_attach_is_idempotent(spark):
    s = spark.createDataFrame([(1, "guide", "u1", None, "o", TS)], SRC)
    a = spark.createDataFrame([(1, 1, "guide", "u1", "9", "n", TS), (2, 1, "guide", "u2", None, None, TS)], "seq long, " + SRC)
    once = state.attach_sources(s, a)
    assert rows_of(once) == rows_of(state.attach_sources(once, a)) and once.count() == 2
    assert {r.source_url: r.outcome for r in state.attach_outcome(s, a).collect()} == {"u1": "already_attached", "u2": "new_source"}


REV = "id long, status string, source_name string, source_url string, candidate_event_id long, duplicate_status string, reason string, payload string, scores string"


def test_dedupe_reviews(spark):
    r = spark.createDataFrame([(1, "rejected", "g", "u1", None, "likely", "r", "p", "s"), (2, "pending", "g", "u1", None, "likely", "r", "p", "s"), (3, "pending", "g", "u2", 5, "likely", "old", "p", "s")], REV)
    inc = spark.createDataFrame([(1, "g", "u1", None, "likely", "n", "p", "s"), (2, "g", "u2", 5, "ambiguous", "new", "p", "s"), (3, "g", "u3", None, "likely", "n", "p", "s"), (4, "g", "", None, "likely", "n", "p", "s"), (5, "g", "u9", None, "exact", "n", "p", "s")],
                                "seq long, source_name string, source_url string, candidate_event_id long, duplicate_status string, reason string, payload string, scores string")
    assert {x.seq: x.outcome for x in state.dedupe_review_outcome(r, inc).collect()} == {1: "skipped_resolved", 2: "updated_pending", 3: "inserted", 4: "skipped_invalid", 5: "skipped_invalid"}
    once = state.upsert_dedupe_reviews(r, inc)
    assert rows_of(once) == rows_of(state.upsert_dedupe_reviews(once, inc))
    assert {x.id: x.reason for x in once.collect()} == {1: "r", 2: "r", 3: "new", 6: "n"}


def test_dedupe_decisions(spark):
    ev = spark.createDataFrame([(1, "s1", "a", "published", D(2026, 1, 1), None, "x"), (2, "guide-77-2026", "b", "draft", D(2026, 1, 1), None, "y")], "id long, slug string, title string, status string, start_date date, end_date date, source_url string")
    rv = spark.createDataFrame([(10, "pending", "guide", "https://g/event/5/", 1, "t", D(2026, 3, 1), None, None), (11, "pending", "guide", "https://g/event/6/", None, "t", D(2026, 3, 1), None, None), (12, "rejected", "guide", "https://g/event/7/", 1, "t", D(2026, 3, 1), None, None),
                                (13, "pending", "guide", "https://g/event/77/", None, "t", D(2026, 3, 1), None, None), (14, "pending", "guide", "https://g/event/8/", None, "t", D(2026, 3, 1), None, None), (15, "pending", "guide", "https://g/event/9/", None, " ", D(2026, 3, 1), None, None)],
                               "id long, status string, source_name string, source_url string, candidate_event_id long, title string, start_date date, end_date date, resolved_event_id long")
    so = spark.createDataFrame([(2, "guide", "https://g/event/8/", None, None, TS)], SRC)
    dec = spark.createDataFrame([(1, 10, "link"), (2, 11, "create"), (3, 12, "link"), (4, 13, "create"), (5, 14, "create"), (6, 15, "create"), (7, 99, "reject"), (8, 10, "reject")], "seq long, review_id long, intent string")
    out = state.dedupe_decision_outcome(dec, rv, ev, so)
    assert {r.seq: (r.outcome, r.error) for r in out.collect()} == {1: ("linked", None), 2: ("created", None), 3: ("error", "review_not_pending"), 4: ("error", "slug_exists"), 5: ("error", "url_already_attached"),
                                                                    6: ("error", "title is required"), 7: ("error", "review_not_found"), 8: ("error", "review_not_pending")}
    r2, e2, s2 = state.apply_dedupe_decisions(out, rv, ev, so, F.lit(TS))
    assert {r.id: r.status for r in r2.collect()} == {10: "linked", 11: "created", 12: "rejected", 13: "pending", 14: "pending", 15: "pending"}
    assert e2.count() == 3 and s2.count() == 3
    again = state.dedupe_decision_outcome(dec, r2, e2, s2)
    assert again.where("outcome <> 'error'").count() == 0


def test_field_reviews_rerun_and_decisions(spark):
    ev = spark.createDataFrame([(1, "published", "会場A", "無料", ["a"]), (2, "draft", "会場A", None, None)], "id long, status string, venue string, price_text string, category array<string>")
    prop = spark.createDataFrame([(1, 1, "g", "u", "会場　Ａ（周辺）", "有料", ["a", "b"]), (2, 2, "g", "u", "x", "y", None)], "seq long, event_id long, source_name string, source_url string, venue string, price_text string, category array<string>")
    diffs = state.field_diffs(prop, ev)
    assert {(r.event_id, r.field_name) for r in diffs.collect()} == {(1, "price_text"), (1, "category"), (2, "venue"), (2, "price_text")}
    empty = spark.createDataFrame([], "id long, event_id long, source_name string, source_url string, field_name string, current_value string, proposed_value string, proposal_hash string, status string, reason string")
    once = state.sync_field_reviews(empty, diffs, ev)
    assert once.count() == 2 and rows_of(once) == rows_of(state.sync_field_reviews(once, diffs, ev))
    newer = state.field_diffs(prop.withColumn("price_text", F.lit("500円")).withColumn("seq", C("seq") + 10), ev)
    both = state.sync_field_reviews(once, newer, ev)
    assert sorted((r.field_name, r.status) for r in both.collect()) == [("category", "pending"), ("price_text", "expired"), ("price_text", "pending")]
    back = state.sync_field_reviews(both, diffs, ev)
    assert {r.proposed_value: r.status for r in back.collect() if r.field_name == "price_text"} == {'"有料"': "expired", '"500円"': "pending"}
    dec = both.where("status = 'pending'").select(C("id").alias("seq"), C("id").alias("review_id"), F.lit("accept").alias("intent"))
    r2, e2 = state.apply_field_decisions(state.field_decision_outcome(dec, both, ev), both, ev)
    one = e2.where("id = 1").head()
    assert (one.price_text, one.category) == ("500円", ["a", "b"]) and r2.where("status = 'pending'").count() == 0


def test_missing_occurrences_null_clock(spark):
    s = "event_id long, start_date date, end_date date, start_time string, end_time string"
    have = spark.createDataFrame([(1, D(2026, 1, 1), D(2026, 1, 1), None, None)], s)
    new = spark.createDataFrame([(1, D(2026, 1, 1), D(2026, 1, 1), None, None), (1, D(2026, 1, 1), D(2026, 1, 1), "10:00:00", None)], s)
    assert [r.start_time for r in lookups.missing_occurrences(new, have).collect()] == ["10:00:00"]


def test_open_data_csv_both_encodings(spark, tmp_path):
    text = 'ページタイトル,ページURL,開催日時,ところ,内容\r\n"区民""まつり""","https://c/1",2026年8月1日,港区役所,"一行目\n二行目"\r\n,,,,\r\n'
    for name, enc in (("u.csv", "utf-8-sig"), ("s.csv", "cp932")):
        (tmp_path / name).write_bytes(text.encode(enc))
        got = readers.read_open_data(spark, str(tmp_path / name), day("2026-08-01")).collect()
        assert [(r.title, r.description, r.lifecycle, r.area_status, r.filter.status) for r in got] == [('区民"まつり"', "一行目 二行目", "ongoing", "minato", "include")], name


def test_json_feed_report_and_version(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"events": [{"title": "a"}, {"title": "b", "error": "x"}, {"title": "c"}]}))
    df = readers.read_json_feed(spark, str(tmp_path / "f.json"), "title string, error string")
    assert sorted(r.title for r in df.collect()) == ["a", "c"]
    readers.write_report(df, {"n": F.count(F.lit(1))}, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep" / "summary")).head().n == 2
    assert spark.read.parquet(readers.write_version(df, str(tmp_path / "t"), "1")).count() == 2


def test_atom_feed(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>A</title><link rel="alternate" href="/a"/><updated>2026</updated><summary>S &amp; T</summary></entry></feed>'
    r = readers.feed_items(spark.createDataFrame([(1, "https://e.com/x/feed", xml)], "page_id long, url string, xml string")).head()
    assert (r.kind, r.feed_title, r.title, r.link, r.published, r.excerpt) == ("atom", "F", "A", "https://e.com/a", "2026", "A — S & T")


def test_stream_takes_only_new_files(spark, tmp_path):
    feed, seen = tmp_path / "feed", []
    feed.mkdir()
    opts = dict(folder=str(feed), schema="title string")
    merge = lambda name: (lambda batch, n: seen.extend(r.title for r in batch.collect()))
    (feed / "1.json").write_text('{"title": "a"}\n')
    assert ingest.ingest_all(spark, {"bad": dict(folder=str(tmp_path / "missing" ), schema="nonsense!!"), "good": opts}, merge, str(tmp_path / "cp"))["good"] is None
    (feed / "2.json").write_text('{"title": "b"}\n')
    out = ingest.ingest_all(spark, {"bad": dict(folder=str(tmp_path / "missing"), schema="nonsense!!"), "good": opts}, merge, str(tmp_path / "cp"))
    assert seen == ["a", "b"] and out["good"] is None and out["bad"] is not None


def test_pages(spark):
    html = ('<html><head><title>T</title><script type="application/ld+json">{"bad"</script><script type="application/ld+json">{"@graph":[{"@type":["Event"],"name":"N","startDate":"2026-08-01T09:30:00+09:00",'
            '"offers":[{"price":0,"priceCurrency":"JPY"},{"price":"1200","name":"大人"}],"image":{"url":"/i.jpg"}}]}</script></head><body><article><table><tr><th>会場</th><td>ホール<script>x</script></td></tr></table>'
            "<dl><dt>更新日</dt><dd>2026年1月1日</dd><dt>期間</dt><dd>2026年8月1日〜2026年8月3日</dd></dl></article></body></html>")
    df = spark.createDataFrame([(1, "https://e.com/p/", html)], "page_id long, url string, html string")
    f = pages.json_ld_fields(pages.json_ld_nodes(df), df).head()
    assert (f.title, str(f.start_date), f.start_time, f.price_text, f.image_url) == ("N", "2026-08-01", "09:30:00", "大人: 1200円", "https://e.com/i.jpg")
    d = pages.detail_records(df).head()
    assert (d.title, d.venue, d.end_date, d.field_sources["venue"], d.field_sources["end_date"]) == ("N", "ホール", "2026-08-03", "table.会場", "table.end_date")
    v = {r.field: r.value for r in pages.visit_facts_json_ld(pages.json_ld_nodes(df)).collect()}
    assert v == {"price_type": "paid", "price_min": "1200", "price_max": "1200"}


def test_visit_facts_read_pages_once(spark):
    node = lambda kind, price: f'{{"@type":"{kind}","offers":[{{"price":"9","priceCurrency":"USD"}},{{"price":"{price}","url":"https://t.com/{price}"}}]}}'
    page = lambda *nodes: "".join(f'<script type="application/ld+json">{n}</script>' for n in nodes)
    # an event hides other nodes of its page, a series is none, a page without events offers all its nodes, one without a key none
    rows = [(1, page(node("Place", 300), node("Event", 500))), (2, page(node("Place", 300), node("EventSeries", 700))), (None, page(node("Event", 900))), (3, page('{"@type":"Event"}', node("Place", 100)))]
    found = pages.visit_facts_json_ld(pages.json_ld_nodes(spark.createDataFrame(rows, "page_id long, html string")))
    assert sorted((r.page_id, r.value) for r in found.where("field in ('price_min', 'reservation_url')").collect()) == [
        (1, "500"), (1, "https://t.com/500"), (2, "300"), (2, "700"), (2, "https://t.com/300"), (2, "https://t.com/700")]
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_visit_text(spark):
    df = spark.createDataFrame([(1, "アクセスは次のとおりです、上野駅から徒歩5分、銀座駅から徒歩3分。"), (2, "最寄駅：銀座駅 徒歩約4分。入場料 一般1,500円、小人800円。要予約。3歳以上。")], "page_id long, text string")
    got = {}
    for r in pages.visit_facts_text(df).collect():
        got.setdefault(r.page_id, {})[r.field] = r.value
    assert set(got[1]) == {"access_text"}
    assert {k: got[2][k] for k in ("nearest_station", "walk_minutes", "price_min", "price_max", "reservation_status", "family_friendly", "age_note")} == {
        "nearest_station": "銀座駅", "walk_minutes": "4", "price_min": "800", "price_max": "1500", "reservation_status": "required", "family_friendly": "yes", "age_note": "3歳以上"}


def test_guard(spark):
    src = spark.createDataFrame([(1, x, "experience") for x in ("楽しかった！写真も撮った", "面白かった。混雑していた", "混んでいたが楽しめた")] + [(1, "公式情報", "official")], "event_id long, excerpt string, class string")
    bullet = lambda text, theme, n: (text, theme, n, [])
    model = spark.createDataFrame([(1, [bullet("全体的に好意的です", "enjoyment", 9), bullet("混雑していたという声があります", "crowd", 9), bullet("最寄り駅の電車が遅延", "other", 1), bullet("屋内で楽しめた", "enjoyment", 2)],
                                    {"crowd": "positive", "rain": "positive"}, "平日", 9, "high")],
                                  "event_id long, bullets array<struct<text:string,theme:string,evidence_count:int,cited:array<string>>>, signals map<string,string>, recommended_time string, recommended_evidence int, confidence string")
    r = guard.guard_summaries(model, src).head()
    assert r.themes == ["enjoyment", "crowd", "photo"] and r.bullets[0] == guard.JOY_SOME
    assert (r.signals["crowd"], r.signals["rain"], r.recommended_time, r.confidence) == ("mixed", "unknown", None, "low")


def test_selection_labels(spark):
    rows = [(1, i, "experience", "exact" if i != 14 else "weak", float(-i)) for i in range(15)] + [(1, 20 + i, "official", "likely", 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "event_id long, post_id long, class string, relevance string, score double")
    ex = spark.createDataFrame([(1, 0)] + [(1, 1000 + i) for i in range(9)], "event_id long, post_id long")
    got = {r.post_id: r.decision for r in reactions.select_posts(df, ex).collect()}
    assert got[0] == "skip_duplicate" and got[14] == "skip_irrelevant"
    assert [p for p, d in sorted(got.items()) if d == "save"] == list(range(1, 11)) and got[20] == "skip_quota"


def test_summary_guards(column):
    mat = F.lit("夏の花火を見られる催しです。開館10周年を記念します。")
    rows = [("おすすめの催し",), ("夏の催し",), ("開館を記念した催し",), ("開館" + "あ" * 140,)]
    assert column(rows, "s string", summaries.summary_refusal(C("s"), mat, F.lit("題"))) == ["added:おすすめ", "missing:開館", None, "length 142"]
    assert column([("屋内の催し",), ("花火の催し",)], "s string", summaries.grounded_summary(C("s"), F.lit("花火"), F.lit("本文"))) == ["本文", "花火の催し"]


def test_every_query_has_a_stable_schema(spark):
    import __spark_entry__ as e
    assert e.entry(spark).columns == ["id", "slug", "day", "clock", "pos"]
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 120


def test_decisions_see_earlier_links_and_creates(spark):
    ev = spark.createDataFrame([(1, "taken", "draft")], "id long, slug string, status string")
    url = "https://x.example.com/event/{}".format
    review = lambda i, u, title: (i, "pending", "guide", u, 1, title, dt.date(2026, 1, 1), None)
    rv = spark.createDataFrame([review(1, url(1), "a"), review(2, url(1), "b"), review(3, url(2), "c"), review(4, url(2), "d"), review(5, url(3), "e")],
                               "id long, status string, source_name string, source_url string, candidate_event_id long, title string, start_date date, end_date date")
    so = spark.createDataFrame([], "source_name string, source_url string")
    dec = spark.createDataFrame([(1, 1, "link"), (2, 2, "create"), (3, 3, "create"), (4, 4, "create"), (5, 5, "create")], "seq long, review_id long, intent string")
    got = {r.seq: (r.outcome, r.error) for r in state.dedupe_decision_outcome(dec, rv, ev, so).collect()}
    assert got[1] == ("linked", None) and got[2] == ("error", "url_already_attached") and got[3] == ("created", None) and got[4] == ("error", "url_already_attached") and got[5] == ("created", None)


def test_last_save_wins(spark):
    old = spark.createDataFrame([(1, "draft", ["a"])], "event_id long, status string, bullets array<string>")
    saves = spark.createDataFrame([(1, 1, "save", ["b"], False), (2, 1, "publish", None, False), (3, 2, "save", ["x"], False), (4, 2, "save", ["y"], False)],
                                  "seq long, event_id long, intent string, bullets array<string>, forced boolean")
    assert sorted((r.event_id, r.status, r.bullets) for r in state.save_summaries(old, saves).collect()) == [(1, "published", ["b"]), (2, "draft", ["y"])]
    tr = spark.createDataFrame([], "event_id long, locale string, status string, title string, summary string")
    ev = spark.createDataFrame([(1, "t", "s")], "id long, title string, summary string")
    drafts = spark.createDataFrame([(1, 1, "en", "one", "x", False), (2, 1, "en", "two", "y", False)], "seq long, event_id long, locale string, title string, summary string, forced boolean")
    assert [(r.title, r.status) for r in state.save_translations(tr, drafts, ev).collect()] == [("two", "draft")]


def test_many_json_ld_nodes_keep_their_order(spark):
    block = '<script type="application/ld+json">{"@graph":[' + ",".join(f'{{"@type":"Thing","name":"n{k}"}}' for k in range(1500)) + ']}</script>'
    rows = spark.createDataFrame([(1, "http://x", block + "<script type='application/ld+json'>{}</script>" * 2200 + block)], "page_id long, url string, html string")
    nodes = pages.json_ld_nodes(rows).orderBy("pos").collect()
    assert len(nodes) == 5200 and [(n.pos.b, n.pos.j) for n in nodes[:1500]] == [(0, k) for k in range(1500)] and nodes[-1].pos.b == 2201


def test_slugs_settle(spark):
    drafts = [(1, "a", "u1"), (2, "a", "u2"), (3, "b", "u3"), (4, "c", "u4"), (5, "a", "u2"), (6, "d", "u6")]
    from tsudoi.functions import canon
    from tsudoi.operators import importing
    taken = spark.createDataFrame([("b", "other"), ("c", "u4"), (None, "x")], "slug string, source_url string")
    df = spark.createDataFrame(drafts, "seq long, slug string, source_url string")
    suffix = {r.seq: r.s for r in df.select("seq", canon.suffixed_slug(df.slug, df.source_url).alias("s")).collect()}
    taken = taken.unionByName(spark.createDataFrame([(suffix[3], "z")], "slug string, source_url string"))
    got = {r.seq: r.final_slug for r in importing.settle_slugs(df, taken).collect()}
    assert got == {1: "a", 2: suffix[2], 3: None, 4: "c", 5: None, 6: "d"}


def test_audit_counters(spark):
    df = spark.createDataFrame([(1, "s", None, ["other"]), (2, "s", "v", ["a", "other"]), (3, None, None, None), (4, None, "w", ["other"])], "id long, slug string, venue string, category array<string>")
    from tsudoi.operators import audit
    got = {r.rule: r.violations for r in audit.unique_violations(df, {"distinct": (["slug"], True), "equal": (["slug"], False)}).collect()}
    assert got == {"distinct": 1, "equal": 2}
    occ = spark.createDataFrame([(1,), (1,), (9,)], "event_id long")
    assert {r.counter: r.n for r in audit.batch_counts(df, occ, ["venue"]).collect()} == {"null_venue": 2, "only_other": 2, "occurrences": 2}
    rows = spark.createDataFrame([(1, 1, dt.date(2026, 1, 1), None), (2, 2, dt.date(2026, 3, 1), None), (3, 11, dt.date(2026, 1, 1), None)], "id long, pos long, start_date date, end_date date")
    assert [r.id for r in audit.ended_in_front(rows, "pos", dates.day("2026-02-01")).collect()] == [1]


def test_of_equal_numbers_the_first_line_item_counts(spark, tmp_path):
    from tsudoi.plans import catalog
    rows = [(k, 5 if a == "max" else 4, n, q, 0.05, 0.05 if n else 0.01, "A") for k, (a, *qs) in enumerate(
        [("max", 32.0, 37.0), ("max", 37.0, 32.0), ("min", 7.0, 41.0), ("min", 41.0, 7.0)]) for n, q in ((1, qs[0]), (1, qs[1]), (0 if a == "max" else 3, 32.0 if a == "max" else 7.0))]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string")
    cur = df.where("l_linenumber = 0").drop("l_tax").withColumn("l_tax", F.lit(0.05))
    df.where("l_linenumber > 0").unionByName(cur).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.event_id: r.route for r in catalog.QUERIES["proposal_routing"](spark, str(tmp_path)).collect()}
    assert got == {0: "skip_same", 1: "review", 2: "skip_same", 3: "review"}


def test_catalogue_rows_are_dealt_before_they_are_worked_on(spark, tmp_path):
    """However few splits a file has, the views that pages and rules are worked out from have a task for each shuffle partition."""
    from tsudoi.plans import domain
    parts = spark.range(1, 400).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'T' AS p_type", "cast(id % 50 AS int) AS p_size", "1.0 AS p_retailprice")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("catalogue", "event_pages", "visit_texts", "event_cards"):
        df = domain.view(spark, str(tmp_path), name)
        sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) == 399
