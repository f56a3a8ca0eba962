"""Rule columns against hand-checked cases."""
import datetime as dt

from pyspark.sql import functions as F

from tsudoi.functions import canon, classify, dates, feeddates, images, place, text, urls
from tsudoi.functions.dates import day

C = F.col

PRICES = [
    ("入場無料", "free"), ("観覧無料", "free"), ("料金: 入場無料。", "free"), ("一般2,300円、高校生以下無料", "paid"), ("入場無料、飲食は有料", "partially_paid"),
    ("観覧無料、パレード参加500円", "partially_paid"), ("一部有料", "partially_paid"), ("店舗によって異なる", "varies"), ("", None), (None, None), ("料金記載なし", None),
    ("入場料は無料。ラーメンは1杯1,100円。ラーメンはチケット制。 チケット1枚でラーメン1杯と引き換え。", "partially_paid"), ("料金: 入場無料。飲食代は別途。200円刻みの食券制", "partially_paid"),
    ("料金: 有料。3,300円（※街に姿を現すポケモンたちは、無料で鑑賞可能。）", "partially_paid"), ("料金: 有料。カレー提供店によって異なる", "varies"),
    ("観覧・来場の参加費は不要。パレード参加は猫まち旅券バッジが必要。【市民猫】500円（化け猫パレード参加権）", "partially_paid"), ("入場料：無料", "free"), ("入場料金：無料", "free"),
    ("入場料: 無料", "free"), ("入場料金 : 無料", "free"), ("各種イベントによって異なります", "varies"), ("2,000円 ※内容により異なるため最新情報は公式確認", None),
    ("サポーターズシートあり1口8,000円 公式HPの応募フォームから申し込み", None), ("屋台での飲食のみ有料", None), ("キッチンカー、テントでの飲食は有料", None),
    ("１，０００円", "paid"), ("無料ではない", "paid")]


def test_price_type(column):
    got = column([(p,) for p, _ in PRICES], "p string", classify.price_type(classify.price_compact(C("p"))))
    assert got == [want for _, want in PRICES]


def test_municipality(spark):
    rows = [("東京都あきる野市1-2-3", None, None, "akiruno"), ("東京都羽村市1-2-3", None, None, "hamura"), ("八王子市高尾町", "高尾山", None, "hachioji"), ("北区王子1-1", "王子", None, "kita"),
            ("中野区東中野1-59-14", "港区の会場", None, "nakano"), (None, "羽村市富士見公園", None, "hamura"), (None, None, "fuchu", "fuchu"), (None, "小平駅前ショッピングセンター", None, None),
            ("多摩", "多摩", None, None), ("東京都多摩市関戸", None, None, "tama"), ("小平市と府中市", None, None, None), (None, None, "tama", None), (None, None, "odaiba", None), (None, None, "ueno", "taito"),
            ("横浜市港北区", None, None, "yokohama"), ("小平市と府中市", None, "ueno", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, address string, venue string, area string, want string")
    got = place.with_municipality(df).collect()
    assert [(r.i, r.inferred_municipality) for r in got if r.inferred_municipality != r.want] == []


def test_place(spark):
    rows = [("八王子市", "八王子市高尾町", "高尾山", "hachioji", None, "hachioji"), (None, "北区王子1-1", None, "kita", "oji", "oji"), ("六本木", "東京都港区六本木6", None, "minato", "roppongi", "roppongi"),
            ("六本木", "東京都渋谷区1-1", None, "shibuya", None, "roppongi"), ("渋谷", None, None, "shibuya", None, "shibuya"), ("お台場", None, None, None, "odaiba", "odaiba")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, area string, address string, venue string, m string, a string, l string")
    for r in place.with_place(df).collect():
        assert (r.place.municipality, r.place.area, r.place.legacy_area) == (r.m, r.a, r.l), r


def test_kids(column):
    cases = [("邦楽フレッシュコンサート 未就学児入場不可", False), ("子供と", None), ("高校生以下300円", None), ("小学生以下無料", None), ("子どもも入場できます", None), ("子ども", None), ("学生料金", None),
             ("親子で参加できるワークショップ", True), ("子ども向けワークショップ", True), ("ファミリー向けイベント", True), ("小学生を対象とした体験教室", True), ("0歳から楽しめる親子コンサート", True), (None, None)]
    assert column([(c,) for c, _ in cases], "t string", classify.kids_from_text(C("t"))) == [w for _, w in cases]
    tags = [(["子供と"], None, None), (["恋人と・夫婦で / 子供と"], None, None), (["子ども向けワークショップ"], None, True), (["子供と", "キッズ"], None, True), (["子供と"], "0歳から楽しめる親子コンサート", True), (["大人限定"], None, False)]
    assert column([(a, b) for a, b, _ in tags], "g array<string>, t string", classify.kids_from_tags(C("g"), C("t"))) == [w for _, _, w in tags]


def test_category_mapping(column):
    cases = [(["子供と"], ["other"]), (["ライブ・音楽イベント", "子供と"], ["music"]), (["フリーマーケット", "恋人と・夫婦で"], ["market"]), (["祭り", "グルメ・フードフェス", "子供と"], ["festival", "food"]),
             (["美術展・博物展"], ["exhibition"]), (["体験イベント・アクティビティ"], ["workshop"]), (["キッズ"], ["kids"]), (["舞台・演劇", "子供と"], ["other"]), (["商業施設のイベント"], ["other"]), ([], ["other"])]
    assert column([(c,) for c, _ in cases], "g array<string>", classify.map_categories(C("g"))) == [w for _, w in cases]


def test_discrete_days_and_plan(spark):
    rows = [("2026年10月3日(土)・4日(日)", "2026-10-03", "2026-10-04", "2026-10-03", "2026-10-04", 0), ("2026年10月10日(土)・12日(月)", "2026-10-10", "2026-10-12", "2026-10-10", "2026-10-10", 2),
            ("11月中旬～12月中旬", "2026-11-11", "2026-12-20", "2026-11-11", "2026-12-20", 0), ("2026年9月1日・20日", "2026-09-01", "2026-09-20", "2026-09-20", "2026-09-20", 2), (None, "2026-10-05", None, "2026-10-05", "2026-10-05", 0)]
    df = spark.createDataFrame([(i, r[0], *r[1:]) for i, r in enumerate(rows)], "i int, period string, s string, e string, ws string, we string, n int").withColumns(
        {"start_date": C("s").cast("date"), "end_date": C("e").cast("date"), "start_time": F.lit("10:00"), "end_time": F.lit(None).cast("string")})
    for r in feeddates.schedule_plan(df, day("2026-09-30")).collect():
        assert (str(r.plan.start_date), str(r.plan.end_date), len(r.plan.occurrences)) == (r.ws, r.we, r.n), r.period
        assert all(o.start_time == "10:00" for o in r.plan.occurrences)
    assert spark.range(1).select(feeddates.discrete_days(F.lit("2026年10月30日(金)～11月8日(日)"))).head()[0] is None


def test_image_exclusions(column):
    null = F.lit(None).cast("string")
    rows = [("draft", "upcoming", "none", None, None, "unknown"), ("published", "today", "none", None, None, "unknown"), ("published", "ended", "pending", "u", "x", "licensed"), ("published", "today", "blocked", None, "x", "forbidden")]
    schema = "s string, k string, g string, gu string, u string, r string"
    make = lambda **o: images.exclusion_reasons(C("s"), C("k"), C("g"), C("gu"), null, null, C("u"), C("r"), **o)
    assert column(rows, schema, make()) == [["not_active"], [], ["not_active", "generated_status", "generated_url", "official_image"], ["generated_status", "image_forbidden"]]
    assert column(rows, schema, make(allow_draft=True, allow_blocked=True))[0::3] == [[], ["image_forbidden"]]


def test_clock_and_ended(column):
    assert column([("9:05",), ("24:00",), ("10:30:59",), ("10:30:60",), ("x",), (None,)], "c string", dates.db_time(C("c"))) == ["09:05:00", None, "10:30:00", None, None, None]
    assert column([("2026-08-01T18:30:00+09:00",), ("2026-08-01",), ("2026-08-01T07:05Z",)], "c string", dates.time_of_iso(C("c"))) == ["18:30:00", None, "07:05:00"]
    rows = [("2026-01-01", None, True), ("2026-01-01", "2026-02-31", False), ("2026-01-01", "2026-03-01", False), ("2026-02-31", None, False), ("", "2025-01-01", False), ("2026-03-01", None, False)]
    assert column([r[:2] for r in rows], "s string, e string", dates.ended(C("s"), C("e"), day("2026-02-01"))) == [r[2] for r in rows]


def test_weekend(column):
    got = column([("2026-08-02",), ("2026-08-01",), ("2026-08-05",)], "d string", dates.weekend(C("d").cast("date")))
    assert got == [[dt.date(2026, 8, 1), dt.date(2026, 8, 2)], [dt.date(2026, 8, 1), dt.date(2026, 8, 2)], [dt.date(2026, 8, 8), dt.date(2026, 8, 9)]]
    assert column([("2026-08-02",)], "d string", dates.weekend_explorer(C("d").cast("date"))) == [[dt.date(2026, 8, 2)]]


def test_hours(spark):
    cases = [("10:00〜18:00", "10:00:00", "18:00:00", "single_time_range"), ("第1部 10:00〜12:00 第2部 14:00〜16:00", None, None, "multiple_time_ranges"), ("開演 午後6時30分", "18:30:00", None, "labeled_start_only"),
             ("2026年8月1日 10:00〜", None, None, "single_time_unlabeled"), ("2026年 9:00", None, None, "no_clock_token"), ("", None, None, "empty"), ("※荒天中止", None, None, "empty_after_note_strip"), ("大人 10:00", None, None, "no_clock_token")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, s string, e string, r string")
    for row in feeddates.parse_hours(df, "t").collect():
        p = row.hours_parsed
        assert (p.start_time, p.end_time, p.reason) == (row.s, row.e, row.r), row.t


def test_url_keys(column):
    cases = [("HTTP://www.Example.com/a/?utm_source=x&b=1#f", "https://example.com/a?b=1"), ("https://example.com", "https://example.com/"), ("https://example.com:8080/x/?q=a%20b&fbclid=1", "https://example.com/x?q=a+b"),
             ("https://e.com/?a", "https://e.com/?a="), (" Not A Url/ ", "not a url"), ("", None), (None, None)]
    assert column([(c,) for c, _ in cases], "u string", urls.normalize_url(C("u"))) == [w for _, w in cases]


def test_url_safety(column):
    cases = [("https://example.com/a", None), ("ftp://example.com", "scheme_not_http(s)"), ("http://u:p@example.com", "userinfo_not_allowed"), ("http://localhost/", "blocked_hostname"), ("http://a.internal/", "blocked_hostname_tld"),
             ("http://10.1.2.3/", "blocked_literal_ip"), ("http://8.8.8.8/", None), ("http://[::1]/", "blocked_literal_ip"), ("http://[fe80::1]/", "blocked_literal_ip"), ("nope", "invalid_url"), (" ", "empty_url")]
    assert column([(c,) for c, _ in cases], "u string", urls.url_refusal(C("u"))) == [w for _, w in cases]
    pairs = [("https://www.a.com/x", "http://a.com", True), ("https://b.a.com", "https://a.com", True), ("https://ba.com", "https://a.com", False), (None, "https://a.com", False)]
    assert column([p[:2] for p in pairs], "a string, b string", urls.same_site(C("a"), C("b"))) == [p[2] for p in pairs]


def test_text_keys(column):
    norm = text.normalize_text(C("t"))
    rows = [("第３回　夏まつり２０２６【元氣】",), ("",), (None,)]
    assert column(rows, "t string", norm) == ["第3回 夏まつり2026【元気】", "", ""]
    assert column(rows, "t string", text.title_core(norm))[0] == "夏まつり元気"
    assert column(rows, "t string", text.title_edition(norm)) == ["3", None, None]
    assert column(rows, "t string", text.title_year(norm)) == ["2026", None, None]
    assert column([("あ" * 50,), (" a  b ",)], "t string", text.truncate(C("t"), 10)) == ["あ" * 9 + "…", "a b"]


def test_similarity_is_multiset_dice(column):
    from collections import Counter
    def dice(a, b):
        if a == b: return 1.0
        if not a or not b: return 0.0
        s, l = sorted((a, b), key=len)
        if len(s) >= 4 and s in l: return min(1, 0.88 + len(s) / len(l) * 0.12)
        if len(s) < 2: return 0.0
        A, B = (Counter(x[i:i + 2] for i in range(len(x) - 1)) for x in (a, b))
        return 2 * sum((A & B).values()) / (sum(A.values()) + sum(B.values()))
    rows = [("aaaa", "aaab"), ("banana", "bandana"), ("ab", "b"), ("", ""), ("", "a"), ("夏まつり花火", "夏まつり"), ("abcabc", "bcabca"), ("x", "x")]
    got = column(rows, "a string, b string", text.string_similarity(C("a"), C("b")))
    assert [round(g, 9) for g in got] == [round(dice(*r), 9) if r != ("", "") else 1.0 for r in rows]


def test_canonical_and_warnings(column):
    h = canon.proposal_hash("price_text", canon.canonical_json("price_text", canon.canonical("price_text", C("v"), "compare")))
    import hashlib
    assert column([('a "q"\r\nb',)], "v string", h) == [hashlib.sha256('price_text:"a \\"q\\"\\nb"'.encode()).hexdigest()]
    tags = canon.canonical_json("category", canon.canonical("category", C("g"), "store"))
    assert column([([" b", "a", "b", ""],), ([""],)], "g array<string>", tags) == ['["a","b"]', None]
    rows = [("category", '["a","b"]', '["a"]'), ("category", '["a"]', '["a","b"]'), ("price_text", '"とても長い料金の説明文"', '"無料"'), ("venue", '"a"', '"b"')]
    assert column(rows, "f string, c string, p string", canon.review_warnings(C("f"), C("c"), C("p"))) == [["sensitive_field", "category_replaced"], ["sensitive_field"], ["price_text_shortened"], []]


def test_address_cleanup(column):
    cases = [("東京都渋谷区神宮前1-2-3・JR原宿駅", "東京都渋谷区神宮前1-2-3"), ("渋谷・JR渋谷駅", "渋谷・JR渋谷駅"), ("東京都港区１－１", "東京都港区1-1"), (None, None), ("", None)]
    assert column([(c,) for c, _ in cases], "a string", place.clean_address(C("a"))) == [w for _, w in cases]


def test_open_data(column):
    null = F.lit(None).cast("string")
    d = feeddates.open_data_dates(C("r"), null)
    got = column([("2026年8月1日,2026年8月3日から2026年8月5日",), ("2026年8月1日,後日",), ("毎週月曜",), ("2026年8月1日",)], "r string", d)
    assert [(g.date_status, len(g.occurrences)) for g in got] == [("multiple", 2), ("partial", 1), ("weekly", 0), ("single", 1)]
    rows = [("オレンジカフェ", None, "認知症の家族", None), ("江戸カフェ", None, None, None), ("区民まつり", None, None, None), ("法律相談", None, None, None), ("施設見学", None, None, None), ("何か", None, None, None)]
    got = column(rows, "t string, c string, g string, b string", classify.outing_filter(C("t"), C("c"), C("g"), C("b")))
    assert [g.status for g in got] == ["exclude", "include", "include", "exclude", "review", "review"]
