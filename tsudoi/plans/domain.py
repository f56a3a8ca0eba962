"""Domain views over the driver tables, written in SQL that Spark and DuckDB both read.

Every row of a driver table yields one domain row, so the work grows with the tables. The Japanese
texts are picked by column values, which gives every rule real hits and real misses.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

TODAY = "1998-06-20"  # a Saturday inside the range of the ship dates


def pick(column: str, *values: str | None) -> str:
    """CASE that maps column % n to the n-th value."""
    whens = " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values))
    return f"CASE {column} % {len(values)} {whens} END"


ADDRESSES = ("東京都港区六本木6-10-1・東京メトロ六本木駅直結", "東京都台東区上野公園5-20", "東京都渋谷区神宮前1丁目2-3・JR原宿駅から徒歩5分",
             "東京都八王子市旭町1-1", None, "神奈川県横浜市港北区新横浜3丁目", "東京都北区王子1-11-1", "東京都多摩市落合2-31",
             "東京都中央区銀座4丁目・地下鉄銀座駅", "千代田区丸の内1-1と港区芝公園4-2", "東京都杉並区高円寺南4丁目", "会場は当日発表")
VENUES = ("上野公園周辺", "六本木ヒルズ（会場）", None, "お台場海浜公園・屋外ステージ", "港区立みなと図書館", "渋谷区文化センター 大ホール",
          "池袋駅前広場", "浅草寺付近", "八王子市民会館")
AREAS = ("ueno", "roppongi", "minato", None, "shibuya", "tama", "odaiba", "koenji", "Ginza", "taito", "unknown-town")
MUNICIPALITIES = ("taito", "minato", None, "shibuya", "suginami", "chuo", "")
PRICES = ("入場無料", "大人1,000円、小学生以下無料", None, "一部有料", "無料", "店舗によって料金が異なります", "入場無料（飲食ブースは有料）",
          "観覧無料、体験は別途500円", "前売券2,500円", "キッチンカーは有料です", "無料ではない", "要問い合わせ", "料金：入場は無料。")
TITLES_JA = ("夏まつり", "ナイトマルシェ", "現代アート展", "法律相談会", "盆踊り大会", "文化交流カフェ", "親子ワークショップ", "施設見学",
             "ジャズライブ", "花火大会", "採用説明会")
TAGS = ("祭り,子供と", "アニメ・ゲーム,商業施設", "グルメ・フード,ライブ", "", "体験イベント,家族で", "美術展,ファミリー", "スポーツ", "花火,フリーマーケット",
        "恋人と/夫婦で", "ワークショップ,未就学児入場不可")
AUDIENCES = ("子ども向けの体験です", "小学生以下無料", "未就学児入場不可", None, "親子で参加できます", "どなたでも", "大人限定の夜")
CATEGORIES = ("festival,food", "exhibition", "kids,workshop", "", "music, Music ,other", "illumination", "other", "sports,market", "Art,jazz")
HOURS = ("10:00〜18:00", "開演 18:30", "午前10時～午後5時30分", "平日 10:00〜18:00 土日 9:00〜20:00", None, "未定", "第1部 10:00〜12:00 第2部 14:00〜16:00",
         "10:00 集合", "開始 9:00 終了 17:00", "10:00〜18:00（最終日は10:00〜15:00）※荒天中止", "入場料500円 11:00", "9時30分から")
PERIODS = ("2026年8月1日・2日・9日", "2026年7月30日・31日・1日", "2026年8月1日・2日・3日", "2026年8月1日〜8月9日", "2026年12月30日・2日", "2026年8月1日",
           None, "2026年5月3日・6月4日・10日", "8月1日・2日")
LIST_DATES = ("開催中 2026年8月1日(土)〜2026年8月9日(日)", "2026年8月1日(土)〜8月9日(日)", "〜2026年9月30日", "2026年7月1日から", "2026年10月10日(土)", "毎週日曜", None)
OPEN_DATES = ("2026年8月1日", "2026年8月1日から2026年8月9日", "2026年8月1日,2026年8月15日", "2026年8月1日,未定", "未定", None,
              "2026年13月1日", "2026年9月1日から2026年8月1日")
POST_TEXTS = ("行ってきた。とても楽しかったし写真も撮れた", "公式サイトのお知らせ: チケット発売中です", "イベント情報まとめニュース", "入場無料、期間限定開催。ぜひお越しください",
              "混雑していて待ち時間が長かった", "最寄り駅は電車の遅延で大変", "雨でも子どもと楽しめた", "ただの日常のつぶやき", "空いていて快適だった。デートに最高だった",
              "一人で行ってみた。平日の午前が良かった")

VIEWS = {
    "catalogue": f"""
SELECT p_partkey AS id, concat('feed-', cast(p_partkey AS string)) AS slug,
  concat(p_name, ' ', lower(p_type),
    CASE WHEN p_size % 6 = 0 THEN concat(' 第', cast(p_size % 5 + 1 AS string), '回') ELSE '' END,
    CASE WHEN p_size % 7 = 0 THEN concat(' ', cast(1996 + p_size % 4 AS string)) ELSE '' END) AS title,
  {pick('p_partkey', *TITLES_JA)} AS title_ja,
  CASE WHEN p_size <= 8 THEN 'draft' WHEN p_size <= 12 THEN 'hidden' ELSE 'published' END AS status,
  DATE '1995-01-02' + cast((p_partkey * 37) % 2500 AS int) AS start_date,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE DATE '1995-01-02' + cast((p_partkey * 37) % 2500 + p_size AS int) END AS end_date,
  {pick('p_partkey', '9:30', '10:00:00', None, '17:30', '18:00:00', '25:00', '13:15:00')} AS start_time,
  {pick('p_partkey', '18:00', '17:00:00', None, '21:30')} AS end_time,
  {pick('p_partkey', *VENUES)} AS venue, {pick('p_size', *AREAS)} AS area,
  {pick('p_partkey', *MUNICIPALITIES)} AS municipality, {pick('p_partkey', *ADDRESSES)} AS address,
  {pick('p_partkey', *PRICES)} AS price_text,
  {pick('p_size', 'free', 'paid', None, 'partially_paid', 'varies')} AS price_type,
  CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_kids,
  CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_indoor,
  CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false END AS is_night,
  {pick('p_partkey', *CATEGORIES)} AS category, {pick('p_partkey', *TAGS)} AS tags, {pick('p_partkey', *AUDIENCES)} AS audience,
  {pick('p_partkey', *HOURS)} AS hours, {pick('p_partkey', *PERIODS)} AS period,
  {pick('p_partkey', *LIST_DATES)} AS list_date, {pick('p_partkey', *OPEN_DATES)} AS open_date,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE concat('https://www.venue', cast(p_partkey AS string), '.example.com/event/', cast(p_partkey AS string), '/') END AS official_url,
  concat('https://feed.example.com/event/ar', cast(p_size AS string), 'e', cast(p_partkey AS string), '/') AS source_url,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat('https://img.example.com/', cast(p_partkey AS string), '.jpg') END AS image_url,
  {pick('p_size', 'unknown', 'licensed', None, 'own', 'forbidden', 'organizer_granted')} AS image_usage_status,
  {pick('p_size', 'none', 'pending', 'approved', None, 'blocked', 'rejected', 'none')} AS generated_image_status,
  CASE WHEN p_size % 7 IN (1, 2) THEN concat('https://gen.example.com/', cast(p_partkey AS string), '.webp') ELSE '' END AS generated_image_url,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE concat(p_name, ' の紹介です。', lower(p_type)) END AS summary,
  p_size AS size, p_brand AS brand, p_retailprice AS price,
  TIMESTAMP '2026-01-01 00:00:00' AS updated_at
FROM {{part}}""",
    "sessions": f"""
SELECT l_partkey AS event_id, cast(l_shipdate AS date) AS start_date,
  cast(l_shipdate AS date) + cast(l_quantity % 4 AS int) AS end_date,
  {pick('l_linenumber', None, '10:00:00', '9:30', '19:00', '13:00:00')} AS start_time,
  {pick('l_linenumber', None, '12:00:00', '17:00')} AS end_time
FROM {{lineitem}}""",
    # a second feed: each order announces an event under a catalogue title
    "incoming": f"""
SELECT o_orderkey AS seq, {pick('o_orderkey', 'guide', 'magazine', 'opendata')} AS source_name,
  concat(p_name, CASE WHEN o_orderkey % 4 = 0 THEN ' ' WHEN o_orderkey % 4 = 1 THEN '!' ELSE ' the ' END, lower(p_type),
    CASE WHEN o_orderstatus = 'P' THEN ' 1998' ELSE '' END) AS title,
  cast(o_orderdate AS date) AS start_date,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE cast(o_orderdate AS date) + cast(o_orderkey % 20 AS int) END AS end_date,
  {pick('o_orderkey', *VENUES)} AS venue, {pick('o_custkey', *AREAS)} AS area, {pick('o_orderkey', *PRICES)} AS price_text,
  CASE WHEN o_orderkey % 16 = 0 THEN concat('http://venue', cast(o_custkey AS string), '.example.com/event/', cast(o_custkey AS string), '?utm_source=mail') END AS official_url,
  CASE WHEN o_orderkey % 12 = 0 THEN concat('https://feed.example.com/event/ar', cast(p_size AS string), 'e', cast(o_custkey AS string))
       ELSE concat('https://other.example.com/event/', cast(o_orderkey AS string), '/') END AS source_url,
  o_custkey AS custkey, o_orderstatus AS orderstatus, o_orderpriority AS priority
FROM {{orders}} JOIN {{part}} ON p_partkey = o_custkey""",
    "posts": f"""
SELECT event_id AS post_id, user_id AS event_id, ts AS created_at, value AS raw_score, event_type,
  concat({pick('event_id', *POST_TEXTS)}, ' ', event_type) AS text,
  CASE event_id % 9 WHEN 0 THEN 'venue_official' WHEN 1 THEN 'city_info' ELSE concat('user', cast(user_id AS string)) END AS username,
  CASE event_id % 8 WHEN 0 THEN concat('https://www.venue', cast(user_id AS string), '.example.com/event/', cast(user_id AS string), '/map')
                    WHEN 1 THEN 'https://www.timeout.com/tokyo' ELSE '' END AS urls
FROM {{events}}""",
    # a detail page per event: JSON-LD in three shapes or none, meta tags, a facts table, pictures
    "event_pages": """
SELECT id AS page_id, source_url AS url, concat('<!DOCTYPE html><html><head><title>', title, ' | Feed</title>',
  CASE WHEN id % 3 = 0 THEN concat('<meta property="og:title" content="', title, '">') ELSE '' END,
  CASE WHEN summary IS NULL THEN '' ELSE concat('<meta content="', summary, '" name="description">') END,
  CASE WHEN id % 5 = 0 THEN concat('<meta property="og:image" content="/ogp/', cast(id AS string), '.png">') ELSE '' END,
  '<link rel="canonical" href="/event/', cast(id AS string), '">',
  CASE WHEN id % 4 = 0 THEN '' ELSE concat('<script type="application/ld+json">', CASE WHEN id % 4 = 2 THEN '[' WHEN id % 4 = 3 THEN concat(chr(123), '"@graph":[', chr(123), '"@type":"Organization","name":"Org"', chr(125), ',') ELSE '' END,
    chr(123), '"@type":"Event","name":"', title, '","startDate":"', cast(start_date AS string), 'T10:00:00+09:00"',
    CASE WHEN end_date IS NULL THEN '' ELSE concat(',"endDate":"', cast(end_date AS string), '"') END,
    ',"location":', chr(123), '"name":"', coalesce(venue, ''), '","address":', chr(123), '"streetAddress":"', coalesce(address, ''), '"', chr(125), chr(125),
    ',"offers":', chr(123), '"price":"', CASE WHEN size % 3 = 0 THEN '0' ELSE cast(size * 100 AS string) END, '","priceCurrency":"', CASE WHEN size % 7 = 0 THEN 'USD' ELSE 'JPY' END, '","url":"https://tickets.example.com/', cast(id AS string), '"', chr(125),
    CASE WHEN image_url IS NULL THEN '' ELSE concat(',"image":["', image_url, '"]') END, chr(125), CASE WHEN id % 4 = 2 THEN ']' WHEN id % 4 = 3 THEN concat(']', chr(125)) ELSE '' END, '</script>') END,
  '</head><body><script>var t = "<h1>no</h1>";</script><h1>', title_ja, '</h1><p>Hours &amp; place</p><table><tr><th>料金</th><td>', coalesce(price_text, ''), '</td></tr><tr><th>所在地</th><td>〒100-0001 ', coalesce(address, ''),
  '</td></tr></table><dl><dt>開催期間</dt><dd>', coalesce(list_date, ''), '</dd></dl><img src="/common/logo.png" width="300"><img class="event" alt="main" width="', cast(size * 10 AS string), 'px" src="/spot/ex', cast(id AS string), '/a.jpg"></body></html>') AS html
FROM {catalogue}""",
    # free text with visit facts, amounts and minutes taken from the columns
    "visit_texts": """
SELECT id, concat('イベント会場は', CASE size % 4 WHEN 0 THEN '屋内' WHEN 1 THEN '屋外' WHEN 2 THEN '屋内・屋外' ELSE '未定' END, 'です。', chr(10),
  CASE size % 3 WHEN 0 THEN '入場無料。' WHEN 1 THEN concat('料金 大人', cast(size * 100 AS string), '円、小人', cast(size * 50 AS string), '円。') ELSE '' END, chr(10),
  CASE size % 5 WHEN 0 THEN '要予約。' WHEN 1 THEN '予約不要。' WHEN 2 THEN '予約優先。' ELSE '' END, CASE size % 6 WHEN 0 THEN '雨天中止。' WHEN 1 THEN '雨天決行。' ELSE '' END, chr(10),
  CASE size % 4 WHEN 1 THEN concat('上野駅から徒歩', cast(size AS string), '分。') WHEN 2 THEN concat('最寄駅：銀座駅 徒歩約', cast(size AS string), '分。') WHEN 3 THEN concat('アクセスは下記の通りです。赤坂駅から徒歩5分、新橋駅から徒歩', cast(size AS string), '分。') ELSE '' END, chr(10),
  CASE size % 7 WHEN 0 THEN concat('所要時間約', cast(size AS string), '〜', cast(size * 2 AS string), '分。') WHEN 1 THEN concat('所要時間', cast(size AS string), '分。') ELSE '' END, chr(10),
  CASE size % 8 WHEN 0 THEN '駐車場なし' WHEN 1 THEN '駐車場あり' WHEN 2 THEN '近隣駐車場を利用' ELSE '' END, chr(10), CASE size % 9 WHEN 0 THEN '親子向け。' WHEN 1 THEN '3歳以上。' WHEN 2 THEN 'カップル向け。' ELSE '' END) AS text, size
FROM {catalogue}""",
    # listing pages: one page per brand with a card per event
    "event_cards": """
SELECT id, brand, concat('<li class="card"><a href="/event/ar1e', cast(id AS string), '/"><h3>', title, '</h3></a><span class="tag">', split(tags, ',')[CARD_FIRST], '</span><p class="area">', coalesce(area, ''), '</p><p>', coalesce(list_date, ''), '</p></li>') AS card
FROM {catalogue}""",
}

USES = {name: [t for t in [*TABLES, *VIEWS] if "{" + t + "}" in sql] for name, sql in VIEWS.items()}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if name not in VIEWS:
        raise AttributeError(name)
    parents = {t: view(spark, folder, t) for t in USES[name]}
    if name == "catalogue":
        parents["part"] = spread(parents["part"], "p_partkey")
    return spark.sql(VIEWS[name].replace("CARD_FIRST", "0"), **parents)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the tasks while they are narrow. A million of them fill one split of a file, and every page and rule
    is worked out from them; their hash, not the key, deals them, so a later join by the key still chooses its own partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


def with_views(sql: str) -> str:
    """The oracle text with the views it names (and the views those use) as leading CTEs."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                add(VIEWS[name].replace("{", " ").replace("}", " "))
                wanted.append(name)

    add(sql)
    if not wanted:
        return sql
    # arrays count from 0 in Spark and from 1 in DuckDB
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in USES[n]})})" for n in wanted).replace("CARD_FIRST", "1")
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if head:
        return f"WITH {head.group(1) or ''}{ctes}, {sql[head.end():]}"
    return f"WITH {ctes} {sql}"
