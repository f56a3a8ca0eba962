"""Classification rules over texts and tags."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsudoi.functions.dates import clock_minutes
from tsudoi.functions.text import WS, any_match, blank_to_null, first_rule, nfkc, squeeze, strip
from tsudoi.functions.urls import host

# ---- price ------------------------------------------------------------------------------------
# Price wording.
PRICE_VARIES = "(?:各種イベント|提供店|プログラム|イベント|店舗|お店|内容)によって(?:料金が)?(?:異なります|異なる)"
PRICE_FREE_BASE = ("(?:入場料金?(?:は|が|:)?無料|入場無料|観覧料(?:は|が)?無料|観覧無料|観覧は無料|参加費は不要|参加費不要|"
                   "無料で鑑賞|無料で観覧)")
PRICE_FREE_PART = "^(?:(?:入場|観覧|参加)(?:料(?:金)?)?(?:は|が)?)?無料[。．]?$"
PRICE_YEN = "[0-9][0-9,]*円"
PRICE_ENTRY_AMOUNT = "(?:一般|入場料|入場券|チケット|参加費)[0-9]"
PRICE_SIDE_FEE = "(?:屋台|飲食|キッチンカー|テント).{0,16}有料"


def price_compact(c: Column) -> Column:
    """NFKC text without any white space; the price rules read this form."""
    return F.regexp_replace(nfkc(c), WS, "")


def price_type(compact: Column) -> Column:
    """Free, partially_paid, paid, varies or null, first rule wins. Takes ``price_compact`` text."""
    has = lambda p: any_match(compact, p)
    yen, free_base = has(PRICE_YEN), has(PRICE_FREE_BASE)
    parts = F.filter(F.split(F.regexp_replace(compact, "^料金[:：]", ""), "[。．]"), lambda p: p != "")
    all_free = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(PRICE_FREE_PART))
    side_fee = ~has(PRICE_ENTRY_AMOUNT) & (has("サポーターズシート") | has(PRICE_SIDE_FEE))
    return (F.when(F.coalesce(compact, F.lit("")) == "", None).when(has(PRICE_VARIES), "varies").when(has("一部有料"), "partially_paid")
            .when(free_base & (has("有料") | yen | has("別途")), "partially_paid").when(free_base | all_free, "free")
            .when(has("無料ではな|無料じゃな"), "paid").when(yen & has("内容により異"), None).when(side_fee, None)
            .when(yen | has("有料"), "paid"))


# ---- night, kids, indoor ------------------------------------------------------------------------
# Evening words, and words that only look like them.
NIGHT_WORDS = "夜市|宵|夜間|夜祭|ナイト|ビアガーデン|盆踊|オクトーバーフェスト"
NIGHT_FALSE = "グッドナイト|暗闇"
NIGHT_FROM = 17 * 60


def is_night(text: Column, start_time: Column) -> Column:
    """True from words or a start at 17:00 or later, else null. ``text`` is NFKC."""
    words = any_match(F.regexp_replace(text, NIGHT_FALSE, ""), NIGHT_WORDS)
    return F.when(words | F.coalesce(clock_minutes(start_time) >= NIGHT_FROM, F.lit(False)), F.lit(True))


def resolve_night(rule: Column, model: Column) -> Column:
    """The rule beats the model; a lone model 'true' is not believed."""
    return F.when(F.coalesce(rule, F.lit(False)), True).when(F.coalesce(model, F.lit(False)), None).otherwise(model)


# Audience wording.
KIDS_EXCLUDED = ("未就学児(?:の)?入場不可|未就学児不可|幼児(?:の)?入場不可|乳幼児(?:の)?入場不可|子ども(?:の)?入場不可|子供(?:の)?入場不可|"
                 "こども(?:の)?入場不可|小学生(?:の)?入場不可|子ども不可|子供不可|こども不可|大人限定|大人向け|成人限定|未成年不可")
KIDS_PRICE = ("(?:高校生|中学生|小学生|未就学児|幼児|乳幼児|子ども|子供|こども|18歳未満|学生)(?:以下|未満)?.{0,16}(?:無料|円|割引|料金)|"
              "(?:子ども|子供|こども)も入場|(?:子ども|子供|こども)料金|学生料金")
KIDS_TARGETED = ("子ども向け|子供向け|こども向け|キッズ向け|キッズ|ファミリー向け|親子向け|親子で参加|親子参加|親子で学べ|親子で楽し|"
                 "小学生を対象|小学生対象|小学生向け|未就学児を対象|未就学児対象|未就学児向け|幼児向け|乳幼児向け|0歳から")
COMPANION = "^(?:子供と|子どもと|こどもと|お子様と|お子さまと|恋人と|夫婦で|友達と|友人と|一人で|両親と|家族で|仲間と)$"


def kids_from_text(c: Column) -> Column:
    """Excluded audience is false, named child audience is true, anything else null."""
    text = squeeze(c)
    return (F.when(any_match(text, KIDS_EXCLUDED), False)
            .when(any_match(F.regexp_replace(text, KIDS_PRICE, " "), KIDS_TARGETED), True))


def companion_only(tag: Column) -> Column:
    parts = F.filter(F.split(tag, rf"(?:[/／・,、]|{WS})+"), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(COMPANION))


def kids_from_tags(tags: Column, audience: Column) -> Column:
    """Companion tags say nothing; any true wins, then any false."""
    real = F.filter(F.transform(tags, strip), lambda t: (t != "") & ~companion_only(t))
    judged = F.concat(F.transform(F.coalesce(real, F.array().cast("array<string>")), kids_from_text), F.array(kids_from_text(audience)))
    any_of = lambda value: F.coalesce(F.exists(judged, lambda j: F.coalesce(j == value, F.lit(False))), F.lit(False))
    return F.when(any_of(True), True).when(any_of(False), False)


INDOOR = "屋内|室内|[0-9０-９]+階|ホール|プラネタリウム|美術館|博物館|科学館|ギャラリー"
OUTDOOR = "屋外|野外|運河|船上|クルーズ"


def is_indoor(place_text: Column) -> Column:
    """C14: indoor or outdoor words, but not both and not none."""
    inside, outside = any_match(place_text, INDOOR), any_match(place_text, OUTDOOR)
    return F.when(inside != outside, inside)


# ---- categories -----------------------------------------------------------------------------------
# The category vocabulary.
CATEGORIES = ("exhibition", "art", "science", "festival", "food", "kids", "traditional", "illumination", "nightlife", "workshop",
              "music", "sports", "market", "seasonal", "other")
# One tag to one category, first rule wins; a shopping-centre tag alone maps to nothing.
TAG_RULES = (
    ("美術展|博物|展覧会|特別展|企画展|展示会", "exhibition"), ("アニメ・ゲーム|アニメ|ゲーム", "exhibition"), ("商業施設", ""),
    ("体験イベント|アクティビティ|体験型", "workshop"), ("^祭り$|フェスティバル|パレード", "festival"),
    ("グルメ|フード|物産|ビアガーデン|グルメ・フード", "food"), ("子供|子ども|キッズ|ファミリー|親子", "kids"), ("ライブ|音楽|コンサート", "music"),
    ("スポーツ", "sports"), ("花火|紅葉|イルミ|クリスマス|花見|季節|夏祭|ハロウィン|ライトアップ", "seasonal"),
    ("フリーマーケット|物産展", "market"), ("ワークショップ|講演|トーク", "workshop"),
)


def map_categories(tags: Column) -> Column:
    """C11: tags to the vocabulary in tag order; 'other' only when nothing maps."""
    raw = F.array_distinct(F.filter(F.transform(tags, strip), lambda t: t != ""))
    mapped = F.array_distinct(F.array_compact(F.transform(raw, lambda t: F.when(companion_only(t), None).otherwise(
        blank_to_null(first_rule(t, TAG_RULES))))))
    return F.when(F.size(mapped) > 0, mapped).otherwise(F.array(F.lit("other")))


# Report buckets over tags and title.
BUCKETS = (
    ("商業施設|ショッピング|百貨店|デパート", "commercial"), ("アニメ・ゲーム|アニメ|ゲーム|ピクサー|ドラえもん|ポケモン", "anime_game"),
    ("キャラクター|サンリオ|ディズニー|ホグワーツ|ハローキティ|くまのプーさん|リラックマ", "character"),
    ("美術展|博物|展覧会|ミュージアム|特別展", "exhibition"), ("体験イベント|アクティビティ|体験型|ワークショップ", "experience"),
    ("グルメ|フード|物産|味覚", "food"), ("子供|子ども|キッズ|ファミリー|親子", "kids"),
    ("祭り|花火|紅葉|イルミ|クリスマス|花見|季節|夏祭|ハロウィン", "seasonal"),
)
# Genre tags the feed is known to use, and how the first of them picks a fallback bucket.
KNOWN_GENRES = ("祭り", "フェスティバル・パレード", "美術展・博物展", "商業施設のイベント", "商業施設イベント", "アニメ・ゲーム", "体験イベント・アクティビティ",
                "体験イベント", "グルメ・フードフェス", "物産展・観光フェア", "ライブ・音楽イベント", "映画イベント", "スポーツイベント", "展示会", "ライトアップ",
                "花見", "花火", "紅葉", "イルミネーション", "クリスマスイベント", "動物関連イベント", "講演会・トークショー", "伝統芸能・お笑いライブ", "趣味・生活",
                "花・自然", "年中行事・歳時記", "バーゲンセール", "フリーマーケット", "福袋・初売り", "カウントダウン", "味覚狩り・フルーツ狩り")
GENRE_FALLBACK = (("祭り|花火|紅葉|イルミ|クリスマス|花見", "seasonal"), ("商業施設", "commercial"), ("アニメ・ゲーム", "anime_game"),
                  ("美術展|博物", "exhibition"), ("体験", "experience"), ("グルメ|フード|物産", "food"))


def category_buckets(tags: Column, title: Column) -> Column:
    """C12."""
    joined = F.concat(F.array_join(tags, " "), F.lit(" "), F.coalesce(title, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(any_match(joined, p), F.lit(b)) for p, b in BUCKETS]))
    primary = F.get(F.filter(tags, lambda t: t.isin(*KNOWN_GENRES)), F.lit(0))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.coalesce(first_rule(primary, GENRE_FALLBACK), F.lit("other"))))


# Labels that are navigation, time, place or companion, not genre.
TAG_BLOCKLIST = ("関東", "東京都", "イベント", "関東のイベント", "東京都のイベント", "全件", "今日", "明日", "今週末", "イベント一覧", "条件", "施設条件", "タグ", "恋人・夫婦で", "食べる", "遊ぶ", "観る・学ぶ", "午前中", "お昼",
                 "夕方・夜", "31", "9月", "10月", "11月", "8月すべてのイベント", "花イベント", "その他", "その他のイベント", "無料イベント", "終了間際",
                 "アミューズメント施設", "ショッピング施設", "千代田区", "中央区", "港区", "新宿区", "文京区", "台東区", "墨田区", "江東区", "品川区", "目黒区",
                 "大田区", "世田谷区", "渋谷区", "中野区", "杉並区", "豊島区", "北区", "荒川区", "板橋区", "練馬区", "足立区", "葛飾区", "江戸川区", "八王子市",
                 "立川市", "武蔵野市", "町田市", "多摩市")


def clean_tags(*lists: Column) -> Column:
    """Tag lists in the given order, blocked labels out, first spelling kept."""
    every = F.flatten(F.array(*[F.coalesce(l, F.array().cast("array<string>")) for l in lists]))
    trimmed = F.transform(F.array_compact(every), strip)
    return F.array_distinct(F.filter(trimmed, lambda t: (t != "") & (F.char_length(t) <= 40) & ~t.isin(*TAG_BLOCKLIST)
                                     & ~t.rlike("^[0-9]+月$") & ~t.rlike("^(令和|平成)")))


def split_keywords(c: Column) -> Column:
    return F.split(c, "[,、/]")


# ---- open-data feed -------------------------------------------------------------------------------
# Outing rules of the municipal feed.
OUTING_HARD_EXCLUDE = ("法律相談|労働相談|行政相談|はり・マッサージ|マッサージサービス|家族会|茶話会|支援者向け|研修|求人|説明会|検診|健診|出演者募集|"
                       "事業者募集|職員向け|委員会|審議会|支援員|申請案内|手続き|(?<!交流)会議")
OUTING_INCLUDE = ("祭|まつり|華火|花火|フェス|マルシェ|ワークショップ|体験|講座|教室|講演|親子|子ども|こども|キッズ|幼児|展示|展覧会|展|コンサート|演奏|"
                  "ライブ|スポーツ|大会|公園|文化|ハロウィン|クリスマス|盆踊|見学会|作品|クルーズ|英語であそぼう|料理|昼食会|収穫|自然観察|生き物観察")
OUTING_BODY_EXCLUDE = "はり・マッサージ|家族会|茶話会|支援者向け"
CAFE_SUPPORT = "患者|家族|メンター|がん|介護|相談|支援者|支援"
CAFE_CULTURE = "文化|交流|江戸|展示|音楽|コンサート|物語|カフェ「"
VISIT_OK = "収穫|観察|体験|展示|文化"
PUBLISH_WORDS = ("祭|華火|花火|クルーズ|子ども|こども|親子|展示|文化|スポーツ|体験|ワークショップ|自然観察|生き物観察|収穫|料理|音楽|コンサート|フェス|マルシェ|"
                 "ボッチャ|江戸カフェ")
WELFARE_WORDS = ("介護|予防教室|家族介護|ひきこもり|ボランティア|養成|研修|人権|ユマニチュード|認知症|語り部ガイド|パソコン教室|タブレット|麻雀|ウクレレ|水泳教室|"
                 "テニスレッスン|体操教室|鍼|マッサージ")
# Place words outside and inside the feed's own ward.
OUTSIDE_PLACES = ("あきる野", "秋川", "千代田区", "中央区", "新宿区", "文京区", "台東区", "墨田区", "江東区", "品川区", "目黒区", "大田区", "世田谷区", "渋谷区",
                  "中野区", "杉並区", "豊島区", "北区", "荒川区", "板橋区", "練馬区", "足立区", "葛飾区", "江戸川区", "八王子", "立川市", "武蔵野", "三鷹", "青梅",
                  "府中市", "調布", "町田")
INSIDE_PLACES = ("港区", "赤坂", "青山", "六本木", "芝浦", "白金", "麻布", "高輪", "新橋", "虎ノ門", "浜松町", "田町", "愛宕", "汐留", "竹芝", "台場", "お台場",
                 "芝公園", "三田")


def _lines(*cols: Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in cols])


def outing_filter(title: Column, category: Column, target: Column, body: Column) -> Column:
    """struct<status, rule>; the rule name says which of the ordered rules decided."""
    head = _lines(title, category, target)
    blob = _lines(head, body)
    cafe, hard_head, include_head = any_match(head, "カフェ"), any_match(head, OUTING_HARD_EXCLUDE), any_match(head, OUTING_INCLUDE)
    rules = (
        (cafe & any_match(blob, CAFE_SUPPORT), "exclude", "support_cafe"),
        (hard_head | any_match(blob, OUTING_BODY_EXCLUDE), "exclude", "consultation_or_recruiting"),
        (any_match(title, "相談") & ~any_match(title, OUTING_INCLUDE), "exclude", "consultation_title"),
        (cafe & ~any_match(head, CAFE_CULTURE), "review", "cafe_only"),
        (any_match(head, "見学") & ~any_match(head, VISIT_OK), "review", "visit_only"),
        (cafe & any_match(head, CAFE_CULTURE), "include", "culture_cafe"),
        (any_match(blob, OUTING_HARD_EXCLUDE) & include_head, "review", "mixed_words"),
        (include_head, "include", "outing_words"),
    )
    out = None
    for hit, status, rule in rules:
        value = F.struct(F.lit(status).alias("status"), F.lit(rule).alias("rule"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("review").alias("status"), F.lit("undecided").alias("rule")))


def area_status(title: Column, venue: Column, body: Column, inside: str = "minato") -> Column:
    """Inside the feed's ward, outside it, or unknown."""
    place = _lines(venue, body)
    far, near = "|".join(OUTSIDE_PLACES), "|".join(INSIDE_PLACES)
    title_far, near_any = any_match(title, far), any_match(_lines(title, place), near)
    return (F.when(any_match(place, far), f"outside_{inside}").when(title_far & near_any, "unknown")
            .when(title_far, f"outside_{inside}").when(near_any, inside).otherwise("unknown"))


def publish_candidate(status: Column, title: Column, category: Column, body: Column, inside: str = "minato") -> Column:
    """C17: struct<candidate, rule>."""
    text = _lines(title, category, body)
    outing, welfare = any_match(text, PUBLISH_WORDS), any_match(text, WELFARE_WORDS)
    rule = (F.when(status == f"outside_{inside}", "outside").when(outing & welfare, "mixed_words").when(welfare, "welfare_words")
            .when(outing & (status == "unknown"), "outing_place_unknown").when(outing, "outing").otherwise("undecided"))
    return F.struct(rule.isin("outing", "outing_place_unknown").alias("candidate"), rule.alias("rule"))


# ---- reactions ------------------------------------------------------------------------------------
# Wording of first-hand, official and media posts (posts and stored excerpts differ slightly).
POST_EXPERIENCE = ("行ってきた|行ってき|見てきた|見て来|来たよ|行ってきた|楽し(かった|めた)|面白(かった|い)|混んで|混雑|空いて|すいて|子どもと|子供と|子連れ|雨(だった|で)|"
                   "待った|待ち時間|並んだ|列が|写真(撮|を撮)|撮った|おすすめ|オススメ|体験|入場(した|して)|会場(に|で)|現地|行ってみた|行ってよ|行こうと思|行ったら|行ったよ|"
                   "最高だった|良かった|よかった|寒かった|暑かった|感動")
EXCERPT_EXPERIENCE = ("行ってきた|行ってき|見てきた|見て来|来たよ|楽し(かった|めた)|面白(かった|い)|混んで|混雑|空いて|すいて|子どもと|子供と|子連れ|雨(だった|で)|"
                      "待った|待ち時間|並んだ|列が|写真(撮|を撮)|撮った|おすすめ|オススメ|体験|入場(した|して)|会場(に|で)|現地|行ってみた|行ってよ|行ったら|行ったよ|"
                      "最高だった|良かった|よかった|寒かった|暑かった|感動")
POST_OFFICIAL = ("公式(アカウント|情報|サイト|発表|HP)?|主催(者|より)?|オフィシャル|チケット(販売|発売)(中|開始)?|本日(より|から)開催|開催(決定|のお知らせ|します)|"
                 "ご来場お待ち|詳細は(こちら|公式)|プレスリリース")
EXCERPT_OFFICIAL = ("公式(アカウント|情報|サイト|発表|HP)?|主催(者|より)?|オフィシャル|チケット(販売|発売)|開催(決定|のお知らせ|します)|ご来場お待ち|詳細は(こちら|公式)|"
                    "プレスリリース")
MEDIA_WORDS = "ニュース|報道|イベント情報|まとめ|ウォーカー|walkerplus|gotokyo|enjoytokyo|ぴあ|timeout|タイムアウト|情報サイト|メディア"
MEDIA_NAMES = "walkerplus|gotokyo|enjoytokyo|ぴあ|timeout|ニュース"
MEDIA_HOSTS = (r"(?i)walkerplus\.|gotokyo\.|enjoytokyo\.|pia\.co\.jp|timeout\.com|asahi\.|yomiuri\.|mainichi\.|nhk\.or\.jp|natalie\.|moviewalker\.")
OFFICIAL_NAMES = "official|公式|staff|主催"
OFFICIAL_HANDLES = "_pr$|_info$|official"
ANNOUNCEMENT = ("開催(中|します|のお知らせ|決定)|チケット(発売|販売|受付)|詳細はこちら|公式サイト(へ|は|で)|お知らせ|入場無料(?!で行った)|本日オープン|期間限定開催|好評開催中|"
                "ぜひ(お越し|ご来場)")


def post_class(text: Column, username: Column, urls: Column) -> Column:
    """C19 for posts: experience, official, media or other."""
    user = F.lower(F.coalesce(username, F.lit("")))
    return (F.when(any_match(text, POST_EXPERIENCE), "experience")
            .when(any_match(text, POST_OFFICIAL) | user.rlike(OFFICIAL_NAMES) | user.rlike(OFFICIAL_HANDLES), "official")
            .when(any_match(text, MEDIA_WORDS) | F.coalesce(F.exists(urls, lambda u: u.rlike(MEDIA_HOSTS)), F.lit(False)), "media")
            .otherwise("other"))


def excerpt_class(source_type: Column, excerpt: Column, source_name: Column) -> Column:
    """C19 for stored excerpts."""
    name = F.lower(F.coalesce(source_name, F.lit("")))
    kind = F.coalesce(source_type, F.lit(""))
    return (F.when(any_match(excerpt, EXCERPT_EXPERIENCE), "experience")
            .when(kind.isin("official_web", "press_release") | any_match(excerpt, EXCERPT_OFFICIAL) | name.rlike(OFFICIAL_NAMES), "official")
            .when(kind.isin("news", "rss") | any_match(excerpt, MEDIA_WORDS) | name.rlike(MEDIA_NAMES), "media").otherwise("other"))


def announcement_heavy(text: Column) -> Column:
    """C20."""
    return ~any_match(text, POST_EXPERIENCE) & any_match(text, ANNOUNCEMENT)


def candidate_kind(url: Column) -> Column:
    """Kind hinted by an extra URL."""
    return F.coalesce(first_rule(F.lower(url), ((r"(\.xml|/feed/?|/rss/?|atom)", "rss"), ("press|prtimes|newsrelease", "press"),
                                                (r"blog|note\.com|medium\.com", "blog_news"))), F.lit("extra_url"))


NEWS_HOSTS = "news|nikkei|asahi|yomiuri|mainichi|nhk|reuters|kyodo|jiji"


def web_source_type(url: Column, kind: Column, content_kind: Column, official_domain: Column, hinted: Column | None = None) -> Column:
    """Stored source type of a page."""
    h = F.coalesce(host(url), F.lit(""))
    rules = (F.when(content_kind.isin("rss", "atom"), "rss")
             .when((kind == "official_url") | official_domain, "official_web").when(kind == "press", "press_release").when(kind == "rss", "rss")
             .when(h.rlike(NEWS_HOSTS) | (kind == "blog_news"), F.when(h.rlike(r"blog|note\.com|medium\.com"), "blog").otherwise("news"))
             .when(h.rlike(r"blog|note\.com|medium\.com|hatena"), "blog")
             .when(h.rlike("press|prtimes|newsrelease") | any_match(url, "(?i)/press/"), "press_release").otherwise("other_web"))
    return rules if hinted is None else F.coalesce(hinted, rules)


# Reaction themes and the words that reveal them.
THEMES = {
    "enjoyment": "楽し(かった|めた|んだ|む)|面白(かった|い)|満足|最高だった|見応え|また行きたい|展示を?楽|行ってよかった|見てよかった",
    "crowd": "混雑|混んで|人が多|人多|ガラガラ|空いて|すいて|閑散|ゆったり見|少人数",
    "wait_time": "待ち時間|待った|並ん|行列|列が|待機",
    "family": "子ども|子供|子連れ|家族|親子|キッズ",
    "photo": "写真|フォト|映え|撮っ|撮影",
    "rain": "雨|雨天|レイン|大雨|傘",
    "solo": "一人で|ひとりで|ソロ|単独",
    "date": "デート|カップル|恋人|彼氏|彼女",
    "recommended_time": "午前|午後|夕方|朝イチ|朝一|夜(が|は)?|平日|土日|週末|開場直後|閉館前|おすすめ.*時間|行きやすい時間",
}
THEME_ORDER = tuple(THEMES) + ("other",)
BODY_ENJOYMENT = ("楽し(かった|めた|んだ|む)|面白(かった|い)|満足|最高だった|見応え|また行きたい|展示を?楽|会場で楽し|イベントを?楽し|行ってよかった|見てよかった|行ってきた|"
                  "見てきた|入場.*(楽|面白)")
PERIPHERAL = ("最寄り駅|駅員|駅スタッフ|電車|乗り換え|乗換|遅延|運休|運行状況|帰宅|帰り道|帰り|アクセスが(良い|いい|よい|良く|よく)|アクセス良好|駐車場スタッフ|周辺店舗|"
              "コンビニ|レストラン|ランチ|ディナー|買い物|グッズ屋|移動が楽|駅が便利|周辺が便利")
VISIT_CRITICAL = "入退場|入場導線|退場|会場設備|会場入口|バリアフリー|アクセス(注意|難|が悪|が大変)|徒歩が.*(長い|遠い)|持ち物|ロッカー|雨天実施|中止"
TRAVEL_CLAUSES = "(?:最寄り駅|駅員|駅スタッフ|電車|帰宅|帰り道|アクセスが(?:良い|いい|よい|良く|よく))[^、。]*"
EXCLUDED_TOPICS = ("スタッフ対応|チケット(販売|発売|受付)|開催(中です|のお知らせ|決定)|詳細はこちら|公式サイト|プレスリリース|割引コード|求人|募集|宣伝|コラボカフェ(?!.*楽し)|グッズ売")
SPECIFIC_THEMES = ("crowd", "wait_time", "family", "photo", "rain", "solo", "date", "recommended_time")


def is_peripheral(text: Column) -> Column:
    """Mostly about the way there or the neighbourhood."""
    return any_match(text, PERIPHERAL) & ~any_match(text, VISIT_CRITICAL)


def valid_enjoyment(text: Column) -> Column:
    """Enjoyment of the event itself, also after travel clauses are taken out."""
    return any_match(text, BODY_ENJOYMENT) & (
        ~is_peripheral(text) | any_match(F.regexp_replace(text, TRAVEL_CLAUSES, ""), BODY_ENJOYMENT))


def bullet_theme(text: Column) -> Column:
    """Theme of a summary bullet, specific themes before enjoyment."""
    off_topic = is_peripheral(text) | (any_match(text, EXCLUDED_TOPICS) & ~any_match(text, VISIT_CRITICAL))
    out = F.when(off_topic, "other")
    for theme in SPECIFIC_THEMES:
        out = out.when(any_match(text, THEMES[theme]), theme)
    return out.when(valid_enjoyment(text), "enjoyment").otherwise("other")


def theme_counts_as_evidence(text: Column, theme: str) -> Column:
    hit = any_match(text, THEMES[theme])
    return hit & valid_enjoyment(text) if theme == "enjoyment" else hit


# ---- English titles -------------------------------------------------------------------------------
def clean_title(c: Column) -> Column:
    """Title part of a page title, site names and 'official' tails removed."""
    text = squeeze(c)
    first = F.regexp_replace(text, rf"{WS}*[|｜–—].*$", "")
    first = F.when(strip(first) == "", text).otherwise(strip(first))
    return blank_to_null(strip(F.regexp_replace(first, rf"(?i){WS}*[-–—]{WS}*(公式|Official).*$", "")))


def looks_english(c: Column) -> Column:
    """C29."""
    text = squeeze(c)
    n, latin = F.char_length(text), F.regexp_count(text, F.lit("[A-Za-z]"))
    japanese = F.regexp_count(text, F.lit(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"))
    return F.coalesce(n.between(3, 200) & (latin >= 4) & (japanese <= F.greatest(F.lit(2), F.floor(latin * 0.35)))
                      & ~text.rlike("(?i)^(home|official|top|news|blog)$"), F.lit(False))
