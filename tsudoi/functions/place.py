"""Place rules: area, municipality, place, address clean-up."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.functions.text import any_match, blank_to_null, first_rule, let, nfkc, squeeze, strip

# Area slugs and their labels.
AREA_LABELS = {
    "arakawa": "荒川区", "asakusa": "浅草", "chuo": "中央区", "ginza": "銀座", "harajuku": "原宿", "higashiyamato": "東大和市",
    "ikebukuro": "池袋", "koenji": "高円寺", "machida": "町田市", "meguro": "目黒区", "minato": "港区", "odaiba": "お台場",
    "oji": "王子", "roppongi": "六本木", "shibuya": "渋谷区", "shinjuku": "新宿区", "sumida": "墨田区", "taito": "台東区",
    "tama": "多摩市", "ueno": "上野", "yokohama": "横浜",
}
# Labels of the other municipality slugs.
MUNICIPALITY_LABELS = {
    "adachi": "足立区", "akiruno": "あきる野市", "bunkyo": "文京区", "chiyoda": "千代田区", "chofu": "調布市", "edogawa": "江戸川区",
    "fuchu": "府中市", "hachioji": "八王子市", "hamura": "羽村市", "itabashi": "板橋区", "katsushika": "葛飾区", "kita": "北区",
    "kodaira": "小平市", "koganei": "小金井市", "kokubunji": "国分寺市", "kunitachi": "国立市", "koto": "江東区", "mitaka": "三鷹市",
    "musashino": "武蔵野市", "nakano": "中野区", "nerima": "練馬区", "ota": "大田区", "setagaya": "世田谷区", "shinagawa": "品川区",
    "suginami": "杉並区", "tachikawa": "立川市", "toshima": "豊島区", "kichijoji": "吉祥寺",
}
PLACE_LABELS = {**MUNICIPALITY_LABELS, **AREA_LABELS}
# Neighbourhood patterns, first match wins.
NEIGHBOURHOODS = (
    ("お台場|odaiba", "odaiba"), ("六本木|roppongi", "roppongi"), ("銀座|ginza", "ginza"), ("浅草|asakusa", "asakusa"),
    ("上野|ueno", "ueno"), ("原宿|harajuku|表参道|omotesando", "harajuku"), ("池袋|ikebukuro", "ikebukuro"), ("高円寺|koenji", "koenji"),
    ("(?<!八)王子|(?:^|[^a-z])oji(?:$|[^a-z])", "oji"),
)


def _latin(name: str) -> str:
    return f"(?:^|[^a-z]){name}(?:$|[^a-z-])"


def _short(name: str, tail: str = r"[\s　]") -> str:
    return rf"(?:^|[\s　]){name}(?:$|{tail})|^{name}$"


# Ward and city patterns, first match wins; bare short names come last.
WARDS = (
    ("東大和市|higashiyamato", "higashiyamato"), ("あきる野市|akiruno", "akiruno"), ("国分寺市|kokubunji", "kokubunji"),
    ("小平市|kodaira", "kodaira"), ("羽村市|hamura", "hamura"), ("国立市|kunitachi", "kunitachi"), ("府中市|fuchu", "fuchu"),
    (f"多摩市|{_latin('tama')}", "tama"), ("町田市|machida", "machida"), (f"渋谷区|{_latin('shibuya')}", "shibuya"),
    (f"新宿区|{_latin('shinjuku')}", "shinjuku"), (f"台東区|{_latin('taito')}", "taito"), (f"墨田区|{_latin('sumida')}", "sumida"),
    (f"荒川区|{_latin('arakawa')}", "arakawa"), (f"目黒区|{_latin('meguro')}", "meguro"), (f"港区|{_latin('minato')}", "minato"),
    (f"中央区|{_latin('chuo')}", "chuo"), ("八王子市|hachioji", "hachioji"), ("葛飾区|katsushika", "katsushika"),
    ("板橋区|itabashi", "itabashi"), ("江戸川区|edogawa", "edogawa"), ("中野区|nakano", "nakano"), ("豊島区|toshima", "toshima"),
    (f"江東区|{_latin('koto')}", "koto"), ("足立区|adachi", "adachi"), ("武蔵野市|musashino", "musashino"), ("調布市|chofu", "chofu"),
    ("三鷹市|mitaka", "mitaka"), (_short("渋谷"), "shibuya"), (_short("新宿"), "shinjuku"), (_short("目黒"), "meguro"),
    (_short("町田"), "machida"), (_short("多摩", r"[\s　市]"), "tama"),
)
# Municipalities named outright; 港北区 is not 北区.
EXPLICIT = (
    ("東大和市", "higashiyamato"), ("あきる野市", "akiruno"), ("国分寺市", "kokubunji"), ("羽村市", "hamura"), ("国立市", "kunitachi"),
    ("府中市", "fuchu"), ("八王子市", "hachioji"), ("武蔵野市", "musashino"), ("横浜市", "yokohama"), ("小金井市", "koganei"),
    ("小平市", "kodaira"), ("立川市", "tachikawa"), ("町田市", "machida"), ("調布市", "chofu"), ("三鷹市", "mitaka"), ("多摩市", "tama"),
    ("葛飾区", "katsushika"), ("板橋区", "itabashi"), ("江戸川区", "edogawa"), ("中野区", "nakano"), ("豊島区", "toshima"), ("江東区", "koto"),
    ("足立区", "adachi"), ("千代田区", "chiyoda"), ("世田谷区", "setagaya"), ("杉並区", "suginami"), ("品川区", "shinagawa"),
    ("練馬区", "nerima"), ("大田区", "ota"), ("渋谷区", "shibuya"), ("新宿区", "shinjuku"), ("中央区", "chuo"), ("文京区", "bunkyo"),
    ("台東区", "taito"), ("墨田区", "sumida"), ("目黒区", "meguro"), ("荒川区", "arakawa"), ("(?<!港)北区", "kita"), ("港区", "minato"),
)
# Neighbourhoods with one parent, and those whose parent is not unique.
PARENT = {"roppongi": "minato", "ginza": "chuo", "asakusa": "taito", "ueno": "taito", "harajuku": "shibuya", "koenji": "suginami"}
REVIEW_AREAS = ("odaiba", "ikebukuro", "oji", "kichijoji")
MUNICIPALITIES = tuple(slug for _, slug in EXPLICIT)
TOKEN = r"(?:東京都|神奈川県|埼玉県|千葉県)?([^\s\x{3000}0-9０-９]{1,10}?[市区])"


def lookup_text(c: Column) -> Column:
    return F.coalesce(strip(nfkc(c)), F.lit(""))


def municipality_token(text: Column) -> Column:
    """C2 over lookup text."""
    return blank_to_null(F.regexp_extract(text, TOKEN, 1))


def _joined(*cols: Column) -> Column:
    return F.concat_ws(" ", *[blank_to_null(c) for c in cols])


def resolve_area(hint: Column, address: Column, venue: Column) -> Column:
    """C1 over lookup texts. Composite texts are bound once, then run through the ordered patterns."""
    slug = F.lower(hint)
    by = lambda rules, value: let(value, lambda x: F.when(x.rlike("|".join(p for p, _ in rules)), first_rule(x, rules)))
    named = _joined(hint, venue)
    return F.when(slug.isin(*AREA_LABELS), slug).otherwise(F.coalesce(
        by(NEIGHBOURHOODS, named), by(NEIGHBOURHOODS, address), by(NEIGHBOURHOODS, _joined(hint, venue, address)),
        by(WARDS, named), by(WARDS, municipality_token(address)), by(WARDS, address)))


def explicit_municipalities(text: Column) -> Column:
    """Every municipality the text names."""
    named = F.array_compact(F.array(*[F.when(any_match(text, p), F.lit(slug)) for p, slug in EXPLICIT]))
    return F.when(any_match(text, "[市区]"), named).otherwise(F.array().cast("array<string>"))


def _mapped(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def municipality_of_area(area: Column) -> Column:
    key = blank_to_null(F.lower(strip(area)))
    return F.when(key == "tama", None).when(key.isin(*PARENT), _mapped(key, PARENT)).when(key.isin(*MUNICIPALITIES), key)


def infer_municipality(area: Column, address_names: Column, venue_names: Column) -> Column:
    """C4. One named municipality decides; several named ones decide for 'unknown'; none falls through."""
    only = lambda names: F.when(F.size(names) == 1, F.get(names, F.lit(0)))
    return (F.when(F.size(address_names) > 0, only(address_names)).when(F.size(venue_names) > 0, only(venue_names))
            .otherwise(municipality_of_area(area)))


def with_place(df: DataFrame, hint: str | None = "area", address: str = "address", venue: str = "venue") -> DataFrame:
    """C5. Adds place struct<municipality, area, legacy_area, token>."""
    hint_col = F.col(hint) if hint else F.lit(None).cast("string")
    step = df.withColumns({"_h": lookup_text(hint_col), "_a": lookup_text(F.col(address)), "_v": lookup_text(F.col(venue))})
    h, a, v = F.col("_h"), F.col("_a"), F.col("_v")
    step = step.withColumns({"_legacy": resolve_area(h, a, v), "_by_venue": resolve_area(F.lit(""), a, v),
                             "_token": municipality_token(a), "_an": explicit_municipalities(a), "_vn": explicit_municipalities(v)})
    town = lambda c: F.when(c.isin(*PARENT), c)
    review = lambda c: F.when(c.isin(*REVIEW_AREAS), c)
    legacy, by_venue = F.col("_legacy"), F.col("_by_venue")
    step = step.withColumns({"_town": F.coalesce(town(by_venue), town(legacy)), "_review": F.coalesce(review(by_venue), review(legacy))})
    step = step.withColumn("_m", infer_municipality(F.coalesce("_town", "_legacy", "_by_venue"), F.col("_an"), F.col("_vn")))
    area = F.when(F.col("_town").isNotNull(), F.when(F.col("_m") == _mapped(F.col("_town"), PARENT), F.col("_town"))).otherwise(F.col("_review"))
    return (step.withColumn("place", F.struct(F.col("_m").alias("municipality"), area.alias("area"), legacy.alias("legacy_area"), F.col("_token").alias("token")))
            .drop("_h", "_a", "_v", "_legacy", "_by_venue", "_an", "_vn", "_town", "_review", "_m", "_token"))


def with_municipality(df: DataFrame, area: str = "area", address: str = "address", venue: str = "venue",
                      out: str = "inferred_municipality") -> DataFrame:
    step = df.withColumns({"_an": explicit_municipalities(lookup_text(F.col(address))), "_vn": explicit_municipalities(lookup_text(F.col(venue)))})
    return step.withColumn(out, infer_municipality(F.col(area), F.col("_an"), F.col("_vn"))).drop("_an", "_vn")


# Words that start an access note inside an address.
ACCESS_MARKERS = (r"(?i)[・･]\s*(?:JR|ｊｒ)", r"[・･]\s*地下鉄", r"[・･]\s*都営", r"[・･]\s*東京メトロ", r"[・･]\s*メトロ", r"[・･]\s*徒歩",
                  r"[・･]\s*(?:京王|小田急|東急|西武|東武|京成|りんかい|ゆりかもめ|つくばエクスプレス|TX)")


def clean_address(c: Column) -> Column:
    """C6. Cuts a trailing access note unless what is left no longer reads like an address."""
    text = squeeze(nfkc(c))
    starts = [F.regexp_instr(text, F.lit(m)) for m in ACCESS_MARKERS]
    cut = F.array_min(F.filter(F.array(*starts), lambda i: i > 1))
    head = strip(F.regexp_replace(F.substring(text, F.lit(1), cut - 1), r"[・･、，,\s]+$", ""))
    n = F.char_length(head)
    keep = (n >= 8) & (head.rlike("[都道府県市区町村]") | head.rlike("[0-9]")) & (n >= F.least(F.lit(15.0), F.char_length(text) * 0.4))
    return blank_to_null(F.when(cut.isNotNull() & keep, head).otherwise(text))


def place_label(municipality: Column, area: Column, omit_raw: bool = False) -> Column:
    """E3. Ward and area in one label, without repetition."""
    def part(c: Column) -> Column:
        raw = blank_to_null(strip(c))
        known = _mapped(F.lower(raw), PLACE_LABELS)
        rest = F.when(~raw.rlike("(?i)^[a-z0-9-]+$"), raw) if omit_raw else raw
        return F.coalesce(known, rest)
    ward, town = part(municipality), part(area)
    return (F.when(ward.isNotNull() & town.isNotNull() & (ward != town), F.concat(ward, F.lit("・"), town))
            .otherwise(F.coalesce(ward, town)))
