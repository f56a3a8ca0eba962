"""Page jobs (P1-P10, W18, W19): metadata, plain text, JSON-LD, labelled facts, cards, visit facts.

A page is read once, by ``markup.with_facts``, into a typed struct of what its markup holds; everything else is a Spark
expression over that struct, JSON-LD by the variant type, so a page job needs neither a second scan nor an exchange.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsudoi.functions import images
from tsudoi.functions.dates import safe_date, time_of_iso
from tsudoi.functions.feeddates import listing_dates
from tsudoi.functions.markup import with_facts
from tsudoi.functions.text import WS, any_match, blank_to_null, clean_text, let, nfkc, squeeze, strip, truncate
from tsudoi.functions.urls import absolute_url
from tsudoi.plans.ranking import top_k

# ---- text and tags -----------------------------------------------------------------------------
HIDDEN_BLOCKS = r"(?is)<(script|style|noscript|svg|iframe)\b[^>]*>.*?</\1\s*>"
COMMENTS = r"(?s)<!--.*?-->"
ENTITIES = (("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&amp;", "&"))


def decode_basic(c: Column) -> Column:
    out = c
    for pattern, char in ENTITIES:
        out = F.regexp_replace(out, pattern, char)
    return out


def visible_html(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, COMMENTS, " "), HIDDEN_BLOCKS, " ")


def strip_tags(html: Column) -> Column:
    """One line of text without tags, scripts and styles."""
    return squeeze(decode_basic(F.regexp_replace(visible_html(html), "<[^>]+>", " ")))


def plain_text(html: Column) -> Column:
    """Text with the line breaks of block elements kept."""
    broken = F.regexp_replace(visible_html(html), r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/dd|/dt|/table|/ul|/article|/section)\b[^>]*>", "\n")
    text = decode_basic(F.regexp_replace(broken, "<[^>]+>", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\x{00a0}]+", " "), r" ?\n ?", "\n")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def meta_content(metas: Column, *names: str) -> Column:
    """Content of the first meta tag, by name or property, in the order of ``names``."""
    one = lambda name: F.get(F.filter(metas, lambda m: (m["name"] == name) & F.coalesce(m["content"] != "", F.lit(False))), F.lit(0))["content"]
    return F.coalesce(*[one(n) for n in names])


def metadata(facts: str, url: Column) -> dict[str, Column]:
    """Title, description, site_name, published, canonical and the excerpt of a page from its facts."""
    f = lambda name: F.col(f"{facts}.{name}")
    m, title, description = f("metas"), F.coalesce(meta_content(f("metas"), "og:title"), f("title")), meta_content(f("metas"), "og:description", "description", "twitter:description")
    body = F.concat_ws(" — ", description, blank_to_null(f("main")))
    return {"title": title, "description": description, "site_name": meta_content(m, "og:site_name"),
            "published": F.coalesce(meta_content(m, "article:published_time", "pubdate", "publishdate"), blank_to_null(f("time"))),
            "canonical": absolute_url(F.coalesce(f("canonical"), meta_content(m, "og:url")), url),
            "excerpt": truncate(F.coalesce(blank_to_null(body), title, F.lit("")), 400)}


def page_metadata(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """P1. Adds title, description, site_name, published, canonical and a short excerpt; drops the html."""
    return with_facts(pages, html).withColumns(metadata("_facts", F.col(url))).drop("_facts")


# ---- JSON-LD -------------------------------------------------------------------------------------
LD_BLOCK = r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""


def node_list(blocks: Column) -> Column:
    """The nodes of JSON-LD blocks as one array, arrays and @graph flattened in page order; bad JSON is skipped."""
    arr = lambda c, path: F.try_variant_get(c, path, "array<variant>")
    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(strip(b))), lambda v: v.isNotNull())
    listed = F.flatten(F.transform(parsed, lambda v: F.coalesce(arr(v, "$"), F.array(v))))
    return F.flatten(F.transform(listed, lambda n: F.coalesce(arr(n, '$["@graph"]'), F.array(n))))


def json_ld_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """P3. (key, pos, node variant): blocks, arrays and @graph flattened in page order; bad JSON is skipped."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(LD_BLOCK), 1)).alias("b", "raw"))
    parsed = blocks.withColumn("v", F.try_parse_json(strip(F.col("raw")))).where(F.col("v").isNotNull())
    arr = lambda c, path: F.try_variant_get(c, path, "array<variant>")
    listed = parsed.select(key, "b", F.posexplode(F.coalesce(arr("v", "$"), F.array("v"))).alias("i", "n"))
    nodes = listed.select(key, "b", "i", F.posexplode(F.coalesce(arr("n", '$["@graph"]'), F.array("n"))).alias("j", "node"))
    return nodes.select(key, F.struct("b", "i", "j").alias("pos"), "node")


def _str(node: str | Column, path: str) -> Column:
    """A text value; numbers and objects at the path do not count as text."""
    v = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", clean_text(F.try_variant_get(node, path, "string")))


def _types(node: str | Column) -> Column:
    return F.coalesce(F.try_variant_get(node, '$["@type"]', "array<string>"), F.array_compact(F.array(F.try_variant_get(node, '$["@type"]', "string"))))


def event_nodes(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """P3. The first Event node of each page."""
    return top_k(nodes.where(F.array_contains(_types("node"), "Event")), [key], [F.col("pos")], 1, "_r").drop("_r")


def strip_postal(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, rf"^〒?{WS}*[0-9]{{3}}-?[0-9]{{4}}{WS}*", ""))


def offer_list(node: str) -> Column:
    return F.coalesce(F.try_variant_get(node, "$.offers", "array<variant>"), F.array_compact(F.array(F.try_variant_get(node, "$.offers", "variant"))))


def offers_price_text(node: str) -> Column:
    """Offers as price text, 'name: amount' joined by ' / '; zero and 'none' say nothing."""
    def one(o: Column) -> Column:
        get = lambda p, t="string": F.try_variant_get(o, p, t)
        raw = F.coalesce(get("$.price"), get("$.lowPrice"), get("$.highPrice"))
        number = raw.rlike(r"^[0-9]+(\.[0-9]+)?$")
        amount = F.when(number & (raw.try_cast("double") > 0), F.concat(raw, F.when(F.coalesce(get("$.priceCurrency"), F.lit("JPY")) == "JPY", "円")
                                                                        .otherwise(F.concat(F.lit(" "), get("$.priceCurrency")))))
        words = F.when(~number & ~raw.rlike("(?i)^none$") & raw.rlike(PRICE_VALUE), strip(raw))
        value = F.coalesce(amount, words)
        return F.when(value.isNotNull(), F.concat_ws(": ", clean_text(get("$.name")), value))
    return blank_to_null(F.array_join(F.array_compact(F.transform(offer_list(node), one)), " / "))


def first_event(nodes: Column) -> Column:
    return F.get(F.filter(nodes, lambda n: F.coalesce(F.array_contains(_types(n), "Event"), F.lit(False))), F.lit(0))


def event_facts(node: str, page: Column) -> dict[str, Column]:
    """Name, dates, clocks, venue, address, area, price text, url and image of an Event node."""
    g = lambda p: _str(node, p)
    parts = F.concat_ws(" ", g("$.location.address.streetAddress"), g("$.location.address.addressLocality"), g("$.location.address.addressRegion"))
    address = F.coalesce(g("$.location.address"), blank_to_null(parts))
    image = F.coalesce(F.try_variant_get(node, "$.image", "array<variant>"), F.array_compact(F.array(F.try_variant_get(node, "$.image", "variant"))))

    def image_text(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$.contentUrl", "string"), F.try_variant_get(v, "$.url", "string"),
                          F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))

    urls = F.array_compact(F.transform(image, lambda v: images.valid_image(image_text(v), page)))
    return {"title": g("$.name"), "description": g("$.description"), "start_date": safe_date(F.substring(g("$.startDate"), 1, 10)),
            "end_date": safe_date(F.substring(g("$.endDate"), 1, 10)), "start_time": time_of_iso(g("$.startDate")),
            "end_time": time_of_iso(g("$.endDate")), "venue": g("$.location.name"), "address": strip_postal(address),
            "area": g("$.location.address.addressLocality"), "price_text": offers_price_text(node),
            "official_url": absolute_url(g("$.url"), page), "image_url": F.get(urls, F.lit(0))}


def json_ld_fields(nodes: DataFrame, pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """P4. Event facts per page: name, dates, clocks, venue, address, area, price text, url, image."""
    ev = event_nodes(nodes, key).join(pages.select(key, F.col(url).alias("_page")), key)
    return ev.select(key, *[c.alias(name) for name, c in event_facts("node", F.col("_page")).items()])


# ---- labelled facts ------------------------------------------------------------------------------
PRICE_LABEL = "^(料金|入場料|入場|チケット|観覧料|参加費|利用料|一般|大人|学生|高校生|中学生|小人|シニア)"
PRICE_VALUE = r"([0-9]{1,3}(?:,[0-9]{3})*\s*円|無料|入場無料|有料|¥\s*[0-9]|各[0-9]|要問合せ|要予約)"
# Label words per field; the first field a label fits takes the value.
LABELS = (("開催期間|開催日|期間", "period"), ("開催時間|開館時間|営業時間|開催時刻|開始時間|開演時間|開場時間|^時間$", "hours"), ("住所|所在地", "address"),
          ("会場|開催場所|場所", "venue"), (PRICE_LABEL, "price"), ("公式|ホームページ|URL", "official_url"))


def labelled_pairs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """P5. (key, seq, label, value, href) of table rows and definition lists, in page order per kind."""
    pairs = with_facts(pages.select(key, html), html).select(key, F.posexplode("_facts.pairs").alias("i", "p"))
    return pairs.select(key, F.struct("p.kind", "i").alias("seq"), "p.label", "p.value", "p.href")


def label_field(label: Column) -> Column:
    """P5: the field a label names, null if none; update dates are no facts."""
    field = F.when(label.rlike("更新日"), F.lit(None).cast("string"))
    for pattern, name in LABELS:
        field = field.when(label.rlike(pattern), name)
    return field


def telling(field: Column, value: Column, href: Column) -> Column:
    """P5: whether a labelled value says something; a price needs an amount or a price word."""
    return field.isNotNull() & ((value != "") | href.isNotNull()) & ((field != "price") | (value.rlike(PRICE_VALUE) & F.char_length(value).between(2, 180)))


def labelled_facts(pairs: DataFrame, key: str = "page_id") -> DataFrame:
    """P5. (key, field, value, href): the first fitting label per field."""
    rows = pairs.withColumn("field", label_field(F.col("label"))).where(telling(F.col("field"), F.col("value"), F.col("href")))
    best = rows.groupBy(key, "field").agg(F.min(F.struct("seq", "label", "value", "href")).alias("b"))
    return best.select(key, "field", "b.label", "b.value", "b.href")


def fact_list(pairs: Column) -> Column:
    """P5 in one row: structs (field, label, value, href) of the pairs that say something, in their order."""
    named = F.transform(pairs, lambda p: F.struct(label_field(p["label"]).alias("field"), p["label"].alias("label"), p["value"].alias("value"), p["href"].alias("href")))
    return F.filter(named, lambda p: F.coalesce(telling(p["field"], p["value"], p["href"]), F.lit(False)))


# ---- field choice --------------------------------------------------------------------------------
def choose_fields(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """W19. candidates(key, field, tier, seq, value, source): the first non-empty value by tier, with its source."""
    filled = candidates.where(strip(F.col("value")) != "")
    best = filled.groupBy(key, "field").agg(F.min(F.struct("tier", "seq", "value", "source")).alias("b"))
    return best.select(key, "field", "b.value", "b.source", "b.tier")


DETAIL_FIELDS = ("title", "description", "start_date", "end_date", "start_time", "end_time", "venue", "address", "price_text", "official_url", "image_url")


def detail_records(pages: DataFrame, listing: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """P6. One record per page from JSON-LD (tier 1), labelled facts (2), page and meta (3) and the listing (4, one row per
    key), with field_sources telling where each value came from. One scan and no exchange, but for a listing's join.
    Pages that say nothing give no record."""
    read = with_facts(pages.select(key, "url", "html"))
    read = read.select(key, "url", "_facts", first_event(node_list(F.col("_facts.json_ld"))).alias("_event"), fact_list(F.col("_facts.pairs")).alias("_labelled"))
    ld, meta = event_facts("_event", F.col("url")), metadata("_facts", F.col("url"))
    fact = lambda field: F.get(F.filter("_labelled", lambda p: p["field"] == field), F.lit(0))
    listed = [] if listing is None else [f for f in DETAIL_FIELDS if f in listing.columns]
    step = read.select(key, "url", *[ld[f].alias("ld_" + f) for f in DETAIL_FIELDS], F.get("_facts.h1", F.lit(0)).alias("_h1"), meta["title"].alias("_title"), meta["description"].alias("_description"),
                       *[fact(f).alias("t_" + f) for f in ("period", "venue", "address", "price", "official_url")])
    step = step.withColumn("_period", listing_dates(F.col("t_period.value")))
    if listed:
        step = step.join(listing.select(key, *[F.col(f).alias("l_" + f) for f in listed]), key, "left")
    told: dict[str, list[tuple[Column, Column]]] = {f: [(F.col("ld_" + f).cast("string"), F.lit("jsonld." + f))] for f in DETAIL_FIELDS}
    table = lambda name, value: (value, F.concat(F.lit("table."), F.col(f"t_{name}.label")))
    told["venue"].append(table("venue", F.col("t_venue.value")))
    told["address"].append(table("address", strip_postal(F.col("t_address.value"))))
    told["price_text"].append(table("price", F.col("t_price.value")))
    told["official_url"].append(table("official_url", F.coalesce("t_official_url.href", "t_official_url.value")))
    for f in ("start_date", "end_date"):
        told[f].append((F.col("_period." + f).cast("string"), F.lit("table." + f)))
    told["title"] += [(F.col("_h1"), F.lit("h1.title")), (F.col("_title"), F.lit("meta.title"))]
    told["description"].append((F.col("_description"), F.lit("meta.description")))
    for f in listed:
        told[f].append((strip(F.col("l_" + f).cast("string")), F.lit("listing." + f)))
    chosen = {f: F.coalesce(*[F.when(v != "", F.struct(v.alias("value"), s.alias("source"))) for v, s in ways]) for f, ways in told.items()}
    # a generator leaves empty records out; a filter would be pushed down and compute every field twice
    whole = F.filter(F.array(F.struct(*[c.alias(f) for f, c in chosen.items()])), lambda r: F.coalesce(*[r[f] for f in DETAIL_FIELDS]).isNotNull())
    step = step.select(key, F.explode(whole).alias("_r")).select(key, "_r.*")
    sources = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f + ".source").alias("source")) for f in sorted(DETAIL_FIELDS)]), lambda s: s["source"].isNotNull())
    return step.select(key, *[F.col(f + ".value").alias(f) for f in DETAIL_FIELDS], F.map_from_entries(sources).alias("field_sources"))


# ---- listing cards -------------------------------------------------------------------------------
def listing_cards(pages: DataFrame, detail_link: str, key: str = "page_id", url: str = "url") -> DataFrame:
    """P7. (key, pos, title, detail_url, date_text, start_date, end_date, area, venue, tags, summary, image_url):
    one row per card whose link matches ``detail_link``, the first per detail URL and page."""
    blocks = with_facts(pages.select(key, url, "html")).select(key, url, F.posexplode("_facts.cards").alias("pos", "card"))
    link = F.get(F.filter("card.links", lambda a: F.coalesce(any_match(a["href"], detail_link), F.lit(False))), F.lit(0))
    step = blocks.withColumn("_a", link).where(F.col("_a").isNotNull())
    marked = lambda name: F.transform(F.filter("card.classed", lambda e: F.contains(e["cls"], F.lit(name))), lambda e: e["text"])
    heading = F.coalesce(blank_to_null(F.col("_a.title")), blank_to_null(F.col("card.heading")), blank_to_null(F.get("card.links", F.lit(0))["text"]))
    date_text = blank_to_null(F.regexp_extract("card.text", r"((?:開催中\s*|終了間近\s*)?(?:[〜～]\s*)?[0-9]{4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日[^。\n]{0,60})", 1))
    paragraphs = F.filter("card.paragraphs", lambda p: F.char_length(p).between(8, 200) & ~any_match(p, r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月"))
    rows = step.select(key, "pos", heading.alias("title"), absolute_url(F.col("_a.href"), F.col(url)).alias("detail_url"), date_text.alias("date_text"),
                       blank_to_null(F.get(marked("area"), F.lit(0))).alias("area"), blank_to_null(F.get(marked("venue"), F.lit(0))).alias("venue"), marked("tag").alias("tags"),
                       F.get(paragraphs, F.lit(0)).alias("summary"), absolute_url(F.col("card.image"), F.col(url)).alias("image_url"))
    rows = rows.where(F.char_length("title") >= 2).withColumn("_d", listing_dates(F.col("date_text"))).withColumns(
        {"start_date": F.col("_d.start_date"), "end_date": F.col("_d.end_date")}).drop("_d")
    return top_k(rows, [key, "detail_url"], [F.col("pos")], 1, "_f").drop("_f")


# ---- images --------------------------------------------------------------------------------------
def scored_images(imgs: Column, page: Column) -> Column:
    """Structs (s, pos, image_url) of the usable <img> tags; the smallest is the best, s is the negative score."""
    def one(img: Column, pos: Column) -> Column:
        size = lambda n: F.regexp_replace(img[n], "(?i)px$", "").try_cast("double")
        cls, alt, w, h = F.lower(F.coalesce(img["cls"], F.lit(""))), F.lower(F.coalesce(img["alt"], F.lit(""))), size("width"), size("height")

        def graded(url: Column) -> Column:
            u = F.lower(url)
            pts = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
            largest = F.greatest(F.coalesce(w, F.lit(0.0)), F.coalesce(h, F.lit(0.0)))
            score = (F.lit(10) + pts(u.rlike(r"/spot/(ex|ev)[0-9]+/"), 50) + pts(u.rlike("/assets/images/event(/|_draft/)"), 50) + pts(cls.rlike("js-image-view-image"), 40)
                     + pts(cls.rlike("event|exhibition|spot"), 10) + pts((alt != "") & ~alt.rlike("facebook|twitter|youtube|instagram|logo"), 5)
                     - pts(u.rlike("/shared/"), 20) - pts(u.rlike("/assets/pr/"), 100) - pts(u.rlike(r"ogp\.png"), 100)
                     + F.when(largest >= 200, 15).when(largest >= 100, 5).otherwise(0))
            small = F.coalesce((w > 0) & (w < 48), F.lit(False)) | F.coalesce((h > 0) & (h < 48), F.lit(False))
            return F.when(url.isNotNull() & ~small, F.struct((-score).alias("s"), pos.alias("pos"), url.alias("image_url")))
        return let(images.valid_image(img["src"], page), graded)
    return F.filter(F.transform(imgs, one), lambda x: x.isNotNull() & (x["s"] <= -20))


def best_html_image(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """W18. (key, image_url, score): the best-scoring <img> of each page, the first of equals, at least 20 points."""
    best = with_facts(pages.select(key, url, "html")).select(key, F.array_min(scored_images(F.col("_facts.images"), F.col(url))).alias("b"))
    return best.where(F.col("b").isNotNull()).select(key, "b.image_url", (-F.col("b.s")).alias("score"))


def event_images(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """W18. (key, image_url, source): JSON-LD, then og:image, twitter:image, the best <img>."""
    read = with_facts(pages.select(key, "url", "html")).withColumn("_event", first_event(node_list(F.col("_facts.json_ld"))))
    m, page = F.col("_facts.metas"), F.col("url")
    found = read.select(key, event_facts("_event", page)["image_url"].alias("_ld"), images.meta_image(meta_content(m, "og:image"), page).alias("_og"),
                        images.meta_image(meta_content(m, "twitter:image"), page).alias("_tw"), F.array_min(scored_images(F.col("_facts.images"), page))["image_url"].alias("_html"))
    source = F.when(F.col("_ld").isNotNull(), "jsonld").when(F.col("_og").isNotNull(), "og:image").when(F.col("_tw").isNotNull(), "twitter:image").when(F.col("_html").isNotNull(), "html")
    return found.select(key, F.coalesce("_ld", "_og", "_tw", "_html").alias("image_url"), source.alias("source"))


def english_title_candidates(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """W20 input: (key, seq, source, value) from og, title, twitter, JSON-LD names and h1, one kind after the other."""
    m = F.col("_facts.metas")
    one = lambda part, source, value, n=F.lit(0): F.struct(F.struct(F.lit(part).alias("part"), n.alias("n")).alias("seq"), F.lit(source).alias("source"), value.alias("value"))
    fixed = F.array(one(0, "og:title", meta_content(m, "og:title")), one(1, "title", F.col("_facts.title")), one(2, "twitter:title", meta_content(m, "twitter:title")))
    names = F.transform(node_list(F.col("_facts.json_ld")), lambda node, i: one(3, "json-ld name", _str(node, "$.name"), i))
    heads = F.transform("_facts.h1", lambda h, i: one(4, "h1", h, i))
    read = with_facts(pages.select(key, "html")).select(key, F.explode(F.concat(fixed, names, heads)).alias("x"))
    return read.select(key, "x.*").where(F.col("value").isNotNull())


# ---- visit facts ---------------------------------------------------------------------------------
def visit_facts_json_ld(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """P8. Proposals (key, seq, field, value, confidence, method) from offers priced in yen."""
    def offer(o: Column, i: Column) -> Column:
        get = lambda p: F.try_variant_get(o, p, "string")
        price = F.round(blank_to_null(F.regexp_replace(get("$.price"), "[^0-9.]", "")).try_cast("double")).cast("long")
        return F.struct(i.alias("i"), F.coalesce(F.upper(get("$.priceCurrency")), F.lit("JPY")).isin("JPY", "YEN").alias("yen"), price.alias("p"),
                        F.when(get("$.url").startswith("http"), strip(get("$.url"))).alias("u"), F.coalesce(get("$.availability").rlike("(?i)Free"), F.lit(False)).alias("fr"))
    # nodes are reduced to their offers first, then a page is asked once whether any of its nodes is an event; nothing is read twice
    is_event = F.exists(_types("node"), lambda t: t.rlike("(?i)Event") & ~t.rlike("(?i)EventSeries"))
    read = nodes.where(F.col(key).isNotNull()).select(key, "pos", is_event.alias("_t"), F.filter(F.transform(offer_list("node"), offer), lambda o: o["yen"]).alias("_o"))
    target = read.withColumn("_any", F.bool_or("_t").over(Window.partitionBy(key))).where(F.col("_t") | ~F.col("_any"))
    rows = target.select(key, "pos", F.explode("_o").alias("o")).select(key, "pos", "o.i", "o.p", "o.u", "o.fr")
    per = rows.groupBy(key, "pos").agg(F.bool_or((F.col("p") == 0) | (F.col("fr") & F.col("p").isNull())).alias("free"), F.min(F.when(F.col("p") > 0, F.col("p"))).alias("lo"),
                                       F.max(F.when(F.col("p") > 0, F.col("p"))).alias("hi"), F.max_by("u", F.when(F.col("u").isNotNull(), F.col("i"))).alias("u"))
    free = F.coalesce(F.col("free"), F.lit(False)) & F.col("lo").isNull()
    paid = F.col("lo").isNotNull()
    item = lambda field, value, conf: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(conf).alias("confidence"))
    some = lambda cond, field, value, conf: F.when(cond & value.isNotNull(), item(field, value, conf))
    props = F.array_compact(F.array(
        some(free | paid, "price_type", F.when(free, "free").otherwise("paid"), "high"), some(free | paid, "price_min", F.when(free, F.lit(0)).otherwise(F.col("lo")), "high"),
        some(free | paid, "price_max", F.when(free, F.lit(0)).otherwise(F.col("hi")), "high"), some(F.lit(True), "reservation_url", F.col("u"), "medium")))
    return per.select(key, "pos", F.posexplode(props).alias("k", "x")).select(key, F.struct("pos", "k").alias("seq"), "x.*", F.lit("jsonld").alias("method"))


# Wording of the visit facts.
FREE_WORDS = r"(?:入場|参加|観覧)?無料|料金\s*[:：]?\s*無料|チケット\s*[:：]?\s*無料"
AMOUNT = r"(?:一般|大人|高校生|大学生|中学生|小学生|小人|前売|当日)?[^0-9]{0,6}([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{3,6})\s*円"
PRICE_LINE = r"((?:料金|入場料|チケット|参加費)[^。\n]{0,100}(?:円|無料))"
RESERVATION = (("予約必須|要予約|事前申込(?:必須)?|事前申し込み(?:必須)?", "required"), ("予約推奨|事前予約推奨|予約優先|事前予約がおすすめ", "recommended"),
               ("予約不要|当日参加(?:可|OK)?|当日受付|予約なしで", "not_required"))
BOOKING_URL = r"""(?i)(https?://[^\s"'<>]+(?:reserve|reservation|ticket|entry|apply|booking)[^\s"'<>]*)"""
STATION = r"([^\s、。／/]{2,20}?駅)"
STATION_WALKS = (rf"最寄(?:り)?駅[:：]?\s*{STATION}\s*(?:から)?\s*徒歩\s*約?\s*([0-9]{{1,2}})\s*分", rf"{STATION}\s*(?:から)?\s*徒歩\s*約?\s*([0-9]{{1,2}})\s*分",
                 rf"{STATION}\s*[／/・]\s*徒歩\s*約?\s*([0-9]{{1,2}})\s*分")
NEAREST = rf"最寄(?:り)?駅[:：]?\s*{STATION}"
ACCESS_LINE = r"((?:アクセス|交通|最寄)[^。\n]{8,160}駅[^。\n]{0,40})"
VENUE_MIXED = r"屋内外|一部屋外|屋内・屋外|屋内と屋外"
VENUE_INDOOR = r"(?:会場|開催|イベント|展示|屋内会場)[^。\n]{0,20}(?:屋内|室内)|(?:屋内|室内)(?:会場|展示|イベント)"
VENUE_OUTDOOR = r"(?:会場|開催|イベント|野外会場)[^。\n]{0,20}(?:屋外|野外)|(?:屋外|野外)(?:会場|イベント)"
FAMILY = "子ども向け|子供向け|ファミリー向け|親子(?:向け|同伴)?|キッズ(?:向け)?|お子様向け"
AGE = r"[0-9]{1,2}\s*歳(?:以上|未満|まで)|未就学児|小学生以下|幼児|乳幼児"
AGE_LINE = r"([^\n。]{0,20}[0-9]{1,2}\s*歳[^\n。]{0,30})"
DATE_WORDS, SOLO_WORDS = "デート向け|カップル向け|恋人同士", "一人(?:でも)?(?:楽し|OK|歓迎)|おひとり様歓迎|ソロ向け"
RAIN_OFF, RAIN_ON = "雨天中止|荒天中止|天候により中止", "雨天(?:開催|対応|決行)|雨の日でも|天候に左右されない|全天候"
DURATION_RANGE = r"(?:所要時間|体験時間|滞在時間)\s*約?\s*([0-9]{1,3})\s*[〜~\-－]\s*([0-9]{1,3})\s*分"
DURATION = r"(?:所要時間|体験時間|滞在時間)\s*約?\s*([0-9]{1,3})\s*分"
PARKING = (("専用駐車場なし|駐車場なし|駐車スペースなし", "not_available"), ("近隣駐車場|周辺の駐車場|近隣の有料", "nearby"), ("駐車場あり|駐車場完備|専用駐車場あり", "available"))
PARKING_LINE = r"((?:駐車|パーキング)[^\n]{0,80})"


def visit_facts_text(texts: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """P9. Proposals (key, seq, field, value, confidence, method) from explicit wording in the text."""
    t = F.col(text)
    got = lambda pattern, i=1: blank_to_null(F.regexp_extract(t, pattern, i))
    amounts = F.filter(F.transform(F.regexp_extract_all(t, F.lit(AMOUNT), 1), lambda a: F.replace(a, F.lit(","), F.lit("")).try_cast("long")), lambda n: n <= 100_000)
    hit = F.struct
    walks = F.flatten(F.array(*[F.arrays_zip(F.regexp_extract_all(t, F.lit(p), 1).alias("s"), F.regexp_extract_all(t, F.lit(p), 2).alias("w")) for p in STATION_WALKS]))
    stations = F.filter(F.transform(walks, lambda x: hit(strip(x.s).alias("s"), x.w.try_cast("int").alias("w"))), lambda x: x.w.between(0, 90))
    step = texts.withColumns({
        "_amounts": amounts, "_free": any_match(t, FREE_WORDS), "_stations": stations, "_nearest": strip(got(NEAREST)),
        "_venue": F.when(any_match(t, VENUE_MIXED) | (any_match(t, VENUE_INDOOR) & any_match(t, VENUE_OUTDOOR)), "mixed").when(any_match(t, VENUE_INDOOR), "indoor")
        .when(any_match(t, VENUE_OUTDOOR), "outdoor"), "_family": any_match(t, FAMILY), "_age": any_match(t, AGE),
        "_lo": F.coalesce(got(DURATION_RANGE), got(DURATION)), "_hi": F.coalesce(got(DURATION_RANGE, 2), got(DURATION))})
    names = F.array_distinct(F.transform("_stations", lambda x: x.s))
    near, st = F.col("_nearest"), F.col("_stations")
    by_walk = F.array_sort(F.transform(st, lambda x: hit(x.w.alias("w"), x.s.alias("s"))))
    named = F.get(F.filter(st, lambda x: x.s == near), F.lit(0))
    step = step.withColumns({"_n": F.size(names), "_chosen": F.when(near.isNotNull(), hit(near.alias("s"), named.w.alias("w"))).when(
        F.size(names) == 1, hit(F.get(by_walk, F.lit(0)).s.alias("s"), F.get(by_walk, F.lit(0)).w.alias("w")))})
    am, many = F.col("_amounts"), near.isNull() & (F.col("_n") > 1)
    free, paid = F.col("_free") & (F.size(am) == 0), F.size(am) > 0
    first = lambda rules: F.coalesce(*[F.when(any_match(t, p), F.lit(v)) for p, v in rules])
    line = lambda pattern, n: F.substring(squeeze(got(pattern)), 1, n)
    chosen = F.col("_chosen")
    explicit_age = line(AGE_LINE, 120)
    specs = (
        ("price_type", F.when(free, "free").when(paid, "paid"), F.lit("high")), ("price_min", F.when(free, F.lit(0)).otherwise(F.array_min(am)), F.when(free, "high").otherwise("medium")),
        ("price_max", F.when(free, F.lit(0)).otherwise(F.array_max(am)), F.when(free, "high").otherwise("medium")),
        ("price_text", F.when(F.char_length(strip(got(PRICE_LINE))) >= 6, line(PRICE_LINE, 200)), F.lit("medium")),
        ("reservation_status", first(RESERVATION), F.lit("high")), ("reservation_url", F.regexp_replace(got(BOOKING_URL), r"[),.;]+$", ""), F.lit("medium")),
        ("nearest_station", F.when(~many, chosen.s), F.when(near.isNotNull(), "high").otherwise("medium")), ("walk_minutes", F.when(~many, chosen.w), F.lit("high")),
        ("access_text", F.when(many, line(ACCESS_LINE, 200)).otherwise(F.concat(chosen.s, F.lit("から徒歩約"), chosen.w.cast("string"), F.lit("分"))), F.lit("medium")),
        ("venue_type", F.col("_venue"), F.lit("high")), ("family_friendly", F.when(F.col("_family") | F.col("_age"), "yes"), F.when(F.col("_family"), "high").otherwise("medium")),
        ("age_note", F.when(F.col("_age"), F.coalesce(explicit_age, got("(" + AGE + ")"))), F.lit("high")),
        ("date_friendly", F.when(any_match(t, DATE_WORDS), "yes"), F.lit("high")), ("solo_friendly", F.when(any_match(t, SOLO_WORDS), "yes"), F.lit("high")),
        ("rain_friendly", F.when(any_match(t, RAIN_OFF), "no").when(any_match(t, RAIN_ON) & (F.col("_venue") == "indoor"), "yes"),
         F.when(any_match(t, RAIN_OFF), "high").otherwise("medium")),
        ("duration_minutes_min", F.col("_lo").try_cast("int"), F.lit("high")), ("duration_minutes_max", F.col("_hi").try_cast("int"), F.lit("high")),
        ("parking_status", first(PARKING), F.lit("high")), ("parking_text", line(PARKING_LINE, 200), F.lit("medium")))
    props = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(i).alias("seq"), F.lit(f).alias("field"), v.cast("string").alias("value"), c.alias("confidence")))
                                      for i, (f, v, c) in enumerate(specs)]))
    return step.select(key, F.explode(props).alias("x")).select(key, "x.*", F.lit("deterministic").alias("method"))


EVIDENCE_WORDS = ("料金|入場|チケット|無料|予約|申込|申し込み|アクセス|最寄|徒歩|駅|屋内|屋外|室内|野外|子ども|子供|ファミリー|親子|キッズ|歳|年齢|所要|駐車場|雨天|天候")


def evidence_excerpt(text: Column, lines: int = 80, chars: int = 4000) -> Column:
    """P10: lines of 4-240 characters that hold a keyword (all lines when none does)."""
    fit = F.filter(F.transform(F.split(text, "\n+"), strip), lambda l: F.char_length(l).between(4, 240))
    hits = F.filter(fit, lambda l: l.rlike(EVIDENCE_WORDS))
    picked = let(F.struct(fit.alias("f"), hits.alias("h")), lambda s: F.when(F.size(s.h) > 0, s.h).otherwise(s.f))
    return F.substring(F.array_join(F.slice(picked, 1, lines), "\n"), 1, chars)
