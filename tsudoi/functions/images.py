"""Image rules: URLs, rights, display choice, eligibility."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsudoi.functions.text import any_match, blank_to_null, let, strip
from tsudoi.functions.urls import absolute_url, host, path

# Paths that are never an event picture, and accepted file types.
REJECTED_PATHS = (r"(?i)favicon|/logo(\.|_|/|-|$)|/icons?/|icon\.(png|jpe?g|gif|svg|webp)|spacer|pixel|tracking|1x1|blank\.|/banner|"
                  r"facebook_icon|twitter_icon|youtube_icon|insta_icon|instagram_icon|/sns/|/footer/|/header/|/common/|"
                  r"/shared/site_gotokyo/images/ogp/|/assets/img/logo|/assets/pr/|member_register|apple-touch-icon")
IMAGE_TYPES = ("jpg", "jpeg", "png", "webp", "gif")
SITE_WIDE_META = r"(?i)/ogp/ogp\.(png|jpe?g|webp)|/shared/site_gotokyo/"
EMBEDDED = r"(?i)^(data|blob|javascript):"


def decode_entities(c: Column) -> Column:
    out = c
    for pattern, char in (("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")):
        out = F.regexp_replace(out, pattern, char)
    return out


def image_url(raw: Column, page: Column) -> Column:
    """An absolute http(s) image URL, or null."""
    secured = let(strip(decode_entities(raw)), lambda v: F.when(v.startswith("//"), F.concat(F.lit("https:"), v)).otherwise(v))
    full = let(secured, lambda v: F.when(~any_match(v, EMBEDDED), absolute_url(v, page)))
    return let(full, lambda u: F.when(any_match(u, "(?i)^https?://[^/?#]"), u))


def rejected_image(url: Column) -> Column:
    """Logos, icons, ads, trackers, odd file types, or no URL at all."""
    route = F.concat(path(url), F.regexp_extract(url, r"(\?[^#]*)", 1))
    ext = F.regexp_extract(F.lower(path(url)), r"\.([a-z0-9]+)$", 1)
    return F.coalesce(any_match(url, EMBEDDED) | host(url).isNull() | any_match(route, REJECTED_PATHS)
                      | ((ext != "") & ~ext.isin(*IMAGE_TYPES)), F.lit(True))


def valid_image(raw: Column, page: Column) -> Column:
    return let(image_url(raw, page), lambda u: F.when(~rejected_image(u), u))


def meta_image(raw: Column, page: Column) -> Column:
    """C24 for page meta tags: site-wide previews do not count."""
    return let(valid_image(raw, page), lambda u: F.when(~any_match(u, SITE_WIDE_META), u))


# Rights that allow display.
DISPLAYABLE = ("licensed", "organizer_granted", "own")


def can_display(usage: Column) -> Column:
    return F.coalesce(usage.isin(*DISPLAYABLE), F.lit(False))


def public_image(url: Column, usage: Column) -> Column:
    """C25."""
    return F.when(can_display(usage), blank_to_null(strip(url)))


# Category words to picture slugs, slug priority, pictures per slug.
IMAGE_SLUGS = {
    "festival": ("festival", "matsuri", "fireworks", "hanabi"), "exhibition": ("exhibition", "art", "museum", "gallery", "expo"),
    "food": ("food", "gourmet", "dining"), "kids": ("kids", "children", "family"), "nightlife": ("nightlife", "night", "bar", "club"),
    "sports": ("sports", "fitness", "run", "running", "yoga"), "market": ("market", "flea", "bazaar"),
    "seasonal": ("seasonal", "sakura", "illumination", "nature"), "workshop": ("workshop", "craft", "diy"), "music": ("music", "concert", "live", "jazz"),
}
SLUG_PRIORITY = ("kids", "nightlife", "festival", "music", "sports", "workshop", "market", "seasonal", "exhibition", "food")
VARIANTS = {"festival": 5, "exhibition": 5, "kids": 5, "workshop": 4}


def image_slug(categories: Column, kids: Column | None = None, night: Column | None = None) -> Column:
    """Best picture slug of the categories, 'generic' when none maps."""
    words = F.transform(categories, lambda c: F.lower(strip(c)))
    alias = F.create_map(*[F.lit(x) for slug, names in IMAGE_SLUGS.items() for n in names for x in (n, slug)])
    mapped = F.transform(words, lambda w: alias[w])
    best = F.get(F.array_intersect(F.array(*[F.lit(s) for s in SLUG_PRIORITY]), mapped), F.lit(0))
    flags = F.when(F.coalesce(kids, F.lit(False)), "kids") if kids is not None else F.lit(None)
    if night is not None:
        flags = F.coalesce(flags, F.when(F.coalesce(night, F.lit(False)), "nightlife"))
    return F.coalesce(best, flags, F.lit("generic"))


def image_path(slug: Column, event_id: Column, folder: str = "/images/event-categories") -> Column:
    counts = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])
    index = F.coalesce(F.abs(event_id) % F.coalesce(counts[slug], F.lit(1)), F.lit(0))
    return F.concat(F.lit(folder + "/"), slug, F.when(index > 0, F.concat(F.lit("-"), (index + 1).cast("string"))).otherwise(""), F.lit(".webp"))


def display_image(event_id: Column, url: Column, usage: Column, generated_url: Column, generated_status: Column, categories: Column) -> Column:
    """struct<kind, src>: licensed picture, approved generated one, category picture, generic one."""
    external = public_image(url, usage)
    generated = F.when(generated_status == "approved", blank_to_null(strip(generated_url)))
    slug = image_slug(categories)
    return F.struct(F.when(external.isNotNull(), "external").when(generated.isNotNull(), "generated")
                    .when(slug == "generic", "generic").otherwise("category").alias("kind"),
                    F.coalesce(external, generated, image_path(slug, event_id)).alias("src"))


def _filled(c: Column) -> Column:
    return F.coalesce(strip(c) != "", F.lit(False))


def exclusion_reasons(status: Column, schedule_status: Column, generated_status: Column, generated_url: Column, generated_source: Column,
                      generated_instruction: Column, url: Column, usage: Column, allow_blocked: bool = False, allow_draft: bool = False) -> Column:
    """Every reason an event is left out of bulk image generation; empty means eligible."""
    allowed = F.coalesce(status == "published", F.lit(False))
    if allow_draft:
        allowed = allowed | F.coalesce(status == "draft", F.lit(False))
    active = F.coalesce(schedule_status.isin("today", "upcoming"), F.lit(False))
    state = F.coalesce(blank_to_null(strip(generated_status)), F.lit("none"))
    started = (state != "none") & ((state != "blocked") if allow_blocked else F.lit(True))
    right = F.coalesce(strip(usage), F.lit(""))
    return F.array_compact(F.array(
        F.when(~allowed | ~active, "not_active"), F.when(started, "generated_status"), F.when(_filled(generated_url), "generated_url"),
        F.when(_filled(generated_source), "generated_source"), F.when(_filled(generated_instruction), "generated_instruction"),
        F.when(_filled(url) & right.isin(*DISPLAYABLE), "official_image"), F.when(right == "forbidden", "image_forbidden")))
