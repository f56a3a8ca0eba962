"""URL keys and predicates."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsudoi.functions.text import WS, any_match, blank_to_null, normalize_text, strip

ABSOLUTE = rf"^{WS}*([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::([0-9]*))?([^?#]*?)(?:\?([^#]*?))?(?:#.*)?{WS}*$"
# Query keys that only track visits.
TRACKING_KEYS = ("fbclid", "gclid", "gbraid", "wbraid", "mc_cid", "mc_eid", "igshid", "si")


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, ABSOLUTE, group)


def scheme(c: Column) -> Column:
    return F.lower(_part(c, 1))


def host(c: Column) -> Column:
    """Lower-case host, null when the text is not an absolute URL."""
    return F.lower(blank_to_null(_part(c, 3)))


def bare_host(c: Column) -> Column:
    return F.regexp_replace(host(c), r"^www\.", "")


def path(c: Column) -> Column:
    p = _part(c, 5)
    return F.when(host(c).isNotNull(), F.when(p == "", "/").otherwise(p))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def normalize_url(c: Column, ascii_only: bool = False) -> Column:
    """One https key per page; unparseable text falls back to N1 text."""
    pairs = F.transform(F.filter(F.split(_part(c, 6), "&"), lambda p: p != ""), lambda p: F.struct(
        _decode(F.substring_index(p, "=", 1)).alias("k"),
        F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.filter(pairs, lambda p: ~(F.lower(p.k).startswith("utm_") | F.lower(p.k).isin(*TRACKING_KEYS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p.k), F.lit("="), F.url_encode(p.v))), "&")
    route = F.regexp_replace(_part(c, 5), "/+$", "")
    route = F.when(route == "", "/").otherwise(route)
    key = F.concat(F.lit("https://"), bare_host(c), route, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    rest = blank_to_null(F.regexp_replace(normalize_text(c, ascii_only), "/+$", ""))
    return F.when(strip(c) == "", None).when(host(c).isNotNull(), key).otherwise(rest)


# Where each feed keeps its own id in the detail URL.
SPOT_ID = r"(?i)/spot/((?:ex|ev)[0-9]+)/"
NUMERIC_ID = r"(?i)/event/([0-9]+)/?"
AREA_ID = r"(?i)/event/(ar[0-9]+e[0-9]+)/?"
AREA_ID_TAIL = r"(?i)/event/ar[0-9]+e([0-9]+)"
STATUS_ID = r"(?i)/status(?:es)?/([0-9]+)"


def spot_id(c: Column) -> Column:
    return F.lower(blank_to_null(F.regexp_extract(c, SPOT_ID, 1)))


def numeric_event_id(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, NUMERIC_ID, 1))


def area_event_id(c: Column) -> Column:
    return F.lower(blank_to_null(F.regexp_extract(c, AREA_ID, 1)))


def area_event_number(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, AREA_ID_TAIL, 1))


def source_event_id(c: Column) -> Column:
    """The feed's own id, whichever feed the URL belongs to."""
    return F.coalesce(spot_id(c), area_event_number(c), numeric_event_id(c))


def id_aliases(c: Column) -> Column:
    """All spellings of one event id (full and numeric tail), from an id or a URL."""
    raw = F.lower(strip(c))
    full = F.coalesce(area_event_id(c), F.when(raw.rlike("^ar[0-9]+e[0-9]+$"), raw))
    tail = F.coalesce(area_event_number(c), blank_to_null(F.regexp_extract(full, "e([0-9]+)$", 1)))
    plain = F.when(host(c).isNull(), blank_to_null(raw))
    return F.array_distinct(F.array_compact(F.array(full, tail, plain)))


def post_id(c: Column) -> Column:
    """Id of a short post from its URL."""
    return blank_to_null(F.regexp_extract(c, STATUS_ID, 1))


def reaction_key(event: Column, url: Column, ascii_only: bool = False) -> Column:
    """Event and page in one key."""
    return F.concat(event.cast("string"), F.lit("::"), normalize_url(url, ascii_only))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a sub-domain of the other."""
    ha, hb = bare_host(a), bare_host(b)
    return F.coalesce((ha == hb) | ha.endswith(F.concat(F.lit("."), hb)) | hb.endswith(F.concat(F.lit("."), ha)), F.lit(False))


# Hosts and IPv4 ranges that are not public.
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata")
BLOCKED_SUFFIXES = (".local", ".internal", ".localhost")
BLOCKED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"),
    ("100.64.0.0", "100.127.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"


def ipv4_number(c: Column) -> Column:
    parts = F.split(c, r"\.")
    return F.when(c.rlike(IPV4), F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long")))


def _number(ip: str) -> int:
    a, b, c, d = (int(p) for p in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def ipv4_blocked(c: Column) -> Column:
    n = ipv4_number(c)
    hit = F.lit(False)
    for low, high in BLOCKED_IPV4:
        hit = hit | n.between(_number(low), _number(high))
    return F.coalesce(hit, F.lit(False))


def ipv6_blocked(c: Column) -> Column:
    mapped = F.substring_index(c, ":", -1)
    return (c.isin("::1", "::") | c.rlike("^f[cd]") | c.rlike("^fe[89ab]")
            | (F.contains(c, F.lit(".")) & ipv4_blocked(mapped)))


def url_refusal(c: Column) -> Column:
    """Why a URL must not be fetched; null when it is public http(s)."""
    h = host(c)
    bare6 = F.regexp_replace(h, r"[\[\]]", "")
    suffix = F.lit(False)
    for s in BLOCKED_SUFFIXES:
        suffix = suffix | h.endswith(s)
    return (F.when(c.isNull() | (strip(c) == ""), "empty_url")
            .when(_part(c, 1) == "", "invalid_url")
            .when(~scheme(c).isin("http", "https"), "scheme_not_http(s)")
            .when(_part(c, 2) != "", "userinfo_not_allowed")
            .when(h.isNull(), "missing_host")
            .when(h.isin(*BLOCKED_HOSTS), "blocked_hostname")
            .when(suffix, "blocked_hostname_tld")
            .when(h.startswith("[") & ipv6_blocked(bare6), "blocked_literal_ip")
            .when(ipv4_blocked(h), "blocked_literal_ip"))


def absolute_url(link: Column, base: Column) -> Column:
    """A link made absolute against its page; null when neither is usable."""
    origin = F.concat(scheme(base), F.lit("://"), host(base), F.when(_part(base, 4) != "", F.concat(F.lit(":"), _part(base, 4))).otherwise(""))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    l = strip(link)
    return (F.when(l == "", None).when(any_match(l, "^[A-Za-z][A-Za-z0-9+.-]*:"), l)
            .when(l.startswith("//"), F.concat(scheme(base), F.lit(":"), l))
            .when(l.startswith("/"), F.concat(origin, l))
            .otherwise(F.concat(origin, folder, l)))
