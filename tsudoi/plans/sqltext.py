"""Small builders for the oracle texts (DuckDB dialect)."""
from __future__ import annotations

# RE2 has no look-around; these spell the same tests for the texts at hand.
_LOOK = (("(?<!八)", "(?:^|[^八])"), ("(?<!港)", "(?:^|[^港])"), ("(?<!交流)", "(?:^|[^流]|[^交]流)"), ("(?!で行った)", ""), ("(?!.*楽し)", ""))


def re2(pattern: str) -> str:
    for old, new in _LOOK:
        pattern = pattern.replace(old, new)
    return pattern.replace("'", "''")


def has(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, '{re2(pattern)}'), false)"


def first(col: str, rules, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {has(col, p)} THEN {'NULL' if v == '' else repr(v)}" for p, v in rules)
    return f"CASE {whens} ELSE {default} END"


def nfkc(col: str) -> str:
    """Compatibility form for the few wide characters the domain texts use."""
    return f"translate({col}, '（）：！～　', '():!~ ')"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def mapping(col: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def norm(col: str) -> str:
    """Normalised text of a plain column."""
    return f"coalesce(lower(trim(regexp_replace({nfkc(col)}, '\\s+', ' ', 'g'))), '')"


def title_key(col: str) -> str:
    return rf"""regexp_replace({norm(col)}, '["“”‘’・･·（）()【】\[\]「」『』〈〉<>!！?？:：;；,，.。/／\\|〜~－—–_\s-]', '', 'g')"""


def title_core(col: str) -> str:
    cut = rf"regexp_replace(regexp_replace({norm(col)}, '第\s*[0-9]+\s*回', ' ', 'g'), '(?:19|20)[0-9][0-9]', ' ', 'g')"
    return rf"""regexp_replace({cut}, '["“”‘’・･·（）()【】\[\]「」『』〈〉<>!！?？:：;；,，.。/／\\|〜~－—–_\s-]', '', 'g')"""


def title_year(col: str) -> str:
    return rf"nullif(regexp_extract({norm(col)}, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:[^0-9]|$)', 1), '')"


def title_edition(col: str) -> str:
    return rf"nullif(regexp_extract({norm(col)}, '第\s*([0-9]+)\s*回', 1), '')"


def venue_key(col: str) -> str:
    return (rf"regexp_replace(regexp_replace({norm(col)}, '周辺|付近|一帯|エリア|会場|駅前|駅周辺|jr|地下鉄|徒歩[0-9]+分', ' ', 'g'), "
            rf"'[（）()【】\[\]・･·/／、,\s]', '', 'g')")


def url_key(col: str) -> str:
    """Page key of a simple absolute URL whose query values need no re-encoding."""
    host = rf"regexp_replace(lower(regexp_extract({col}, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\.', '')"
    path = rf"regexp_replace(regexp_extract({col}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    raw = rf"regexp_extract({col}, '^[^?#]*\?([^#]*)', 1)"
    kept = (rf"list_aggregate([CASE WHEN contains(q, '=') THEN q ELSE q || '=' END for q in string_split({raw}, '&') if q <> '' AND NOT "
            rf"regexp_matches(lower(q), '^(utm_[^=]*|fbclid|gclid|gbraid|wbraid|mc_cid|mc_eid|igshid|si)(=|$)')], 'string_agg', '&')")
    return (f"CASE WHEN {col} IS NULL OR trim({col}) = '' THEN NULL WHEN {host} = '' THEN nullif(lower(trim({col})), '') ELSE "
            f"'https://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || coalesce('?' || nullif({kept}, ''), '') END")
