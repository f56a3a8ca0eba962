"""Personal data by weak supervision.

Patterns propose candidate spans; five labelers vote on each for, against or not at all: its shape, its checksum, a
gazetteer of words that announce such data, words that speak against it, and the characters around it. The votes of the
whole corpus are counted by kind; expectation-maximisation over those counts estimates how each labeler votes on true and
on false candidates of a kind and so how likely each vote pattern is true. With these probabilities as soft labels, a
final naive Bayes classifier over votes and surface features is trained and decides on every candidate. Spans of the base
kinds stay whatever it says; those of the further kinds stay if it accepts them.

All counting is Spark's; the driver sees one row for each distinct pattern of kind, votes and features, whose number is
bounded by the product of their values and doesn't grow with the corpus.
"""
from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsudoi.llm.common import checkpointed, fresh
from tsudoi.llm.spans import SPAN, Pattern, count, spans_of, written

LOCAL = "A-Za-z0-9._%+-"
LABEL = "A-Za-z0-9-"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right counts double, less nine if above nine."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((F.length(number) - i) % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + twice
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """The check of an IBAN: country and check digits last, letters as numbers from 10."""
    turned = F.concat(F.substring(m, 5, 40), F.substring(m, 1, 4))
    def add(acc: Column, i: Column) -> Column:
        n = F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int")
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


# Base kinds. The patterns find the same matches as the plain ones named beside them, but never try a long run of
# letters or digits from each of its places, nor recurse into groups: texts may be very long.
BASE = (
    # [LOCAL]+@[LABEL]+(\.[LABEL]+)+ : a local part begins where its run begins or the last match ended
    Pattern("email", f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@(?=[{LABEL}]+\\.[{LABEL}])[{LABEL}](?:[.{LABEL}](?<!\\.(?![{LABEL}])))*+"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Pattern("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", lambda m: m.rlike(f"^{PART}\\.{PART}\\.{PART}\\.{PART}$")),
    # [0-9]([\x20-]?[0-9])+ : whole runs, and only those that can hold 14 digits
    Pattern("card", "[0-9](?:[0-9\\x20-](?<![\\x20-](?![0-9]))){13,}", lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m))),
    Pattern("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(10, 15)),
)
MORE = (
    Pattern("local_phone", "(?<![0-9A-Za-z+.-])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z.-])"),
    Pattern("ssn", "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    Pattern("iban", "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])"),
    Pattern("person", "(?<![0-9A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame)\\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?"),
)
# Fixed word lists: strict shapes, words that announce a kind, words that speak against any.
SHAPES = {"email": "\\.[A-Za-z]{2,}$", "ip": "^[1-9][0-9]{0,2}(\\.(0|[1-9][0-9]{0,2})){3}$", "card": "^([0-9]{14,19}|[0-9]{4}([ -][0-9]{4}){3})$", "phone": "^\\+[0-9]{1,3}[ (]",
          "local_phone": "^(\\([2-9][0-9]{2}\\) |[2-9][0-9]{2}[.-])[2-9]", "ssn": "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "iban": "^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
          "person": " [A-Z][a-z]+ [A-Z][a-z]+$"}
GAZETTEER = {"email": "e-?mail|mail|contact|correo|courriel", "ip": "\\bip\\b|host|address|server|login", "card": "card|visa|master|credit|karte|carte|tarjeta",
             "phone": "phone|tel|call|fax|mobile|handy", "local_phone": "phone|tel|call|fax|mobile|handy", "ssn": "ssn|social security", "iban": "iban|account|konto|compte|cuenta",
             "person": "dear|name|contact|author|by|signed"}
AGAINST = "version|order|invoice|isbn|issn|sku|build|serial|part no|figure|table|section|release"
LABELERS = ("shape", "checksum", "gazetteer", "against", "around")
FEATURES = ("length", "left", "right")
CANDIDATE = "array<struct<s:int,o:int,e:int,kind:string,m:string,votes:array<string>,features:array<string>>>"


def by_kind(kind: Column, patterns: dict[str, str], text: Column) -> Column:
    out = F.lit(False)
    for k, p in patterns.items():
        out = F.when(kind == k, text.rlike(f"(?i){p}" if patterns is GAZETTEER else p)).otherwise(out)
    return out


def charclass(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "edge").when(c.rlike("\\s"), "space").when(c.rlike("[A-Za-z0-9]"), "word").when(c.rlike("[.,;:!?]"), "stop").otherwise("other")


def judged(span: Column) -> Column:
    """The span with its votes (+, -, 0 in the order of LABELERS) and features (in the order of FEATURES)."""
    kind, m, left = span["kind"], span["m"], span["before"]
    before, after = charclass(F.right(left, F.lit(1))), charclass(span["after"])
    vote = lambda yes, no: F.when(yes, "+").when(no, "-").otherwise("0")
    strict = by_kind(kind, SHAPES, m)
    checked = F.when(kind == "card", luhn(digits(m))).when(kind == "iban", mod97(m))
    loose = before.isin("space", "edge") & after.isin("space", "edge", "stop")
    votes = F.array(vote(strict, ~strict), F.coalesce(vote(checked, ~checked), F.lit("0")), vote(by_kind(kind, GAZETTEER, left), F.lit(False)),
                    vote(F.lit(False), left.rlike(f"(?i){AGAINST}")), vote(loose, (before == "word") | (after == "word")))
    features = F.array(F.least(F.floor(F.length(m) / 4), F.lit(8)).cast("string"), before, after)
    return F.struct(span["s"].alias("s"), span["o"].alias("o"), span["e"].alias("e"), kind.alias("kind"), m.alias("m"), votes.alias("votes"), features.alias("features"))


def candidates(docs: DataFrame, columns: list[str], result: str, text_col: str = "text", base: tuple[Pattern, ...] = BASE, more: tuple[Pattern, ...] = MORE) -> DataFrame:
    """The given columns of every row and its candidates; a candidate of a further kind that overlaps a base span is none."""
    text, own, rest = fresh(docs, "text_"), fresh(docs, "own_"), fresh(docs, "rest_")
    none = F.array().cast(SPAN)
    now = docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    now = now.select("*", F.concat(*[spans_of(F.col(text), r, n) for n, r in enumerate(base)]).alias(own),
                     F.concat(none, *[spans_of(F.col(text), r, len(base) + n) for n, r in enumerate(more)]).alias(rest))
    apart = F.filter(rest, lambda x: ~F.exists(own, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    every = F.concat(F.col(own), F.when(F.size(rest) > 0, apart).otherwise(none))
    told = F.when(F.size(own) + F.size(rest) > 0, F.transform(every, judged)).otherwise(F.array().cast(CANDIDATE))
    return now.select(*[F.col(f"`{c}`") for c in columns], told.alias(result))


def reliabilities(patterns: list[tuple[str, tuple[str, ...], float]], rounds: int = 60) -> dict[tuple[str, tuple[str, ...]], float]:
    """Probability that a candidate of (kind, votes) is true, by EM over (kind, votes, count), from majority votes on.

    A labeler has its own vote probabilities for each kind, on true and on false candidates, smoothed by one pseudo-vote
    each way that says labelers are better than chance.
    """
    total: dict[tuple[str, tuple[str, ...]], float] = defaultdict(float)
    for kind, votes, n in patterns:
        total[kind, votes] += n
    p = {}
    for kind, votes in total:
        lead = votes.count("+") - votes.count("-")
        p[kind, votes] = 1 / (1 + math.exp(-lead))
    for _ in range(rounds):
        prior: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
        seen: dict[tuple, float] = defaultdict(float)
        for (kind, votes), n in total.items():
            for true, share in ((1, p[kind, votes]), (0, 1 - p[kind, votes])):
                prior[kind][true] += n * share
                for j, v in enumerate(votes):
                    seen[kind, j, true, v] += n * share
        for kind, votes in total:
            odds = math.log(prior[kind][1] / prior[kind][0])
            for j, v in enumerate(votes):
                hint = {"+": (1.0, 0.25), "-": (0.25, 1.0), "0": (0.5, 0.5)}[v]
                yes = (seen[kind, j, 1, v] + hint[0]) / (prior[kind][1] + 1.75)
                no = (seen[kind, j, 0, v] + hint[1]) / (prior[kind][0] + 1.75)
                odds += math.log(yes / no)
            p[kind, votes] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return p


def train(rows: list[tuple[str, tuple[str, ...], tuple[str, ...], int]]) -> dict[str, float]:
    """Naive Bayes log-odds for "kind" and "kind|place|value", places being votes and features, from soft labels."""
    p = reliabilities([(k, v, n) for k, v, _, n in rows])
    total: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    seen: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.5, 0.5])
    for kind, votes, features, n in rows:
        for true, share in ((1, p[kind, votes]), (0, 1 - p[kind, votes])):
            total[kind][true] += n * share
            for place, value in enumerate((*votes, *features)):
                seen[kind, f"{place}|{value}"][true] += n * share
    weights = {k: math.log(t[1] / t[0]) for k, t in total.items()}
    for (kind, key), c in seen.items():
        weights[f"{kind}|{key}"] = math.log(c[1] / (total[kind][1] + 1)) - math.log(c[0] / (total[kind][0] + 1))
    return weights


def odds(candidate: Column, weights: Column) -> Column:
    """Log-odds of a candidate."""
    values = F.concat(candidate["votes"], candidate["features"])
    each = F.transform(values, lambda v, i: F.coalesce(weights[F.concat_ws("|", candidate["kind"], i.cast("string"), v)], F.lit(0.0)))
    return F.aggregate(each, F.coalesce(weights[candidate["kind"]], F.lit(0.0)), lambda a, x: a + x)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Pattern, ...] = BASE, more: tuple[Pattern, ...] = MORE) -> DataFrame:
    """(doc_id, spans): start, order of kind, end, kind, text, log-odds of each span that stays.

    One row for each input row. Null and empty texts have none; extra columns are ignored; an empty table gives an empty
    one, and a corpus without candidates needs no classifier.
    """
    found = checkpointed(candidates(docs, [id_col], "found_", text_col, base, more))
    groups = found.select(F.explode("found_").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    weights = train([(r["kind"], tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in groups.toLocalIterator()])
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in weights]), F.array(*[F.lit(float(w)) for w in weights.values()])) if weights else F.create_map().cast("map<string,double>")
    scored = F.transform("found_", lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["kind"].alias("kind"), x["m"].alias("m"), odds(x, table).alias("odds")))
    kinds = [r.kind for r in base]
    kept = F.filter(scored, lambda x: x["kind"].isin(kinds) | (x["odds"] > 0))
    return found.select(F.col(f"`{id_col}`").alias("doc_id"), kept.alias("spans"))


def digests(found: DataFrame, base: tuple[Pattern, ...] = BASE) -> DataFrame:
    kinds = [r.kind for r in base]
    own = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *[count(F.col("spans"), k).alias(f"n_{k}") for k in kinds], F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
