import hashlib
import random
import re

from tests.llm import cases
from tsudoi.llm import pii as P


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]


def plain(text):
    spans = sorted((m.start(), n, m.end(), k) for n, (k, p, ok) in enumerate(KINDS) for m in re.finditer(p, text) if ok(m.group()))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def fuzz(n):
    r = random.Random(6)
    for i in range(n):
        alphabet = "ab1 .@-+_%()029\né😀" if i % 2 else "012345 .-+()"
        yield 1000 + i, "".join(r.choice(alphabet) for _ in range(r.randrange(70)))
    for i in range(80):
        yield 9000 + i, f"x {r.randrange(10 ** 15, 10 ** 16)} card 4111 1111 1111 1111, +1 (811) 555-3281 and a.b@c.example.com or 10.0.{r.randrange(400)}.7"


def test_base_spans_against_brute_force(spark):
    data = cases.odd_rows() + list(fuzz(800)) + [(20_000, "a@" + "b." * 60_000 + "c"), (20_001, "1 " * 60_000)]
    got = P.digests(P.report(cases.docs(spark, data))).collect()
    want = [(i, hashlib.sha256(plain(t or "").encode()).hexdigest()) for i, t in data]
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_very_long_runs_end(spark):
    data = [(1, "1" * 300_000), (2, "x" * 400_000), (3, "+1" + " 2" * 100_000), (4, "x@" * 100_000), (5, "1.2." * 60_000)]
    assert P.report(cases.docs(spark, data)).count() == 5


def test_further_kinds_need_the_classifier(spark):
    good = [(i, f"call us by phone 212-555-01{i:02d} now") for i in range(10, 40)] + [(100 + i, f"ssn 123-45-67{i:02d} here") for i in range(10, 40)]
    bad = [(200 + i, f"order part no 012-045-00{i:02d}x") for i in range(10, 40)]
    spans = {r.doc_id: [s.kind for s in r.spans] for r in P.report(cases.docs(spark, good + bad)).collect()}
    assert all(spans[i] == ["local_phone"] for i in range(10, 40)) and all(spans[100 + i] == ["ssn"] for i in range(10, 40))
    assert not any(spans[200 + i] for i in range(10, 40))


def test_em_learns_who_is_reliable():
    r = random.Random(2)
    rows = {}
    for _ in range(4000):
        true = r.random() < 0.4
        vote = lambda right: "+" if (r.random() < right) == true else "-"
        key = ("k", (vote(0.95), vote(0.9), vote(0.85), vote(0.5)), true)
        rows[key] = rows.get(key, 0) + 1
    p = P.reliabilities([(k, v, n) for (k, v, _), n in rows.items()])
    right = sum(n for (k, v, t), n in rows.items() if (p[k, v] > 0.5) == t)
    assert right / 4000 > 0.95 and abs(p["k", ("+", "+", "+", "+")] - p["k", ("+", "+", "+", "-")]) < 0.05


def test_checks(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432", True), ("GB82WEST12345698765433", False), ("DE89370400440532013000", True)], "m string, ok boolean")
    assert all(r.ok == r.got for r in df.select("ok", P.mod97(df.m).alias("got")).collect())
    assert P.report(cases.docs(spark, [])).count() == 0
