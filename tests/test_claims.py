import random

from pyspark.sql import functions as F

from tests.test_schedule_match import CAND, D
from tsudoi.operators import claims, match
from tsudoi.operators.components import components


def plain(held, near=None):
    """Rows {seq: keys} in order of seq against the winners so far, one by one."""
    won = {}
    for seq in sorted(held):
        earlier = {k for s, w in won.items() if w for k in held[s]}
        won[seq] = not any((a == b) if near is None else ((a, b) in near) for a in held[seq] for b in earlier)
    return won


def run(spark, held, near=None, **options):
    rows = spark.createDataFrame([(s,) for s in held], "seq long")
    keys = spark.createDataFrame([(s, k) for s, ks in held.items() for k in [*ks, None]], "seq long, key string")
    beside = None if near is None else spark.createDataFrame(sorted(near), "a string, b string")
    return {r.seq: r.won for r in claims.first_claims(rows, keys, beside, **options).collect()}


def random_claims(seed, n=120, keys=90):
    r = random.Random(seed)
    held = {s: {f"k{r.randrange(keys)}" for _ in range(r.randrange(0, 4))} for s in range(n)}
    pairs = {(f"k{r.randrange(keys)}", f"k{r.randrange(keys)}") for _ in range(40)}
    near = {(f"k{k}", f"k{k}") for k in range(keys)} | pairs | {(b, a) for a, b in pairs}
    return held, near


def test_equal_to_the_loop(spark):
    held, near = random_claims(1)
    assert run(spark, held) == plain(held) and run(spark, held, near) == plain(held, near)
    hot = {s: {"same", f"own{s}"} for s in range(50)}
    assert run(spark, hot) == plain(hot)


def test_components_and_rounds_equal_the_loop(spark):
    held, near = random_claims(2, 60, 80)
    sparse = {(a, b) for a, b in near if a == b or hash((min(a, b), max(a, b))) % 3 == 0}
    assert run(spark, held, fold_rows=30) == plain(held)  # several tasks, and rounds for what is larger
    assert run(spark, held, sparse, fold_rows=60) == plain(held, sparse)
    assert run(spark, {}) == {} and run(spark, {1: set()}) == {1: True}


def test_chain_of_ten_thousand_in_few_jobs(spark):
    chain = {s: {f"c{s}", f"c{s + 1}"} for s in range(10_000)}
    chain |= {20_000 + s: {f"x{s}"} for s in range(500)}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = run(spark, chain)
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("after", "after")
    assert got == {s: s % 2 == 0 or s >= 20_000 for s in chain} and jobs < 40


def test_components_of_paths_and_hot_nodes(spark):
    r = random.Random(3)
    code = [r.randrange(1 << 62) for _ in range(700)]
    edges = [(code[i], code[i + 1]) for i in range(299)] + [(code[300], code[i]) for i in range(301, 600)] + [(code[650], code[650]), (None, code[1])]
    found = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 600 and len({found[code[i]] for i in range(300)}) == 1 and len({found[code[i]] for i in range(300, 600)}) == 1
    assert found[code[0]] != found[code[300]] and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_in_batch_tiers(spark):
    """A later row meets the drafts before it by the whole cascade, not by its title alone."""
    d, park = (lambda m, x: D(2026, m, x)), "国営昭和記念公園"
    rows = [(1, "コスモスまつり2026", d(9, 12), d(10, 26), park, "minato", None, "https://s.com/1"), (2, "コスモスまつり2026 秋の特別版", d(9, 12), d(10, 26), park, None, None, "https://s.com/2"),
            (3, "コスモスまつり2026 秋の特別版", d(9, 12), d(10, 26), "別の公園", None, None, "https://s.com/3"), (4, "コスモスまつり2026", d(11, 1), d(11, 3), park, None, None, "https://s.com/4"),
            (5, "コスモスまつり2026 秋の特別版", d(9, 12), None, None, None, None, "https://s.com/5"), (6, "冬の市", d(12, 1), None, None, None, "https://o.com/6", None),
            (7, "別の名前", None, None, None, None, "https://o.com/6?utm_source=x", None), (8, "コスモスまつり2026", d(9, 12), None, None, None, None, None)]
    cand = match.with_match_keys(spark.createDataFrame(rows, CAND))
    out = {r.seq: r for r in match.attach_within_batch(cand, cand.select("seq", F.lit("none").alias("duplicate_status"))).collect()}
    assert {s: (r.leader, r.tier) for s, r in out.items()} == {1: (1, None), 2: (1, 4), 3: (1, 6), 4: (1, 7), 5: (1, 5), 6: (6, None), 7: (6, 1), 8: (1, 3)}
    assert out[2].duplicate_status == "likely" and out[3].action == "review_required" and out[7].action == "attach_source_only" and out[6].action == "create_draft"
    # the same rows against a catalogue that holds the drafts
    pool = match.match_pool(cand.where("seq in (1, 6)").withColumnRenamed("seq", "id").select("id", "title", "start_date", "end_date", "venue", "area", "official_url", "source_url"))
    want = {r.seq: r for r in match.decide(cand.where("seq not in (1, 6)"), pool, keyed=True).collect()}
    assert all((out[s].tier, out[s].confidence, out[s].reason) == (w.tier, w.confidence, w.reason) for s, w in want.items())


def test_only_earlier_drafts_count(spark):
    rows = [(1, "summer festival tokyo bay", D(2026, 1, 1), None, "pier", None, None, None), (2, "summer festival tokyo baywalk", D(2026, 3, 1), None, "pier", None, None, None),
            (3, "tokyo baywalk by night", D(2026, 3, 1), None, "pier", None, None, None)]
    cand = match.with_match_keys(spark.createDataFrame(rows, CAND))
    out = {r.seq: (r.leader, r.tier) for r in match.attach_within_batch(cand, cand.select("seq", F.lit("none").alias("duplicate_status"))).collect()}
    assert out[1] == (1, None) and out[2][0] == 1  # 3 is a draft, but made after 2


def test_drafts_move_no_titles(spark, monkeypatch):
    rows = [(1, "夏まつり大会"), (2, "夏まつり大会！"), (3, "現代アート展示"), (4, "現代アート展示会")]
    df = spark.createDataFrame([(i, t, None, None, "上野公園", "ueno", None, None) for i, t in rows],
                               "seq long, title string, start_date date, end_date date, venue string, area string, official_url string, source_url string")
    moved, cut = [], match.cut_lineage
    monkeypatch.setattr(match, "cut_lineage", lambda d: moved.append(d.columns) or cut(d))
    cand = match.with_match_keys(df)
    empty = match.match_pool(df.limit(0).withColumnRenamed("seq", "id"))
    out = match.attach_within_batch(cand, match.decide(cand, empty, keyed=True))
    assert {r.seq: r.leader for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    assert not any("seq" in c and {"title", "title_key", "core"} & set(c) for c in moved)


def test_early_claims_equal_the_loop(spark):
    """Sure winners and the rows left open after any number of rounds settle to the loop's winners."""
    r = random.Random(8)
    for fold_rows, groups in ((1, 12), (1, 150), (10_000, 30)):
        rows = [(s, r.randrange(groups), r.choice([None, f"o{r.randrange(40)}"]), r.choice([None, f"s{r.randrange(60)}", f"u{s}"])) for s in range(300)]
        links = {(r.randrange(groups), r.randrange(groups)) for _ in range(groups // 2)}
        links |= {(b, a) for a, b in links} | {(g, g) for g in range(groups)}
        near = {(f"g{a}", f"g{b}") for a, b in links}
        held = {s: {f"g{g}", *(x for x in (o, u) if x)} for s, g, o, u in rows}
        own = {(k, k) for ks in held.values() for k in ks}
        want = {s for s, won in plain(held, near | own).items() if won}
        df = spark.createDataFrame(rows, "seq long, g long, o string, u string")
        sure, left = claims.early_claims(df, spark.createDataFrame(sorted(links), "a long, b long"), "g", ["o", "u"], fold_rows)
        sure, left = {x.seq for x in sure.collect()}, {x.seq: {f"g{x.g}", *(k for k in (x.o, x.u) if k)} for x in left.collect()}
        assert sure and not sure & set(left) and len(left) <= len(rows) - len(sure)
        assert sure | {s for s, won in plain(left, near | own).items() if won} == want


def test_rows_of_a_batch_are_written_once(spark, monkeypatch):
    """Many rows with few titles: the rows are written once, whatever becomes of them, and rows that others forestall are not moved with their keys."""
    rows = [(i, ("夏まつり大会", "現代アート展示", "jazz night", "flea market")[i % 4], D(2026, 1, 1 + i % 28), None, f"v{i % 7}", "ueno", None, f"https://x.com/{i}") for i in range(1, 2001)]
    written = []
    for module in (match, claims):
        cut = module.cut_lineage

        def noted(d, cut=cut):
            out = cut(d)
            if "seq" in out.columns:
                written.append(out.count())
            return out
        monkeypatch.setattr(module, "cut_lineage", noted)
    cand = match.with_match_keys(spark.createDataFrame(rows, CAND))
    out = match.attach_within_batch(cand, cand.select("seq", F.lit("none").alias("duplicate_status")))
    assert {x.seq: x.leader for x in out.collect()} == {i: (i - 1) % 4 + 1 for i in range(1, 2001)}
    assert sum(written) < 1.1 * len(rows)


def test_a_first_import_needs_no_decisions_and_no_keys(spark):
    r = random.Random(4)
    rows = [(i if i != 7 else None, r.choice(["コスモスまつり2026", "コスモスまつり2026 秋の特別版", "コスモスまつり", "冬の市", "冬の市場 第2回", "第3回 冬の市場", "", "2026"]), r.choice([None, D(2026, 9, r.randint(1, 9))]),
             r.choice([None, D(2026, 9, r.randint(9, 20))]), r.choice([None, "", "国営昭和記念公園", "昭和記念公園", "別の公園"]), r.choice([None, "minato", "ueno"]),
             r.choice([None, None, f"https://o.com/{r.randrange(30)}?utm_source=x"]), r.choice([None, f"https://s.com/{r.randrange(60)}"])) for i in range(1, 160)]
    df = spark.createDataFrame(rows, CAND)
    cand = match.with_match_keys(df)
    with_keys = match.attach_within_batch(cand, cand.select("seq", F.lit("none").alias("duplicate_status")))
    got = sorted(match.attach_within_batch(df, keyed=False).collect())
    assert [r.seq for r in got] == [i for i in range(1, 160) if i != 7] and got == sorted(with_keys.collect())
    assert {x.tier for x in got} >= {None, 1, 2, 3, 4, 5, 6, 7}
