import random

from tsudoi.operators import reactions


def plain(path, rules):
    longest = {kind: max([len(p) for k, p in rules if k == kind and p and path.startswith(p)], default=-1) for kind in ("allow", "disallow")}
    return longest["disallow"] < 0 or longest["allow"] > longest["disallow"]


def test_longest_prefix_decides(spark):
    r = random.Random(2)
    part = lambda: r.choice(["a", "b", "ab", "news", "x%20"])
    rules = [(f"https://h{r.randrange(4)}.com", r.choice(["allow", "disallow"]), "/" + "/".join(part() for _ in range(r.randrange(0, 3))) + r.choice(["", "/"])) for _ in range(60)]
    rules += [("https://hot.com", r.choice(["allow", "disallow"]), "/" + "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))) for _ in range(400)]  # one origin with most rules
    rules += [("https://h0.com", "disallow", ""), ("https://h1.com", "allow", None)]
    urls = [(i, f"https://{r.choice(['h0', 'h1', 'h2', 'h3', 'none'])}.com/" + "/".join(part() for _ in range(r.randrange(0, 4)))) for i in range(150)]
    urls += [(1000 + i, "https://hot.com/" + "".join(r.choice("ab") for _ in range(r.randrange(1, 12)))) for i in range(150)] + [(5000, None), (5001, "https://hot.com")]
    got = {x.id: x.allowed for x in reactions.robots_allowed(spark.createDataFrame(urls, "id int, url string"), spark.createDataFrame(rules, "origin string, kind string, prefix string")).collect()}
    by = {}
    for o, k, p in rules:
        by.setdefault(o, []).append((k, p))
    assert got[5000] is False and len(got) == len(urls)
    for i, u in urls:
        if u and i != 5001:
            origin, path = u[:u.index(".com") + 4], u[u.index(".com") + 4:]
            assert got[i] == plain(path, by.get(origin, [])), u


def test_no_list_of_rules_in_the_plan(spark):
    rules = spark.createDataFrame([("https://a.com", "allow", "/")], "origin string, kind string, prefix string")
    plan = reactions.robots_allowed(spark.createDataFrame([("https://a.com/x",)], "url string"), rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(struct" not in plan and "collect_list" not in plan


def test_rules_of_a_file(spark):
    text = "# robots\r\nUser-agent: other\nDisallow: /o\n\nUSER-AGENT: *\nuser-agent: tsu # us\nCrawl-delay: 3\nUser-agent: more\nDisallow: /all # not here\nAllow:/all/but\nSitemap: https://x/y\nUser-agent: *\nDisallow: /late\nnonsense"
    files = spark.createDataFrame([("https://a.com", text), ("https://b.com", "User-agent: *\nDisallow:\nUser-agent: Tsudoi\nDisallow: /"), ("https://c.com", "Disallow: /x"), ("https://d.com", None)], "origin string, text string")
    got = sorted(map(tuple, reactions.robots_rules(files, "tsudoi-bot").collect()))
    assert got == [("https://a.com", "allow", "/all/but"), ("https://a.com", "disallow", "/all"), ("https://b.com", "disallow", "/")]
