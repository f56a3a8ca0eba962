import random
import re
import time
from html.parser import HTMLParser

import pyarrow as pa

from tsudoi.functions.markup import Page, portions, with_facts
from tsudoi.operators import pages


def facts(source):
    return Page(source).facts


def pairs(source):
    return [(p["kind"], p["label"], p["value"], p["href"]) for p in facts(source)["pairs"]]


def test_cells_close_each_other():
    assert pairs("<table><tr><th>会場<td>ホール<tr><th>料金<td>500円</table>") == [(0, "会場", "ホール", None), (0, "料金", "500円", None)]
    assert pairs("<dl><dt>期間<dd>8/1<dt>住所<dd>港区") == [(1, "期間", "8/1", None), (1, "住所", "港区", None)]
    assert pairs("<table><tr><th>a</th><td>1</td><th>b</th><td>2</td></tr></table>") == [(0, "a", "1", None), (0, "b", "2", None)]


def test_nested_tables_and_lists():
    inner = "<table><tr><th>大人</th><td>500円</td></tr></table>"
    assert pairs(f"<table><tr><th>料金</th><td>次の通り{inner}以上</td></tr><tr><th>会場</th><td>A</td></tr></table>") == [
        (0, "大人", "500円", None), (0, "料金", "次の通り 大人 500円 以上", None), (0, "会場", "A", None)]
    # a stray end tag inside the inner table doesn't close the outer cell
    assert pairs("<table><tr><th>x</th><td>1<table><tr><td>2</td></td></tr></table>3</td></tr></table>")[-1] == (0, "x", "1 2 3", None)
    assert pairs("<dl><dt>a</dt><dd><dl><dt>b</dt><dd>c</dd></dl>d</dd></dl>") == [(1, "b", "c", None), (1, "a", "c d", None)] or pairs("<dl><dt>a</dt><dd><dl><dt>b</dt><dd>c</dd></dl>d</dd></dl>") == [(1, "b", "c", None), (1, "a", "b c d", None)]


def test_links_labels_and_order():
    assert pairs('<dl><dt>公式</dt><dd><a title="x > y" href="/o?a=1&b">here</a></dd></dl><table><tr><th>a</th><td>b</td></tr></table>') == [(0, "a", "b", None), (1, "公式", "here", "/o?a=1&b")]
    assert pairs("<tr><td>no label</td></tr><th></th><td>empty label</td>") == []


def test_scripts_comments_and_odd_markup():
    f = facts('<title>A &amp; <b>B</b></title><!-- <h1>no</h1> --><script>var t = "<h1>no</h1></div>";</script><h1>1 < 2 <i>and</i> 3 > 2</h1><style>h1{}</style><svg/><h1>two')
    assert f["title"] == "A & B" and f["h1"] == ["1 < 2 and 3 > 2", "two"]
    f = facts("<script type='application/ld+json'>{\"a\": \"</p><h1>\"}</script><SCRIPT TYPE=application/ld+json>[1]</SCRIPT><script type=application/ld+json>unclosed")
    assert f["json_ld"] == ['{"a": "</p><h1>"}', "[1]", "unclosed"] and f["h1"] == []
    f = facts("<meta name=a content='x'><META property=\"og:title\" content='q \"r\" > s'><link rel=canonical href=/c><link rel=canonical href=/d><time datetime=2026-01-01>")
    assert [(m["name"], m["content"]) for m in f["metas"]] == [("a", "x"), ("og:title", 'q "r" > s')] and f["canonical"] == "/c" and f["time"] == "2026-01-01"
    assert facts("<article>one<article>two</article>three</article><main>m</main>")["main"] == "one two three" and facts("<main>m")["main"] == "m"
    assert facts("")["title"] is None and facts("<<<>>><a<b>")["cards"] == [] and facts('<p x="unclosed>text')["h1"] == []


def test_cards():
    cards = facts('<ul><li class=c><a href=/e/1 title=T><h3>H</h3></a><span class="tag new">g1</span><span class=tag>g2</span><p class=area>ueno<p>a longer paragraph<img src=i.jpg><li><a href=/e/2>two</a><ul><li>x</ul></ul><li>no link')["cards"]
    assert [(c["links"][0]["href"], c["heading"], c["image"]) for c in cards] == [("/e/1", "H", "i.jpg"), ("/e/2", None, None)]
    assert [(e["cls"], e["text"]) for e in cards[0]["classed"]] == [("tag new", "g1"), ("tag", "g2"), ("area", "ueno")] and cards[0]["paragraphs"] == ["ueno", "a longer paragraph"]


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_text_equals_the_standard_parser():
    r = random.Random(4)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["word", "a b", "&amp;", "&lt;x&gt;", "é"])
        tag = r.choice(["div", "p", "b", "section", "em", "h2"])
        return f"<{tag} class='k{r.randrange(9)}'>" + " ".join(tree(depth - 1) for _ in range(r.randrange(1, 4))) + f"</{tag}>"
    for _ in range(60):
        source = "<body>out<article>" + tree(5) + "<!-- c --></article>after</body>"
        plain = Plain()
        plain.feed(source)
        assert facts(source)["main"] == re.sub(r"\s+", " ", "".join(plain.out)).strip()


def test_long_broken_pages_stay_linear():
    for source in ("<" * 200_000, "<td>" * 30_000, '<a href="' * 20_000, "<li><a href=x>" * 3_000, "</td>" * 50_000, "<a 'x>" * 20_001, "<ul>" * 20_000, "<!-- " * 20_000):
        start = time.perf_counter()
        facts(source)
        assert time.perf_counter() - start < 8


def test_detail_records_reads_once(spark, tmp_path):
    rows = [(i, f"https://e.com/{i}", f"<title>t{i}</title><h1>h{i}</h1><table><tr><th>会場<td>v{i}<tr><th>料金<td>無料</table>") for i in range(20)] + [(99, "https://e.com/", None), (98, "https://e.com/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    df = pages.detail_records(spark.read.parquet(str(tmp_path / "p")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and plan.count("MapInArrow") == 1
    got = {r.page_id: r for r in df.collect()}
    assert set(got) == set(range(20)) and (got[3].title, got[3].venue, got[3].price_text, got[3].field_sources) == (
        "h3", "v3", "無料", {"title": "h1.title", "venue": "table.会場", "price_text": "table.料金"})


def test_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "<title>x</title>", None), (2, None, 5)], "page_id long, html string, extra int")
    got = with_facts(df).orderBy("page_id").collect()
    assert [(r.page_id, r.extra, r._facts.title) for r in got] == [(1, None, "x"), (2, 5, None)]


def test_references_need_their_semicolon():
    f = facts('<title>a &amp; b&amp</title><meta name="description" content="x &#39;y&#39; &lt"><h1>&notit; &eacute;&copy2</h1>')
    assert f["title"] == "a & b&amp" and f["h1"] == ["&notit; é&copy2"]
    assert [m["content"] for m in f["metas"]] == ["x 'y' &lt"]


def test_pages_are_read_in_portions():
    # 40 texts of 100 kB, a null one and one of 3 MB: no portion holds more than a megabyte, or it is one text
    texts = ["x" * 100_000] * 40 + [None, "y" * 3_000_000, "", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["page_id", "html"])
    parts = [p.column(1).to_pylist() for p in portions(batch, 1)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 1 << 20 for p in parts) and len(parts) == 6
    assert list(portions(batch.slice(0, 0), 1)) == []
