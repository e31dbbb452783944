"""Nearest neighbours and page text."""

import re
from html import unescape

import numpy as np
import pytest

from burrstone.llm import ann, html, queries


def brute(ids, x, queries_, k):
    out = {}
    for q in queries_:
        s = (x * x[ids.index(q)]).sum(1)
        order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)
        out[q] = [(v, -s_) for s_, v in order[:k]]
    return out


def test_recall_at_sf001(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in queries.op4_nearest_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], []).append(r)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(rs, rs[1:]))
        scores = dict(brute(ids, x, [q], len(ids))[q])
        assert all(r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-12) for r in rs)
        hits += len({r["vec_id"] for r in rs} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_few_odd_and_equal_vectors(spark):
    v = [float(i) for i in range(1, 5)]
    rows = [(0, v), (1, v), (2, v), (3, [0.0] * 4), (4, None), (5, [1.0, None, 2.0, 3.0]), (6, [float("nan")] * 4), (7, [float("inf")] * 4), (8, [-1.0] * 4), (20, v), (None, v), (9, [1.0]), (2, v)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, code int")
    got = {}
    for r in ann.nearest(spark, df, lambda i: i % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 30.0), (2, 30.0), (20, 30.0), (8, -10.0)], 20: [(0, 30.0), (1, 30.0), (2, 30.0), (8, -10.0)]}
    assert ann.nearest(spark, df.where("vec_id = 3"), lambda i: i % 20 == 0).count() == 0
    assert ann.nearest(spark, df.where("vec_id = 8"), lambda i: i % 20 == 0).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    x[100:300] = x[100] + 0.01 * rng.standard_normal((200, 16))  # a third of all in one place
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    run = lambda: sorted(tuple(r) for r in ann.nearest(spark, df, lambda i: i % 20 == 0, 10).collect())
    one = run()
    monkeypatch.setattr(ann, "VECTORS", 600)
    monkeypatch.setattr(ann, "QUERIES", 7)
    assert run() == one
    want = brute(list(range(600)), x, range(0, 600, 20), 10)
    assert sum(len({v for q2, _, v, _ in one if q2 == q} & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)


def test_repeated_ids_take_one_place_each(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = brute(list(range(120)), x, range(0, 120, 20), 20)
    rows = [(i, e) for i, e in enumerate(x.tolist()) for _ in range(2)]
    # An id that is repeated often, beside the first query.
    often = (120, (2 * x[0]).tolist())
    for table in (rows, rows + [often] * 100):
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest(spark, df, lambda i: i % 20 == 0, 20).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert all(len(got[q]) == 20 for q in want)
        if len(table) == len(rows):
            assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 20 * len(want)
    pandas = pytest.importorskip("pandas")
    vectors = pandas.DataFrame({"vec_id": [1] * 100 + list(range(2, 40)), "code": 0, "v": [np.array([9.0])] * 100 + [np.array([float(i)]) for i in range(-40, -2)]})
    asked = pandas.DataFrame({"query": [0], "of": [np.array([1.0])], "codes": [None]})
    assert ann._search(asked, vectors, 20)["vec_id"].tolist() == [1, *range(39, 20, -1)]


def test_pages_against_a_plain_cut(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op9_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], flags=re.S).group(1)
        blocks = [" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside).replace("<br>", " "))]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="no-sidebar"><header>H</header><div id="cookie-notice">Cookies</div>
<main><h1>T &lt;b&gt; &amp; &eacute;</h1><p>One<p>Two <i>it</i><br>x<ul><li>a<li>b</ul><aside>side</aside><div class="comments"><p>c</p></div>
<form><p>f</p></form><p hidden>z</p><table><tr><td>1<td>2</table>tail &nbsp; text<!-- c --><span class="ad">AD</span> end<script>if (a</p>b) {}</script></main><footer>F</footer>"""


@pytest.mark.parametrize("page, text", [
    (PAGE, "T <b> & é\n\nOne\n\nTwo it x\n\na\n\nb\n\n1\n\n2\n\ntail text end"), (None, ""), ("", ""), ("plain a<b & c", "plain a<b & c"),
    ("<p>x<script>never closed</p>", "x"), ("<nav>menu</nav>", ""), ("<article><article class=comment>no</article>yes</article>", "yes"),
    ("<body><div class='advert'>buy</div><p>story</p></body>", "story"), ("<p a='<p>'>q</p></div></p>r", "q\n\nr"),
])
def test_page_text(page, text):
    assert html._text(page, None) == text


@pytest.mark.parametrize("sent", [html.SENT_BYTES, 0])
def test_templates_without_an_article(spark, monkeypatch, sent):
    monkeypatch.setattr(html, "SENT_BYTES", sent)
    page = "<body><div>Site</div><div>Welcome</div><div><p>story {} one</p><p>story {} two</p></div><p>Imprint</p></body>"
    rows = [(i, f"https://U:p@Host.org:80/{i}", page.format(i, i)) for i in range(5)] + [(7, "http://other/", page.format(7, 7)), (8, None, None), (9, "http://e/", "")]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html.main_text(spark, df).collect()}
    assert got[3] == "story 3 one\n\nstory 3 two" and got[7].startswith("Site") and got[8] == got[9] == ""
    assert html.main_text(spark, df.where("page_id = 99")).count() == 0


def test_matching_keeps_order_and_is_largest():
    a, b = (["r", "p", "q", "p"], [-1, 0, 0, 0]), (["r", "p", "p", "q", "p"], [-1, 0, 0, 0, 0])
    assert len(html.match(a, b)) == 4 and html.match((["x"], [-1]), (["y"], [-1])) == []


def test_a_template_needs_the_votes_of_most_distinct_pages(spark):
    """Blocks that only the reference has, whole copies, and a node with a text of its own are content."""
    page = "<body><div>Site</div><div>Welcome</div><p>{0} first</p><p>{0} second</p>{1}</body>"
    rows = [(i, "http://long/", page.format(f"story {i}", "<p>x</p><table><tr><td>only here</td></tr></table>" if not i else "")) for i in range(6)]
    rows += [(10 + i, "http://copies/", page.format("equal", "")) for i in range(4)]
    rows += [(20 + i, "http://odd/", page.format(f"tale {i}", "").replace("Welcome", "Real news" if i == 9 else "Welcome")) for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(spark, df).collect()}
    assert got[0] == "story 0 first\n\nstory 0 second\n\nx\n\nonly here" and got[5] == "story 5 first\n\nstory 5 second"
    assert all(got[10 + i] == "Site\n\nWelcome\n\nequal first\n\nequal second" for i in range(4))
    assert got[20] == "tale 0 first\n\ntale 0 second" and got[29] == "Real news\n\ntale 9 first\n\ntale 9 second"


def test_constant_blocks_inside_articles_are_template(spark):
    page = "<body><nav>Menu</nav><article><h1>Title {0}</h1><div>All rights with us</div>{1}<p>Read on at our shop</p></article></body>"
    told = lambda i: [f"story {i} has a part {k} of its own, told at some length" for k in range(1 + i % 3)]
    rows = [(i, "http://site/", page.format(i, "".join(f"<p>{t}</p>" for t in told(i)))) for i in range(8)]
    # Editions of one article share most of their text, and all of that is content.
    text = [f"sentence {k} of the one article that this host has" for k in range(6)]
    rows += [(20 + i, "http://editions/", page.format(0, "".join(f"<p>{t}</p>" for t in text[:5] + [f"edition {i}"]))) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(spark, df).collect()}
    assert all(got[i] == "\n\n".join([f"Title {i}", *told(i)]) for i in range(8))
    assert got[22] == "\n\n".join(["Title 0", "All rights with us", *text[:5], "edition 2", "Read on at our shop"])


@pytest.mark.parametrize("bits", [1, 5, 9])
def test_likeliest_codes_against_all_codes(bits):
    rng = np.random.default_rng(bits)
    for share in (0.01, 0.5, 0.97, 1.0):
        up = rng.random(bits)
        chance = np.array([np.prod([p if code >> (bits - 1 - i) & 1 else 1 - p for i, p in enumerate(up)]) for code in range(1 << bits)])
        got = ann.likeliest(up, share)
        assert len(set(got.tolist())) == len(got)
        assert np.allclose(chance[got], np.sort(chance)[::-1][: len(got)])
        assert chance[got].sum() >= min(share, 1) - 1e-9 and (len(got) == 1 or chance[got[:-1]].sum() < share)


def test_likeliest_with_certain_bits():
    assert ann.likeliest(np.array([0.0, 1.0, 1.0]), 0.9).tolist() == [3]
    assert 3 in ann.likeliest(np.array([0.0, 1.0, 1.0]), 1.0).tolist()


@pytest.mark.parametrize("kind", ["unequal lengths", "clusters"])
def test_recall_where_vectors_are_no_unit_vectors(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        v = rng.standard_normal((60, 24))[rng.integers(0, 60, 3000)] + 0.3 * rng.standard_normal((3000, 24))
    else:
        v = rng.standard_normal((3000, 24)) * rng.lognormal(0, 0.7, (3000, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(spark, df, lambda c: c % 50 == 0).toPandas()
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    hits = sum(len(set(g["vec_id"]) & set(np.argsort(-scores[q])[:20].tolist())) for q, g in got.groupby("query_id"))
    assert len(got) == 60 * 20 and hits >= 0.9 * 60 * 20


def test_a_large_host_is_dealt_into_blocks(spark):
    """A third of all rows are of one host; each row finds its host's row once, and no block has most of them."""
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('h', id) END AS host")
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg({"id": "max"}).withColumnRenamed("max(id)", "top").where("host <> 'h1'")
    large = html._large(rows.groupBy("host").count().withColumnRenamed("count", "n"))
    assert [r["host"] for r in large.where("host IS NOT NULL").collect()] == ["hot"]
    got = html._by_host(rows, "id", hosts, large, "left").collect()
    assert len(got) == 3000
    assert all(r["top"] == {0: 2997, 1: r["id"], 2: None}[r["id"] % 3] for r in got if r["id"] != 1)
    assert html._by_host(rows, "id", hosts, large).count() == 1999
    none = rows.limit(0)
    assert html._by_host(none, "id", hosts, html._large(none.groupBy("host").count().withColumnRenamed("count", "n")), "left").count() == 0
