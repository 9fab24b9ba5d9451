import html
import json
import random
import re

import pytest

from wayfind.llm import dom
from wayfind.llm import html_extraction as H

SF = "/root/testdata/sf0.001"


def article_of(page):
    """The blocks of a generated page's article, by patterns: a plain second way for such pages."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", ""))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    out = H.op12_html_extraction(spark, SF)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article_of(r.html) and got[r.page_id].n_chars == len(article_of(r.html)) and got[r.page_id].url == r.url


def score(a, b):
    """Simple tree matching as it is defined."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2], 1):
        for j, y in enumerate(b[2], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + score(x, y))
    return m[-1][-1] + 1


def size(t):
    return 1 + sum(map(size, t[2]))


def test_trees_against_the_definition():
    r = random.Random(1)

    def tree(depth):
        return [r.choice("ab") if depth < 3 else "a", 1, [tree(depth - 1) for _ in range(r.randrange(4))] if depth else [], []]

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert dom.matched(a, b, {})[0] == score(a, b)
        pairs = [(x, k) for x, k in dom.aligned(a, b, {id(t): i for i, t in enumerate(dom.numbered(a))}) if k >= 0]
        assert len(pairs) == score(a, b) and len({k for _, k in pairs}) == len(pairs)
        most = size(a) + size(b) - score(a, b)
        dom.merge(a, b)
        assert size(a) <= most
        for x in dom.numbered(a):
            assert all(p[0] != q[0] for p, q in zip(x[2], x[2][1:])) or not x[3]


PAGE = """<html><head><title>no</title><script>if (a<b) x("</p>")</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><p>menu</nav><div class="cookie-banner">We use cookies</div><div id="leftSidebar">side</div><article><header><h2>Head &amp; line</h2><p>by someone</p></header>
<p>One <b>bold</b>word &lt;x&gt;<br>next<p>Two&nbsp;<i>i</i><!-- <p>no</p> --> <a href="x>y">link</a> <span class="share">Share!</span>end
<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form><p>your mail<input></form><aside>aside</aside><div class="ad">buy</div><pre>x
  y</pre><footer>tags</footer></article><section id="comments"><article class="comment"><p>first!</article></section><footer>&copy;</footer></body></html>"""


def test_elements_by_name_and_class():
    text = H.main_text(dom.Page(PAGE), H.Wrapper(None))
    assert text.split("\n\n") == ["Head & line", "One boldword <x> next", "Two i link end", "a", "b", "c", "d", "x y"]
    for broken in ("", "<", "<p", "a < b", "<p>&am", "<a b='<p>x", "<!-- x", "<script>x", "</p></div>", "<b><p>x", "<p title=\"a>b\">y"):
        H.main_text(dom.Page(broken), H.Wrapper(None))
    assert H.main_text(dom.Page("a < b <p>&am"), H.Wrapper(None)) == "a < b\n\n&am"
    deep = dom.Page("<div>" * 5000 + "deep" + "</div>" * 5000)
    assert [b[1] for b in deep.blocks] == ["deep"] and len(deep.nodes) <= dom.DEEP + 1
    assert len(dom.Page("<p>x" * 20_000).blocks) == 20_000 and len(dom.Page('<a b="' * 50_000).blocks) == 0


def plain_pages(n=20, name="http://Plain.example.org:80/"):
    """Pages of nameless elements: only other pages tell what is content."""
    r = random.Random(6)
    rows = []
    for i in range(n):
        words = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
        own = [words(r.randrange(12, 40)) for _ in range(r.randrange(2, 6))]
        links = "".join(f"<a href=/{j}>{words(2)}</a> " for j in range(9))
        body = f"<div>{links}</div><div><p>Read this first, dear reader of ours: {'long ' * 9}</p>{''.join(f'<p>{p}</p>' for p in own)}<p>All rights are with us, and with nobody else.</p></div><div>{words(3)}</div>"
        rows.append((i, f"{name}{i}", f"<html><body>{body}</body></html>", "\n\n".join(own)))
    return rows


@pytest.mark.parametrize("way", ["broadcast", "dealt", "rounds"])
def test_constant_texts_and_content_slot(spark, monkeypatch, way):
    if way != "broadcast":
        monkeypatch.setattr(H, "BROADCAST", -1)
    if way == "rounds":
        monkeypatch.setattr(H, "MERGED", 3)
    rows = plain_pages() + [(100 + i, *x[1:]) for i, x in enumerate(plain_pages(9, "https://u@Other.example.org/"))]
    rows += [(200, None, "<p>alone</p>", "alone"), (201, "no url", "<p>alone</p><p>too</p>", "alone\n\ntoo"), (202, "http://one/", None, ""), (None, "http://one/", "", ""), (203, "http://two/x", "<div class=ad>all there is</div>", "all there is")]
    rows += [(300 + i, "http://copies/", "<p>the same</p><p>everywhere</p>", "the same\n\neverywhere") for i in range(10)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in rows], "page_id long, url string, html string, host string").repartition(3)
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in H.extract(df).collect())
    assert got == sorted((str(i), u, t, len(t)) for i, u, _, t in rows)


def test_pages_of_varying_structure_merge_the_same_way(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for i in range(120):
        parts = [f"<div class={r.choice('abc')}><p>w{r.random()} text</div>" for _ in range(r.randrange(6))]
        rows.append((i, "http://x/", f"<body>{''.join(parts)}<article><p>{i} own</p></article></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(x.page_id, x.text) for x in H.extract(df.repartition(5)).collect()} == {(i, f"{i} own") for i in range(120)}
    rows = df.select(H.host(df.url).alias("host"), "html")
    one, two = (H.templates(rows.repartition(k)).first() for k in (1, 7))
    assert one == two and one.n == 120 and json.loads(one.tree)[0] == "html"


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
