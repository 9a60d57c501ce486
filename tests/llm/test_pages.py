"""Operators on pages."""

from pyspark.sql import functions as F

from platter.llm import linkgraph, wrapper

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu {n}</a></ul></nav><!-- c --><div class="ad">buy {n}</div><div id="cookie-notice">notice</div>
<article><h1>Head &amp; {n}</h1><p><b>First {n}.<br><p>Second  &quot;{n}&quot; &lt;ok&gt;</p><aside>side {n}</aside><ul><li>item {n}<li>last</ul><form>f<input></form></article>
<div class="comments"><p>reader {n}</p></div><footer>&copy; host</footer></body></html>"""
TEXT = 'Head & {n}\nFirst {n}.\nSecond "{n}" <ok>\nitem {n}\nlast'


def test_main_text(spark):
    rows = [(i, f"https://h{i % 2}.example.com/{i}", PAGE.format(n=i)) for i in range(12)]
    rows += [(20, "https://alone.example.org/", PAGE.format(n=20)), (21, None, None), (22, "x", ""), (23, "https://h0.example.com/", "<p>a<p>b"), (None, "https://h1.example.com/", PAGE.format(n=7))]
    rows += [(30 + k, "https://copies.example.net/", PAGE.format(n=5)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.url): r for r in wrapper.main_text(df).collect()}
    for i, url, html in rows:
        want = "" if not html else "a\nb" if i == 23 else TEXT.format(n=i if i is not None and i < 30 else 7 if i is None else 5)
        assert got[i, url].text == want
        assert got[i, url].n_chars == len(want)
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_tree_matching():
    a, b = (wrapper.skeleton(wrapper.parse(x)) for x in ("<div><ul></ul><table></table></div><section></section>", "<div><table></table></div><nav></nav><section></section>"))
    assert wrapper.matching(a, b, {}) == 4  # the roots, the divisions, the tables and the sections
    both = wrapper.fold(a, b)
    assert [c.label for c in both.children] == ["div", "nav", "section"] and [c.pages for c in both.children] == [2, 1, 2]


def test_main_text_of_pages_with_many_elements(spark):
    """A wrapper keeps the content's path, and the template, of pages with hundreds of elements that are all alike."""
    page = "<body><div class='top'>welcome to this host</div><div class='text'><p>Words of {n}, and more of {n}.</p></div>" + "<div class='cell'></div>" * 450 + "</body>"
    table = "<body><div class='top'>welcome to this host</div><article><p>Words of {n}.</p><table>" + "<tr><td></td><td></td><td></td><td></td></tr>" * 100 + "</table></article></body>"
    rows = [(i, f"https://cells.example.com/{i}", page.format(n=i)) for i in range(5)] + [(10 + i, f"https://table.example.com/{i}", table.format(n=i)) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert got == {i: f"Words of {i}, and more of {i}." for i in range(5)} | {10 + i: f"Words of {i}." for i in range(5)}


def test_neutral_names(spark):
    """Without article, main or telling names the alignment alone finds the content: what is constant goes, what varies most
    stays. No wrapper, no such result."""
    page = "<body><div class='q1'><p>Start</p><p>Topics</p></div><div class='q2'><p>All rights</p></div><div class='q3'><h2>Title {n}</h2><p>Share this page</p><p>Body {n} has its own words, {m}.</p></div><div class='q4'><p>Offer {n}</p></div></body>"
    rows = [(i, "https://plain.example.com/%d" % i, page.format(n=i, m=i * i)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    assert got == {i: f"Title {i}\nBody {i} has its own words, {i * i}." for i in range(9)}
    assert all(wrapper.extract(h, None) != got[i] for i, _, h in rows)


def test_constants_of_any_number(spark):
    """A slot with hundreds of constant texts loses them all."""
    same = "".join(f"<p>same {k}</p>" for k in range(300))
    rows = [(i, "https://many.example.com/%d" % i, f"<body><div class='a'>{same}<p>own words of page {i} and no others</p></div></body>") for i in range(6)]
    got = {r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {f"own words of page {i} and no others" for i in range(6)}


def test_deep_pages(spark):
    """Elements nested thousands deep, alone and on a host."""
    deep = lambda n, t: "<div>" * n + f"<p>{t}</p>" + "</div>" * n
    rows = [(i, "https://deep.example.com/", deep(5000, f"text {i}")) for i in range(4)] + [(9, "https://other.example.com/", deep(5000, "text 9"))]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert got == {i: f"text {i}" for i in (0, 1, 2, 3, 9)}


def test_markup():
    text = lambda x: wrapper.extract(x, None)
    assert text('<p>ok</p><a href="foo>text</a><p>after</p>') == "ok\ntext\nafter"
    assert text('<p title="a > b">x</p><img alt=\'>\'/><p>y') == "x\ny"
    assert text("<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by line</p></header><p class='legal'>The law says so.</p><div class='related'>more</div><p>End</p></article>") == "Title\nThe law says so.\nEnd"
    assert text("<article><p>a<br/>b</p><div class='ad'>buy</div></article>") == "a\nb"


def test_rules_and_links(spark):
    link = '<a href="https://{}/x">x</a>'
    rows = [
        (1, "http://A.Example.com/en/7x?q", None),
        (2, "http://a.example.com/en/1", ""),
        (3, "https://example.net/de/8", ""),
        (4, "https://x.example.net/de/9#f", ""),
        (5, "http://y.example.org/es", ""),
        (6, "notaurl", ""),
        (7, None, None),
        (8, "ftp://com/en/", ""),
        (9, "http://notexample.com/en/7", ""),
        # bad.org has only blocked pages; a host that links to it is suspect, one that links to nobody is not
        (10, "http://bad.org/es/1", ""),
        (11, "http://bad.org/es/2", ""),
        (12, "http://friend.info/", link.format("bad.org")),
        (13, "http://other.info/", link.format("friend.info") + '<a href="/own">y</a>'),
        (14, "http://calm.info/?u=http://bad.org/", ""),
        (15, "http://good.net/de/1", link.format("calm.info")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("salt", F.lit("clash"))
    got = {r.page_id: r for r in linkgraph.verdicts(df).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow")]
    assert [got[i].rule for i in (5, 6, 7, 8, 9)] == [None, None, None, "com/en/", "com/en/"]
    assert (got[6].host, got[6].path, got[7].host, got[7].path, got[6].verdict) == ("", "", "", "", "allow")
    assert (got[1].host, got[1].path) == ("a.example.com", "/en/7x")
    assert [got[i].verdict for i in (10, 12, 13, 14)] == ["block", "block", "block", "allow"]
    assert linkgraph.verdicts(df.limit(0)).count() == 0
