import time

from tessera.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a="<p>no</p>";</script><style>p{}</style></head>
<body class="has-sidebar"><header class="top"><h1>Site</h1><nav><a href="/">menu</a></nav></header>
<div class="cookie-notice">We use cookies</div><div class="page"><%s class="%s-12">
<h1>Title &amp; more</h1><p>First   paragraph,<br>same &#233; block <b>bold</b>tail<p>Second unclosed
<div class="ad-slot ads">buy</div><ul><li>one<li>two <a href="x">link</a></ul><form><p>subscribe</p></form>
<aside>aside</aside><!-- <p>no</p> --><blockquote><p>quoted</p></blockquote>
<section class="comments"><article class="comment"><p>%s</p></article></section></%s>
<div id="sidebar"><p>%s</p></div></div><footer>foot</footer></body>"""
TEXT = "Title & more\n\nFirst paragraph, same é block boldtail\n\nSecond unclosed\n\none\n\ntwo link\n\nquoted"


def page(tag="article", name="post", comment="nice", side="related things"):
    return PAGE % (tag, name, comment, tag, side)


def test_article_without_the_rest():
    assert html_text.main_text(page(), None) == TEXT
    assert html_text.main_text(page(comment="long comment " * 300), None) == TEXT
    assert html_text.main_text(page("div", "entry"), None) == TEXT


def test_odd_input_is_read_whole_and_fast():
    assert html_text.main_text("", None) == "" and html_text.main_text("a < b & c", None) == "a < b & c"
    assert html_text.main_text("<p>x<script>never closed <p>y", None) == "x"
    began = time.time()
    for s in ("<div>" * 20000 + "x" + "<p>y" * 20000, '<a "' * 50000, "<" * 100000, "<!--" * 30000,
              "<b>" * 30000 + "</i>" * 30000, "<p>" + "word " * 200000, "</p>" * 50000):
        html_text.main_text(s, html_text.best_path(s)[0])
    assert time.time() - began < 60


def test_hosts_agree_on_a_path(spark):
    """A page whose sidebar is larger than its article follows its host."""
    odd = page("div", "box", side="an advert that is much longer than the article " * 40).replace(
        'id="sidebar"', 'class="col"')
    rows = [(i, "https://one.org/%d" % i, page("div", "box")) for i in range(9)]
    rows += [(9, "https://one.org:80/odd", odd), (10, "http://two.org/", page("main", "m")), (11, None, page()),
             (12, None, None), (13, "no host", ""), (14, "https://one.org/other", "<p>only this"),
             (1, "https://one.org/1", page("div", "box"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    paths = {r["host"]: (r["path"], r["votes"]) for r in html_text.host_paths(df).collect()}
    assert paths["one.org"][0] == "body.has-sidebar>div.page>div.box-#" and paths["one.org"][1] >= 10
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert html_text.extract(df).count() == len(rows)
    for i in [*range(11), 11]:
        url = next(r[1] for r in rows if r[0] == i)
        assert got[i, url] == (TEXT, len(TEXT)), i
    assert got[12, None] == ("", 0) and got[13, "no host"] == ("", 0)
    assert got[14, "https://one.org/other"] == ("only this", 9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(df).count() == 0


STRAP = "<body><div><p>short strap line</p></div><article><p>%s</p></article></body>"
LONG = "a long article that says much " * 20


def test_path_of_another_template_does_not_drop_the_article(spark):
    """The host's path is a bare div; some pages hold their text elsewhere."""
    usual = "<body><div><p>%s</p></div></body>" % LONG
    rows = [(i, "https://two.org/%d" % i, usual) for i in range(5)] + [(9, "https://two.org/9", STRAP % LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_text.host_paths(df).first()["path"] == "body>div"
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[9] == LONG.strip() and got[0] == LONG.strip()


def test_pages_without_a_host_do_not_vote(spark):
    rows = [(i, None, "<body><div><p>%s</p></div></body>" % LONG) for i in range(5)] + [(9, "", STRAP % "Short text.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_text.host_paths(df).collect() == []
    assert {r["text"] for r in html_text.extract(df).filter("page_id < 9").collect()} == {LONG.strip()}


def test_votes_that_tie_go_to_the_first_path(spark):
    a, b = "<body><div class=b><p>%s</p></div></body>" % LONG, "<body><div class=a><p>%s</p></div></body>" % LONG
    df = spark.createDataFrame([(1, "http://x.org", a), (2, "http://x.org", b)], "page_id long, url string, html string")
    r = html_text.host_paths(df).first()
    assert (r["path"], r["votes"]) == ("body>div.a", 1)


def test_all_pages_equal_a_plain_count_of_votes(spark):
    """The Spark job against one loop over all pages."""
    import re
    from collections import Counter, defaultdict

    from tessera.session import table

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    rows = pages.collect()
    votes = defaultdict(Counter)

    def host(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        return m and m.group(1).lower()

    for r in rows:
        path, weight = html_text.best_path(r["html"] or "")
        if host(r["url"]) and path and weight:
            votes[host(r["url"])][path] += 1
    first = {h: min(c, key=lambda p: (-c[p], p)) for h, c in votes.items()}
    want = {r["page_id"]: html_text.main_text(r["html"] or "", first.get(host(r["url"]))) for r in rows}
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == want and sum(map(bool, got.values())) > 0.9 * len(got)
