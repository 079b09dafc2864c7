"""Page operators on hand-made pages whose expected results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from webloom.operators import content, metadata, robots, seo, structure
from webloom.sources import readers
from webloom.sources.dom import elements, parse

RICH = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A page about web analysis &amp; more</title>
<meta name="description" content="Short one"><meta name="keywords" content="web, analysis, ,seo"><meta property="og:title" content="OG Title"><meta property="og:type" content="product">
<meta property="og:image" content="a.png"><meta property="og:image" content="b.png"><meta property="article:tag" content="extra"><meta name="twitter:card" content="summary"><meta name="robots" content="noindex, nofollow">
<meta name="viewport" content="width=device-width, initial-scale=1"><link rel="canonical" href="/canon"><link rel="stylesheet" href="bootstrap.css"><link rel="shortcut icon" href="/fav.png">
<link rel="alternate" hreflang="de" href="/de"><script type="application/ld+json">{"@type": "Thing"}</script><script type="application/ld+json">{bad</script><script src="jquery.js" defer></script><script>var a = "</p>";</script></head>
<body><header class="sticky"><nav class="main-menu"><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav></header>
<main><h1>Head</h1><p>First <b>bold</b> text that is long enough to count as content of this page, as it goes on and on for more than a hundred characters in all.</p><h3>Skipped</h3>
<a href="https://other.org/x?y=1" rel="nofollow">Out</a><a href="/in/page#frag">In</a><a href="#top">Top</a><a href="mailto:a@b.c">Mail</a><a href="javascript:void(0)"></a>
<ul><li>Long item one with words</li><li>Long item two</li></ul><table><caption>Cap</caption><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>
<dl><dt>T1</dt><dt>T2</dt><dd>D2</dd><dd>D3</dd></dl><blockquote>Said<cite>Me</cite></blockquote><pre class="language-python"><code>x = 1</code></pre>
<form id="login-form" method="post"><input type="email" name="e" required><input type="password"><button type="submit">Sign up</button></form>
<img src="a.png" alt="x"><img src="b.png" alt=""><img src="c.png" loading="lazy"><iframe src="https://www.youtube.com/embed/1"></iframe><a class="btn btn-primary" href="/buy">Buy now</a>
<div itemscope itemtype="https://schema.org/Offer"><span itemprop="name">N</span><div itemscope itemtype="T"><span itemprop="name">Inner</span></div></div></main>
<aside class="sidebar-left"><ul><li><a href="/s">S</a></li></ul></aside><footer><p>© 2024 Firm</p>
<a href="https://github.com/x">G</a> mail@firm.org</footer></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    rows = [(1, "http://ex.com/dir/page", RICH), (2, "http://ex.com/empty", ""), (3, "http://ex.com/null", None), (4, None, "<P>a<p>b</b></i><br/>c &lt; d<!-- no --></P>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").cache()
    return pages, elements(pages).cache()


def one(df, page_id=1):
    return [r.asDict(recursive=True) for r in df.where(F.col("page_id") == page_id).orderBy("pre" if "pre" in df.columns else "page_id").collect()]


def test_tree_of_broken_html():
    rows = parse('<p>a<p>b</b></i><br>c</p>d<script>"</p>"</script>')
    assert [(r["tag"], r["depth"], r["post"]) for r in rows] == [("p", 1, 3), ("p", 2, 2), ("br", 3, 2), ("script", 2, 3)]
    assert rows[0]["text"] == "abcd" and rows[3]["text"] == '"</p>"'
    assert parse(None) == [] and parse("") == [] and parse("plain") == []
    assert parse('<a x="1" x="2">')[0]["attrs"] == {"x": "2"}


def test_metadata(page):
    (m,) = one(metadata.metadata(*page))
    assert m["title"] == "OG Title" and m["description"] == "Short one" and m["keywords"] == ["web", "analysis", "seo", "extra"]
    assert m["canonical"] == "http://ex.com/canon" and m["language"] == "en" and m["charset"] == "utf-8" and m["page_type"] == "product"
    assert m["robots"] == {"index": False, "follow": False, "archive": True, "snippet": True, "imageindex": True, "translate": True}
    assert m["open_graph"]["image"] == "b.png" and m["twitter_cards"] == {"card": "summary"} and m["json_ld"] == ['{"@type": "Thing"}']
    assert m["hreflang"] == {"de": "/de"} and m["favicon"] == "http://ex.com/fav.png" and m["viewport"].startswith("width")
    (empty,) = one(metadata.metadata(*page), 3)
    assert empty["title"] is None and empty["keywords"] == [] and empty["page_type"] == "general" and empty["canonical"] == "http://ex.com/null"


def test_robots_words(spark):
    df = spark.createDataFrame([("none",), ("all, noindex",), ("noindex, all",), ("",), (None,)], "c string")
    got = [r[0].asDict() for r in df.select(metadata.robots(F.col("c"))).collect()]
    assert [g["index"] for g in got] == [False, True, True, True, True] and [g["follow"] for g in got] == [False, True, True, True, True]


def test_headings_and_counts(page):
    (h,) = one(structure.headings(page[1]))
    assert (h["h1"], h["h3"], h["total"], h["proper_hierarchy"], h["multiple_h1"]) == (1, 1, 2, False, False)
    (c,) = one(structure.page_counts(page[1]))
    assert (c["images"], c["images_with_alt"], c["images_empty_alt"], c["images_missing_alt"], c["images_lazy"]) == (3, 1, 1, 1, 1)
    assert c["videos_youtube"] == 1 and c["iframes_video"] == 1 and c["lib_jquery"] and not c["lib_react"] and c["scripts_defer"] == 0
    assert c["stylesheets"] == 2 and c["distinct_stylesheets"] == 1 and c["css_bootstrap"] and c["mobile_optimized"] and c["complexity"] == "simple"


def test_links(page):
    found = one(structure.links(*page))
    assert [(x["url"], x["internal"], x["nofollow"]) for x in found][2:5] == [("https://other.org/x?y=1", False, True), ("http://ex.com/in/page#frag", True, False), ("http://ex.com/buy", True, False)]
    (s,) = one(structure.link_summary(page[1]))
    assert (s["total"], s["anchor"], s["mailto"], s["javascript"], s["empty"]) == (10, 1, 1, 1, 1)
    (x,) = one(structure.external_summary(structure.links(*page)))
    assert x["external"] == 2 and x["platforms"] == ["github"] and x["nofollow"] == 1


def test_forms_tables_lists(page):
    (f,) = one(structure.forms(page[1]))
    assert (f["kind"], f["method"], f["fields"], f["required"], f["submit_text"]) == ("login", "POST", 2, 1, "Sign up")
    (t,) = one(structure.tables(page[1]))
    assert t["caption"] == "Cap" and t["headers"] == ["A", "B"] and t["rows"] == [["1", "2"]] and t["heading"] == "Skipped" and t["column_count"] == 2
    ls = one(structure.lists(page[1]))
    assert [(x["items"], x["is_navigation"], x["heading"]) for x in ls] == [(2, True, None), (2, False, "Skipped"), (1, True, "Skipped")]
    kinds = [c["type"] for c in one(structure.calls_to_action(page[1]))]
    assert sorted(kinds) == ["button", "form_submit"]


def test_regions(page):
    (h,) = one(structure.regions(page[1], "header"))
    assert h["has_nav"] and h["links"] == 2 and h["sticky"] and h["navigation_type"] == "simple"
    (f,) = one(structure.regions(page[1], "footer"))
    assert f["copyright"] == "© 2024 Firm" and f["email"] == "mail@firm.org" and f["platforms"] == ["github"]
    (s,) = one(structure.sidebars(page[1]))
    assert s["position"] == "left" and s["links"] == 1
    nav = one(structure.navigation(page[1]))
    assert [n["is_main"] for n in nav] == [True] and nav[0]["texts"] == ["One", "Two"] and nav[0]["loc"] == "header"


def test_content(page):
    (m,) = one(content.main_content(*page))
    assert m["how"] == "selector" and m["text"].startswith("Head")
    assert one(content.definitions(page[1]))[0]["term"] == "T2" and len(one(content.definitions(page[1]))) == 1
    assert one(content.blockquotes(page[1]))[0]["cite"] == "Me"
    assert one(content.code_blocks(page[1]))[0]["language"] == "python"
    found = one(metadata.microdata(page[1]))
    assert [x["properties"] for x in found] == [{"name": "N"}, {"name": "Inner"}]


def test_pages_without_elements_keep_a_row(page):
    assert metadata.metadata(*page).count() == 4 and content.main_content(*page).count() == 4
    assert structure.headings(page[1]).where("page_id IN (2, 3)").isEmpty()


def test_seo(page):
    df = metadata.metadata(*page).join(structure.headings(page[1]), "page_id", "left")
    (r,) = one(seo.url_score(seo.heading_score(seo.meta_score(df, F.array(F.lit("og"))), F.array(F.lit("head"))), keywords=F.array(F.lit("dir"))))
    assert r["meta_issues"] == ["title_short", "description_short", "no_keyword_in_description"] and abs(r["meta_score"] - 0.4) < 1e-9
    assert r["heading_issues"] == ["level_skipped"] and r["url_score"] == 1.0 and r["path_length"] == 9


def test_keywords(spark):
    df = spark.createDataFrame([("web content and web pages",), (None,)], "text string")
    r = seo.keyword_score(df, F.array(F.lit("web"), F.lit("web content"), F.lit("zzz"))).collect()
    assert [u["count"] for u in r[0]["keyword_usage"]] == [2, 1, 0] and [u["count"] for u in r[1]["keyword_usage"]] == [0, 0, 0]


def test_robots_rules(spark):
    text = "User-agent: *\nDisallow: /private\nDisallow: /*.pdf\nAllow: /private/open\n\nUser-agent: mybot\nDisallow: /tmp/\n"
    rules = robots.rules(spark.createDataFrame([("ex.com", text), ("none.com", None)], "host string, content string"))
    urls = ["http://ex.com/private/x", "http://ex.com/private/open/y", "http://ex.com/a.pdf", "http://ex.com/tmp/z", "http://other.com/private", "not a url"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    judge = lambda agent: {r["url"]: r["allowed"] for r in robots.allowed(df, rules, agent).collect()}
    assert [judge("otherbot")[u] for u in urls] == [False, True, False, True, True, True]
    assert [judge("MyBot/2")[u] for u in urls] == [True, True, True, False, True, True]


def test_sources(spark):
    xml = "<urlset><url><loc>http://a/1</loc></url><url><lastmod>x</lastmod><loc> http://a/2 </loc></url></urlset>"
    got = readers.sitemap(spark.createDataFrame([(xml,), ("<sitemapindex><sitemap><loc>http://a/s</loc></sitemap></sitemapindex>",), (None,)], "xml string")).collect()
    assert got[0]["urls"] == ["http://a/1", "http://a/2"] and not got[0]["is_index"] and got[1]["is_index"] and got[2]["urls"] == []
    urls = spark.createDataFrame([("http://a/x.html",), ("http://a/x.png",), ("http://analytics.a/x.js",), ("http://a/dir",)], "url string")
    assert [r[0] for r in readers.requested(urls).collect()] == ["http://a/x.html", "http://a/dir"]
    assert content.dynamic_pages(spark.createDataFrame([(1, "u", "<div ng-app>"), (2, "u", "<p>x</p>"), (3, "u", None)], "page_id long, url string, html string")).orderBy("page_id").select("is_dynamic").collect() == [(True,), (False,), (False,)]


def test_topics_count_every_document_and_word(spark):
    from webloom.operators import vectors

    rows = [(i, [f"common{i}"] * 20 + [f"filler{i}x{n}" for n in range(100)]) for i in range(60)]
    got = vectors.topics(spark.createDataFrame(rows, "doc_id long, words array<string>"), k=2, terms_each=10_000)[0].collect()
    weight = {}
    for r in got:
        weight[r["term"]] = max(r["weight"], weight.get(r["term"], 0.0))
    assert len(weight) == 60 * 101
    assert all(weight[f"common{i}"] > max(weight[f"filler{i}x{n}"] for n in range(100)) for i in range(60))


def test_last_section_takes_the_rest(spark):
    """24 words: sections of 4, 4, 4, 4 and 8; the top word of the last section stands among its last words."""
    from webloom.operators import terms
    from webloom.operators import text_analysis as ta

    words = ["w" + chr(97 + n) * 3 for n in range(24)]
    for n in (0, 4, 8, 12, 23):
        words[n] = "apple"
    df = ta.prepare(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))
    assert df.select("words").first()[0] == words
    assert "keyword_uneven" not in {r["code"] for r in terms.semantic_rules(df).collect()}
