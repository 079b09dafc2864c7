"""Queries over pages rich in structure: one page made for each row of the pages table, and the SQL of what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, content, metadata, relational, seo, structure
from ..sources.dom import elements, strings
from ..sources.readers import table
from ..sources.sinks import kept_rows

#: One page; # stands for the page's id. Paragraph texts are given below, so that the SQL can say their lengths.
INTRO = "This guide says what item # is for, how long it lasts, where it comes from and why people who tried it once come back for a second one."
PAGE = (
    '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Page # of the guide</title><meta name="description" content="All about item #, at length.">'
    '<meta name="keywords" content="alpha, beta ,item#"><meta name="author" content="Ann #"><meta name="robots" content="noindex, nofollow"><meta name="viewport" content="width=device-width">'
    '<meta property="og:title" content="OG #"><meta property="og:type" content="product"><meta property="article:tag" content="tagged"><meta name="twitter:card" content="summary">'
    '<link rel="canonical" href="/p/#"><link rel="alternate" hreflang="de" href="/de/#"><link rel="icon" sizes="32x32" href="/i.png"><link rel="apple-touch-icon" href="/t.png"><link rel="stylesheet" href="/bootstrap.css">'
    '<script type="application/ld+json">{"n": #}</script><script src="/jquery.js" defer="defer"></script><style>@media print {}</style></head><body>'
    '<header id="top" class="sticky"><img class="logo" src="/logo.png" alt="logo"><nav class="main-nav"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/shop">Shop #</a></li><li><a href="/help">Help</a></li><li><a href="/about">About</a></li></ul></nav>'
    '<form action="/search" class="search-form"><input type="search" name="q" placeholder="Search #"></form></header>'
    '<ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/c">Class #</a></li></ol>'
    f'<main><h1>Item #</h1><section id="intro"><h2>Intro</h2><p>{INTRO}</p><blockquote>Best # ever.<cite>Bob</cite></blockquote></section>'
    '<section><h2>Data</h2><table><caption>Prices</caption><thead><tr><th>Name</th><th>Price</th></tr></thead><tbody><tr><td>A#</td><td>1</td></tr><tr><td>B</td><td>2</td></tr></tbody></table>'
    '<ul><li>one #</li><li>two<ol><li>deep</li></ol></li></ul><dl><dt>Term</dt><dd>Meaning #</dd></dl><pre><code class="language-python">x = #</code></pre></section>'
    '<a class="btn btn-primary" href="/buy/#">Buy now</a><div itemscope itemtype="https://schema.org/Offer"><span itemprop="name">Offer #</span><meta itemprop="price" content="9.5"></div>'
    '<a href="https://example.com/x">Example</a><a rel="nofollow" href="https://twitter.com/w">Tweet</a><a href="mailto:a@b.example">mail</a><a href="#end">end</a></main>'.replace('"#end"', '"@end"')
    + '<aside class="sidebar-left"><div class="widget"><h3>More</h3><p>Side</p><a href="/more">more</a></div></aside>'
    '<form id="contact-form" method="post" action="/send"><input type="email" name="e" required><textarea name="t"></textarea><button type="submit">Sign up</button></form>'
    '<iframe src="https://www.youtube.com/embed/1"></iframe><video></video><img src="/a.png" loading="lazy">'
    '<footer><div class="col"><h4>About</h4><a href="https://facebook.com/x">fb</a></div><div class="col"><a href="https://youtube.com/y">yt</a></div><p>© 2020 Shop #</p>\n<p>info@shop.example</p>\n<p>+1 555 123 4567</p></footer></body></html>'
)
BASE = "https://shop.example/p/"
QUERIES: dict = {}
ORACLES: dict = {}


def query(columns: str | list[str]):
    """Registers a query with SQL: a select list over pages, or several that make a row of each."""

    def put(f):
        QUERIES[f.__name__] = f
        each = [columns] if isinstance(columns, str) else columns
        ORACLES[f.__name__] = " UNION ALL ".join(f"SELECT page_id, {c} FROM pages" for c in each)
        return f

    return put


def rich_source(spark, sf_dir: str) -> DataFrame:
    """The pages as made. Their ids are dealt out first: they come in as few splits as the small column has, and a page is far more work than its id."""
    ids = table(spark, sf_dir, "pages").select("page_id")
    ids = ids.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    own = F.col("page_id").cast("string")
    html = F.replace(F.replace(F.lit(PAGE), F.lit("#"), own), F.lit("@end"), F.lit("#end"))
    return ids.select("page_id", F.concat(F.lit(BASE), own).alias("url"), html.alias("html"))


def rich_pages(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages and their elements, parsed once and kept as a table, of which each part of a query reads the columns it uses."""
    pages = rich_source(spark, sf_dir)
    return pages, kept_rows(elements(pages))


def joined(c: str | Column) -> Column:
    """An array as one string."""
    return F.array_join(c, "|")


def said(c: str | Column) -> Column:
    """A map as one string, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|")


@query(
    "'OG ' || page_id AS title, 'All about item ' || page_id || ', at length.' AS description, 'alpha|beta|item' || page_id || '|tagged' AS keywords, 'Ann ' || page_id AS author, 'https://shop.example/p/' || page_id AS canonical, 'en' AS language, 'utf-8' AS charset, "
    "'width=device-width' AS viewport, false AS may_index, false AS may_follow, true AS may_archive, 'title=OG ' || page_id || '|type=product' AS open_graph, 'card=summary' AS twitter, '{\"n\": ' || page_id || '}' AS json_ld, "
    "'alternate=https://shop.example/de/' || page_id || '|apple-touch-icon=https://shop.example/t.png|canonical=https://shop.example/p/' || page_id || '|icon=https://shop.example/i.png|stylesheet=https://shop.example/bootstrap.css' AS rel_links, "
    "'de=/de/' || page_id AS hreflang, 'icon_32x32=https://shop.example/i.png' AS icons, 'https://shop.example/favicon.ico' AS favicon, 'https://shop.example/t.png' AS apple_touch_icon, 'product' AS page_type"
)
def rich_metadata(spark, sf_dir):
    m = metadata.metadata(*rich_pages(spark, sf_dir))
    maps = {"open_graph": "open_graph", "twitter_cards": "twitter", "rel_links": "rel_links", "hreflang": "hreflang", "icons": "icons"}
    return m.select(
        "page_id", "title", "description", joined("keywords").alias("keywords"), "author", "canonical", "language", "charset", "viewport", F.col("robots.index").alias("may_index"), F.col("robots.follow").alias("may_follow"),
        F.col("robots.archive").alias("may_archive"), joined("json_ld").alias("json_ld"), "favicon", "apple_touch_icon", "page_type", *[said(c).alias(out) for c, out in maps.items()],
    )


@query("'https://schema.org/Offer' AS item_type, 'name=Offer ' || page_id || '|price=9.5' AS properties")
def rich_microdata(spark, sf_dir):
    return metadata.microdata(rich_pages(spark, sf_dir)[1]).select("page_id", "item_type", said("properties").alias("properties"))


@query("'Prices' AS caption, 'Name|Price' AS headers, 'A' || page_id || '|1;B|2' AS cells, 2 AS row_count, 2 AS column_count, true AS has_thead, true AS has_th, 'Data' AS heading")
def rich_tables(spark, sf_dir):
    t = structure.tables(rich_pages(spark, sf_dir)[1])
    return t.select("page_id", "caption", joined("headers").alias("headers"), F.array_join(F.transform("rows", joined), ";").alias("cells"), "row_count", "column_count", "has_thead", "has_th", "heading")


@query([
    "'ul' AS tag, 4::BIGINT AS items, 'Home|Shop ' || page_id || '|Help|About' AS texts, true AS is_navigation, false AS is_nested, NULL AS heading",
    "'ol', 2, 'Home|Class ' || page_id, true, false, NULL",
    "'ul', 2, 'one ' || page_id || '|twodeep', false, false, 'Data'",
    "'ol', 1, 'deep', false, true, 'Data'",
])
def rich_lists(spark, sf_dir):
    return structure.lists(rich_pages(spark, sf_dir)[1]).select("page_id", "tag", "items", joined("texts").alias("texts"), "is_navigation", "is_nested", "heading")


@query(["'definition' AS kind, 'Meaning ' || page_id AS text, 'Term' AS note", "'quotation', 'Best ' || page_id || ' ever.Bob', 'Bob'", "'code', 'x = ' || page_id, 'python'"])
def rich_structured_content(spark, sf_dir):
    e = rich_pages(spark, sf_dir)[1]
    d = content.definitions(e).select("page_id", F.lit("definition").alias("kind"), F.col("definition").alias("text"), F.col("term").alias("note"))
    q = content.blockquotes(e).select("page_id", F.lit("quotation").alias("kind"), "text", F.col("cite").alias("note"))
    return d.unionByName(q).unionByName(content.code_blocks(e).select("page_id", F.lit("code").alias("kind"), F.col("code").alias("text"), F.col("language").alias("note")))


@query([
    "'search' AS kind, 'GET' AS method, '/search' AS action, 1::BIGINT AS fields, 0::BIGINT AS required, 'search' AS input_types, NULL AS submit_text, 'header' AS loc",
    "'contact', 'POST', '/send', 2, 1, 'button|email|textarea', 'Sign up', 'unknown'",
])
def rich_forms(spark, sf_dir):
    return structure.forms(rich_pages(spark, sf_dir)[1]).select("page_id", "kind", "method", "action", "fields", "required", joined("input_types").alias("input_types"), "submit_text", "loc")


@query(["'button' AS type, 'a' AS tag, 'Buy now' AS text, '/buy/' || page_id AS url, true AS is_primary, 'main' AS loc", "'form_submit', 'form', 'Sign up', NULL, false, 'unknown'"])
def rich_calls_to_action(spark, sf_dir):
    return structure.calls_to_action(rich_pages(spark, sf_dir)[1]).select("page_id", "type", "tag", "text", "url", "is_primary", "loc")


@query("'form' AS element")
def rich_search_box(spark, sf_dir):
    return structure.search_boxes(rich_pages(spark, sf_dir)[1]).select("page_id", "element")


@query("1 AS strength, 'Home|Class ' || page_id AS items")
def rich_breadcrumbs(spark, sf_dir):
    return structure.breadcrumbs(rich_pages(spark, sf_dir)[1]).select("page_id", "strength", joined("items").alias("items"))


@query(["'nav' AS tag, 'header' AS loc, 4::BIGINT AS link_count, 'Home|Shop ' || page_id || '|Help|About' AS texts, true AS is_main", "'ul', 'main', 4, 'Home|Shop ' || page_id || '|Help|About', false"])
def rich_navigation(spark, sf_dir):
    return structure.navigation(rich_pages(spark, sf_dir)[1]).select("page_id", "tag", "loc", "link_count", joined("texts").alias("texts"), "is_main")


@query("4::BIGINT AS links, true AS has_nav, true AS has_logo, true AS has_form, true AS has_search, false AS has_cta, 4::BIGINT AS nav_items, 'standard' AS navigation_type, true AS sticky")
def rich_header(spark, sf_dir):
    return structure.regions(rich_pages(spark, sf_dir)[1], "header").select("page_id", "links", "has_nav", "has_logo", "has_form", "has_search", "has_cta", "nav_items", "navigation_type", "sticky")


@query("2::BIGINT AS links, 2::BIGINT AS social_links, 'facebook|youtube' AS platforms, '2020' AS year, 'info@shop.example' AS email, '+1 555 123 4567' AS phone, 2::BIGINT AS columns")
def rich_footer(spark, sf_dir):
    f = structure.regions(rich_pages(spark, sf_dir)[1], "footer")
    return f.select("page_id", "links", "social_links", joined("platforms").alias("platforms"), F.regexp_extract("copyright", "[0-9]{4}", 0).alias("year"), "email", "phone", F.col("columns").cast("long").alias("columns"))


@query("'aside' AS tag, 'left' AS position, 1::BIGINT AS links, 1::BIGINT AS widgets, 0::BIGINT AS lists, 1::BIGINT AS headings, 1::BIGINT AS paragraphs")
def rich_sidebars(spark, sf_dir):
    return structure.sidebars(rich_pages(spark, sf_dir)[1]).select("page_id", "tag", "position", "links", "widgets", "lists", "headings", "paragraphs")


@query([
    "'main' AS tag, NULL AS elem_id, 'Item ' || page_id AS heading, 3::BIGINT AS headings, false AS has_images, true AS has_links, 'Item ' AS starts",
    "'section', 'intro', 'Intro', 1, false, false, 'Intro'", "'section', NULL, 'Data', 1, false, false, 'DataP'", "'aside', NULL, 'More', 1, false, true, 'MoreS'",
])
def rich_sections(spark, sf_dir):
    return structure.sections(rich_pages(spark, sf_dir)[1]).select("page_id", "tag", "elem_id", "heading", "headings", "has_images", "has_links", F.substring("snippet", 1, 5).alias("starts"))


@query("1::BIGINT AS word_count, 'MoreSidemore' AS snippet")
def rich_section_words(spark, sf_dir):
    """The aside, whose texts stand side by side without a blank."""
    return structure.sections(rich_pages(spark, sf_dir)[1]).where("tag = 'aside'").select("page_id", "word_count", "snippet")


@query(["'youtube' AS kind, '1' AS video_id, 'https://www.youtube.com/embed/1' AS src", "'html5', NULL, NULL"])
def rich_videos(spark, sf_dir):
    return structure.videos(rich_pages(spark, sf_dir)[1]).select("page_id", "kind", "video_id", "src")


@query("0.5::DOUBLE AS images_with_alt_share, 0.0::DOUBLE AS images_linked_share, 0.5::DOUBLE AS images_lazy_share, '/logo.png|/a.png' AS image_sources, 'https://www.youtube.com/embed/1' AS frame_sources")
def rich_media(spark, sf_dir):
    m = structure.media_details(rich_pages(spark, sf_dir)[1])
    return m.select("page_id", "images_with_alt_share", "images_linked_share", "images_lazy_share", joined("image_sources").alias("image_sources"), joined("frame_sources").alias("frame_sources"))


@query(
    "'Page ' || page_id || ' of the guide' AS title, 'All about item ' || page_id || ', at length.' AS description, 'alpha|beta|item' || page_id AS keywords, 'https://shop.example/p/' || page_id AS canonical, 'en' AS language, 'Ann ' || page_id AS author, "
    "'noindex, nofollow' AS robots, 'https://shop.example/i.png' AS favicon"
)
def rich_simple_metadata(spark, sf_dir):
    m = metadata.simple_metadata(*rich_pages(spark, sf_dir))
    return m.select("page_id", "title", "description", joined("keywords").alias("keywords"), "canonical", "language", "author", "robots", "favicon")


@query("'apple_touch_icon=https://shop.example/t.png|favicon=https://shop.example/favicon.ico|icon_32x32=https://shop.example/i.png' AS icons")
def rich_icons(spark, sf_dir):
    return metadata.metadata(*rich_pages(spark, sf_dir)).select("page_id", said("all_icons").alias("icons"))


@query(["'A' AS item_type, 'inner=2|outer=1' AS properties, true AS nested", "'B', 'inner=2', true", "'A', 'outer=1', false", "'B', 'inner=2', false"])
def rich_nested_microdata(spark, sf_dir):
    """A scope in a scope: the outer one with and without what the inner one holds."""
    pages = rich_source(spark, sf_dir).drop("html")
    e = elements(pages.withColumn("html", F.lit('<div itemscope itemtype="A"><b itemprop="outer">1</b><p itemscope itemtype="B"><i itemprop="inner">2</i></p></div>')))
    each = [metadata.microdata(e, nested).select("page_id", "item_type", said("properties").alias("properties"), F.lit(nested).alias("nested")) for nested in (True, False)]
    return each[0].unionByName(each[1])


@query("'# Head ' || page_id || chr(10) || chr(10) || 'One **two** _three_ link & more.' || chr(10) || chr(10) || '  * first' || chr(10) || '  * second' || chr(10) || chr(10) || '> Said' AS text_content")
def rich_text_content(spark, sf_dir):
    pages = rich_source(spark, sf_dir).drop("html")
    parts = [F.lit("<html><head><title>T</title></head><body><nav>Menu</nav><script>x()</script><h1>Head "), F.col("page_id").cast("string"), F.lit('</h1>\n<p>One <b>two</b> <em>three</em> <a href="/x">link</a> &amp;\n more.<img src="i.png"></p><ul><li>first</li><li>second</li></ul><blockquote>Said</blockquote><footer>End</footer></body></html>')]
    pages = pages.withColumn("html", F.concat(*parts))
    return content.text_content(elements(pages), strings(pages))


@query(f"'section' AS tag, 0.0::DOUBLE AS link_density, (length(replace('{INTRO}', '#', page_id::VARCHAR)) + length('IntroBest  ever.Bob') + length(page_id::VARCHAR))::INTEGER AS text_length, 'main' AS loc")
def rich_content_blocks(spark, sf_dir):
    return structure.content_blocks(rich_pages(spark, sf_dir)[1]).select("page_id", "tag", "link_density", "text_length", "loc")


LINKS = [("/", "Home", "navigation"), ("/shop", "Shop #", "navigation"), ("/help", "Help", "navigation"), ("/about", "About", "navigation"), ("/", "Home", "unknown"), ("/c", "Class #", "unknown"), ("/buy/#", "Buy now", "main"), ("/more", "more", "sidebar")]


@query([
    *[f"'https://shop.example' || replace('{p}', '#', page_id::VARCHAR) AS url, replace('{t}', '#', page_id::VARCHAR) AS text, 'shop.example' AS host, true AS internal, false AS nofollow, '{loc}' AS loc" for p, t, loc in LINKS],
    *[f"'https://{h}/{p}', '{t}', '{h}', false, {n}, '{loc}'" for h, p, t, n, loc in (("example.com", "x", "Example", "false", "main"), ("twitter.com", "w", "Tweet", "true", "main"), ("facebook.com", "x", "fb", "false", "footer"), ("youtube.com", "y", "yt", "false", "footer"))],
])
def rich_links(spark, sf_dir):
    return structure.links(*rich_pages(spark, sf_dir)).select("page_id", "url", "text", "host", "internal", "nofollow", "loc")


@query("4::BIGINT AS external, 4::BIGINT AS unique_domains, 1::BIGINT AS nofollow, 3::BIGINT AS social, 'facebook|twitter|youtube' AS platforms")
def rich_external_links(spark, sf_dir):
    found = structure.external_summary(structure.links(*rich_pages(spark, sf_dir)))
    return found.select("page_id", "external", "unique_domains", "nofollow", "social", joined("platforms").alias("platforms"))


@query(["'/' AS path, 2::BIGINT AS n, 1 AS rank", "'/about', 1, 2", "'/buy/' || page_id, 1, 3", "'/c', 1, 4", "'/help', 1, 5"])
def rich_top_paths(spark, sf_dir):
    return structure.top_paths(structure.links(*rich_pages(spark, sf_dir)))


@query([f"'https://shop.example' || replace('{p}', '#', page_id::VARCHAR) AS url" for p in ("/", "/shop", "/help", "/about", "/c", "/buy/#", "/more")])
def rich_follow_links(spark, sf_dir):
    return relational.follow(structure.links(*rich_pages(spark, sf_dir))).select("page_id", "url")


@query("14::BIGINT AS total, 1::BIGINT AS anchor, 1::BIGINT AS mailto, 4::BIGINT AS absolute, 8::BIGINT AS relative, 4::BIGINT AS in_nav, 4::BIGINT AS in_header, 2::BIGINT AS in_footer, 5::BIGINT AS in_main, 1::BIGINT AS in_aside, 13::BIGINT AS unique_texts")
def rich_link_summary(spark, sf_dir):
    return structure.link_summary(rich_pages(spark, sf_dir)[1]).select("page_id", "total", "anchor", "mailto", "absolute", "relative", "in_nav", "in_header", "in_footer", "in_main", "in_aside", "unique_texts")


@query(
    "2::BIGINT AS images, 1::BIGINT AS images_with_alt, 1::BIGINT AS images_missing_alt, 1::BIGINT AS images_lazy, 1::BIGINT AS videos_html5, 1::BIGINT AS videos_youtube, 1::BIGINT AS iframes_video, 2::BIGINT AS scripts, 1::BIGINT AS scripts_external, 1::BIGINT AS scripts_defer, "
    "true AS lib_jquery, false AS lib_react, 1::BIGINT AS distinct_stylesheets, 1::BIGINT AS style_elements, 1::BIGINT AS media_queries, true AS css_bootstrap, true AS has_header, true AS has_footer, true AS has_main, true AS has_sidebar, true AS has_navigation, "
    "true AS semantic_sectioning, true AS mobile_optimized, 2::BIGINT AS sections, 2::BIGINT AS lists_ul, 2::BIGINT AS lists_ol, 1::BIGINT AS lists_dl, 9::BIGINT AS list_items, 'simple' AS complexity"
)
def rich_page_counts(spark, sf_dir):
    names = "images images_with_alt images_missing_alt images_lazy videos_html5 videos_youtube iframes_video scripts scripts_external scripts_defer lib_jquery lib_react distinct_stylesheets style_elements media_queries css_bootstrap has_header has_footer has_main has_sidebar has_navigation semantic_sectioning mobile_optimized sections lists_ul lists_ol lists_dl list_items complexity"
    return structure.page_counts(rich_pages(spark, sf_dir)[1]).select("page_id", *names.split())


@query("1::BIGINT AS h1, 2::BIGINT AS h2, 1::BIGINT AS h3, 1::BIGINT AS h4, 5::BIGINT AS total, true AS proper_hierarchy, 1.0::DOUBLE AS uniqueness_ratio, '1 Item ' || page_id || '|2 Intro|2 Data|3 More|4 About' AS outline")
def rich_headings(spark, sf_dir):
    h = structure.headings(rich_pages(spark, sf_dir)[1])
    outline = F.transform("structure", lambda x: F.concat(x["level"].cast("string"), F.lit(" "), x["text"]))
    return h.select("page_id", "h1", "h2", "h3", "h4", "total", "proper_hierarchy", "uniqueness_ratio", joined(outline).alias("outline"))


@query(
    "7::BIGINT AS lists_navs_tables, 2::BIGINT AS forms, 'contact|search' AS form_kinds, 1::BIGINT AS required_fields, 2::BIGINT AS ctas, 1::BIGINT AS primary_ctas, 1::BIGINT AS cta_button, 1::BIGINT AS cta_form_submit, 1::BIGINT AS ctas_in_main, 2::BIGINT AS navs, 4::BIGINT AS main_nav_links, "
    "false AS main_nav_dropdown, 1::BIGINT AS navs_in_header, 4::BIGINT AS lists, 2::BIGINT AS navigation_lists, 1::BIGINT AS nested_lists, 2.25::DOUBLE AS avg_list_items, 4::BIGINT AS longest_list, 1::BIGINT AS tables, 1::BIGINT AS tables_with_headers, "
    "1::BIGINT AS tables_with_caption, 2::BIGINT AS table_rows, 0::BIGINT AS layout_tables, 4::BIGINT AS section_elements, 4::BIGINT AS sections_with_heading, 1::BIGINT AS content_blocks, 'Home|Class ' || page_id AS breadcrumb, 1::BIGINT AS sidebars, 'left' AS sidebar_positions, "
    "'form' AS search_box, true AS header_logo, true AS footer_found, 5::BIGINT AS headings, 14::BIGINT AS links, 4::BIGINT AS external_links, '/|/about|/buy/' || page_id || '|/c|/help' AS top_paths"
)
def rich_structure(spark, sf_dir):
    """One row for all parts of a page."""
    pages, e = rich_pages(spark, sf_dir)
    names = "forms required_fields ctas primary_ctas cta_button cta_form_submit ctas_in_main navs main_nav_links main_nav_dropdown navs_in_header lists navigation_lists nested_lists avg_list_items longest_list tables tables_with_headers tables_with_caption table_rows layout_tables section_elements sections_with_heading content_blocks sidebars search_box headings links external_links"
    listed = ("form_kinds", "breadcrumb", "sidebar_positions", "top_paths")
    return structure.everything(pages, e).select(
        "page_id", (F.col("lists") + F.col("navs") + F.col("tables")).alias("lists_navs_tables"), *names.split(), *[joined(c).alias(c) for c in listed], F.col("header.has_logo").alias("header_logo"), F.col("footer.found").alias("footer_found")
    )


@query(["1 AS rank, 'About us' AS text, '/us' AS href", "2, 'Jobs', '/jobs'"])
def rich_footer_links(spark, sf_dir):
    pages = rich_source(spark, sf_dir).drop("html")
    foot = '<footer><a href="https://facebook.com/x">fb</a><a href="/i"><img src="i.png"></a><a href="/out">Out</a><nav><a href="/us"> About us</a><a href="https://x.com.twitter.com/">t</a><a href="/jobs">Jobs</a></nav></footer>'
    return structure.footer_links(elements(pages.withColumn("html", F.lit(foot))))


@query("'selector' AS how, true AS has_intro, false AS has_footer")
def rich_main_content(spark, sf_dir):
    m = content.main_content(*rich_pages(spark, sf_dir))
    return m.select("page_id", "how", F.col("text").contains("how long it lasts").alias("has_intro"), F.col("text").contains("info@shop").alias("has_footer"))


@query(f"'Item ' || page_id || chr(10) || 'Intro' || chr(10) || replace('{INTRO}', '#', page_id::VARCHAR) || chr(10) || 'Best ' || page_id || ' ever.Bob' || chr(10) || 'Data' || chr(10) || 'Name' || chr(10) || 'Price' || chr(10) || 'A' || page_id || chr(10) || '1' || chr(10) || 'B' || chr(10) || '2' || chr(10) || 'one ' || page_id || chr(10) || 'twodeep' || chr(10) || 'Term' || chr(10) || 'Meaning ' || page_id || chr(10) || 'x = ' || page_id AS main_lines")
def rich_body_text(spark, sf_dir):
    lines = content.body_text(rich_pages(spark, sf_dir)[1])
    # From the first heading on to the code: what stands before and after is furniture or a region of its own.
    return lines.select("page_id", F.regexp_extract("body_text", r"(?s)(Item \d+\n.*\nx = \d+)", 1).alias("main_lines"))


@query("'meta_tags' AS category, 1 AS priority, 'title_short' AS code")
def rich_seo_recommendations(spark, sf_dir):
    pages, e = rich_pages(spark, sf_dir)
    df = metadata.metadata(pages, e).join(structure.headings(e), "page_id", "left")
    found = seo.recommendations(seo.url_score(seo.heading_score(seo.meta_score(df))))
    return found.where("place = 0").select("page_id", "category", "priority", "code")


@query("0.2::DOUBLE AS meta_score, 0.8::DOUBLE AS heading_score, 0.85::DOUBLE AS url_score, 0.5::DOUBLE AS relevance_score, 0.5::DOUBLE AS phrase_score, 'thin_content|keywords_not_covered' AS relevance_issues, 'balanced' AS optimisation, 'guide:1|zzz:0' AS counts")
def rich_seo_scores(spark, sf_dir):
    """Given keywords, of which the text holds one and the tags none, and given phrases, of which it holds one."""
    keys, phrases = F.array(F.lit("guide"), F.lit("zzz")), F.array(F.lit("how long it"), F.lit("never said"))
    pages, e = rich_pages(spark, sf_dir)
    df = metadata.metadata(pages, e).join(structure.headings(e), "page_id", "left").join(content.body_text(e), "page_id", "left")
    df = seo.relevance_score(seo.url_score(seo.heading_score(seo.meta_score(df, keys), keys), keywords=keys), "body_text", keys)
    df = seo.optimisation_score(seo.phrase_score(seo.keyword_score(df, keys, "body_text"), phrases, "body_text"))
    counts = F.transform("keyword_usage", lambda u: F.concat(u["keyword"], F.lit(":"), u["count"].cast("string")))
    rounded = [F.round(c, 9).alias(c) for c in ("meta_score", "heading_score", "url_score", "relevance_score", "phrase_score")]
    return df.select("page_id", *rounded, joined("relevance_issues").alias("relevance_issues"), "optimisation", joined(counts).alias("counts"))


@query("'OG ' || page_id AS title, 'en' AS language, 0.6::DOUBLE AS meta_score, 1.0::DOUBLE AS heading_score, 1.0::DOUBLE AS url_score, true AS has_words")
def rich_page_analysis(spark, sf_dir):
    """Each page's analysis from its markup alone."""
    df = analysis.analyze_pages(rich_source(spark, sf_dir))
    return df.select("page_id", "title", "language", *[F.round(c, 9).alias(c) for c in ("meta_score", "heading_score", "url_score")], (F.col("basic.word_count") > 20).alias("has_words"))


def one_page(spark, sf_dir):
    """The analysis of the page with the least id, by its url."""
    pages = rich_source(spark, sf_dir)
    url = pages.orderBy("page_id").select("url").first()[0]
    return analysis.analyze_url(pages, url).select("page_id", "url", "title")


QUERIES["rich_analyze_one"] = one_page
ORACLES["rich_analyze_one"] = f"SELECT page_id, '{BASE}' || page_id AS url, 'OG ' || page_id AS title FROM pages WHERE page_id = (SELECT min(page_id) FROM pages)"
