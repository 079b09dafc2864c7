"""Structure of pages from their elements.

Counts and flags are aggregated by page with partial sums before the shuffle. "Inside" is an interval join on
(page, pre, post): equal pages meet, and only rows of the kinds wanted are there, so its size follows the elements.
Every function gives one schema whatever a page holds; pages without a row here have no such element."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions import text as tx
from ..functions.urls import is_social, part, social_platform, url_join
from .metadata import attr, first

TAG = F.col
mark = lambda: F.lower(F.concat_ws(" ", F.coalesce(F.col("elem_id"), F.lit("")), F.array_join("classes", " ")))
has_class = lambda pattern: F.coalesce(F.exists("classes", lambda c: F.lower(c).rlike(pattern)), F.lit(False))
n_if = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
#: What a call to action says.
CTA_TEXTS = ["sign up", "register", "subscribe", "join", "get started", "try", "buy", "purchase", "order", "add to cart", "checkout", "download", "request", "contact", "learn more", "read more", "more info", "continue"]
CTA_CLASSES = ["cta", "call-to-action", "action", "primary-button", "main-button"]


def tag(*names: str) -> Column:
    return F.col("tag").isin(*names)


def inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows of inner with o_pre of each row of outer that contains them."""
    o = outer.select(F.col("page_id").alias("o_page"), F.col("pre").alias("o_pre"), F.col("post").alias("o_post"))
    return inner.join(o, (F.col("page_id") == F.col("o_page")) & (F.col("pre") > F.col("o_pre")) & (F.col("pre") <= F.col("o_post"))).drop("o_page")


def headings(e: DataFrame) -> DataFrame:
    h = e.where(tag("h1", "h2", "h3", "h4", "h5", "h6")).withColumn("level", F.substring("tag", 2, 1).cast("int")).withColumn("t", F.trim("text"))
    counts = [n_if(F.col("level") == k).alias(f"h{k}") for k in range(1, 7)]
    listed = F.transform(F.sort_array(F.collect_list(F.struct("level", "pre", "t"))), lambda x: F.struct(x["level"].alias("level"), x["t"].alias("text")))
    levels = F.sort_array(F.collect_set("level"))
    out = h.groupBy("page_id").agg(*counts, F.count(F.lit(1)).alias("total"), listed.alias("structure"), levels.alias("levels"), F.countDistinct("t").alias("distinct_texts"), F.countDistinct(F.when(F.col("level") == 1, F.col("t"))).alias("distinct_h1"))
    steps = F.zip_with("levels", F.slice("levels", F.lit(2), F.greatest(F.size("levels"), F.lit(1))), lambda a, b: F.coalesce(b - a, F.lit(0)))
    proper = ~F.exists(F.slice(steps, F.lit(1), F.greatest(F.size("levels") - 1, F.lit(0))), lambda s: s > 1)
    return out.select("page_id", *[f"h{k}" for k in range(1, 7)], "total", (F.col("h1") > 0).alias("has_h1"), (F.col("h1") > 1).alias("multiple_h1"), proper.alias("proper_hierarchy"), "structure", tx.ratio(F.col("distinct_texts"), F.col("total")).alias("uniqueness_ratio"), tx.ratio(F.col("distinct_h1"), F.col("h1")).alias("h1_uniqueness"))


def page_counts(e: DataFrame) -> DataFrame:
    """Images, videos, frames, scripts, sheets, layout flags and complexity, one row a page."""
    src, cls = F.coalesce(attr("src"), F.lit("")), F.lower(F.array_join("classes", " "))
    img, frame, script = tag("img"), tag("iframe"), tag("script")
    sheet = tag("link") & F.lower(F.coalesce(attr("rel"), F.lit(""))).contains("stylesheet")
    alt = F.map_contains_key("attrs", "alt")
    kind = F.when(src.rlike("(?i)map|google.com/maps"), "map").when(src.rlike("(?i)youtube|vimeo|video"), "video").when(src.rlike("(?i)form|survey"), "form").when(src.rlike("(?i)facebook|twitter|instagram|linkedin"), "social").otherwise("other")
    library = {"jquery": "jquery", "react": "react", "vue": "vue", "angular": "angular", "bootstrap": "bootstrap", "lodash": "lodash", "d3": r"d3\.", "analytics": "analytics|gtag|gtm", "moment": "moment"}
    inline = {"jquery": r"\$\(|jQuery", "react": r"React\.|ReactDOM", "vue": r"new Vue|Vue\."}
    frameworks = {"bootstrap": "bootstrap", "tailwind": "tailwind", "foundation": "foundation", "bulma": "bulma", "materialize": "materialize", "semantic": "semantic"}
    on = lambda name: F.coalesce(attr(name), F.lit("")) != ""
    region = lambda name, *extra: F.max(tag(name, *extra))
    return e.groupBy("page_id").agg(
        n_if(img).alias("images"), n_if(img & alt & (attr("alt") != "")).alias("images_with_alt"), n_if(img & alt & (attr("alt") == "")).alias("images_empty_alt"), n_if(img & ~alt).alias("images_missing_alt"),
        n_if(img & F.array_contains("anc_tags", "a")).alias("images_linked"), n_if(img & (F.map_contains_key("attrs", "srcset") | cls.rlike("responsive|fluid"))).alias("images_responsive"), n_if(img & ((attr("loading") == "lazy") | cls.contains("lazy"))).alias("images_lazy"),
        n_if(tag("video")).alias("videos_html5"), n_if(frame & src.rlike("(?i)youtube\\.com|youtu\\.be")).alias("videos_youtube"), n_if(frame & src.rlike("(?i)vimeo\\.com")).alias("videos_vimeo"), n_if(cls.contains("video-js")).alias("videos_videojs"),
        *[n_if(frame & (kind == k)).alias(f"iframes_{k}") for k in ("map", "video", "form", "social", "other")], n_if(frame).alias("iframes"),
        n_if(script).alias("scripts"), n_if(script & (src == "")).alias("scripts_inline"), n_if(script & (src != "")).alias("scripts_external"), n_if(script & on("defer")).alias("scripts_defer"), n_if(script & on("async")).alias("scripts_async"), n_if(script & (attr("type") == "module")).alias("scripts_module"),
        *[F.coalesce(F.max(script & (F.lower(src).rlike(p) | ((src == "") & F.col("text").rlike(inline[k]) if k in inline else F.lit(False)))), F.lit(False)).alias(f"lib_{k}") for k, p in library.items()],
        (2 * n_if(sheet)).alias("stylesheets"), n_if(sheet).alias("distinct_stylesheets"), n_if(tag("style")).alias("style_elements"), n_if(sheet & (attr("media") == "print")).alias("sheets_print"), n_if(sheet & F.coalesce(attr("media"), F.lit("")).contains("max-width")).alias("sheets_mobile"),
        F.sum(F.when(tag("style"), F.regexp_count("text", F.lit("@media"))).otherwise(0)).alias("media_queries"), *[F.coalesce(F.max(sheet & F.lower(F.coalesce(attr("href"), F.lit(""))).contains(p)), F.lit(False)).alias(f"css_{k}") for k, p in frameworks.items()],
        region("header").alias("has_header"), region("footer").alias("has_footer"), region("main").alias("has_main"), (F.max(tag("aside") | mark().contains("sidebar"))).alias("has_sidebar"), region("nav").alias("has_navigation"),
        F.max(cls.rlike("grid|row|col-")).alias("uses_grid"), F.max(cls.contains("flex")).alias("uses_flexbox"), F.max(tag("header", "footer", "main", "nav", "article", "section", "aside")).alias("semantic_sectioning"),
        F.max(tag("meta") & (F.lower(attr("name")) == "viewport")).alias("has_viewport"), F.coalesce(F.max(tag("meta") & (F.lower(attr("name")) == "viewport") & attr("content").contains("width=device-width")), F.lit(False)).alias("mobile_optimized"),
        n_if(tag("section")).alias("sections"), n_if(tag("article")).alias("articles"), n_if(tag("ul")).alias("lists_ul"), n_if(tag("ol")).alias("lists_ol"), n_if(tag("dl")).alias("lists_dl"), n_if(tag("li")).alias("list_items"),
        F.count(F.lit(1)).alias("elements"), F.countDistinct("tag").alias("unique_tags"), F.max("depth").alias("max_nesting"), n_if(F.size("classes") > 0).alias("with_class"), n_if(F.col("elem_id").isNotNull()).alias("with_id"),
        F.sum(F.when(F.col("depth") == 1, F.col("text_length"))).alias("text_length"), F.sum(F.when(F.col("depth") == 1, F.col("html_length"))).alias("html_length"),
    ).withColumn("complexity", F.when((F.col("elements") < 300) & (F.col("max_nesting") < 10), "simple").when((F.col("elements") < 1000) & (F.col("max_nesting") < 15), "moderate").otherwise("complex")).withColumn("text_html_ratio", tx.ratio(F.col("text_length"), F.col("html_length")))


def links(pages: DataFrame, e: DataFrame) -> DataFrame:
    """A row for each link that leads somewhere: url, text, rel, title, nofollow, internal, and where it stands."""
    a = e.where(tag("a") & (F.coalesce(attr("href"), F.lit("")) != "")).where(~F.lower(F.trim(attr("href"))).rlike("^(javascript:|#|mailto:|tel:)"))
    a = a.select("page_id", "pre", "post", "loc", "anc_tags", attr("href").alias("href"), F.trim("text").alias("text"), attr("rel").alias("rel"), attr("title").alias("title"))
    a = a.join(pages.select("page_id", F.col("url").alias("base")), "page_id").withColumn("url", url_join(F.col("base"), F.col("href")))
    host, own = F.coalesce(part(F.col("url"), "AUTHORITY"), F.lit("")), F.coalesce(part(F.col("base"), "AUTHORITY"), F.lit(""))
    return a.withColumns({"host": host, "internal": (host == own) | (host == ""), "nofollow": F.coalesce(F.lower("rel").contains("nofollow"), F.lit(False))}).drop("post")


def link_summary(e: DataFrame) -> DataFrame:
    a, href = e.where(tag("a") & F.map_contains_key("attrs", "href")), F.lower(F.trim(F.coalesce(attr("href"), F.lit(""))))
    kind = F.when(href.startswith("#"), "anchor").when(href.startswith("mailto:"), "mailto").when(href.startswith("tel:"), "tel").when(href.startswith("javascript:"), "javascript").when(href.rlike("^(https?:)?//"), "absolute").otherwise("relative")
    t = F.trim("text")
    out = a.groupBy("page_id").agg(F.count(F.lit(1)).alias("total"), n_if(t != "").alias("with_text"), n_if(t == "").alias("empty"), F.countDistinct(F.when(t != "", t)).alias("unique_texts"), F.avg(F.when(t != "", F.length(t))).alias("avg_text_length"), *[n_if(kind == k).alias(k) for k in ("anchor", "mailto", "tel", "javascript", "absolute", "relative")], n_if(href.rlike(r"\.(pdf|docx?|xlsx?|pptx?|zip|rar|csv)$")).alias("file"), *[n_if(F.array_contains("anc_tags", k)).alias(f"in_{k}") for k in ("nav", "header", "footer", "main", "aside", "article")])
    return out.withColumn("diversity", tx.ratio(F.col("unique_texts"), F.greatest("with_text", F.lit(1))))


def top_paths(found: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent internal paths of each page; ties by path."""
    n = found.where("internal").groupBy("page_id", F.coalesce(part(F.col("url"), "PATH"), F.lit("")).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "path"))).where(F.col("rank") <= k)


def external_summary(found: DataFrame) -> DataFrame:
    out = found.where(~F.col("internal"))
    return out.groupBy("page_id").agg(F.count(F.lit(1)).alias("external"), F.countDistinct("host").alias("unique_domains"), n_if(F.col("nofollow")).alias("nofollow"), n_if(is_social(F.col("url"))).alias("social"), F.sort_array(F.collect_set(F.when(is_social(F.col("url")), social_platform(F.col("url"))))).alias("platforms"))


def forms(e: DataFrame) -> DataFrame:
    """A row for each form: its kind (by indicators, else by inputs), method, fields, required, submit text."""
    f = e.where(tag("form"))
    kind = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.col("mark").contains(w) for w in words]), F.lit(k)) for k, words in lex.FORM_INDICATORS.items()])
    base = f.select("page_id", "pre", "post", "loc", mark().alias("mark"), F.upper(F.coalesce(attr("method"), F.lit("GET"))).alias("method"), F.coalesce(attr("action"), F.lit("")).alias("action")).withColumn("kind_", kind)
    fields = inside(f, e.where(tag("input", "textarea", "select", "button")))
    typ = F.when(tag("input"), F.lower(F.coalesce(attr("type"), F.lit("text")))).otherwise(F.col("tag"))
    fields = fields.withColumn("t", typ).withColumn("said", F.coalesce(F.when(F.trim("text") != "", F.trim("text")), attr("value")))
    shown = ~F.col("t").isin("hidden", "submit", "button", "image", "reset")
    submit = (tag("input") & F.col("t").isin("submit", "image")) | (tag("button") & (F.lower(F.coalesce(attr("type"), F.lit("submit"))) == "submit"))
    per = fields.groupBy("page_id", F.col("o_pre").alias("pre")).agg(n_if(shown).alias("fields"), n_if(F.map_contains_key("attrs", "required")).alias("required"), n_if(F.col("t") == "password").alias("passwords"), n_if(F.col("t") == "email").alias("emails"), n_if(F.col("t") == "search").alias("searches"), n_if(tag("textarea")).alias("areas"), n_if(shown & (F.col("t") == "text")).alias("texts"), F.sort_array(F.collect_list("t")).alias("input_types"), first(submit, F.col("said")).alias("submit_text"))
    out = base.join(per, ["page_id", "pre"], "left").fillna(0, ["fields", "required", "passwords", "emails", "searches", "areas", "texts"])
    by_input = F.when(F.col("searches") > 0, "search").when(F.col("passwords") == 1, "login").when(F.col("passwords") > 1, "register").when((F.col("emails") > 0) & (F.col("areas") > 0), "contact").when((F.col("emails") > 0) & (F.col("fields") <= 2), "newsletter").otherwise("other")
    return out.select("page_id", "pre", F.coalesce("kind_", by_input).alias("kind"), "method", "action", "fields", "required", F.coalesce("input_types", F.array().cast("array<string>")).alias("input_types"), "submit_text", "loc")


def calls_to_action(e: DataFrame) -> DataFrame:
    """Buttons and links that read or are styled like calls to action, and submit buttons that do."""
    said = lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in CTA_TEXTS])
    text = F.trim("text")
    button = tag("button", "a") & has_class("btn|button") & (text != "") & (said(F.lower(text)) | (F.length(text) < 20))
    classed = has_class("|".join(CTA_CLASSES)) & (text != "")
    rows = e.select("page_id", "pre", "tag", text.alias("text"), attr("href").alias("url"), "loc", F.when(button, "button").when(classed, "element_with_cta_class").alias("type"), (classed | has_class("primary|main|cta")).alias("is_primary")).where("type IS NOT NULL")
    sub = forms(e).where(F.col("submit_text").isNotNull() & said(F.lower("submit_text")))
    return rows.unionByName(sub.select("page_id", "pre", F.lit("form").alias("tag"), F.col("submit_text").alias("text"), F.lit(None).cast("string").alias("url"), "loc", F.lit("form_submit").alias("type"), F.lit(False).alias("is_primary")))


def search_boxes(e: DataFrame) -> DataFrame:
    """The first search form or input of each page."""
    near = (tag("form") & (mark().contains("search") | mark().contains("find") | F.lower(F.coalesce(attr("action"), F.lit(""))).contains("search"))) | (tag("input") & ((attr("type") == "search") | F.lower(F.concat_ws(" ", attr("name"), attr("placeholder"))).contains("search")))
    return e.where(near).groupBy("page_id").agg(F.min_by("tag", "pre").alias("element"), F.min_by(attr("placeholder"), F.col("pre")).alias("placeholder"), F.min("pre").alias("pre"))


def navigation(e: DataFrame) -> DataFrame:
    """nav elements, and div or ul with an indicator and two links or more."""
    wanted = reduce(lambda a, b: a | b, [mark().contains(w) for w in lex.NAV_INDICATORS])
    n = e.where(tag("nav") | (tag("div", "ul") & wanted))
    a = inside(n, e.where(tag("a"))).groupBy("page_id", F.col("o_pre").alias("pre")).agg(F.count(F.lit(1)).alias("link_count"), F.transform(F.sort_array(F.collect_list(F.struct("pre", F.trim("text").alias("t")))), lambda x: x["t"]).alias("texts"))
    drop = inside(n, e.where(has_class("dropdown|submenu") | (tag("ul") & F.array_contains("anc_tags", "li")))).select("page_id", F.col("o_pre").alias("pre")).distinct().withColumn("has_dropdown", F.lit(True))
    out = n.select("page_id", "pre", "tag", "loc").join(a, ["page_id", "pre"], "left").join(drop, ["page_id", "pre"], "left").fillna(0, ["link_count"]).fillna(False, ["has_dropdown"])
    out = out.where((F.col("tag") == "nav") | (F.col("link_count") >= 2))
    best = Window.partitionBy("page_id").orderBy((F.col("loc") != "header").cast("int"), (~F.col("has_dropdown")).cast("int"), F.desc("link_count"), "pre")
    return out.withColumn("is_main", F.row_number().over(best) == 1)


def breadcrumbs(e: DataFrame) -> DataFrame:
    """The first breadcrumb of each page: by schema, by id or class, or a short list of links that reads like one."""
    text = F.coalesce("text", F.lit(""))
    c = e.where(F.coalesce(attr("itemtype"), F.lit("")).contains("BreadcrumbList") | mark().contains("breadcrumb") | (tag("ol", "ul") & text.rlike("[>/»]")))
    strong = F.when(F.coalesce(attr("itemtype"), F.lit("")).contains("BreadcrumbList"), 0).when(mark().contains("breadcrumb"), 1).otherwise(2)
    a = inside(c, e.where(tag("a"))).groupBy("page_id", F.col("o_pre").alias("pre")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pre", F.trim("text").alias("t")))), lambda x: x["t"]).alias("items"))
    out = c.withColumn("strength", strong).select("page_id", "pre", "strength").join(a, ["page_id", "pre"], "left").where((F.col("strength") < 2) | F.size("items").between(2, 5))
    return out.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("strength", "pre"))).where("r = 1").select("page_id", "pre", "strength", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def lists(e: DataFrame) -> DataFrame:
    """A row for each ul and ol with items: how many, whether it navigates, is nested, and the heading before it."""
    li = e.where(tag("li")).groupBy("page_id", F.col("parent").alias("pre")).agg(F.count(F.lit(1)).alias("items"), F.transform(F.sort_array(F.collect_list(F.struct("pre", F.trim("text").alias("t")))), lambda x: x["t"]).alias("texts"))
    up = e.select("page_id", F.col("pre").alias("parent"), F.col("tag").alias("p_tag"), mark().alias("p_mark"))
    a = e.where(tag("a")).groupBy("page_id", "parent").agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.trim("text"))).alias("longest"))
    item = e.where(tag("li")).select("page_id", F.col("pre").alias("li"), F.col("parent").alias("pre")).join(a.withColumnRenamed("parent", "li"), ["page_id", "li"], "left")
    menu = item.groupBy("page_id", "pre").agg((F.min(F.coalesce("n", F.lit(0))) > 0).alias("all_links"), F.max(F.coalesce("longest", F.lit(0))).alias("longest"))
    out = e.where(tag("ul", "ol")).join(li, ["page_id", "pre"]).join(up, ["page_id", "parent"], "left").join(menu, ["page_id", "pre"])
    nav = (F.col("p_tag") == "nav") | F.coalesce(F.col("p_mark"), F.lit("")).contains("nav") | F.exists("classes", lambda c: F.lower(c).isin("menu", "nav", "navigation", "navbar")) | (F.col("all_links") & (F.col("longest") < 20))
    out = out.select("page_id", "pre", "tag", "items", "texts", F.coalesce(nav, F.lit(False)).alias("is_navigation"), F.array_contains("anc_tags", "li").alias("is_nested"))
    return _with_heading(e, out)


def _with_heading(e: DataFrame, rows: DataFrame) -> DataFrame:
    """The last heading before each row, as of document order: one window over headings and rows of a page."""
    h = e.where(tag("h1", "h2", "h3", "h4", "h5", "h6")).select("page_id", "pre", F.trim("text").alias("heading_"))
    both = h.unionByName(rows.select("page_id", "pre").distinct(), allowMissingColumns=True)
    w = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("heading", F.last("heading_", ignorenulls=True).over(w)).where("heading_ IS NULL").select("page_id", "pre", "heading")
    return rows.join(seen, ["page_id", "pre"], "left")


def tables(e: DataFrame) -> DataFrame:
    """A row for each table with rows: caption, headers, rows as arrays of cells, and the heading before it."""
    t = e.where(tag("table"))
    tr = inside(t, e.where(tag("tr"))).select("page_id", "o_pre", F.col("pre").alias("tr"), F.col("post").alias("tr_post"), F.array_contains("anc_tags", "thead").alias("in_head"))
    cell = e.where(tag("td", "th")).select("page_id", "pre", F.col("parent").alias("tr"), "tag", F.trim("text").alias("t"))
    rows = tr.join(cell, ["page_id", "tr"], "left").groupBy("page_id", "o_pre", "tr", "in_head").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("pre").isNotNull(), F.struct("pre", "t")))), lambda x: x["t"]).alias("cells"), n_if(F.col("tag") == "th").alias("th"))
    per = rows.groupBy("page_id", F.col("o_pre").alias("pre")).agg(F.sort_array(F.collect_list(F.struct("tr", "in_head", "cells", "th"))).alias("r"))
    cap = inside(t, e.where(tag("caption"))).groupBy("page_id", F.col("o_pre").alias("pre")).agg(F.min_by(F.trim("text"), "pre").alias("caption"))
    head = F.filter("r", lambda x: x["in_head"])
    has_head, first_th = F.size(head) > 0, F.col("r")[0]["th"] > 0
    out = per.join(cap, ["page_id", "pre"], "left")
    headers = F.when(has_head, F.flatten(F.transform(head, lambda x: x["cells"]))).when(first_th, F.col("r")[0]["cells"]).otherwise(F.array().cast("array<string>"))
    body = F.when(has_head, F.filter("r", lambda x: ~x["in_head"])).when(first_th, F.slice("r", F.lit(2), F.greatest(F.size("r"), F.lit(1)))).otherwise(F.col("r"))
    out = out.withColumns({"headers": headers, "rows": F.transform(body, lambda x: x["cells"])})
    out = out.select("page_id", "pre", "caption", "headers", "rows", F.size("rows").alias("row_count"), F.when(F.size("headers") > 0, F.size("headers")).otherwise(F.size(F.col("r")[0]["cells"])).alias("column_count"), has_head.alias("has_thead"), (F.size(F.filter("r", lambda x: x["th"] > 0)) > 0).alias("has_th"))
    return _with_heading(e, out)


def regions(e: DataFrame, name: str) -> DataFrame:
    """The header or footer of each page (by element, else by id, else by class) and what it holds."""
    strength = F.when(tag(name), 0).when(F.lower(F.coalesce("elem_id", F.lit(""))).contains(name), 1).when(has_class(name), 2)
    own = e.withColumn("strength", strength).where("strength IS NOT NULL").groupBy("page_id").agg(F.min(F.struct("strength", "pre", "post", "text")).alias("m"))
    style = e.select("page_id", "pre", attr("style").alias("style"), F.array_join("classes", " ").alias("cls"))
    own = own.select("page_id", "m.pre", "m.post", "m.text").join(style, ["page_id", "pre"])
    parts = inside(own, e)
    has = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    href = F.coalesce(attr("href"), F.lit(""))
    held = parts.groupBy("page_id").agg(
        n_if(tag("a")).alias("links"), has(tag("nav")).alias("has_nav"), n_if(tag("a") & is_social(href)).alias("social_links"), F.sort_array(F.collect_set(F.when(tag("a") & is_social(href), social_platform(href)))).alias("platforms"),
        has((tag("img") | has_class("logo")) & (has_class("logo") | F.lower(F.concat_ws(" ", attr("alt"), attr("src"))).contains("logo"))).alias("has_logo"), has(tag("form")).alias("has_form"), has(tag("a", "button") & has_class("btn|button|cta")).alias("has_cta"),
        has((attr("type") == "search") | mark().contains("search")).alias("has_search"), has(has_class("hamburger|menu-toggle|navbar-toggle")).alias("hamburger"), has(has_class("mega")).alias("mega_menu"), has(has_class("dropdown")).alias("dropdown"), n_if(tag("li") & F.array_contains("anc_tags", "nav")).alias("nav_items"),
        F.countDistinct(F.when(has_class("col|column|grid"), F.col("pre"))).alias("grid_cells"), n_if(tag("h2", "h3", "h4", "h5")).alias("column_headings"),
    )
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("hamburger"), "responsive").when(F.col("nav_items") > 3, "standard").when(F.col("mega_menu"), "mega_menu").when(F.col("dropdown"), "dropdown").otherwise("simple")
    out = own.join(held, "page_id", "left").withColumns({
        "copyright": F.nullif(F.regexp_extract(text, r"((?:©|\(c\)|[Cc]opyright)[^\n.]*)", 1), F.lit("")), "email": F.nullif(F.regexp_extract(text, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1), F.lit("")), "phone": F.nullif(F.regexp_extract(text, r"(\+?\d[\d\s().-]{7,}\d)", 1), F.lit("")),
        "navigation_type": kind, "sticky": F.coalesce(F.col("style").rlike(r"position\s*:\s*(fixed|sticky)"), F.lit(False)) | F.col("cls").rlike("(?i)sticky|fixed"), "columns": F.greatest(F.coalesce(F.when(F.col("grid_cells") > 0, F.col("grid_cells")).otherwise(F.col("column_headings")), F.lit(0)), F.lit(1)),
    })
    return out.drop("post", "text", "style", "cls", "grid_cells", "column_headings", "hamburger", "mega_menu", "dropdown")


def sidebars(e: DataFrame) -> DataFrame:
    """A row for each sidebar: its side and what it holds."""
    s = e.where(tag("aside") | (tag("div", "section") & mark().rlike("sidebar|side-bar|side_bar")))
    side = F.when(mark().contains("left"), "left").when(mark().contains("right"), "right").when(mark().rlike(r"(-l\b|\bl-)"), "left").when(mark().rlike(r"(-r\b|\br-)"), "right").otherwise("unknown")
    held = inside(s, e).groupBy("page_id", F.col("o_pre").alias("pre")).agg(n_if(tag("a")).alias("links"), n_if(has_class("widget")).alias("widgets"), n_if(tag("nav", "ul", "ol")).alias("lists"), n_if(tag("img")).alias("images"), n_if(tag("form")).alias("forms"), n_if(tag("h1", "h2", "h3", "h4", "h5", "h6")).alias("headings"), n_if(tag("p")).alias("paragraphs"))
    return s.select("page_id", "pre", "tag", side.alias("position")).join(held, ["page_id", "pre"], "left").fillna(0)


def content_blocks(e: DataFrame, min_text: int = 100, max_links: float = 0.5) -> DataFrame:
    """Outermost div, section and article with enough text and few links, with their densities."""
    b = e.where(tag("div", "section", "article") & (F.col("stripped_length") >= min_text))
    la = inside(b, e.where(tag("a"))).groupBy("page_id", F.col("o_pre").alias("pre")).agg(F.sum("text_length").alias("link_text"))
    b = b.join(la, ["page_id", "pre"], "left").withColumn("link_density", tx.ratio(F.coalesce("link_text", F.lit(0)), F.col("text_length"))).where(F.col("link_density") <= max_links)
    ends = F.max("post").over(Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
    return b.withColumn("before", ends).where("before IS NULL OR pre > before").select("page_id", "pre", "post", "tag", "text_length", "link_density", tx.ratio(F.col("text_length"), F.col("html_length")).alias("text_density"), "loc")


def sections(e: DataFrame) -> DataFrame:
    """A row for each section: sectioning elements, and div with an id that reads like one; its heading, words, what it holds and how it begins."""
    s = e.where(tag("section", "article", "main", "aside") | (tag("div") & F.lower(F.coalesce("elem_id", F.lit(""))).rlike("section|content|block|container|wrapper|module")))
    h = inside(s, e.where(tag("h1", "h2", "h3", "h4", "h5", "h6", "img", "a"))).groupBy("page_id", F.col("o_pre").alias("pre")).agg(
        F.min_by(F.when(F.col("tag").startswith("h"), F.trim("text")), F.when(F.col("tag").startswith("h"), F.col("pre"))).alias("heading"), n_if(F.col("tag").startswith("h")).alias("headings"),
        F.max(tag("img")).alias("has_images"), F.max(tag("a")).alias("has_links"),
    )
    text = tx.squeeze(F.col("text"))
    words = F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("long")
    out = s.select("page_id", "pre", "tag", "elem_id", "classes", "stripped_length", "loc", words.alias("word_count"), F.substring(text, 1, 100).alias("snippet"))
    return out.join(h, ["page_id", "pre"], "left").fillna(0, ["headings"]).fillna(False, ["has_images", "has_links"])


def videos(e: DataFrame) -> DataFrame:
    """A row for each video: html5, youtube and vimeo with their ids, video.js."""
    src = F.coalesce(attr("src"), F.lit(""))
    player = F.exists("classes", lambda c: c == "video-js")
    kind = F.when(player, "videojs").when(tag("video"), "html5").when(tag("iframe") & src.rlike(r"(?i)youtube\.com|youtu\.be"), "youtube").when(tag("iframe") & src.rlike(r"(?i)vimeo\.com"), "vimeo")
    key = F.when(F.col("kind") == "youtube", F.regexp_extract(src, r"(?:embed/|v=|youtu\.be/)([\w-]+)", 1)).when(F.col("kind") == "vimeo", F.regexp_extract(src, r"(?:video/|vimeo\.com/)(\d+)", 1))
    return e.withColumn("kind", kind).where("kind IS NOT NULL").select("page_id", "pre", "kind", F.nullif(key, F.lit("")).alias("video_id"), F.nullif(src, F.lit("")).alias("src"))


def media_details(e: DataFrame) -> DataFrame:
    """Shares of pictures with texts, links, responsive and lazy ones, the sources of the first 20 pictures and the first 5 frames."""
    n = page_counts(e).where("images > 0 OR iframes > 0")
    share = lambda c: tx.ratio(F.col(c), F.greatest(F.col("images"), F.lit(1))).alias(f"{c}_share")
    shares = n.select("page_id", *[share(c) for c in ("images_with_alt", "images_linked", "images_responsive", "images_lazy")])
    first_ = lambda name, k: F.slice(F.transform(F.sort_array(F.collect_list(F.when(tag(name) & (F.coalesce(attr("src"), F.lit("")) != ""), F.struct("pre", attr("src").alias("src"))))), lambda x: x["src"]), 1, k)
    sources = e.where(tag("img", "iframe")).groupBy("page_id").agg(first_("img", 20).alias("image_sources"), first_("iframe", 5).alias("frame_sources"))
    return shares.join(sources, "page_id", "left")


def form_summary(e: DataFrame) -> DataFrame:
    f = forms(e)
    return f.groupBy("page_id").agg(F.count(F.lit(1)).alias("forms"), F.sort_array(F.collect_set("kind")).alias("form_kinds"), F.sum("required").alias("required_fields"))


def action_summary(e: DataFrame) -> DataFrame:
    """How many calls to action, primary ones, of each type and of each place."""
    c = calls_to_action(e)
    out = c.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("ctas"), n_if(F.col("is_primary")).alias("primary_ctas"), *[n_if(F.col("type") == k).alias(f"cta_{k}") for k in ("button", "element_with_cta_class", "form_submit")],
        *[n_if(F.col("loc") == k).alias(f"ctas_in_{k}") for k in ("header", "main", "sidebar", "footer")],
    )
    return out


def navigation_summary(e: DataFrame) -> DataFrame:
    n = navigation(e)
    main = F.col("is_main")
    return n.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("navs"), F.max(F.when(main, F.col("link_count"))).alias("main_nav_links"), F.max(F.when(main, F.col("has_dropdown"))).alias("main_nav_dropdown"),
        *[n_if(F.col("loc") == k).alias(f"navs_in_{k}") for k in ("header", "footer", "sidebar", "main")],
    )


def list_summary(e: DataFrame) -> DataFrame:
    rows = lists(e)
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("lists"), n_if(F.col("is_navigation")).alias("navigation_lists"), n_if(F.col("is_nested")).alias("nested_lists"), F.avg("items").alias("avg_list_items"), F.max("items").alias("longest_list")
    )


def table_summary(e: DataFrame) -> DataFrame:
    """Tables with and without headers, their size, and those that only lay out: one row or column and no header."""
    t = tables(e)
    headed = F.col("has_thead") | F.col("has_th")
    return t.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("tables"), n_if(headed).alias("tables_with_headers"), n_if(F.col("caption").isNotNull()).alias("tables_with_caption"), F.sum("row_count").alias("table_rows"), F.avg("row_count").alias("avg_table_rows"), F.avg("column_count").alias("avg_table_columns"),
        n_if(~headed & ((F.col("row_count") <= 1) | (F.col("column_count") <= 1))).alias("layout_tables"),
    )


def section_summary(e: DataFrame) -> DataFrame:
    s, b = sections(e), content_blocks(e)
    a = s.groupBy("page_id").agg(F.count(F.lit(1)).alias("section_elements"), n_if(F.col("headings") > 0).alias("sections_with_heading"), F.avg("stripped_length").alias("avg_section_length"))
    c = b.groupBy("page_id").agg(F.count(F.lit(1)).alias("content_blocks"), F.avg("text_density").alias("avg_text_density"), F.avg("link_density").alias("avg_link_density"))
    return a.join(c, "page_id", "full")


def footer_links(e: DataFrame, k: int = 10) -> DataFrame:
    """Of each page's footer the first k links with a text that lead to no social platform: those of its nav if it has one, else all."""
    own = e.where(tag("footer")).groupBy("page_id").agg(F.min_by(F.struct("pre", "post"), "pre").alias("f")).select("page_id", "f.*")
    a = inside(own, e.where(tag("a") & (F.trim("text") != "") & ~is_social(F.coalesce(attr("href"), F.lit("")))))
    a = a.withColumn("in_nav", F.array_contains("anc_tags", "nav")).withColumn("any_nav", F.max("in_nav").over(Window.partitionBy("page_id"))).where(F.col("in_nav") | ~F.col("any_nav"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))
    return a.withColumn("rank", rank).where(F.col("rank") <= k).select("page_id", "rank", F.trim("text").alias("text"), attr("href").alias("href"))


def everything(pages: DataFrame, e: DataFrame) -> DataFrame:
    """A row for each page with the summaries of all its parts; numbers are 0 and flags false where a page has no such part."""
    found = links(pages, e)
    head, foot = (regions(e, n).select("page_id", F.struct(F.lit(True).alias("found"), "links", "has_nav", "has_logo", "has_form", "has_search", "social_links", "copyright", "navigation_type", "sticky").alias(n)) for n in ("header", "footer"))
    crumbs = breadcrumbs(e).select("page_id", F.col("items").alias("breadcrumb"))
    side = sidebars(e).groupBy("page_id").agg(F.count(F.lit(1)).alias("sidebars"), F.sort_array(F.collect_set("position")).alias("sidebar_positions"))
    box = search_boxes(e).select("page_id", F.col("element").alias("search_box"))
    paths = top_paths(found).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("top_paths"))
    outer = external_summary(found).withColumnsRenamed({"external": "external_links", "unique_domains": "external_domains", "nofollow": "external_nofollow", "social": "external_social"})
    h = headings(e).withColumnRenamed("total", "headings").drop("structure")
    parts = [page_counts(e).drop("sections"), h, link_summary(e).withColumnRenamed("total", "links"), outer, paths, form_summary(e), action_summary(e), navigation_summary(e), list_summary(e), table_summary(e), section_summary(e), crumbs, side, box, head, foot]
    out = reduce(lambda a, b: a.join(b, "page_id", "left"), parts, pages.select("page_id", "url"))
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() in ("long", "integer", "double") and f.name != "page_id"]
    flags = [f.name for f in out.schema.fields if f.dataType.typeName() == "boolean"]
    return out.fillna(0, numbers).fillna(False, flags)
