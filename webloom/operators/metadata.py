"""Metadata of pages from their elements: one aggregation by page, whose partial sums are taken before the shuffle.

Of several candidates the first in document order counts; of several values for one key the last. A page without
an element has null and empty values (see `with_all`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_join


def first(cond: Column, value: Column) -> Column:
    """The value at the first element that meets cond and has a value."""
    ok = cond & value.isNotNull() & (value != "")
    return F.min_by(F.when(ok, value), F.when(ok, F.col("pre")))


def pairs(cond: Column, key: Column, value: Column) -> Column:
    """A map from key to value; the last of a key wins."""
    rows = F.sort_array(F.collect_list(F.when(cond & key.isNotNull() & (key != "") & value.isNotNull(), F.struct("pre", key.alias("k"), value.alias("v")))))
    fold = F.aggregate(rows, F.create_map().cast("map<string,string>"), lambda m, r: F.map_concat(F.map_filter(m, lambda k, _: k != r["k"]), F.create_map(r["k"], r["v"])))
    return fold


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def with_all(pages: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each page, with nulls where found has none."""
    return pages.select("page_id", "url").join(found, "page_id", "left")


def candidates(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """A row for each page with every value that metadata may be taken from."""
    tag = F.col("tag")
    meta = lambda key, value: (tag == "meta") & (F.lower(attr(key)) == value)
    content = attr("content")
    rel = F.transform(F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"\s+"), lambda x: F.trim(x))
    link = (tag == "link") & (F.coalesce(attr("rel"), F.lit("")) != "")
    text = F.trim(F.col("text"))
    e = elements.join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    e = e.where(tag.isin("html", "meta", "link", "title", "h1", "script", "article", "form", "a") | attr("itemprop").isNotNull() | attr("itemtype").isNotNull() | attr("rel").isNotNull() | (F.size("classes") > 0) | tag.rlike("login|signin"))
    wanted = F.when((tag == "link") & attr("href").isNotNull(), attr("href"))
    e = e.withColumn("joined", F.when(wanted.isNotNull(), url_join(F.col("base"), wanted)))
    classes = F.lower(F.array_join("classes", " "))
    found = e.groupBy("page_id").agg(
        first(meta("property", "og:title"), content).alias("og_title"), first(tag == "title", text).alias("title_tag"), first(tag == "h1", text).alias("h1"),
        first(meta("name", "description"), content).alias("d1"), first(meta("property", "og:description"), content).alias("d2"), first(meta("name", "twitter:description"), content).alias("d3"),
        first(meta("name", "keywords"), content).alias("keywords_raw"),
        F.transform(F.sort_array(F.collect_list(F.when(meta("property", "article:tag") & content.isNotNull(), F.struct("pre", content.alias("v"))))), lambda r: r["v"]).alias("tags"),
        first(meta("name", "author"), content).alias("a1"), first(meta("property", "article:author"), content).alias("a2"), first(F.array_contains(rel, "author"), text).alias("a3"), first(attr("itemprop") == "author", F.coalesce(content, text)).alias("a4"),
        first(link & F.array_contains(rel, "canonical"), F.col("joined")).alias("c1"), first(meta("property", "og:url"), content).alias("c2"),
        first(tag == "html", attr("lang")).alias("l1"), first(meta("http-equiv", "content-language"), content).alias("l2"), first(meta("property", "og:locale"), content).alias("l3"),
        first((tag == "meta"), attr("charset")).alias("s1"), first(meta("http-equiv", "content-type"), F.regexp_extract(content, "charset=([^;]+)", 1)).alias("s2"),
        first(meta("name", "viewport"), content).alias("viewport"), first(meta("name", "robots"), F.lower(content)).alias("robots_raw"),
        pairs((tag == "meta") & attr("property").startswith("og:"), F.substring(attr("property"), F.lit(4), F.length(attr("property"))), content).alias("open_graph"),
        pairs((tag == "meta") & attr("name").startswith("twitter:"), F.substring(attr("name"), F.lit(9), F.length(attr("name"))), content).alias("twitter_cards"),
        F.transform(F.sort_array(F.collect_list(F.when((tag == "script") & (attr("type") == "application/ld+json") & F.try_parse_json("text").isNotNull(), F.struct("pre", F.trim("text").alias("v"))))), lambda r: r["v"]).alias("json_ld"),
        pairs(link, rel[0], F.col("joined")).alias("rel_links"), pairs(link & F.array_contains(rel, "alternate"), attr("hreflang"), attr("href")).alias("hreflang"),
        pairs(link & F.array_contains(rel, "icon"), F.when(attr("sizes").isNotNull(), F.concat(F.lit("icon_"), attr("sizes"))).otherwise(F.lit("favicon")), F.col("joined")).alias("icons"),
        first(link & F.array_contains(rel, "apple-touch-icon"), F.col("joined")).alias("apple_touch_icon"),
        first(meta("property", "og:type"), content).alias("og_type"), F.max(tag == "article").alias("has_article"), F.max(attr("itemtype").rlike("Product|Offer")).alias("is_product"),
        F.max((tag == "form") & F.lower(F.coalesce(F.col("elem_id"), F.lit(""))).rlike("checkout|cart")).alias("is_checkout"), F.max((tag == "form") & F.lower(F.coalesce(F.col("elem_id"), F.lit(""))).rlike("contact|feedback")).alias("is_contact"),
        F.max(tag.rlike("login|signin")).alias("is_login"), F.max(classes.rlike("post|blog|article")).alias("is_blog"), F.max(classes.rlike("product|listing")).alias("is_listing"),
    )
    return with_all(pages, found)


def simple_metadata(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """The short form: the title tag before Open Graph, the canonical link as joined, keywords without article tags."""
    out = candidates(pages, elements)
    words = F.filter(F.transform(F.split(F.coalesce("keywords_raw", F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "")
    return out.select(
        "page_id", "url", F.coalesce("title_tag", "og_title").alias("title"), F.coalesce("d1", "d2").alias("description"), words.alias("keywords"), F.col("c1").alias("canonical"), F.col("l1").alias("language"),
        "open_graph", "twitter_cards", F.col("a1").alias("author"), F.col("robots_raw").alias("robots"), F.coalesce(F.col("icons")["favicon"], F.element_at(F.map_values("icons"), 1)).alias("favicon"),
    )


def metadata(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """A row for each page with all metadata."""
    out = candidates(pages, elements)
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    words = F.filter(F.transform(F.split(F.coalesce("keywords_raw", F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "")
    kind = F.coalesce("og_type", F.when(on("has_article"), "article"), F.when(on("is_product"), "product"), F.when(on("is_checkout"), "checkout"), F.when(on("is_contact"), "contact"), F.when(on("is_login"), "login"), F.when(on("is_blog"), "blog"), F.when(on("is_listing"), "listing"), F.lit("general"))
    default_icon = F.when(F.map_contains_key(F.coalesce("icons", F.create_map().cast("map<string,string>")), "favicon"), F.col("icons")["favicon"]).otherwise(url_join(F.col("url"), F.lit("/favicon.ico")))
    others = F.map_filter(F.coalesce("icons", F.create_map().cast("map<string,string>")), lambda k, _: k != "favicon")
    touch = F.when(F.col("apple_touch_icon").isNotNull(), F.create_map(F.lit("apple_touch_icon"), F.col("apple_touch_icon"))).otherwise(F.create_map().cast("map<string,string>"))
    all_icons = F.map_concat(others, F.create_map(F.lit("favicon"), default_icon), touch)
    return out.select(
        "page_id", "url", F.coalesce("og_title", "title_tag", "h1").alias("title"), F.coalesce("d1", "d2", "d3").alias("description"), F.concat(words, F.coalesce("tags", F.array().cast("array<string>"))).alias("keywords"),
        F.coalesce("a1", "a2", "a3", "a4").alias("author"), F.coalesce("c1", "c2", "url").alias("canonical"), F.coalesce("l1", "l2", "l3").alias("language"), F.coalesce("s1", "s2").alias("charset"), "viewport",
        robots(F.col("robots_raw")).alias("robots"), "open_graph", "twitter_cards", "json_ld", "rel_links", "hreflang", "icons", default_icon.alias("favicon"), "apple_touch_icon", all_icons.alias("all_icons"), kind.alias("page_type"),
    )


ROBOT_FLAGS = ("index", "follow", "archive", "snippet", "imageindex", "translate")


def robots(raw: Column) -> Column:
    """Six permissions, all true at first; none clears and all sets every one and ends; no<name> clears one."""
    words = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda w: F.trim(w))
    stop = F.least(*[F.when(F.array_position(words, w) > 0, F.array_position(words, w)) for w in ("none", "all")], F.lit(1 << 30).cast("long"))
    ended = F.when(F.array_contains(words, "none") & (F.array_position(words, "none") == stop), F.lit(False)).when(F.array_contains(words, "all") & (F.array_position(words, "all") == stop), F.lit(True))
    return F.struct(*[F.coalesce(ended, ~F.array_contains(words, f"no{n}")).alias(n) for n in ROBOT_FLAGS])


def microdata(elements: DataFrame, nested: bool = False) -> DataFrame:
    """A row for each itemscope: its type and the properties that lie in it, but in no scope within it unless nested."""
    scope = elements.where(F.map_contains_key("attrs", "itemscope")).select("page_id", F.col("pre").alias("s_pre"), F.col("post").alias("s_post"), attr("itemtype").alias("item_type"))
    prop = elements.where(attr("itemprop").isNotNull()).select("page_id", "pre", attr("itemprop").alias("name"), F.coalesce(attr("content"), F.when(F.col("tag").isin("a", "link"), attr("href")), F.when(F.col("tag") == "img", attr("src")), F.trim("text"), F.lit("")).alias("value"))
    inside = prop.join(scope, (prop["page_id"] == scope["page_id"]) & (prop["pre"] > scope["s_pre"]) & (prop["pre"] <= scope["s_post"])).drop(prop["page_id"])
    nearest = inside.groupBy("page_id", "pre").agg(F.max(F.struct("s_pre", "name", "value")).alias("p")).select("page_id", "pre", "p.*")
    own = inside.select("page_id", "pre", "s_pre", "name", "value") if nested else nearest
    props = own.groupBy("page_id", "s_pre").agg(pairs(F.lit(True), F.col("name"), F.col("value")).alias("properties"))
    return scope.join(props, ["page_id", "s_pre"], "left").select("page_id", F.col("s_pre").alias("pre"), "item_type", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))


def structured_data(e: DataFrame) -> DataFrame:
    """(page_id, pre, n, types, name, value): each object of the page's JSON-LD scripts as a variant, those of lists and of @graph by themselves; n counts them
    within a script. Text that is no JSON, and values that are no objects, have no row."""
    scripts = e.where((F.col("tag") == "script") & (F.lower(F.trim(attr("type"))) == "application/ld+json"))
    rows = scripts.select("page_id", "pre", F.try_parse_json("text").alias("v")).where("v IS NOT NULL")
    inner = lambda v: F.try_variant_get(v, "$['@graph']", "array<variant>")
    tops = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    rows = rows.select("page_id", "pre", F.flatten(F.transform(tops, lambda v: F.coalesce(inner(v), F.array(v)))).alias("vs"))
    rows = rows.select("page_id", "pre", F.posexplode("vs").alias("n", "value")).where(F.schema_of_variant("value").startswith("OBJECT"))
    one, several = F.try_variant_get("value", "$['@type']", "string"), F.try_variant_get("value", "$['@type']", "array<string>")
    types = F.coalesce(several, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")).alias("types")
    return rows.select("page_id", "pre", "n", types, F.try_variant_get("value", "$.name", "string").alias("name"), "value")


def said_by(rows: DataFrame, path: str, kind: str = "string"):
    """A property of the objects by its path, null where it is absent or of another kind."""
    return rows.withColumn("said", F.try_variant_get("value", path, kind))
