"""Main content, plain text and structured content of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as lex
from ..functions import text as tx
from .metadata import attr
from .structure import has_class, inside, mark, tag

# Regions whose text is no content, and marks in id or class that content does not bear.
FURNITURE = ("script", "style", "noscript", "iframe", "svg", "header", "footer", "nav")
BLACKLIST = "comment|sidebar|footer|header|nav|menu|banner|ad-|ads|promo|widget|related|social|share"


def selectors() -> list[Column]:
    """Where main content stands, best first."""
    cls = lambda name: F.array_contains("classes", name)
    return [
        tag("main"), tag("article"), tag("div") & (attr("role") == "main"), F.col("elem_id") == "content", F.col("elem_id") == "main", F.col("elem_id") == "main-content",
        cls("content"), cls("main"), cls("main-content"), cls("post"), cls("article"), cls("entry"),
    ]


def densities(e: DataFrame) -> DataFrame:
    """div, section and article of 100 characters or more, scored by text, links, paragraphs and headings."""
    b = e.where(tag("div", "section", "article") & (F.col("stripped_length") >= 100) & ~mark().rlike(BLACKLIST))
    held = inside(b, e.where(tag("a", "p", "h1", "h2", "h3", "h4", "h5", "h6")))
    per = held.groupBy("page_id", F.col("o_pre").alias("pre")).agg(F.sum(F.when(tag("a"), F.col("text_length")).otherwise(0)).alias("link_text"), F.count_if(tag("p")).alias("p"), F.count_if(tag("h1", "h2", "h3", "h4", "h5", "h6")).alias("h"))
    b = b.join(per, ["page_id", "pre"], "left").fillna(0, ["link_text", "p", "h"])
    n = F.greatest(F.col("text_length"), F.lit(1))
    score = 30.0 * tx.ratio(F.col("text_length"), F.col("html_length")) + 20.0 * (1 - F.col("link_text") / n) + 15.0 * (1000.0 * F.col("p") / n) + 10.0 * (1000.0 * F.col("h") / n) + F.col("text_length") / 1000.0
    return b.withColumn("score", score)


def main_content(pages: DataFrame, e: DataFrame) -> DataFrame:
    """(page_id, how, pre, text): the first selector with over 100 characters of text, else the densest block scoring
    over 20, else the content paragraphs and headings, else the body."""
    # The first element of each selector counts, or none; an element may be the first of several.
    met = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in enumerate(selectors())]))
    by_selector = e.select("page_id", "pre", "text", "stripped_length", F.explode(met).alias("k"))
    by_selector = by_selector.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "k").orderBy("pre"))).where((F.col("r") == 1) & (F.col("stripped_length") > 100))
    a = by_selector.groupBy("page_id").agg(F.min(F.struct("k", "pre", "text")).alias("m")).select("page_id", F.lit("selector").alias("how"), F.col("m.pre").alias("pre"), F.col("m.text").alias("text"), F.lit(0).alias("o"))
    d = densities(e).where("score > 20").groupBy("page_id").agg(F.max(F.struct("score", (-F.col("pre")).alias("k"), "pre", "text")).alias("m")).select("page_id", F.lit("density").alias("how"), F.col("m.pre").alias("pre"), F.col("m.text").alias("text"), F.lit(1).alias("o"))
    piece = e.where(tag("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "section") & ~F.arrays_overlap("anc_tags", F.array(*[F.lit(t) for t in ("nav", "header", "footer", "aside", "style", "script", "iframe", "p", "ul", "ol", "section")])) & ~mark().rlike(BLACKLIST))
    piece = piece.where(F.col("tag").startswith("h") | (F.col("stripped_length") >= 15))
    c = piece.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pre", "text"))).alias("ps"))
    c = c.select("page_id", F.lit("collected").alias("how"), F.col("ps")[0]["pre"].alias("pre"), F.array_join(F.transform("ps", lambda x: x["text"]), "\n").alias("text"), F.lit(2).alias("o")).where(F.length("text") >= 200)
    top = e.where(F.col("depth") == 1).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pre", F.coalesce("text", F.lit("")).alias("text")))).alias("ps"))
    flat = body_text(e)
    b = top.select("page_id").join(flat, "page_id", "left").select("page_id", F.lit("body").alias("how"), F.lit(None).cast("int").alias("pre"), F.coalesce("body_text", F.lit("")).alias("text"), F.lit(3).alias("o"))
    best = a.unionByName(d).unionByName(c).unionByName(b).groupBy("page_id").agg(F.min_by(F.struct("how", "pre", "text"), F.col("o")).alias("m"))
    return pages.select("page_id", "url").join(best.select("page_id", "m.*"), "page_id", "left")


def body_text(e: DataFrame) -> DataFrame:
    """Text of headings, paragraphs, items and cells outside furniture, a line each, in order."""
    blocks = e.where(tag("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "blockquote", "dt", "dd", "figcaption") & ~F.arrays_overlap("anc_tags", F.array(*[F.lit(t) for t in (*FURNITURE, "p", "li", "td", "th", "blockquote", "dt", "dd")])))
    lines = blocks.where(F.trim("text") != "").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pre", tx.squeeze(F.col("text")).alias("t")))).alias("ls"))
    return lines.select("page_id", F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("body_text"))


# Marks of the fold, as characters that no page holds: a line break, a paragraph break, a level of quotation, a space that stays, and the begin and end of emphasis.
LINE, PARAGRAPH, QUOTE, SPACE, OPEN, SHUT = "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006"
#: Elements whose begin and end part paragraphs, and those that part lines.
PARTED = ("p", "div", "section", "article", "main", "aside", "ul", "ol", "dl", "table", "form", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "fieldset", "figure", "address", "body")
LINED = ("li", "tr", "dt", "dd", "caption", "option", "figcaption", "legend")
EMPHASIS = {"b": "**", "strong": "**", "em": "_", "i": "_", "u": "_", "code": "`", "tt": "`", "kbd": "`", "del": "~~", "s": "~~", "strike": "~~"}


def _begins(number: Column) -> Column:
    """What stands where an element begins; null for none. number: of an item in its list."""
    inner = F.size(F.filter("anc_tags", lambda t: t.isin("ul", "ol")))
    item = F.when(F.get("anc_tags", F.size("anc_tags") - 1) == "ol", F.concat(number.cast("string"), F.lit("."))).otherwise(F.lit("*"))
    kind = F.when(tag("li"), F.concat(F.lit(LINE), F.repeat(F.lit(SPACE + SPACE), inner), item, F.lit(SPACE)))
    kind = kind.when(tag("hr"), F.lit(f"{PARAGRAPH}* * *{PARAGRAPH}")).when(tag("br"), F.lit(LINE)).when(tag("dd"), F.lit(LINE + SPACE * 4)).when(tag("q"), F.lit('"'))
    kind = kind.when(F.col("tag").rlike("^h[1-6]$"), F.concat(F.lit(PARAGRAPH), F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(SPACE)))
    for name, sign in EMPHASIS.items():
        kind = kind.when(tag(name) & ~F.array_contains("anc_tags", "pre"), F.lit(f"{OPEN}{sign}"))
    return kind.when(tag("ul", "ol") & F.array_contains("anc_tags", "li"), F.lit(LINE)).when(tag(*PARTED), F.lit(PARAGRAPH)).when(tag(*LINED), F.lit(LINE))


def _ends() -> Column:
    kind = F.when(tag("td", "th"), F.lit(f"{SPACE}|{SPACE}")).when(tag("q"), F.lit('"'))
    for name, sign in EMPHASIS.items():
        kind = kind.when(tag(name) & ~F.array_contains("anc_tags", "pre"), F.lit(f"{sign}{SHUT}"))
    return kind.when(tag("ul", "ol") & F.array_contains("anc_tags", "li"), F.lit(LINE)).when(tag(*PARTED), F.lit(PARAGRAPH)).when(tag(*LINED), F.lit(LINE))


def text_content(e: DataFrame, strings: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(page_id, text_content): pages as text in the manner of markdown, from their elements and strings (of one parser). Furniture falls out with all it holds; headings, items (numbered
    in ordered lists), quotations and code are marked by what is open around them, emphasis by its elements, whatever their attributes; links stand as their text, pictures fall out,
    blocks are one empty line apart, white space elsewhere is one space.

    roots (page_id, pre): only what those elements hold. Begins, ends and strings are rows in reading order, each with the mark that the open elements
    give it; one sort of them within a page makes the text, so that a page is as much as a task must hold. Pages of tags alone have the empty string, pages of nothing no row."""
    gone = F.array(*[F.lit(t) for t in (*FURNITURE, "head")])
    kept = e.where(~F.array_contains(gone, F.col("tag")) & ~F.arrays_overlap("anc_tags", gone))
    quoted = F.size(F.filter("anc_tags", lambda t: t == "blockquote"))
    number = F.row_number().over(Window.partitionBy("page_id", "parent", tag("li")).orderBy("pre"))
    within = lambda levels: F.repeat(F.lit(QUOTE), levels)
    kept = kept.withColumn("number", number)
    start, end = _begins(F.col("number")), _ends()
    breaks = lambda mark: mark.rlike(f"[{LINE}{PARAGRAPH}]")
    begun = F.when(breaks(start), F.regexp_replace(start, f"^([{LINE}{PARAGRAPH}])", F.concat(F.lit("$1"), within(quoted + tag("blockquote").cast("int"))))).otherwise(start)
    ended = F.when(breaks(end), F.concat(end, within(quoted))).otherwise(end)
    marked = kept.select("page_id", F.explode(F.array(F.struct(F.col("open_at").alias("at"), begun.alias("piece")), F.struct(F.col("close_at").alias("at"), ended.alias("piece")))).alias("m")).select("page_id", "m.*").where("piece IS NOT NULL")
    owners = kept.select("page_id", F.col("pre").alias("owner"), F.when(tag("pre") | F.array_contains("anc_tags", "pre"), True).otherwise(False).alias("raw"), within(quoted + tag("blockquote").cast("int")).alias("quote"))
    said = strings.where("owner >= 0").join(owners, ["page_id", "owner"]).unionByName(strings.where("owner < 0").select("*", F.lit(False).alias("raw"), F.lit("").alias("quote")))
    escaped = F.regexp_replace(F.regexp_replace("content", r"^(\s*\d+)\.(?=\s)", r"$1\\."), r"^(\s*)([+-])(?=\s)", r"$1\\$2")
    raw = F.replace(F.replace(F.col("content"), F.lit(" "), F.lit(SPACE)), F.lit("\n"), F.concat(F.lit("\n"), F.col("quote"), F.lit(SPACE * 4)))
    said = said.select("page_id", "at", F.when(F.col("raw"), F.concat(F.lit(SPACE * 4), raw)).otherwise(F.regexp_replace(escaped, r"\s+", " ")).alias("piece"))
    rows = marked.unionByName(said)
    if roots is not None:
        held = e.join(roots.select("page_id", "pre"), ["page_id", "pre"], "left_semi").select("page_id", F.col("open_at").alias("a"), F.col("close_at").alias("z"))
        rows = rows.join(held, "page_id").where("at BETWEEN a AND z").select("page_id", "at", "piece").distinct()
    pieces = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("t"))
    t = F.col("t")
    for _ in range(2):  # space within emphasis stands outside; emphasis of nothing falls out
        t = F.regexp_replace(t, rf"{OPEN}(\*\*|_|`|~~)( *)\1{SHUT}", "$2")
        t = F.regexp_replace(F.regexp_replace(t, rf"({OPEN}(?:\*\*|_|`|~~)) +", " $1"), rf" +((?:\*\*|_|`|~~){SHUT})", "$1 ")
    t = F.regexp_replace(F.regexp_replace(t, f"[{OPEN}{SHUT}]", ""), f"{SPACE} +", SPACE)
    run = f"[ {LINE}{PARAGRAPH}{QUOTE}]*"
    t = F.regexp_replace(t, rf"{run}{PARAGRAPH}{run}?({QUOTE}*) *(?![ {LINE}{PARAGRAPH}{QUOTE}])", "\n\n$1")
    t = F.regexp_replace(t, rf"[ {LINE}{QUOTE}]*{LINE}({QUOTE}*) *(?![ {LINE}{QUOTE}])", "\n$1")
    t = F.replace(F.regexp_replace(t, " +", " "), F.lit(QUOTE), F.lit("> "))
    t = F.regexp_replace(t, f"[ {SPACE}]+(\n|$)", "$1")
    t = F.regexp_replace(F.replace(t, F.lit(SPACE), F.lit(" ")), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, "</?[a-z][^>]*>", "")  # markup that was text
    out = pieces.select("page_id", F.regexp_replace(t, r"^\n+|\s+$", "").alias("text_content"))
    return e.select("page_id").unionByName(strings.select("page_id")).distinct().join(out, "page_id", "left").fillna("", ["text_content"])


def definitions(e: DataFrame) -> DataFrame:
    """(page_id, pre, term, definition): a dd whose last sibling among dt and dd is a dt."""
    dl = e.where(tag("dl")).select("page_id", F.col("pre").alias("parent"))
    kids = e.where(tag("dt", "dd")).join(dl, ["page_id", "parent"], "left_semi")
    w = Window.partitionBy("page_id", "parent").orderBy("pre")
    kids = kids.select("page_id", "parent", "pre", "tag", F.trim("text").alias("t"), F.lag("tag").over(w).alias("b_tag"), F.lag(F.trim("text")).over(w).alias("term"))
    return kids.where((F.col("tag") == "dd") & (F.col("b_tag") == "dt")).select("page_id", "pre", "term", F.col("t").alias("definition"))


def blockquotes(e: DataFrame) -> DataFrame:
    q = e.where(tag("blockquote"))
    cite = inside(q, e.where(tag("cite", "footer"))).groupBy("page_id", F.col("o_pre").alias("pre")).agg(F.min_by(F.trim("text"), F.struct((F.col("tag") != "cite").cast("int"), "pre")).alias("cite"))
    return q.select("page_id", "pre", F.trim("text").alias("text")).join(cite, ["page_id", "pre"], "left")


def code_blocks(e: DataFrame) -> DataFrame:
    """pre with code inside, or elements classed as code; the language by class."""
    code = e.where(tag("pre", "code") | has_class("code|syntax|highlight"))
    within = inside(e.where(tag("pre")), e.where(tag("code"))).groupBy("page_id", F.col("o_pre").alias("pre")).agg(F.min_by(F.array_join("classes", " "), "pre").alias("inner"))
    out = code.join(within, ["page_id", "pre"], "left").where(has_class("code|syntax|highlight") | (tag("pre") & F.col("inner").isNotNull()))
    cls = F.concat_ws(" ", F.array_join("classes", " "), "inner")
    return out.select("page_id", "pre", "tag", F.col("text").alias("code"), F.nullif(F.regexp_extract(cls, r"(?:language-|lang-|brush:\s*)([A-Za-z0-9+#]+)", 1), F.lit("")).alias("language"))


def dynamic_pages(pages: DataFrame) -> DataFrame:
    """Whether a page likely needs a browser: framework, loading or placeholder marks, or many scripts and little content."""
    html = F.coalesce("html", F.lit(""))
    marks = reduce(lambda a, b: a | b, [html.rlike(p) for p in lex.DYNAMIC])
    few = (F.regexp_count(html, F.lit(r"(?i)<script[\s>]")) > 10) & (F.regexp_count(html, F.lit(r"(?i)<(p|div|article|section)[\s>]")) < 5)
    return pages.select("page_id", "url", (marks | few).alias("is_dynamic"))


def rendered_differs(df: DataFrame, static_col: str = "html", rendered_col: str = "rendered") -> DataFrame:
    """Whether rendering adds over half the html or over 0.3 of the text."""
    bare = lambda c: F.length(tx.squeeze(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?s)<[^>]+>", " ")))
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return df.withColumn("is_dynamic", (tx.ratio(bare(rendered_col), F.greatest(bare(static_col), F.lit(1))) > 1.3) | (tx.ratio(size(rendered_col), F.greatest(size(static_col), F.lit(1))) > 1.5))
