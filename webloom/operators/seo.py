"""SEO scores of pages and their recommendations. Scores are 1 less a fixed amount for each issue, 0 at least."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from ..functions.urls import part


def issues(*found: tuple[str, Column]) -> Column:
    """The names of the issues that hold, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in found]), lambda x: x.isNotNull())


def score(found: Column, each: float) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - each * F.size(found))


def _holds(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))


def meta_score(df: DataFrame, keywords: Column | None = None) -> DataFrame:
    """title 30 to 60, description 70 to 160 characters, a keyword in each."""
    t, d = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    keys = F.array().cast("array<string>") if keywords is None else keywords
    asked = F.size(keys) > 0
    return df.withColumn("meta_issues", issues(
        ("title_missing", t == ""), ("title_short", (t != "") & (F.length(t) < 30)), ("title_long", F.length(t) > 60),
        ("description_missing", d == ""), ("description_short", (d != "") & (F.length(d) < 70)), ("description_long", F.length(d) > 160),
        ("no_keyword_in_title", asked & (t != "") & ~_holds(t, keys)), ("no_keyword_in_description", asked & (d != "") & ~_holds(d, keys)),
    )).withColumn("meta_score", score(F.col("meta_issues"), 0.2))


def heading_score(df: DataFrame, keywords: Column | None = None) -> DataFrame:
    """From the columns of structure.headings."""
    h1 = F.coalesce("h1", F.lit(0))
    keys = F.array().cast("array<string>") if keywords is None else keywords
    texts = F.array_join(F.transform(F.coalesce("structure", F.array().cast("array<struct<level:int,text:string>>")), lambda x: x["text"]), " ")
    return df.withColumn("heading_issues", issues(("h1_missing", h1 == 0), ("several_h1", h1 > 1), ("level_skipped", ~F.coalesce("proper_hierarchy", F.lit(True))), ("no_keyword_in_headings", (F.size(keys) > 0) & ~_holds(texts, keys)))).withColumn("heading_score", score(F.col("heading_issues"), 0.2))


def url_score(df: DataFrame, url_col: str = "url", keywords: Column | None = None) -> DataFrame:
    """Path length and, for each segment, capitals, unusual characters and length; a keyword in the path."""
    path = F.coalesce(part(F.col(url_col), "PATH"), F.lit(""))
    keys = F.array().cast("array<string>") if keywords is None else keywords
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    of = lambda s: F.when(s.rlike("[A-Z]"), F.lit(1)).otherwise(0) + F.when(s.rlike("[^a-zA-Z0-9-]"), F.lit(1)).otherwise(0) + F.when(F.length(s) > 30, F.lit(1)).otherwise(0)
    n = F.aggregate(segments, F.lit(0), lambda a, s: a + of(s)) + (F.length(path) > 100).cast("int")
    slug = F.transform(keys, lambda k: F.lower(F.regexp_replace(k, r"\s+", "-")))
    n = n + ((F.size(keys) > 0) & ~F.exists(slug, lambda k: F.contains(F.lower(path), k))).cast("int")
    df = df.withColumns({"path_length": F.length(path).cast("long"), "segment_count": F.size(segments).cast("long"), "url_issue_count": n.cast("long")})
    return df.withColumn("url_score", F.greatest(F.lit(0.0), 1.0 - 0.15 * F.col("url_issue_count")))


def _held(text: Column, keys: Column) -> Column:
    """The share of the keys that the text holds."""
    return tx.ratio(F.size(F.filter(keys, lambda k: F.contains(text, F.lower(k)))), F.size(keys))


def relevance_score(df: DataFrame, text_col: str = "text", keywords: Column | None = None) -> DataFrame:
    """Depth by words; of given keywords seven tenths are to be held."""
    n = F.size(F.filter(F.split(tx.text_or_empty(F.col(text_col)), r"\s+"), lambda w: w != ""))
    df = df.withColumn("content_words", n.cast("long"))
    df = df.withColumn("content_depth", F.when(F.col("content_words") < 300, "thin").when(F.col("content_words") < 700, "moderate").otherwise("in_depth"))
    keys = F.array().cast("array<string>") if keywords is None else keywords
    df = df.withColumn("keyword_coverage", F.when(F.size(keys) > 0, _held(F.lower(tx.text_or_empty(F.col(text_col))), keys)))
    found = issues(("thin_content", F.col("content_depth") == "thin"), ("keywords_not_covered", F.col("keyword_coverage") < 0.7))
    return df.withColumn("relevance_issues", found).withColumn("relevance_score", score(F.col("relevance_issues"), 0.25))


def phrase_score(df: DataFrame, phrases: Column, text_col: str = "text") -> DataFrame:
    """How many of the related phrases the text holds; under a half is an issue, no phrases score 0."""
    df = df.withColumn("phrase_score", F.when(F.size(phrases) > 0, _held(F.lower(tx.text_or_empty(F.col(text_col))), phrases)).otherwise(0.0))
    return df.withColumn("phrase_issues", issues(("phrases_not_covered", (F.size(phrases) > 0) & (F.col("phrase_score") < 0.5))))


def optimisation_score(df: DataFrame) -> DataFrame:
    """Over- and under-optimisation from what the other scores found: stuffed text or title, missing tags, no keyword used."""
    usage = F.col("keyword_usage") if "keyword_usage" in df.columns else F.array().cast("array<struct<keyword:string,count:bigint,density:double>>")
    title = F.lower(F.coalesce("title", F.lit(""))) if "title" in df.columns else F.lit("")
    hits = F.aggregate(usage, F.lit(0), lambda a, u: a + F.contains(title, F.lower(u["keyword"])).cast("int"))
    over = issues(("density_over_4", F.coalesce(F.col("max_density") > 4, F.lit(False))), ("title_stuffed", hits > 3))
    under = issues(
        ("title_missing", F.array_contains("meta_issues", "title_missing")), ("description_missing", F.array_contains("meta_issues", "description_missing")), ("h1_missing", F.array_contains("heading_issues", "h1_missing")),
        ("keywords_unused", (F.size(usage) > 0) & (F.aggregate(usage, F.lit(0).cast("bigint"), lambda a, u: a + u["count"]) == 0)),
    )
    level = F.when(F.size(over) > 0, "over").when(F.size(under) > 0, "under").otherwise("balanced")
    df = df.withColumn("optimisation", level).withColumn("optimisation_issues", F.concat(over, under))
    return df.withColumn("optimisation_score", F.when(F.col("optimisation") == "balanced", 1.0).otherwise(0.5))


def keyword_score(df: DataFrame, keywords: Column, text_col: str = "text", n_sections: int = 4, long_text: int = 300) -> DataFrame:
    """Counts and densities (in percent of the words that are no stop words) of given keywords and how they spread over n sections.

    Missing, rare (under 0.5 %) and stuffed (over 3 %) ones are issues, and those that a section of a long text lacks; each costs a tenth."""
    low = F.lower(tx.text_or_empty(F.col(text_col)))
    df = df.withColumns({"kw_words_": F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)), "kw_text_": low, "kw_keys_": F.transform(keywords, lambda k: F.lower(k))})
    df = df.withColumns({"kw_parts_": sections(F.col("kw_words_"), n_sections), "kw_usable_": F.size(F.filter("kw_words_", lambda w: ~w.isin(*lex.STOPWORDS)))})
    in_text = lambda text, k: F.floor((F.length(text) - F.length(F.replace(text, k, F.lit("")))) / F.length(k)).cast("long")
    in_words = lambda words, k: F.size(F.filter(words, lambda w: w == k)).cast("long")
    of = lambda text, words, k: F.when(F.contains(k, F.lit(" ")), in_text(text, k)).otherwise(in_words(words, k))
    usage = F.transform("kw_keys_", lambda k: F.struct(k.alias("keyword"), of(F.col("kw_text_"), F.col("kw_words_"), k).alias("count"), F.transform("kw_parts_", lambda p: of(F.array_join(p, " "), p, k)).alias("by_section")))
    usage = F.transform(usage, lambda u: F.struct(u["keyword"].alias("keyword"), u["count"].alias("count"), tx.ratio(u["count"] * 100, F.col("kw_usable_")).alias("density"), u["by_section"].alias("by_section")))
    df = df.withColumn("keyword_usage", usage)
    uneven = lambda u: (F.size("kw_words_") >= long_text) & F.exists(u["by_section"], lambda n: n == 0)
    issue = F.transform("keyword_usage", lambda u: F.concat(F.when(u["count"] == 0, "missing:").when(u["density"] < 0.5, "rare:").when(u["density"] > 3, "stuffed:").when(uneven(u), "uneven:"), u["keyword"]))
    df = df.withColumn("keyword_issues", F.filter(issue, lambda x: x.isNotNull()))
    return df.withColumns({"keyword_score": score(F.col("keyword_issues"), 0.1), "max_density": F.array_max(F.transform("keyword_usage", lambda u: u["density"]))}).drop("kw_words_", "kw_text_", "kw_keys_", "kw_parts_", "kw_usable_")


def overall(df: DataFrame) -> DataFrame:
    total = 0.20 * F.col("meta_score") + 0.15 * F.col("heading_score") + 0.10 * F.col("url_score") + 0.20 * F.col("keyword_score") + 0.10 * F.col("optimisation_score") + 0.25 * F.col("relevance_score")
    return df.withColumn("seo_score", F.round(total, 6))


def recommendations(df: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row for each issue: (id, category, priority, code), by priority and then in the order found."""
    kinds = [("meta_tags", 1, "meta_issues"), ("headings", 2, "heading_issues"), ("url", 2, "url_issues"), ("keywords", 1, "keyword_issues"), ("optimisation", 2, "optimisation_issues"), ("content", 1, "relevance_issues"), ("phrases", 3, "phrase_issues")]
    kind = "array<struct<priority:int,order:int,place:int,category:string,code:string>>"
    if "url_issue_count" in df.columns:
        df = df.withColumn("url_issues", F.when(F.col("url_issue_count") > 0, F.array(F.lit("url_structure"))))

    def records(order: int, category: str, priority: int, column: str) -> Column:
        record = lambda x, i: F.struct(F.lit(priority).alias("priority"), F.lit(order).alias("order"), i.alias("place"), F.lit(category).alias("category"), x.alias("code"))
        return F.coalesce(F.transform(column, record), F.array()).cast(kind)

    each = F.concat(*[records(n, *k) for n, k in enumerate(kinds) if k[2] in df.columns])
    return df.select(id_col, F.posexplode(F.array_sort(each)).alias("place", "r")).select(id_col, "place", "r.priority", "r.category", "r.code")


def sections(words: Column, n: int = 4) -> Column:
    """n chunks of equal numbers of words; what is over goes to the last."""
    size = F.greatest(F.floor(F.size(words) / n).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(words, (k * size + 1).cast("int"), F.when(k == n - 1, F.greatest(F.size(words) - k * size, F.lit(0))).otherwise(size).cast("int")))
