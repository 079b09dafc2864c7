"""The whole analysis of a text in one row, and of many pages by their links.

`analyze` is one chain of projections; recommendations are sorted by priority and then in the order found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dom import elements
from ..sources.sinks import kept_rows
from . import content, metadata, seo, structure
from . import text_analysis as ta


def analyze(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, language, basic, sentiment, ux, recommendations). Text is analysed whole."""
    df = ta.prepare(df, text_col)
    df = ta.user_experience(ta.calls_to_action(ta.emotions(ta.sentiment(ta.quality(ta.readability(ta.statistics(df, text_col), lang_col)))), text_col), text_col)
    basic = ["word_count", "sentence_count", "paragraph_count", "avg_sentence_length", "avg_word_length", "lexical_diversity", "flesch_reading_ease", "flesch_kincaid_grade", "overall_readability", "readability_level", "overall_quality"]
    feel = ["compound", "sentiment", "positive_share", "negative_share", "neutral_share", "dominant_emotion", "emotional_intensity", "cta_count", "cta_triggers", "cta_effectiveness"]
    ux = ["clarity", "distraction_level", "audience_fit", "ux_score"]
    return df.select(id_col, F.col(lang_col).alias("language"), F.struct(*basic).alias("basic"), F.struct(*feel).alias("sentiment"), F.struct(*ux).alias("ux"), recommended(ta.basic_rules(df, lang_col) + ta.experience_rules()).alias("recommendations"))


def recommended(rules: list[tuple[str, str, int, Column]]) -> Column:
    each = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(p).alias("priority"), F.lit(k).alias("place"), F.lit(cat).alias("category"), F.lit(code).alias("code"))) for k, (code, cat, p, cond) in enumerate(rules)]
    return F.array_sort(F.filter(F.array(*each), lambda x: x.isNotNull()))


def analyze_pages(pages: DataFrame) -> DataFrame:
    """Pages parsed and their main text analysed: metadata, SEO scores, and the analysis of the text."""
    e = kept_rows(elements(pages))  # parsed once; each part reads the columns it uses
    main = content.main_content(pages, e).select("page_id", F.col("text").alias("main_text"))
    df = metadata.metadata(pages, e).join(structure.headings(e), "page_id", "left").join(main, "page_id", "left")
    df = seo.relevance_score(seo.url_score(seo.heading_score(seo.meta_score(df))), "main_text")
    text = analyze(df.select("page_id", "main_text", "language"), "page_id", "main_text", "language")
    return df.select("page_id", "url", "title", "meta_score", "heading_score", "url_score", "relevance_score").join(text, "page_id")


def analyze_url(pages: DataFrame, url: str) -> DataFrame:
    """The analysis of one page; the filter reaches the scan."""
    return analyze_pages(pages.where(F.col("url") == url))


def analyze_sitemap(sitemaps: DataFrame, pages: DataFrame, most: int = 100) -> DataFrame:
    """The analysis of the first `most` pages that the sitemaps name (the limit is the caller's choice)."""
    named = sitemaps.select(F.posexplode("urls").alias("place", "url")).orderBy("place", "url").limit(most).select("url").distinct()
    return analyze_pages(pages.join(named, "url", "left_semi"))
