"""The semantic analysis of documents in one row each: keywords and their densities, entities, topics, coherence, and what to mend.

Parts are made by the operators of terms and vectors, a row each for a document, and joined by its id; texts go along once, with the counts by sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import terms, vectors
from . import text_analysis as ta
from .analysis import analyze as analyze_texts
from .analysis import recommended

#: Keywords whose densities are summed for a text and for a section; a section is a fifth of the text, of LEAST words at least.
OVERALL, IN_SECTIONS, SECTIONS, LEAST = 10, 5, 5, 100


def _listed(rows: DataFrame, id_col: str, out: str, *fields: str) -> DataFrame:
    """(id, out): an array of the rows' fields by rank; of bounded length, as their ranks are."""
    return rows.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))), lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(out))


def section_densities(low: Column, keys: Column) -> Column:
    """Of each section the share of words that are keys, in percent."""
    n = F.size(low)
    size = F.greatest(F.lit(LEAST), F.floor(n / SECTIONS).cast("int"))
    own = lambda k: F.slice(low, k * size + 1, size)
    found = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda k: tx.ratio(F.size(F.filter(own(k), lambda w: F.array_contains(keys, w))) * 100, F.size(own(k))))
    return F.when(n > 0, found).otherwise(F.array().cast("array<double>"))


def rules() -> list[tuple[str, str, int, Column]]:
    low, high = F.array_min("section_densities"), F.array_max("section_densities")
    known = F.size("keywords") > 0
    return [
        ("keywords_rare", "seo", 2, known & (F.col("overall_density") < 1)), ("keywords_stuffed", "seo", 2, known & (F.col("overall_density") > 5)),
        ("keywords_uneven", "seo", 3, known & (F.size("section_densities") > 1) & (high > 0) & (low < 0.3 * high)), ("incoherent", "content", 2, F.col("coherence") < 0.2),
        ("unfocused", "content", 2, F.col("topics.unfocused")), ("no_entities", "content", 3, F.size("entities") == 0),
    ]


def analyze(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, keywords, overall_density, section_densities, entities, topics, coherence, semantic_recommendations) of prepared texts. Texts under 20 words have no keywords, those
    under 50 content words no topics."""
    kw = _listed(terms.keywords(df, id_col=id_col), id_col, "keywords", "term", "score", "method")
    en = _listed(terms.entities(df, id_col=id_col), id_col, "entities", "term", "frequency")
    tp = vectors.topics(df, id_col)[1].select(id_col, F.struct("shares", "main_topic", "unfocused").alias("topics"))
    out = ta.coherence(df).select(id_col, tx.lower(F.col("words")).alias("sm_low_"), F.round("coherence", 6).alias("coherence"))
    out = out.join(kw, id_col, "left").join(en, id_col, "left").join(tp, id_col, "left")
    out = out.withColumns({"keywords": F.coalesce("keywords", F.array().cast(out.schema["keywords"].dataType)), "entities": F.coalesce("entities", F.array().cast(out.schema["entities"].dataType))})
    keys = lambda k: F.slice(F.col("keywords")["term"], 1, k)
    hits = F.size(F.filter("sm_low_", lambda w: F.array_contains(keys(OVERALL), w)))
    out = out.withColumns({"overall_density": tx.ratio(hits * 100, F.size("sm_low_")), "section_densities": section_densities(F.col("sm_low_"), keys(IN_SECTIONS))})
    out = out.withColumn("semantic_recommendations", recommended(rules()))
    return out.select(id_col, "keywords", "overall_density", "section_densities", "entities", "topics", "coherence", "semantic_recommendations")


def records(df: DataFrame, now: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The record of each document's analysis, by its id: status, analyzed_at, and as structs seo_metrics, keywords, readability_metrics, sentiment, topics and
    content_quality. sinks.Versions.upsert keeps such records by id."""
    text = ta.prepare(df, text_col)
    whole = analyze_texts(df, id_col, text_col, lang_col).drop("language", "recommendations", "ux")
    stuffed = terms.keyword_stuffing(text, id_col).select(id_col, (F.col("stuffed") > 0).alias("keywords_stuffed"))
    out = whole.join(analyze(text, id_col), id_col).join(stuffed, id_col, "left").withColumn("keywords_stuffed", F.coalesce("keywords_stuffed", F.lit(False)))
    return out.select(
        id_col, F.lit("completed").alias("status"), now.alias("analyzed_at"), F.struct("keywords_stuffed", "overall_density", "section_densities").alias("seo_metrics"), F.struct("keywords", "overall_density").alias("keywords"),
        F.struct("basic.flesch_reading_ease", "basic.flesch_kincaid_grade", "basic.overall_readability", "basic.readability_level").alias("readability_metrics"), "sentiment", "topics", F.col("basic").alias("content_quality"),
    )
