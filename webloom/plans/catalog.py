"""Registered queries, each over its whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..operators import analysis, content, crawling, languages, metadata, relational, robots, semantic, seo, structure, terms, vectors
from ..operators import text_analysis as ta
from ..sources.dom import elements, strings
from ..sources import readers
from ..sources.readers import table
from . import oracles as o
from . import rich

QUERIES: dict = dict(rich.QUERIES)
ORACLES: dict = dict(rich.ORACLES)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def documents(spark, sf_dir: str) -> DataFrame:
    return ta.prepare(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


#: The elements kept for the query at hand, by Spark application.
_KEPT: dict[str, DataFrame] = {}


def parsed(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages and their elements. The elements are kept, spilling to disk: operators use them several times, and parsing is the dearest step.
    Those of the query before are let go (it would parse again if it ran again); those of an application that has ended went with it."""
    app = spark.sparkContext.applicationId
    before = _KEPT.pop(app, None)
    if before is not None:
        before.unpersist()
    _KEPT.clear()
    pages = table(spark, sf_dir, "pages")
    _KEPT[app] = elements(pages).persist(StorageLevel.MEMORY_AND_DISK)
    return pages, _KEPT[app]


STATS = ["doc_id", "word_count", "character_count", "characters_with_spaces", "sentence_count", "paragraph_count", "avg_sentence_length", "avg_word_length", "lexical_diversity", "punctuation_count", "number_count", "long_word_count", "punctuation_density", "long_word_percent"]
READ = ["doc_id", "syllable_count", "complex_words", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index", "automated_readability_index", "coleman_liau_index", "linsear_write", "dale_chall", "flesch_ru", "fog_ru", "overall_readability", "readability_level", "education_level"]


@query(o.TEXT + o.STATS)
def doc_text_stats(spark, sf_dir):
    return ta.statistics(documents(spark, sf_dir)).select(*STATS)


@query(o.TEXT + o.READ + o.READ_OUT)
def doc_readability(spark, sf_dir):
    return ta.readability(documents(spark, sf_dir)).select(*READ)


@query(o.TEXT + o.QUALITY)
def doc_quality_score(spark, sf_dir):
    return ta.quality(ta.readability(ta.statistics(documents(spark, sf_dir)))).select("doc_id", "overall_quality")


@query(o.TEXT + o.BASIC_RULES)
def doc_recommendations_basic(spark, sf_dir):
    df = ta.readability(ta.statistics(documents(spark, sf_dir)))
    return ta.rules(df, ta.basic_rules(df))


@query(o.TEXT + o.TOP_TERMS)
def doc_top_terms(spark, sf_dir):
    return terms.top_terms(documents(spark, sf_dir))


@query(o.TEXT + o.DENSITY)
def doc_keyword_density(spark, sf_dir):
    return terms.keyword_density(documents(spark, sf_dir)).select("doc_id", "term", "frequency", "rank", F.col("word_count").cast("long"), "density")


@query(o.TEXT + o.TFIDF)
def doc_tfidf_top(spark, sf_dir):
    return terms.tfidf(documents(spark, sf_dir))


@query(o.TEXT + o.BIGRAMS)
def doc_bigrams(spark, sf_dir):
    return terms.bigrams(documents(spark, sf_dir))


@query(o.TEXT + o.MERGED)
def doc_merged_bigrams(spark, sf_dir):
    return terms.merged_bigrams(documents(spark, sf_dir))


@query(o.TEXT + "SELECT doc_id, len(toks)::BIGINT AS n, CASE WHEN len(toks) = 0 THEN '' ELSE toks[1] || '/X' END AS first_tag FROM v")
def doc_pos_tags(spark, sf_dir):
    df = terms.pos_tags(documents(spark, sf_dir))
    first = F.get("pos", F.lit(0))
    return df.select("doc_id", F.size("pos").cast("long").alias("n"), F.coalesce(F.concat(first["token"], F.lit("/"), first["tag"]), F.lit("")).alias("first_tag"))


@query(o.TEXT + "SELECT doc_id, (doc_id % 3)::BIGINT AS grammar_errors, CASE WHEN doc_id % 3 = 0 THEN 100.0 ELSE greatest(0.0, 100.0::DOUBLE - 10.0::DOUBLE * CASE WHEN len(words) = 0 THEN 0.0::DOUBLE ELSE (doc_id % 3 * 100)::DOUBLE / len(words) END) END::DOUBLE AS grammar_score FROM v")
def doc_grammar_score(spark, sf_dir):
    """From errors that a checker found elsewhere."""
    return ta.grammar(documents(spark, sf_dir), F.col("doc_id") % 3).select("doc_id", "grammar_errors", "grammar_score")


@query(o.TEXT + o.ENTITIES)
def doc_entities(spark, sf_dir):
    return terms.entities(documents(spark, sf_dir))


@query(o.TEXT + o.GRAPH)
def doc_entity_cooccurrence(spark, sf_dir):
    return terms.entity_graph(documents(spark, sf_dir))


@query(o.TEXT + o.USAGE)
def doc_keyword_usage(spark, sf_dir):
    return terms.keyword_usage(documents(spark, sf_dir))


@query(o.TEXT + o.STUFFED)
def doc_keyword_stuffing(spark, sf_dir):
    return terms.keyword_stuffing(documents(spark, sf_dir))


@query(o.TEXT + o.SENTIMENT)
def doc_sentiment(spark, sf_dir):
    return ta.sentiment(documents(spark, sf_dir)).select("doc_id", "compound", "sentiment", "positive_share", "negative_share", "neutral_share")


@query(o.TEXT + o.EMOTIONS)
def doc_emotions(spark, sf_dir):
    return ta.emotions(documents(spark, sf_dir)).select("doc_id", "joy", "sadness", "anger", "fear", "surprise", "dominant_emotion", "emotional_intensity")


@query(o.TEXT + o.CTA)
def doc_calls_to_action(spark, sf_dir):
    return ta.calls_to_action(documents(spark, sf_dir)).select("doc_id", "cta_count", F.array_join("cta_triggers", ",").alias("cta_triggers"), "cta_effectiveness")


@query(o.TEXT + o.UX)
def doc_ux_score(spark, sf_dir):
    return ta.user_experience(documents(spark, sf_dir)).select("doc_id", "long_sentences", "clarity", "caps", "exclamations", "ellipses", "repeated_trigrams", "distraction_level", "audience_fit", "ux_score")


@query(o.TEXT + o.COHERENCE)
def doc_coherence(spark, sf_dir):
    return ta.coherence(documents(spark, sf_dir)).select("doc_id", F.round("coherence", 6).alias("coherence"))


@query(o.PROFILES)
def doc_language_profiles(spark, sf_dir):
    """Each text's language by profiles of character trigrams, learned from the texts that are not held out."""
    return languages.detected(table(spark, sf_dir, "documents")).select("doc_id", "lang", "held_out", "detected_lang")


@query(o.PROFILES_RIGHT)
def language_accuracy(spark, sf_dir):
    """Of held-out texts of each language, how many are detected as such."""
    found = doc_language_profiles(spark, sf_dir).where("held_out AND lang IS NOT NULL")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == F.col("detected_lang")).alias("right"))


@query(o.LANGUAGE)
def doc_language(spark, sf_dir):
    return ta.language(table(spark, sf_dir, "documents")).select("doc_id", "lang", "detected_lang")


@query(o.ALL_RULES)
def doc_recommendations_all(spark, sf_dir):
    """Basic, sentiment and UX rules in one shape, by priority and then in the order found."""
    df = ta.user_experience(ta.calls_to_action(ta.emotions(ta.sentiment(ta.readability(ta.statistics(documents(spark, sf_dir)))))))
    return relational.recommendations(ta.rules(df, ta.basic_rules(df) + ta.experience_rules()))


@query(o.TEXT.replace("FROM documents", "FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) AS doc_id, '' AS lang, text FROM conversations)") + o.SENTIMENT.replace("SELECT doc_id, compound,", "SELECT (SELECT count(*) FROM c)::BIGINT AS turns, count(*)::BIGINT AS n, sentiment FROM (SELECT doc_id, compound,", 1) + ") GROUP BY sentiment")
def conversation_sentiment(spark, sf_dir):
    df = ta.sentiment(ta.prepare(table(spark, sf_dir, "conversations")))
    per = df.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("turns", F.lit(df.count()))


@query(o.TEXT + o.QUALITY.replace("\nSELECT o.doc_id,", ", qq AS (SELECT o.doc_id,", 1) + ") SELECT quality, count(*) AS n, round(avg(overall_quality), 6) AS mean_quality FROM qq JOIN labels USING (doc_id) GROUP BY quality")
def label_quality_report(spark, sf_dir):
    scored = doc_quality_score(spark, sf_dir)
    return scored.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall_quality"), 6).alias("mean_quality"))


@query(o.TEXT + o.RANKED)
def doc_rank_terms(spark, sf_dir):
    return terms.rank_terms(documents(spark, sf_dir))


@query(o.TEXT + o.KEYWORDS)
def doc_keywords(spark, sf_dir):
    return terms.keywords(documents(spark, sf_dir))


@query(o.TEXT + o.RELATED)
def doc_related_phrases(spark, sf_dir):
    return terms.related_phrases(documents(spark, sf_dir))


@query(o.TEXT + o.CONTENT_WORDS)
def doc_content_words(spark, sf_dir):
    df = terms.stop_words_removed(documents(spark, sf_dir))
    return df.select("doc_id", F.size("content_words").cast("long").alias("content_words"), F.md5(F.array_join("content_words", " ").cast("binary")).alias("content_md5"))


@query(o.TEXT + o.EMOTION_PROFILE)
def doc_emotion_profile(spark, sf_dir):
    df = ta.emotion_profile(documents(spark, sf_dir))
    return df.select("doc_id", *[c for k in lex.EMOTIONS for c in (F.col(f"{k}_share"), F.size(f"{k}_sentences").cast("long").alias(f"{k}_sentences"))])


@query(o.TEXT + o.SECTION_TERMS)
def doc_section_keywords(spark, sf_dir):
    return terms.section_terms(documents(spark, sf_dir))


@query(o.TEXT + o.GRAPH_NODES)
def doc_entity_nodes(spark, sf_dir):
    return terms.entity_nodes(documents(spark, sf_dir))


@query(o.TEXT + o.PREPROCESSED)
def doc_preprocessed(spark, sf_dir):
    """Lemmas without the stop words of each document's language and one of the caller's."""
    df = terms.preprocessed(documents(spark, sf_dir), lang_col="lang", extra=("item",))
    return df.select("doc_id", F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", " ").cast("binary")).alias("md5"))


@query(o.TEXT + o.SIMILAR_ENDS)
def doc_similar_ends(spark, sf_dir):
    """How alike the first and the last sentence of each document are."""
    words = lambda s: F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    ends = terms.similarity(words(F.get("sents", F.lit(0))), words(F.try_element_at("sents", F.lit(-1))))
    return documents(spark, sf_dir).select("doc_id", ends.alias("similarity"))


@query(o.SEMANTIC)
def doc_semantic(spark, sf_dir):
    """Keywords, entities and coherence of each document in one row."""
    df = documents(spark, sf_dir)
    listed = lambda rows, value, out: rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"]), "|").alias(out))
    kw = listed(terms.keywords(df), F.col("term"), "keywords")
    en = listed(terms.entities(df), F.concat("term", F.lit(":"), F.col("frequency").cast("string")), "entities")
    out = ta.coherence(df).select("doc_id", F.round("coherence", 6).alias("coherence")).join(kw, "doc_id", "left").join(en, "doc_id", "left")
    return out.fillna("", ["keywords", "entities"])


@query(o.SEMANTIC_WHOLE)
def doc_semantic_analysis(spark, sf_dir):
    """Keywords, densities, entities, topics, coherence and recommendations of each document."""
    df = semantic.analyze(documents(spark, sf_dir))
    codes = F.array_join(F.transform("semantic_recommendations", lambda r: r["code"]), "|")
    return df.select("doc_id", F.array_join(F.slice(F.col("keywords")["term"], 1, 10), "|").alias("keywords"), F.round("overall_density", 6).alias("overall_density"), F.size("section_densities").cast("long").alias("sections"),
                     F.round(F.array_min("section_densities"), 6).alias("least"), F.round(F.array_max("section_densities"), 6).alias("most"), F.size("entities").cast("long").alias("entities"), F.coalesce("topics.main_topic", F.lit(-1)).alias("main_topic"), "coherence", codes.alias("codes"))


@query(o.RECORDS)
def doc_analysis_records(spark, sf_dir):
    """The record that is kept of each document's analysis: what stands in its parts."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = semantic.records(df, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    first = lambda c: F.coalesce(F.get(c, F.lit(0))["term"], F.lit(""))
    return rows.select("doc_id", "status", F.date_format("analyzed_at", "yyyy-MM-dd HH:mm").alias("analyzed"), F.col("seo_metrics.keywords_stuffed").alias("stuffed"), first(F.col("keywords.keywords")).alias("keyword"), F.round("keywords.overall_density", 6).alias("density"), F.round("readability_metrics.overall_readability", 6).alias("readability"),
                       "sentiment.sentiment", F.coalesce("topics.main_topic", F.lit(-1)).alias("main_topic"), F.round("content_quality.overall_quality", 6).alias("quality"))


@query(o.TEXT + o.TOPIC_TERMS)
def doc_topics(spark, sf_dir):
    """The best terms of three topics of the corpus."""
    return vectors.topics(documents(spark, sf_dir))[0].withColumn("weight", F.round("weight", 6))


@query(o.TEXT + o.TOPIC_SHARES)
def doc_topic_shares(spark, sf_dir):
    """The topics of each document, and whether its two largest are too close."""
    shares = [F.round(F.col("shares")[j], 4).alias(f"share_{j}") for j in range(3)]
    return vectors.topics(documents(spark, sf_dir))[1].select("doc_id", *shares, "main_topic", "unfocused")


@query(o.TEXT + o.RELEVANCE)
def doc_content_relevance(spark, sf_dir):
    """How near each text is to the first content words of its first sentence, each by itself and five together as a title."""
    df = documents(spark, sf_dir)
    first = vectors.content_words(F.regexp_extract_all(F.coalesce(F.get("sents", F.lit(0)), F.lit("")), F.lit(r"\p{L}+"), F.lit(0)))
    asked = F.concat(F.slice(first, 1, 3), F.array(F.array_join(F.slice(first, 1, 5), " ")))
    targets = df.where(F.size(first) > 0).select("doc_id", F.explode(asked).alias("phrase"))
    out = vectors.content_relevance(df, targets).withColumn("topic_coverage_ratio", F.round("topic_coverage_ratio", 6))
    return out.select("doc_id", "word_count", "content_depth", "topical_relevance", "topic_coverage_ratio", *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("key_phrases", "relevance_issues")], "relevance_score")


@query(o.TEXT + o.PHRASE_STUFFING)
def doc_phrase_stuffing(spark, sf_dir):
    """Stuffed texts by words and by phrases that sentences in a row repeat."""
    return terms.stuffed_texts(documents(spark, sf_dir))


#: Sentences put after each text, so that the rule for phrases holds for all of them; # stands for the id.
PLANTED = " End. Cheap green apples# here. Buy cheap green apples today. We have cheap green apples. Others don't."


@query("SELECT doc_id, 'cheap green apples' AS term FROM documents")
def doc_planted_phrases(spark, sf_dir):
    """The phrase of sentences put after each text: of the phrases found, the one that is planted."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(PLANTED)).alias("text"))
    return terms.repeated_phrases(df).where("term = 'cheap green apples'")


@query()
def doc_analysis(spark, sf_dir):
    df = analysis.analyze(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return df.select("doc_id", "language", *[F.to_json(c).alias(c) for c in ("basic", "sentiment", "ux", "recommendations")])


@query(o.ANALYSIS)
def doc_analysis_summary(spark, sf_dir):
    """The whole analysis, flat, with the codes of its recommendations by priority."""
    df = analysis.analyze(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    codes = F.array_join(F.transform("recommendations", lambda r: r["code"]), "|")
    return df.select("doc_id", "language", "basic.word_count", "basic.overall_readability", "basic.readability_level", "basic.overall_quality", "sentiment.sentiment", "sentiment.dominant_emotion", "sentiment.cta_count", "ux.ux_score", codes.alias("codes"))


@query()
def page_analysis(spark, sf_dir):
    df = analysis.analyze_pages(table(spark, sf_dir, "pages"))
    return df.select("page_id", "url", "title", "meta_score", "heading_score", "url_score", "relevance_score", *[F.to_json(c).alias(c) for c in ("basic", "sentiment", "ux", "recommendations")])


# Pages.


@query(o.PAGE_BARE + """, a AS (SELECT page_id, url, unnest(regexp_extract_all(bare, '<a href="([^"]*)"', 1)) AS href FROM h)
SELECT page_id, count(*) AS total, count(*) FILTER (href LIKE '#%') AS anchor, count(*) FILTER (href LIKE 'mailto:%') AS mailto FROM a GROUP BY 1""")
def page_link_types(spark, sf_dir):
    return structure.link_summary(parsed(spark, sf_dir)[1]).select("page_id", "total", "anchor", "mailto")


@query()
def page_links(spark, sf_dir):
    pages, e = parsed(spark, sf_dir)
    return structure.links(pages, e).select("page_id", "pre", "url", "text", "rel", "title", "host", "internal", "nofollow", "loc")


@query(o.LINKS_TOTAL)
def page_link_counts(spark, sf_dir):
    found = structure.links(*parsed(spark, sf_dir))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("internal").alias("internal"))


@query()
def page_top_paths(spark, sf_dir):
    return structure.top_paths(structure.links(*parsed(spark, sf_dir)))


@query()
def page_external_domains(spark, sf_dir):
    return structure.external_summary(structure.links(*parsed(spark, sf_dir)))


@query(o.PAGE_BARE + """SELECT page_id, len(regexp_extract_all(bare, '<h1[ >]'))::BIGINT AS h1, len(regexp_extract_all(bare, '<h2[ >]'))::BIGINT AS h2, len(regexp_extract_all(bare, '<h[1-6][ >]'))::BIGINT AS total
FROM h WHERE regexp_matches(bare, '<h[1-6][ >]')""")
def page_headings(spark, sf_dir):
    return structure.headings(parsed(spark, sf_dir)[1]).select("page_id", "h1", "h2", "total")


@query(o.PAGE_BARE + r"""SELECT page_id, nullif(replace(replace(replace(replace(trim(regexp_extract(bare, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '') AS title_tag, nullif(regexp_extract(bare, '<html lang="([^"]*)"', 1), '') AS language, nullif(regexp_extract(bare, '<meta charset="([^"]*)"', 1), '') AS charset FROM h""")
def page_title_lang_charset(spark, sf_dir):
    return metadata.metadata(*parsed(spark, sf_dir)).select("page_id", F.col("title").alias("title_tag"), "language", "charset")


@query(o.PAGE_BARE + r"""SELECT page_id, len(regexp_extract_all(bare, '<[a-zA-Z][^>]*>'))::BIGINT AS elements, len(regexp_extract_all(bare, '<p[ >]'))::BIGINT AS p, len(regexp_extract_all(bare, '<li[ >]'))::BIGINT AS li, len(regexp_extract_all(bare, '<script[ >]'))::BIGINT AS scripts
FROM h WHERE len(regexp_extract_all(bare, '<[a-zA-Z][^>]*>')) > 0""")
def page_tag_counts(spark, sf_dir):
    e = parsed(spark, sf_dir)[1]
    return e.groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("tag") == "p").alias("p"), F.count_if(F.col("tag") == "li").alias("li"), F.count_if(F.col("tag") == "script").alias("scripts"))


@query(r"""
WITH u AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1) AS path FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM u),
n AS (SELECT *, (length(path) > 100)::INTEGER + coalesce(list_sum(list_transform(segs, lambda s: regexp_matches(s, '[A-Z]')::INTEGER + regexp_matches(s, '[^a-zA-Z0-9-]')::INTEGER + (length(s) > 30)::INTEGER)), 0) AS k FROM s)
SELECT page_id, length(path)::BIGINT AS path_length, len(segs)::BIGINT AS segment_count, k::BIGINT AS url_issue_count, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * k) AS url_score FROM n""")
def page_url_seo(spark, sf_dir):
    return seo.url_score(table(spark, sf_dir, "pages")).select("page_id", "path_length", "segment_count", "url_issue_count", "url_score")


@query("""SELECT page_id, n::INTEGER AS n, types, name, round(price, 2) AS price FROM pages, LATERAL (SELECT 0 AS n, 'WebPage' AS types, url AS name, NULL::DOUBLE AS price UNION ALL SELECT 1, 'Product|Thing', NULL, length(url) / 4.0::DOUBLE UNION ALL SELECT 2, '', 'end', NULL) WHERE url IS NOT NULL""")
def page_json_ld(spark, sf_dir):
    """Objects of JSON-LD made of each page's address, with a graph, several types and none, beside a script that is no JSON."""
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    graph = F.array(F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.col("url").alias("name"))), F.to_json(F.struct(F.array(F.lit("Product"), F.lit("Thing")).alias("@type"), F.struct((F.length("url") / 4.0).alias("price")).alias("offers"))), F.lit('{"name": "end"}'))
    script = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    html = F.concat(script(F.concat(F.lit('{"@graph": ['), F.array_join(graph, ","), F.lit("]}"))), script(F.lit("{no json")), F.coalesce("html", F.lit("")))
    rows = metadata.said_by(metadata.structured_data(elements(pages.withColumn("html", html))), "$.offers.price", "double")
    return rows.select("page_id", "n", F.array_join("types", "|").alias("types"), "name", F.round("said", 2).alias("price"))


@query(o.PAGE_BARE + r""", t AS (SELECT page_id, coalesce(nullif(replace(replace(replace(replace(trim(regexp_extract(bare, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), ''), '') AS t FROM h)
SELECT page_id, length(t)::BIGINT AS title_length, greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.2::DOUBLE * (CASE WHEN t = '' OR length(t) < 30 OR length(t) > 60 THEN 1 ELSE 0 END + 1)) AS meta_score FROM t""")
def page_meta_seo(spark, sf_dir):
    m = seo.meta_score(metadata.metadata(*parsed(spark, sf_dir)))
    return m.select("page_id", F.length(F.coalesce("title", F.lit(""))).cast("long").alias("title_length"), "meta_score")


@query(r"""SELECT page_id, url, regexp_matches(coalesce(html, ''), 'ng-app|react-app|data-vue|ember-application|<nuxt|__NEXT_DATA__|ng-controller|v-if|v-for|v-model|v-on|\.load\(|\.ajax\(|fetch\(|new XMLHttpRequest\(\)|axios|class="[^"]*loading[^"]*"|id="[^"]*loading[^"]*"|skeleton|placeholder|lazy-load')
  OR (len(regexp_extract_all(coalesce(html, ''), '(?i)<script[\s>]')) > 10 AND len(regexp_extract_all(coalesce(html, ''), '(?i)<(p|div|article|section)[\s>]')) < 5) AS is_dynamic FROM pages""")
def page_dynamic_flag(spark, sf_dir):
    return content.dynamic_pages(table(spark, sf_dir, "pages"))


@query()
def page_metadata_full(spark, sf_dir):
    m = metadata.metadata(*parsed(spark, sf_dir))
    return m.select(*[F.to_json(c).alias(c) if m.schema[c].dataType.typeName() in ("map", "struct", "array") else F.col(c) for c in m.columns])


@query()
def page_structure_full(spark, sf_dir):
    df = structure.everything(*parsed(spark, sf_dir))
    return df.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("map", "struct", "array") else F.col(c) for c in df.columns])


@query(o.MARKDOWN)
def page_markdown(spark, sf_dir):
    """Pages as text with marks of headings, emphasis and lists, from their elements and strings."""
    pages, e = parsed(spark, sf_dir)
    return content.text_content(e, strings(pages))


@query()
def page_main_content(spark, sf_dir):
    return content.main_content(*parsed(spark, sf_dir)).select("page_id", "how", "pre", F.length("text").alias("text_length"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def page_navigation(spark, sf_dir):
    return structure.navigation(parsed(spark, sf_dir)[1])


@query()
def page_lists(spark, sf_dir):
    return structure.lists(parsed(spark, sf_dir)[1])


@query()
def page_tables(spark, sf_dir):
    return structure.tables(parsed(spark, sf_dir)[1])


@query()
def page_forms(spark, sf_dir):
    return structure.forms(parsed(spark, sf_dir)[1])


@query()
def page_calls_to_action(spark, sf_dir):
    return structure.calls_to_action(parsed(spark, sf_dir)[1])


@query()
def page_breadcrumbs(spark, sf_dir):
    return structure.breadcrumbs(parsed(spark, sf_dir)[1])


@query()
def page_content_blocks(spark, sf_dir):
    return structure.content_blocks(parsed(spark, sf_dir)[1])


@query()
def page_headers(spark, sf_dir):
    return structure.regions(parsed(spark, sf_dir)[1], "header")


@query()
def page_footers(spark, sf_dir):
    return structure.regions(parsed(spark, sf_dir)[1], "footer")


@query()
def page_sidebars(spark, sf_dir):
    return structure.sidebars(parsed(spark, sf_dir)[1])


@query()
def page_sections(spark, sf_dir):
    return structure.sections(parsed(spark, sf_dir)[1])


@query()
def page_follow_links(spark, sf_dir):
    return relational.follow(structure.links(*parsed(spark, sf_dir)))


@query()
def doc_recommendations_semantic(spark, sf_dir):
    return terms.semantic_rules(documents(spark, sf_dir))


@query()
def page_search_boxes(spark, sf_dir):
    return structure.search_boxes(parsed(spark, sf_dir)[1])


@query()
def page_structured_content(spark, sf_dir):
    """Definitions, quotations and code blocks in one list."""
    e = parsed(spark, sf_dir)[1]
    d = content.definitions(e).select("page_id", "pre", F.lit("definition").alias("kind"), F.col("definition").alias("text"), F.col("term").alias("note"))
    q = content.blockquotes(e).select("page_id", "pre", F.lit("quotation").alias("kind"), "text", F.col("cite").alias("note"))
    return d.unionByName(q).unionByName(content.code_blocks(e).select("page_id", "pre", F.lit("code").alias("kind"), F.col("code").alias("text"), F.col("language").alias("note")))


@query()
def page_microdata(spark, sf_dir):
    return metadata.microdata(parsed(spark, sf_dir)[1]).withColumn("properties", F.to_json("properties"))


def with_seo(pages: DataFrame, e: DataFrame) -> DataFrame:
    """Metadata, headings, body text and every SEO score of each page; its ten most frequent words are the keywords."""
    df = metadata.metadata(pages, e).join(structure.headings(e), "page_id", "left").join(content.body_text(e), "page_id", "left")
    top = terms.top_terms(ta.prepare(df.select("page_id", F.coalesce("body_text", F.lit("")).alias("text"))), 10, "page_id")
    top = top.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_words"))
    df = df.join(top, "page_id", "left").withColumn("top_words", F.coalesce("top_words", F.array().cast("array<string>")))
    df = seo.keyword_score(seo.relevance_score(seo.url_score(seo.heading_score(seo.meta_score(df))), "body_text"), F.col("top_words"), "body_text")
    return seo.overall(seo.optimisation_score(df))


@query()
def page_report(spark, sf_dir):
    """The flagship: structure, metadata and SEO scores of every page."""
    pages, e = parsed(spark, sf_dir)
    df = with_seo(pages, e).join(structure.page_counts(e).select("page_id", "elements", "max_nesting", "complexity", "images", "scripts"), "page_id", "left")
    df = df.join(structure.link_summary(e).select("page_id", F.col("total").alias("links")), "page_id", "left")
    return df.select("page_id", "url", "title", "language", "h1", F.col("total").alias("headings"), "links", "elements", "max_nesting", "complexity", "meta_score", "heading_score", "url_score", "keyword_score", "relevance_score", "optimisation", "seo_score")


@query()
def page_seo_recommendations(spark, sf_dir):
    return seo.recommendations(with_seo(*parsed(spark, sf_dir)))


GIVEN = ("the", "of the", "que", "zzz")


@query(o.GIVEN_KEYWORDS)
def doc_given_keywords(spark, sf_dir):
    """Usage of given keywords, a row for each document and keyword."""
    df = seo.keyword_score(table(spark, sf_dir, "documents").select("doc_id", "text"), F.array(*[F.lit(k) for k in GIVEN]))
    # An inner explode would make the optimiser filter the scan by the size of the usage, and so compute it, words and all, once more for each keyword and section.
    df = df.select("doc_id", "keyword_score", F.explode_outer("keyword_usage").alias("u"), F.array_join("keyword_issues", "|").alias("issues")).where("u IS NOT NULL")
    return df.select("doc_id", "keyword_score", "u.keyword", "u.count", "u.density", F.array_join("u.by_section", "|").alias("by_section"), "issues")


# Tables.


@query("SELECT count(*) AS n FROM orders")
def rel_count(spark, sf_dir):
    return relational.count(table(spark, sf_dir, "orders"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def rel_lookup(spark, sf_dir):
    return relational.get(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", 42)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def rel_page_offset(spark, sf_dir):
    return relational.get_multi(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 100, 50)


@query("SELECT o.o_orderkey, o.o_orderpriority FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = (SELECT min(n_name) FROM nation)")
def rel_ownership(spark, sf_dir):
    user = table(spark, sf_dir, "nation").orderBy("n_name").first()["n_nationkey"]
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return relational.owned(orders, customers, user, project_key="o_custkey", owner="c_nationkey").drop("o_custkey")


@query("SELECT count(*) AS lineitems FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def rel_cascade_delete(spark, sf_dir):
    customer, orders, items = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    left = relational.remove_cascade(customer, "c_custkey", customer.where("c_mktsegment = 'BUILDING'"), (orders, "o_custkey", "o_orderkey"), (items, "l_orderkey", "l_linenumber"))
    return left[2].agg(F.count(F.lit(1)).alias("lineitems"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def rel_latest_by_key(spark, sf_dir):
    return relational.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer")
def rel_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    patch = base.where("c_custkey % 10 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_mktsegment"))
    return relational.update(base, patch, "c_custkey")


@query("SELECT o_orderpriority, CASE WHEN o_orderstatus = 'O' THEN 'parsing' WHEN o_orderstatus = 'F' THEN 'analyzed' ELSE 'error' END AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def rel_status_steps(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("parsing").alias("old"), F.when(F.col("o_orderstatus") == "O", "parsing").when(F.col("o_orderstatus") == "F", "analyzed").otherwise("error").alias("wanted"))
    return df.withColumn("status", relational.step(F.col("old"), F.col("wanted"))).groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def rel_dup_guard(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    return relational.new_only(table(spark, sf_dir, "orders").select("o_custkey"), known, ["o_custkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_regionkey AS id, r_name, r_regionkey IN (1, 3) AS is_implemented FROM region")
def rel_flag_update(spark, sf_dir):
    return relational.mark_implemented(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), "r_name"), [1, 3])


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def rel_by_priority(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    return relational.by_priority(orders, "o_custkey", orders.agg(F.min("o_custkey")).first()[0]).drop("o_custkey")


def customers(spark, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", *more)


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer UNION ALL SELECT -n_nationkey - 1, n_name, n_nationkey, NULL FROM nation")
def rel_insert(spark, sf_dir):
    return relational.insert(customers(spark, sf_dir), table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).alias("c_custkey"), F.col("n_name").alias("c_name"), F.col("n_nationkey").alias("c_nationkey")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 5 OFFSET 2")
def rel_of_parent(spark, sf_dir):
    return relational.of_parent(customers(spark, sf_dir).select("c_custkey", "c_name", "c_nationkey"), "c_nationkey", 7, ["c_custkey"], 2, 5).drop("c_nationkey")


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def rel_with_one(spark, sf_dir):
    return relational.with_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT 'customer' AS name, count(*) = 0 AS empty FROM customer UNION ALL SELECT 'none', true")
def rel_is_empty(spark, sf_dir):
    one = relational.is_empty(table(spark, sf_dir, "customer")).select(F.lit("customer").alias("name"), "empty")
    return one.unionByName(relational.is_empty(table(spark, sf_dir, "customer").where("c_custkey < 0")).select(F.lit("none").alias("name"), "empty"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_nationkey = 3")
def rel_replace_children(spark, sf_dir):
    new = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("o_orderkey"))
    return relational.replace_children(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("o_orderkey")), "o_custkey", new)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_comment_ ELSE 'T' END AS title, 'structure' AS category, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END AS priority, 'd' AS suggestion, o_comment_ AS description FROM (SELECT o_orderkey, o_orderpriority AS o_comment_ FROM orders)")
def rel_stored_recommendations(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("T").alias("title"), F.col("o_orderpriority").alias("text"), F.lit("d").alias("description"),
        F.lit("structure").alias("category"), F.when(F.col("o_orderkey") % 2 == 1, 1).alias("priority"),
    )
    return relational.stored_recommendations(found).select("id", "title", "category", "priority", "suggestion", "description")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'analyzed' END AS status, CASE WHEN o_orderstatus = 'F' THEN '{"message":"' || o_orderpriority || '"}' END AS payload FROM orders""")
def rel_parse_outcome(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("error"))
    return relational.parse_outcome(df).select("o_orderkey", "status", "payload")


@query("SELECT o_custkey AS url, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'down' END AS error, coalesce(min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END), min(o_orderkey)) AS result FROM orders GROUP BY 1")
def rel_batch(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("result"), F.when(F.col("o_orderstatus") == "F", "down").alias("error"))
    return relational.batch(df)


@query("SELECT page_id AS url, md5(html) AS html FROM pages")
def rel_projected(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select(F.col("page_id").alias("url"), F.md5(F.col("html").cast("binary")).alias("html"), F.lit("t").alias("text"))
    return relational.projected(df, {"include_html": True, "include_metadata": True})


@query("SELECT count(*) AS pages, count(*) FILTER (o_orderstatus <> 'F') AS done, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus <> 'F')::DOUBLE / count(*) AS done_share FROM orders")
def rel_counters(spark, sf_dir):
    return relational.counters(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "error").otherwise("analyzed").alias("status")))


def _cache(spark, sf_dir: str) -> tuple[DataFrame, Column]:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return events, F.lit(events.agg(F.max("ts")).first()[0])


@query("SELECT k AS key, ts IS NOT NULL AS hit FROM (SELECT DISTINCT event_id % 500 AS k FROM events) LEFT JOIN (SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY) e ON e.event_id = k")
def cache_lookup(spark, sf_dir):
    cache, now = _cache(spark, sf_dir)
    keys = cache.select((F.col("key") % 500).alias("key")).distinct()
    return relational.cache_get(cache, keys, now, 10 * 86400).select("key", F.col("ts").isNotNull().alias("hit"))


@query("SELECT count(*) AS n, count(*) FILTER (fresh) AS fresh FROM (SELECT event_id, event_id % 7 = 0 AS fresh FROM events WHERE event_id % 5 <> 1 UNION ALL SELECT -1, true)")
def cache_put_and_drop(spark, sf_dir):
    cache = _cache(spark, sf_dir)[0].withColumn("fresh", F.lit(False))
    new = cache.where("key % 7 = 0").unionByName(cache.limit(1).withColumn("key", F.lit(-1).cast(cache.schema["key"].dataType))).withColumn("fresh", F.lit(True))
    left = relational.cache_drop(relational.cache_put(cache, new), cache.where("key % 5 = 1"))
    return left.agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh"))


@query("SELECT key FROM (SELECT event_id AS key, ts FROM events WHERE (SELECT count(*) FROM events) <= 50 OR ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY ORDER BY ts DESC, event_id LIMIT 40)")
def cache_evict_expired(spark, sf_dir):
    cache, now = _cache(spark, sf_dir)
    return relational.evict_expired_first(cache, now, 50, 40, 10 * 86400).select("key")


@query("SELECT page_id, '" + relational.PLACEHOLDER["html"] + "' AS html, '" + relational.PLACEHOLDER["css"] + "' AS css, '{}' AS diff FROM pages")
def rel_placeholder(spark, sf_dir):
    return relational.optimized_placeholder(table(spark, sf_dir, "pages").select("page_id"))


@query("SELECT 'https://n/' || n_name AS url, 1 AS depth FROM nation UNION ALL SELECT 'https://top', 0")
def sitemap_tree(spark, sf_dir):
    """An index that names a sitemap for each region, which names its nations; one names the index again."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.concat(F.lit("<url><loc> https://n/"), "n_name", F.lit(" </loc></url>")).alias("x"))
    leaves = nation.groupBy("r").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x")).select(F.concat(F.lit("map"), F.col("r").cast("string")).alias("loc"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("xml"))
    names = table(spark, sf_dir, "region").select(F.concat(F.lit("<sitemap><loc>map"), F.col("r_regionkey").cast("string"), F.lit("</loc></sitemap>")).alias("x"))
    index = names.agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x")).select(F.lit("index").alias("loc"), F.concat(F.lit("<sitemapindex><sitemap><loc>index</loc></sitemap>"), "x", F.lit("<url><loc>https://top</loc></url></sitemapindex>")).alias("xml"))
    return relational.sitemap_urls(readers.sitemap(leaves.unionByName(index)), "index")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), 'analytics|tracking|pixel|tag') AND lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/.*\\.([A-Za-z0-9]+)$', 1)) IN ('', 'html', 'htm', 'css', 'js', 'json')")
def page_requested(spark, sf_dir):
    return readers.requested(table(spark, sf_dir, "pages").select("page_id", "url"))


@query("SELECT event_id, event_type FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'xhr' WHEN 1 THEN 'document' WHEN 2 THEN 'script' ELSE 'fetch' END AS t FROM events) WHERE t IN ('xhr', 'fetch') OR event_id % 6 = 1")
def request_log_ajax(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("xhr", "document", "script", "fetch")]), (F.col("event_id") % 4 + 1).cast("int"))
    log = table(spark, sf_dir, "events").select("event_id", "event_type", kind.alias("resource_type"), F.when(F.col("event_id") % 12 == 1, "text/json").alias("accept"), F.when(F.col("event_id") % 12 == 7, "XMLHttpRequest").alias("requested_with"))
    return readers.ajax_requests(log).select("event_id", "event_type")


@query("""SELECT page_id, page_id % 3 = 0 AS is_dynamic FROM pages""")
def page_rendered_differs(spark, sf_dir):
    """Every third page is rendered to twice its markup."""
    body = F.concat(F.lit("<p>"), F.repeat(F.lit("word "), F.lit(40)), F.lit("</p>"))
    df = table(spark, sf_dir, "pages").select("page_id", body.alias("html"), F.when(F.col("page_id") % 3 == 0, F.concat(body, body)).otherwise(body).alias("rendered"))
    return content.rendered_differs(df).select("page_id", "is_dynamic")


@query("SELECT count(*) AS live FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def cache_ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return relational.live(events, F.lit(now).cast("timestamp")).agg(F.count(F.lit(1)).alias("live"))


@query("SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT (SELECT CASE WHEN count(*) > 1000 THEN 800 ELSE count(*) END FROM events))")
def cache_evict(spark, sf_dir):
    return relational.evict(table(spark, sf_dir, "events").select("event_id", "ts"), key="event_id").select("event_id")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'url_' || md5('doc' || doc_id) ELSE 'text_' || md5(substr(coalesce(text, ''), 1, 1000)) END AS key FROM documents")
def cache_key(spark, sf_dir):
    url = F.when(F.col("lang") == "en", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", relational.cache_key(url, F.col("text")).alias("key"))


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


ROBOTS = "User-agent: *\nDisallow: /private\nDisallow: /*.pdf\nAllow: /private/open\n\nUser-agent: webloom\nDisallow: /tmp/\n"


@query(o.ROBOTS)
def robots_eval(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.lower(F.expr("try_parse_url(url, 'HOST')"))
    files = pages.select(host.alias("host")).where("host IS NOT NULL").distinct().withColumn("content", F.lit(ROBOTS))
    return robots.allowed(pages, robots.rules(files), "otherbot/1.0")


#: Files of three hosts; the fourth has none.
HOST_FILES = {
    "h0": "User-agent: webloom # us\nDisallow: /tmp/\n\nUser-agent: *\nDisallow: /",
    "h1": "User-agent: other\nUser-agent: WebLoom\nDisallow: /p*.html\nAllow: /p1.html\n\nUser-agent: *\nDisallow:",
    "h2": "User-agent: *\nDisallow: /q\nAllow: /q/open",
}
PATHS = ("tmp/x", "p1.html", "p2.html", "q/z", "q/open", "")


@query("""
SELECT n_nationkey, 'https://h' || h || '/' || p AS url, CASE h WHEN 0 THEN p <> 'tmp/x' WHEN 1 THEN p <> 'p2.html' WHEN 2 THEN p <> 'q/z' ELSE true END AS allowed
FROM (SELECT n_nationkey, n_nationkey % 4 AS h, ['tmp/x', 'p1.html', 'p2.html', 'q/z', 'q/open', ''][n_nationkey // 4 % 6 + 1] AS p FROM nation)""")
def robots_agents(spark, sf_dir):
    """Sections of one agent, of several, wildcards, an empty rule, allow over disallow, no file."""
    files = spark.createDataFrame([(h, text) for h, text in HOST_FILES.items()], "host string, content string")
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.floor(F.col("n_nationkey") / 4) % 6 + 1).cast("int"))
    urls = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("https://h"), (F.col("n_nationkey") % 4).cast("string"), F.lit("/"), path).alias("url"))
    return robots.allowed(urls, robots.rules(files), "WebLoom/2.0")


@query(o.CRAWL)
def crawl_reach(spark, sf_dir):
    """Pages of the first page's host that links reach from it in three steps."""
    pages, e = parsed(spark, sf_dir)
    start = pages.orderBy("page_id").select("url").first()
    edges = structure.links(pages, e).where("internal").select(F.col("base").alias("src"), F.col("url").alias("dst")).distinct()
    return crawling.crawl(edges, start[0] if start else "", 3)


@query(o.CRAWL_PARTS)
def crawl_parts(spark, sf_dir):
    """Parts and suppliers as addresses that link to each other where a line item joins them: all that four steps from the first part reach."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("https://part.example/"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("https://supplier.example/"), F.col("l_suppkey").cast("string")).alias("b"))
    edges = rows.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(rows.select("b", "a")).distinct()
    return crawling.crawl(edges, "https://part.example/1", 4, exclude="/[0-9]*13$", max_pages=10**9)


def flagship(spark, sf_dir: str) -> DataFrame:
    return page_report(spark, sf_dir)
