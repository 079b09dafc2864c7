"""Cases that a review found: each failed before its fix."""

import pyarrow as pa
from pyspark.sql import functions as F

from webloom.llm import common, components, jaccard, substrings
from webloom.operators import counting, languages, measures, relational, vectors
from webloom.operators import text_analysis as ta
from webloom.plans import catalog, rich
from webloom.sources.dom import parse


def test_lifetime_to_the_microsecond(spark):
    """An entry half a second too old is no longer live, one at the very end of its time still is."""
    rows = [(1, "2024-01-01 11:00:00.200000"), (2, "2024-01-01 11:00:00.199999"), (3, "2024-01-01 11:00:00.900000"), (4, "2024-01-01 10:59:59.900000")]
    cache = spark.createDataFrame(rows, "key long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit("2024-01-01 12:00:00.200000").cast("timestamp")
    assert sorted(r["key"] for r in relational.live(cache, now).collect()) == [1, 3]


def test_references_need_their_semicolon():
    rows = parse('<title>a&&amp</title><a href="/x?a=1&copy=2&amp;b&lt" title="&#38;&#38">R&D &lt;&lt &amp;amp;</a><script>a &amp; b && c &lt</script>')
    by = {r["tag"]: r for r in rows}
    assert by["title"]["text"] == "a&&amp" and by["a"]["text"] == "R&D <&lt &amp;"
    assert by["a"]["attrs"] == {"href": "/x?a=1&copy=2&b&lt", "title": "&&#38"} and by["script"]["text"] == "a &amp; b && c &lt"


def test_broadcasts_are_bounded_by_bytes(spark):
    """Wide rows are sent to the driver up to a fixed size only, whatever the limit of rows."""
    wide = spark.range(10).select("id", *[F.col("id").alias(f"c{k}") for k in range(5)])
    hinted = lambda rows, df: "broadcast" in df.join(common.broadcast_if_small(wide, rows, 2_000_000), "id")._jdf.queryExecution().logical().toString().lower()
    assert hinted(200_000, spark.range(5)) and not hinted(400_000, spark.range(5))


def test_counts_within_rows(spark):
    """Runs are counted without exploding the words; rows that repeat an id, nulls among them, are one document, and no run of words spans two rows."""
    rows = [(1, ["a", "b", "a", "b"]), (2, ["a"]), (1, ["b", "a", "b"]), (None, ["x", "y"]), (None, ["x", "y"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>")
    found = counting.counted(df, "doc_id", F.col("words"), (1, 2), 2)
    assert {(r[0], r[1]): r[2] for r in found.collect()} == {(1, "a"): 3, (1, "b"): 4, (1, "a b"): 3, (1, "b a"): 2, (None, "x"): 2, (None, "y"): 2, (None, "x y"): 2}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    best = counting.counted(df.where("doc_id = 1"), "doc_id", F.col("words"), (1, 2, 3), top=3)
    assert [(r[1], r[2]) for r in best.orderBy(F.desc("frequency"), "term").collect()] == [("b", 4), ("a", 3), ("a b", 3)]


def test_texts_are_taken_apart_once(spark):
    """The weights of terms read a table of counts; the texts are not in their plan any more."""
    df = ta.prepare(spark.createDataFrame([(1, "one two two", "en"), (2, "two", "en"), (3, None, "en")], "doc_id long, text string, lang string"))
    weights, texts = vectors.weighed(df)
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert texts == 3 and "regexp" not in plan and "Generate" not in plan
    assert sorted((r["doc_id"], r["term"], r["tf"], r["df"]) for r in weights.collect()) == [(1, "one", 1, 1), (1, "two", 2, 2), (2, "two", 1, 2)]


def test_made_pages_are_parsed_once(spark):
    """A query's parts read the kept elements; the ids of made pages are dealt to as many tasks as an exchange has."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan(rich.QUERIES["rich_structured_content"](spark, "/root/testdata/sf0.001"))
    assert "Repartition" in plan(rich.rich_source(spark, "/root/testdata/sf0.001"))


def test_languages_without_a_row_for_each_trigram(spark):
    """Texts are not taken apart into rows; a repeated id is judged by all its texts; odd characters count by code points."""
    rows = [(n, t, k) for n, (k, t) in enumerate([("en", "the thing that they think"), ("de", "der die das und nicht")] * 8)]
    df = spark.createDataFrame([*rows, (90, "the", None), (90, "der die das und nicht mit der", None), (91, "𝐀𝐁𝐂𝐃 the thing that", None), (92, "x", None)], "doc_id int, text string, lang string")
    found = languages.detected(df)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["doc_id"], r["detected_lang"]) for r in found.where("doc_id >= 90").orderBy("doc_id", "text").collect()]
    assert got == [(90, "de"), (90, "en"), (91, "en"), (92, "en")]  # the first text of 90 is too short to be told


def test_given_keywords_take_texts_apart_once(spark):
    """No filter below the explode repeats the words of a text for each keyword and section."""
    plan = catalog.doc_given_keywords(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("Filter") <= 1


def test_texts_are_counted_by_batches(spark):
    """No step of the analysis goes through a text's words by itself, and odd words count as before: letters beside digits, capitals that lower to two characters, one text over several pieces."""
    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for name in ("doc_analysis", "doc_analysis_summary", "doc_recommendations_all"):
        assert "zip_with" not in plan(name) and "array_distinct" not in plan(name) and plan(name).count("ArrowEvalPython") == 1
    rows = [(1, "İi ab1cd good. Not good xx yy zz! a b c a b c a b c"), (2, ""), (3, None), (4, "  7 ½ Ⅷ, Dd_ Σ ΟΔΟΣ οδος  ")]
    df = ta.user_experience(ta.sentiment(ta.statistics(ta.prepare(spark.createDataFrame(rows, "doc_id long, text string")))))
    got = {r["doc_id"]: (r["word_count"], r["character_count"], r["number_count"], r["sentence_count"], round(r["lexical_diversity"], 4), round(r["compound"], 4), r["neutral_share"], r["repeated_trigrams"]) for r in df.collect()}
    assert got == {1: (16, 28, 0, 3, 0.5625, 0.0, 0.5, 1), 2: (0, 0, 0, 0, 0.0, 0.0, 1.0, 0), 3: (0, 0, 0, 0, 0.0, 0.0, 1.0, 0), 4: (3, 9, 1, 1, 0.6667, 0.0, 1.0, 0)}
    old = measures.MOST
    measures.MOST = 8
    try:
        small = measures.counted(pa.array([r[1] or "" for r in rows]))
    finally:
        measures.MOST = old
    assert small.equals(measures.counted(pa.array([r[1] or "" for r in rows])))


def test_texts_without_requests_are_not_exchanged(spark):
    """A bitmap keeps every row that is asked for and drops most others before the exchange; a join that is too large to be sent goes by it."""
    df, ids = spark.range(-20_000, 20_000).withColumnRenamed("id", "doc"), spark.range(-20_000, 20_000, 10).withColumnRenamed("id", "_ss_id")
    left = {r[0] for r in common.perhaps_among(df, "doc", ids, "_ss_id", 4_000).collect()}
    assert left >= set(range(-20_000, 20_000, 10)) and len(left) < 8_000
    assert common.perhaps_among(df, "doc", ids.limit(0), "_ss_id", 0).count() == 0
    joined = substrings._with(df, ids, substrings.MOST_BROADCAST + 1)
    assert "bitmap" in joined._jdf.queryExecution().optimizedPlan().toString() and joined.count() == 4_000
    assert "bitmap" not in substrings._with(df, ids, 10)._jdf.queryExecution().optimizedPlan().toString()


def test_kept_elements_are_not_sent_through_the_driver(spark):
    """Few MB of files hold millions of elements, so that no estimate by files may make a join of them a broadcast."""
    for name in ("rich_header", "rich_footer", "rich_lists", "rich_structure"):
        done = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert "strategy=merge" in done.optimizedPlan().toString(), name
        assert "Broadcast" not in done.executedPlan().toString() or name in ("rich_lists", "rich_structure"), name  # those join joins, which are estimated as products


def test_tables_beyond_the_limit_are_not_sent_by_estimate(spark, monkeypatch):
    """Ids that compress well are no broadcast beyond the counted limit, in a join by hand or among components; the results stay."""
    ids = common.written(spark.range(1_000_000).select("id", (F.col("id") % 2).alias("b")), "ids")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    big = spark.range(3_000_000).withColumn("x", F.col("id"))
    assert "BroadcastHashJoin" in plan(big.join(ids, "id")) and "BroadcastHashJoin" not in plan(big.join(common.broadcast_if_small(ids, 1_000_000), "id"))
    assert "BroadcastHashJoin" in plan(big.join(common.broadcast_if_small(ids.limit(10), 10), "id"))
    links = spark.createDataFrame([(n + 1, n) for n in range(50)] + [(200, 100)], "a long, b long")
    want = sorted(map(tuple, components.components(links).collect()))
    monkeypatch.setattr(components, "MOST_SENT", 0)
    assert want == sorted(map(tuple, components.components(links).collect())) and len(want) == 53
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g h"), (4, None), (5, "x y z")], "doc_id long, text string")
    few = sorted(map(tuple, jaccard.jaccard_components(docs, 2, 80).collect()))
    monkeypatch.setattr(jaccard, "MOST_SENT", 0)
    assert few == sorted(map(tuple, jaccard.jaccard_components(docs, 2, 80).collect()))
