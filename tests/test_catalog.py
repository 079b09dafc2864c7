"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables; table and stream operators."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.operators import crawling, relational, terms
from webloom.operators import text_analysis as ta
from webloom.plans import catalog
from webloom.streaming import pages as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    c = sorted(got.columns)
    got, want = (d[c].sort_values(c).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for k in c:
        assert ((got[k] == want[k]) | (got[k].isna() & want[k].isna())).all(), k


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    """What these give on pages that hold something is checked by the rich_ queries and in test_pages."""
    df = catalog.QUERIES[name](spark, SF)
    rows = df.toPandas()
    assert list(rows.columns) == df.columns and rows.drop_duplicates(subset=[c for c in rows if rows[c].map(lambda x: not isinstance(x, (list, dict)) and not hasattr(x, "tolist")).all()]).shape[0] > 0 or name in BARE


#: What the pages of the table hold none of.
BARE = {"page_tables", "page_forms", "page_calls_to_action", "page_breadcrumbs", "page_headers", "page_sidebars", "page_search_boxes", "page_structured_content", "page_microdata", "page_external_domains"}


def test_empty_and_null_texts(spark):
    df = ta.prepare(spark.createDataFrame([(1, None, "en"), (2, "", None), (None, "One two. Three!", "ru")], "doc_id long, text string, lang string"))
    rows = ta.user_experience(ta.calls_to_action(ta.emotions(ta.sentiment(ta.quality(ta.readability(ta.statistics(df))))))).collect()
    assert [r["word_count"] for r in rows] == [0, 0, 3] and [r["overall_readability"] for r in rows][:2] == [50.0, 50.0]
    assert all(r["neutral_share"] == 1.0 and r["cta_effectiveness"] == 0.0 for r in rows)
    assert terms.top_terms(df.where("doc_id = 1")).isEmpty() and ta.coherence(df).where("coherence IS NULL").isEmpty()
    none = df.limit(0)
    assert terms.tfidf(none).isEmpty() and terms.bigrams(none).isEmpty() and ta.statistics(none).isEmpty()


def test_calls_to_action(spark):
    df = ta.calls_to_action(spark.createDataFrame([("Buy now, buy  now! Learn more.",)], "text string"))
    r = df.first()
    assert r["cta_count"] == 3 and r["cta_triggers"] == ["urgency"] and abs(r["cta_effectiveness"] - 100 * (0.6 / 6 + 0.4 * 2 / 6)) < 1e-9


def test_patches_and_cascades(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, x string, y int")
    patch = spark.createDataFrame([(2, None)], "k long, x string")
    assert sorted(map(tuple, relational.update(base, patch, "k").collect())) == [(1, "a", 10), (2, None, 20)]
    child = spark.createDataFrame([(1, 7), (2, 8)], "k long, c long")
    grand = spark.createDataFrame([(7, 1), (8, 2)], "c long, g long")
    left = relational.remove_cascade(base, "k", base.where("k = 1"), (child, "k", "c"), (grand, "c", "g"))
    assert [df.count() for df in left] == [1, 1, 1] and left[2].first()["g"] == 2
    mine = relational.owned(child.withColumnRenamed("k", "project_id"), spark.createDataFrame([(1, "u")], "project_id long, user_id string"), "u")
    assert mine.count() == 1
    s = spark.createDataFrame([("pending", "parsing"), ("pending", "optimized"), (None, "parsing")], "a string, b string")
    assert [r[0] for r in s.select(relational.step(F.col("a"), F.col("b"))).collect()] == ["parsing", "pending", None]


def test_crawl_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = {r["url"]: r["depth"] for r in crawling.crawl(edges, "a", 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    capped = {r["url"]: r["depth"] for r in crawling.crawl(edges.union(spark.createDataFrame([("a", "x"), ("a", "y")], edges.schema)), "a", 9, max_pages=3).collect()}
    assert capped == {"a": 0, "b": 1, "x": 1}
    deep = crawling.crawl(edges, "a", 4)
    assert deep._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_streams(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.write.parquet(str(tmp_path / "in"))
    df = stream.table_stream(spark, str(tmp_path / "in"), pages.schema)
    q = df.writeStream.foreachBatch(stream.analyze_each(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == pages.count()
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    live = stream.windowed_counts(stream.table_stream(spark, str(tmp_path / "ev"), events.schema))
    q = live.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


def test_fetch_outcomes(spark):
    df = spark.createDataFrame([(200, 0), (404, 0), (429, 1), (503, 2), (503, 3), (302, 0)], "s int, t int")
    assert [r[0] for r in df.select(relational.fetch_outcome(F.col("s"), F.col("t"))).collect()] == ["ok", "missing", "wait", "retry", "failed", "failed"]


def test_lemmas_and_similarity(spark):
    df = spark.createDataFrame([(["Cities", "classes", "dogs", "bus", "was", "glass", "is"], ["dogs", "x"])], "words array<string>, other array<string>")
    assert terms.lemmas(df).first()["lemmas"] == ["city", "class", "dog", "bus", "was", "glass", "is"]
    assert abs(df.select(terms.similarity(F.col("words"), F.col("other"))).first()[0] - 1 / 8) < 1e-9


def test_upsert_versions(spark, tmp_path):
    from webloom.sources import sinks

    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    sinks.write_version(spark, str(tmp_path), 0, a, "k")
    got = spark.read.parquet(sinks.write_version(spark, str(tmp_path), 1, spark.createDataFrame([(2, "c"), (3, "d")], "k long, x string"), "k"))
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    back = a.select(sinks.unpacked(sinks.packed(F.struct("k", "x")), "k long, x string").alias("s")).select("s.*")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    from webloom.sources import sinks

    a = spark.createDataFrame([(1, "a")], "k long, x string")
    at = sinks.write_version(spark, str(tmp_path), 0, a, "k")
    bad = a.select("k", F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        sinks.write_version(spark, str(tmp_path), 1, bad, "k")
    assert spark.read.parquet(at).collect() == a.collect() and not os.path.exists(tmp_path / "v=1" / "_SUCCESS")


def test_contexts_of_calls_to_action(spark):
    text = "x" * 80 + " Buy now! " + "y" * 10 + " Learn more. " + "z" * 70 + " buy  now"
    r = ta.action_contexts(ta.calls_to_action(spark.createDataFrame([(text,), (None,)], "text string"))).collect()
    assert [c.strip() for c in r[0]["cta_contexts"]] == [text[31:138].strip(), text[text.index("buy  now") - 50 :], text[text.index("Learn more") - 50 : text.index("Learn more") + 60]] and r[1]["cta_contexts"] == []
