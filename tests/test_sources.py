import os

import pytest

from webloom.operators import metadata, robots
from webloom.sources import readers, sinks
from webloom.sources.dom import elements

SCRIPT = '<script type="application/ld+json">%s</script>'


def test_sitemaps_are_read_as_xml(spark):
    texts = [
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a/1?x=1&amp;y=2 </loc><lastmod>2020</lastmod></url><url><loc><![CDATA[http://a/2]]></loc></url><url/></urlset>',
        '<?xml version="1.0"?><s:sitemapindex xmlns:s="q"><!-- <sitemap><loc>no</loc></sitemap> --><s:sitemap><s:loc>http://a/s</s:loc></s:sitemap></s:sitemapindex>',
        "not xml", None, "<urlset><url><loc>u</loc>", "",
    ]
    got = [(r["urls"], r["child_sitemaps"], r["is_index"]) for r in readers.sitemap(spark.createDataFrame(list(enumerate(texts)), "n int, xml string")).orderBy("n").collect()]
    assert got[:2] == [(["http://a/1?x=1&y=2", "http://a/2"], [], False), ([], ["http://a/s"], True)] and all(g == ([], [], False) for g in got[2:])


def test_landed_files(spark, tmp_path):
    def land(name, text):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)

    land("host=a.example/robots.txt", "User-agent: *\nDisallow: /private")
    land("host=b.example/robots.txt", "")
    land("host=a.example/sitemap.xml", "<urlset><url><loc>https://a.example/x</loc></url></urlset>")
    land("host=a.example/index.html", "<title>Änne</title>")
    land("host=b.example/deep/page.html", "<title>B</title>")
    files = readers.landed(spark, str(tmp_path), "robots.txt")
    assert {(r["host"], r["content"]) for r in files.collect()} == {("a.example", "User-agent: *\nDisallow: /private")}
    plan = files.where("host = 'a.example'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(host" in plan and files.where("host = 'a.example'").count() == 1
    urls = spark.createDataFrame([("https://a.example/private/1",), ("https://a.example/open",), ("https://b.example/private",)], "url string")
    assert {r["url"]: r["allowed"] for r in robots.allowed(urls, robots.rules(files), "bot").collect()} == {"https://a.example/private/1": False, "https://a.example/open": True, "https://b.example/private": True}
    assert [r["urls"] for r in readers.sitemap(readers.landed(spark, str(tmp_path), "sitemap*.xml"), "content").collect()] == [["https://a.example/x"]]
    pages = readers.landed_pages(spark, str(tmp_path))
    assert {r["url"] for r in pages.collect()} == {"https://a.example/", "https://b.example/deep/page.html"}
    titles = metadata.metadata(pages, elements(pages)).select("url", "title").collect()
    assert {tuple(r) for r in titles} == {("https://a.example/", "Änne"), ("https://b.example/deep/page.html", "B")}


def test_json_ld_as_values(spark):
    texts = ['{"@type":"Product","name":"N","offers":{"price":9.5}}', '[{"@type":["A","B"]},3,{"name":7}]', "{bad", '{"@context":"x","@graph":[{"@type":"P","name":"g1"},{"@type":"Q"}]}', '"text"', "null", ""]
    pages = spark.createDataFrame([(1, "".join(SCRIPT % t for t in texts)), (2, None), (3, '<script>{"@type":"X"}</script>')], "page_id bigint, html string")
    rows = metadata.structured_data(elements(pages))
    got = [(r["page_id"], r["pre"], r["n"], r["types"], r["name"]) for r in rows.orderBy("pre", "n").drop("value").collect()]
    assert got == [(1, 0, 0, ["Product"], "N"), (1, 1, 0, ["A", "B"], None), (1, 1, 2, [], "7"), (1, 3, 0, ["P"], "g1"), (1, 3, 1, ["Q"], None)]
    prices = metadata.said_by(rows, "$.offers.price", "double").where("said IS NOT NULL").select("said").collect()
    assert [r["said"] for r in prices] == [9.5]


@pytest.fixture
def table(spark, tmp_path):
    return sinks.Versions(spark, f"{tmp_path}/table")


def rows(spark, *values):
    return spark.createDataFrame(values, "id bigint, said string")


def seen(table, **at):
    return {tuple(r) for r in table.read(**at).collect()}


def test_versions_and_conflicts(spark, table, tmp_path):
    assert table.latest() == -1 and table.commit(0, rows=rows(spark, (1, "a"))) == 0
    assert table.upsert(rows(spark, (1, "b"), (2, "c")), "id") == 1
    assert seen(table) == {(1, "b"), (2, "c")} and seen(table, version=0) == {(1, "a")}
    # Two writers of one version: the second fails, what it wrote goes, the first one's stays.
    other = sinks.Versions(spark, f"{tmp_path}/table")
    assert other.commit(2, rows=rows(spark, (9, "first"))) == 2
    with pytest.raises(sinks.Conflict):
        table.commit(2, rows=rows(spark, (9, "second")))
    assert seen(table) == {(9, "first")} and len([d for d in os.listdir(f"{tmp_path}/table") if d.startswith("data-")]) == 3


def test_a_failed_commit_leaves_no_version(spark, table):
    table.commit(0, status=rows(spark, (1, "parsed")), payload=rows(spark, (1, "text")))
    from pyspark.sql import functions as F

    bad = rows(spark, (1, "x")).withColumn("said", F.raise_error(F.lit("worker lost")))
    with pytest.raises(Exception, match="worker lost"):
        table.commit(1, status=rows(spark, (1, "analyzed")), payload=bad)
    assert table.latest() == 0 and seen(table, part="status") == {(1, "parsed")} and seen(table, part="payload") == {(1, "text")}


def test_replayed_batches_change_nothing(spark, table):
    put = sinks.each_batch(table, "id")
    put(rows(spark, (1, "a"), (1, "a")), 0)
    put(rows(spark, (1, "b"), (2, "b")), 1)
    put(rows(spark, (1, "a")), 0)
    put(rows(spark, (1, "x")), 1)
    assert table.latest() == 1 and seen(table) == {(1, "b"), (2, "b")}


def test_a_stream_into_versions(spark, table, tmp_path):
    rows(spark, (1, "a"), (2, "a")).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("id bigint, said string").parquet(f"{tmp_path}/in/*")
    run = lambda: stream.writeStream.foreachBatch(sinks.each_batch(table, "id")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert run()
    rows(spark, (2, "b"), (3, "b")).write.parquet(f"{tmp_path}/in/1")
    assert run() and run()
    assert seen(table) == {(1, "a"), (2, "b"), (3, "b")} and table.latest() == 1
