from pyspark.sql import functions as F

from webloom.operators import crawling


def addresses(spark, a, b):
    return spark.range(a, b).select(F.concat(F.lit("https://h/"), F.col("id").cast("string")).alias("url"))


def test_a_filter_knows_what_it_holds(spark):
    held, bits = addresses(spark, 0, 2000), crawling.filter_bits(2000)
    tested = addresses(spark, 0, 12000).withColumn("maybe", crawling.maybe_held(F.col("url"), crawling.bloom(held, bits), bits))
    n = tested.select(F.regexp_extract("url", r"([0-9]+)$", 1).cast("int").alias("k"), "maybe").groupBy(F.col("k") < 2000).agg(F.count_if("maybe")).collect()
    counts = {r[0]: r[1] for r in n}
    assert counts[True] == 2000 and counts[False] < 200  # about 0.3 % by theory
    assert len(crawling.bloom(held, bits)) == bits // 8 and crawling.bloom(addresses(spark, 0, 0), 4096) == bytes(512)


def test_new_addresses_are_those_not_seen(spark):
    bucket = F.pmod(F.xxhash64("url"), F.lit(crawling.BUCKETS)).cast("int").alias("bucket")
    for n in (0, 1, 700):
        seen = addresses(spark, 0, n).select("url", bucket)
        got = {r["url"] for r in crawling.new_addresses(addresses(spark, 500, 1500), seen, n).collect()}
        assert got == {f"https://h/{k}" for k in range(max(500, n), 1500)}


def test_crawls_by_breadth_with_limits(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("a", None)], "src string, dst string")
    reached = lambda *a, **k: {r["url"]: r["depth"] for r in crawling.crawl(edges, "a", *a, **k).collect()}
    assert reached(3) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert reached(9) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4}
    assert reached(9, max_pages=3) == {"a": 0, "b": 1, "c": 1} and reached(0) == {"a": 0}
    assert reached(9, exclude="^c|e$") == {"a": 0, "b": 1, "d": 2} and reached(9, include="[bd]") == {"a": 0, "b": 1, "d": 2}
