"""Crawls as rounds of joins: a frontier meets the links, and what was visited before falls out.

Visited addresses are files in buckets of their hash, a folder a round, so that a round's plan is the same however many went before. A Bloom filter of all visited addresses,
sized by their number, lets most new ones pass without the anti join; its bits, MOST_BITS (4 MB) at most, go to the tasks with the plan."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import part
from ..sources.sinks import checkpointed, shared_folder

BUCKETS, HASHES, BITS_EACH, LEAST_BITS, MOST_BITS = 64, 5, 12, 1 << 12, 1 << 25


def _places(url: Column, bits: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: F.pmod(F.xxhash64(k, url), F.lit(bits)))


def bloom(urls: DataFrame, bits: int) -> bytes:
    """The filter's bits from a column url: numbers of 64 bits, joined within tasks before they are exchanged, of which the driver puts together bits / 64 at most."""
    at = urls.select(F.explode(_places(F.col("url"), bits)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("at"), F.lit(64)).cast("int"))
    found = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("k")).agg(F.bit_or(bit).alias("w")).toArrow()
    words = np.zeros(bits // 64, dtype="<i8")
    words[found.column("k").to_numpy()] = found.column("w").to_numpy()
    return words.tobytes()


def maybe_held(url: Column, held: bytes, bits: int) -> Column:
    """Whether all of the address's bits are set: never false for a held one."""
    byte = lambda p: F.conv(F.hex(F.substring(F.lit(held), F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.forall(_places(url, bits), lambda p: F.call_function("shiftright", byte(p), F.pmod(p, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)


def filter_bits(n: int) -> int:
    bits = LEAST_BITS
    while bits < BITS_EACH * n and bits < MOST_BITS:
        bits *= 2
    return bits


def new_addresses(found: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """Addresses (url) of found that none of the n rows of seen (bucket, url) has."""
    bits = filter_bits(n)
    tested = found.withColumn("maybe", maybe_held(F.col("url"), bloom(seen, bits), bits))
    bucket = F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int")
    doubtful = tested.where("maybe").select("url", bucket.alias("bucket")).join(seen.select("bucket", "url"), ["bucket", "url"], "left_anti").select("url")
    return tested.where("NOT maybe").select("url").unionByName(doubtful)


def crawl(edges: DataFrame, start: str, max_depth: int = 3, include: str | None = None, exclude: str | None = None, max_pages: int = 100) -> DataFrame:
    """(url, depth) reached from start over edges (src, dst) by breadth, at most max_pages (a limit of the caller's, in the order of the urls
    within a round). Addresses that `exclude` matches, or `include` doesn't, are not visited. A round's new addresses are dealt by host, and written by buckets of their hash."""
    spark = edges.sparkSession
    if include:
        edges = edges.where(F.col("dst").rlike(include))
    if exclude:
        edges = edges.where(~F.col("dst").rlike(exclude))
    path, schema = f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}", "url string, depth int, bucket int"

    def visited(depth: int | None = None) -> DataFrame:
        rows = spark.read.schema(schema + ", round int").option("basePath", path).parquet(path if depth is None else f"{path}/round={depth}")
        return rows.select("url", "depth", "bucket")

    def visit(rows: DataFrame, depth: int) -> None:
        bucket = F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int")
        by_host = rows.select("url", F.lit(depth).alias("depth"), bucket.alias("bucket")).repartition(F.coalesce(part(F.col("url"), "HOST"), F.lit("")))
        by_host.write.partitionBy("bucket").parquet(f"{path}/round={depth}")

    visit(spark.createDataFrame([(start,)], "url string"), 0)
    n = 1
    for depth in range(1, max_depth + 1):
        met = visited(depth - 1).join(edges, F.col("url") == F.col("src"), "inner").select(F.col("dst").alias("url")).where("url IS NOT NULL").distinct()
        found = checkpointed(new_addresses(met, visited(), n))
        more = found.count()
        if not more:
            break
        if n + more > max_pages:
            more = max_pages - n
            found = found.orderBy("url").limit(more)
        visit(found, depth)
        n += more
    return visited().select("url", "depth")
