"""Sources: tables of a folder, inline pages, sitemaps, robots files, request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def inline_page(spark: SparkSession, html: str, url: str = "http://example.com") -> DataFrame:
    """One page from memory, as a row like those of pages."""
    return spark.createDataFrame([(0, url, html)], "page_id bigint, url string, html string")


SITEMAP = "url array<struct<loc string>>, sitemap array<struct<loc string>>"


def sitemap(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(is_index, urls, child_sitemaps) of sitemap documents, read as XML: namespaces, CDATA and entities count. Text that is no well-formed XML has neither."""
    read = F.from_xml(F.col(xml_col), SITEMAP, {"ignoreNamespace": "true"})
    locs = lambda kind: F.coalesce(F.filter(F.transform(read[kind], lambda u: F.trim(u["loc"])), lambda u: u != ""), F.array().cast("array<string>"))
    return df.withColumns({"child_sitemaps": locs("sitemap"), "urls": locs("url")}).withColumn("is_index", F.size("child_sitemaps") > 0)


def landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(host, path, content) of files that fetchers left under folder/host=<host>/.., by a glob of their names: robots.txt, sitemap*.xml, *.html.

    The folder's parts are partitions, so that a filter on host prunes folders before any file is opened; contents are read by Spark's
    own reader, from any store that it reads, a row a file. Empty files have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "false").option("basePath", folder).schema("path string, modificationTime timestamp, length bigint, content binary, host string").load(folder)
    return files.select("host", "path", F.decode("content", "UTF-8").alias("content"))


def landed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) of landed *.html files: the address by host and path below it, the id by a hash of the address."""
    files = landed(spark, folder, "*.html")
    below = F.regexp_replace(F.regexp_extract("path", r"/host=[^/]*(/.*)$", 1), r"(^|/)index\.html$", "$1")
    url = F.concat(F.lit("https://"), "host", below)
    return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("content").alias("html"))


def requested(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose url may be fetched: no tracking host; a page, style, script or data file, or no extension."""
    host = F.coalesce(F.expr(f"try_parse_url(`{url_col}`, 'HOST')"), F.lit(""))
    path = F.coalesce(F.expr(f"try_parse_url(`{url_col}`, 'PATH')"), F.lit(""))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return df.where(~host.rlike("analytics|tracking|pixel|tag") & F.lower(extension).isin("", "html", "htm", "css", "js", "json"))


def ajax_requests(df: DataFrame) -> DataFrame:
    """Rows of a request log (resource_type, accept, requested_with) that scripts made."""
    return df.where(F.col("resource_type").isin("xhr", "fetch") | F.coalesce(F.col("accept").contains("json"), F.lit(False)) | F.coalesce(F.col("requested_with") == "XMLHttpRequest", F.lit(False)))
