"""Streams: pages as they land, and windowed counts of events with late data.

The page operators that are projections work on a stream as they are; `parsed_stream` adds the parser, which keeps no
state. Aggregations by page use a batch at a time (`analyze_each`), which a sink that overwrites its batch by id makes
exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import seo, structure
from ..operators.metadata import metadata
from ..sources.dom import elements


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def parsed_stream(pages: DataFrame) -> DataFrame:
    return elements(pages)


def analyze_each(sink: str):
    """A foreachBatch function: metadata, headings and scores of a batch's pages, written to sink/batch=<id>."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            e = elements(batch)
            df = metadata(batch, e).join(structure.headings(e), "page_id", "left")
            df = seo.url_score(seo.heading_score(seo.meta_score(df))).select("page_id", "url", "title", "language", "meta_score", "heading_score", "url_score")
            df.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        finally:
            batch.unpersist()

    return run


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day", at: str = "ts") -> DataFrame:
    """Events by window and type; rows later than `late` are left out, and state older than that goes."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
