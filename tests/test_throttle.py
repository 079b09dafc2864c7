from datetime import datetime, timedelta

import pytest

from webloom.streaming import throttle

START = datetime(2024, 5, 1, 12)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.mark.parametrize(("status", "attempt", "after", "want"), [
    (200, 0, None, ("done", 0)), (302, 2, None, ("done", 0)), (403, 0, None, ("failed", 0)), (404, 0, 9, ("failed", 0)), (418, 1, None, ("failed", 0)),
    (429, 0, None, ("fetch", 30)), (429, 1, 7, ("fetch", 7)), (429, 3, 7, ("gave_up", 0)), (500, 0, None, ("fetch", 1)), (503, 2, 60, ("fetch", 4)), (None, 1, None, ("fetch", 2)), (None, 3, None, ("gave_up", 0)),
])
def test_rules(status, attempt, after, want):
    assert throttle.next_try(status, attempt, after) == want


def test_stream_of_outcomes(spark, tmp_path):
    """Spacing, waits, tries and late rows over several batches."""
    wish = lambda host, url, s: (host, url, at(s), None, None, None)
    came = lambda host, url, s, attempt, status, after=None: (host, url, at(s), attempt, status, after)
    batches = [
        [wish("a", "a/1", 0), wish("a", "a/2", 0), wish("a", "a/3", 0), wish("b", "b/1", 0)],
        [came("a", "a/1", 2, 0, 500), came("a", "a/2", 2, 0, 429, 5), came("a", "a/3", 2, 0, 404), came("b", "b/1", 2, 0, None)],
        [came("a", "a/1", 4, 1, 500), came("b", "b/1", 5, 1, 200), wish("c", "c/1", 60)],
        [came("a", "a/1", 61, 2, None), wish("a", "a/late", 1)],
        [came("a", "a/1", 70, 3, 503), wish("c", "c/2", 300)],
        [wish("c", "c/3", 600)],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, throttle.ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    out = f"{tmp_path}/out"

    def run():
        rows = spark.readStream.schema(throttle.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = throttle.throttled(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    run()
    run()  # a restart adds nothing
    got = sorted((r["host"], r["url"], r["attempt"], r["action"], (r["due"] - START).total_seconds()) for r in spark.read.parquet(out).collect())
    assert got == sorted([
        ("a", "a/1", 0, "fetch", 0.0), ("a", "a/2", 0, "fetch", 0.2), ("a", "a/3", 0, "fetch", 0.4), ("b", "b/1", 0, "fetch", 0.0),
        ("a", "a/1", 1, "fetch", 3.0), ("a", "a/2", 1, "fetch", 7.0), ("a", "a/3", 0, "failed", 2.0), ("b", "b/1", 1, "fetch", 3.0),
        ("a", "a/1", 2, "fetch", 7.2), ("b", "b/1", 1, "done", 5.0), ("c", "c/1", 0, "fetch", 60.0),
        ("a", "a/1", 3, "fetch", 65.0), ("a", "a/1", 3, "gave_up", 70.0), ("c", "c/2", 0, "fetch", 300.0),
    ])
