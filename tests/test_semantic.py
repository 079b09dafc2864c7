import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webloom.operators import semantic
from webloom.operators import text_analysis as ta
from webloom.sources import sinks

WORDS = [a + b for a in ("kalt", "brim", "dorn", "fels", "gart", "holm") for b in ("an", "er", "il", "os", "um")]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS, k=160)) + ". Alpha met Beta.", "en") for i in range(8)]
    rows += [(10, None, None), (11, "", "en"), (12, "too short", "de"), (13, "green " * 100 + " ".join(rng.choices(WORDS, k=150)), "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_a_row_for_each_text(rows):
    got = {r["doc_id"]: r for r in semantic.analyze(ta.prepare(rows)).collect()}
    assert set(got) == {*range(8), 10, 11, 12, 13}
    for i in (10, 11, 12):
        r = got[i]
        assert r["keywords"] == [] and r["topics"] is None and [x["code"] for x in r["semantic_recommendations"]] == ["no_entities"] and r["overall_density"] == 0
    assert got[10]["section_densities"] == [] and got[12]["section_densities"] == [0.0]
    assert {x["term"] for x in got[0]["entities"]} == {"alpha", "beta"} and len(got[0]["keywords"]) == 30
    # The one word fills the first section of three and is nowhere else.
    r = got[13]
    assert r["keywords"][0]["term"] == "green" and len(r["section_densities"]) == 3 and r["section_densities"][0] == 100.0
    assert {"keywords_stuffed", "keywords_uneven", "no_entities"} <= {x["code"] for x in r["semantic_recommendations"]}
    assert [x["priority"] for x in r["semantic_recommendations"]] == sorted(x["priority"] for x in r["semantic_recommendations"])


def test_records_are_kept_by_id(spark, rows, tmp_path):
    kept = sinks.Versions(spark, f"{tmp_path}/records")
    stamp = lambda s: F.lit(s).cast("timestamp")
    assert kept.upsert(semantic.records(rows, stamp("2024-01-01 00:00:00")), "doc_id") == 0
    assert kept.upsert(semantic.records(rows.where("doc_id < 2"), stamp("2024-02-01 00:00:00")), "doc_id") == 1
    got = kept.read()
    assert got.columns == ["doc_id", "status", "analyzed_at", "seo_metrics", "keywords", "readability_metrics", "sentiment", "topics", "content_quality"]
    assert {r["doc_id"]: r["analyzed_at"] for r in got.collect()} == {i: datetime(2024, 2 if i < 2 else 1, 1) for i in (*range(8), 10, 11, 12, 13)}
