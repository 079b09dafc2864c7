"""The pipeline's stages on the smallest table, each against brute force on its own input."""

import collections

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import classifier, substrings

from .test_joins import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, SF)
        done.write.parquet(str(at / str(k)))
        docs = spark.read.parquet(str(at / str(k)))
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(list(x.columns) == list(stages[0].columns) for x in stages[:5])


def test_quality(spark, stages):
    w = classifier.quality_weights(spark, SF)
    scored = classifier.score(spark.read.parquet(f"{SF}/documents.parquet"), w).select("doc_id", "score").toPandas()
    assert set(stages[1].doc_id) == set(scored[scored.score >= classifier.ACCEPT].doc_id) and len(stages[1]) > 0.7 * len(stages[0])


def test_one_of_each(stages):
    rows = list(zip(stages[1].doc_id.tolist(), stages[1].text.tolist()))
    assert set(stages[2].doc_id) == {i for i, _, root, _ in brute(rows, 5, 80) if i == root}


def test_passages_are_gone(spark, stages):
    before, after = stages[2].set_index("doc_id").text, stages[3].set_index("doc_id").text
    assert set(after.index) <= set(before.index) and (stages[3].n_chars == stages[3].text.str.len()).all()

    def shared(texts, n=60):
        seen = collections.defaultdict(set)
        for i, t in texts.items():
            w = t.lower().split()
            for k in range(len(w) - n + 1):
                seen[tuple(w[k : k + n])].add(i)
        return {g for g, ids in seen.items() if len(ids) > 1}

    assert shared(before) and not shared(after)
    found = {r[0] for r in substrings.repeated_passages(spark.createDataFrame(stages[2])).select("doc_id").collect()}
    assert all(after.get(i, "") == t or i in found for i, t in before.items())


def test_mix(stages):
    size = lambda d: d.text.map(lambda t: len(t.split())).groupby(d.source).sum()
    before, after = size(stages[3]), size(stages[4])
    order = sorted(before.index)
    weight = dict(zip(order, [(5, 2, 1)[k % 3] for k in range(len(order))]))
    assert abs(after.sum() - before.sum()) < 0.1 * before.sum() and max(collections.Counter(stages[4].doc_id).values()) <= 3
    free = [s for s in order if after[s] < 2.7 * before[s]]
    ratios = np.array([after[s] / weight[s] for s in free])
    assert ratios.std() / ratios.mean() < 0.25


def test_packing(stages):
    rows = stages[5]
    assert (rows.groupby("sequence_id").length.sum() <= 1024).all()
    assert collections.Counter(rows[rows.piece == 0].doc_id) == collections.Counter(stages[4].doc_id)
    assert rows.sequence_id.nunique() <= 1.1 * rows.length.sum() / 1024 + 1


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == len(stages[5]) and got.agg(F.sum("length")).first()[0] == stages[5].length.sum()


def test_odd_rows(spark, docs, awkward, prose):
    """Nulls, ids that repeat with one text and with several, and names that operators use themselves."""
    odd = docs.unionByName(spark.createDataFrame([(7, prose(90, 77), "en", "s1", 9), (9, None, None, None, None), (None, prose(60, 78), "en", None, 9), (13, "", "de", "s2", 0)], docs.schema))
    odd = odd.withColumns({c: F.lit("own") for c in ("score", "kept", "start", "doc", "h", "component_id", "n", "rep", "part", "chain", "pos", "length", "rank")})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert all(r["score"] == r["length"] == r["chain"] == "own" for r in rows), name
        if stage is corpus_pipeline.keep_one_of_each:
            ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
            assert len(ids) == len(set(ids)) and {r["text"] for r in rows} >= {None, prose(60, 78)}
    assert corpus_pipeline.pack(spark, odd, SF).where("piece = 0").count() == odd.count()


def test_without_labels_or_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    empty = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).isEmpty()
    assert isinstance(stages_frame := empty.toPandas(), pd.DataFrame) and stages_frame.empty
