import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import terms, vectors
from webloom.operators import text_analysis as ta

WORDS = [a + b for a in ("kalt", "brim", "dorn", "fels", "gart", "holm", "jork", "lund") for b in ("an", "er", "il", "os", "um")]


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS[i % 3 * 10 : i % 3 * 10 + 20], k=rng.randint(60, 90))) + ".") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "too short"), (103, rows[0][1])]
    return ta.prepare(spark.createDataFrame(rows, "doc_id bigint, text string"))


def matrix(rows):
    docs, words = sorted({r["doc_id"] for r in rows}), sorted({r["term"] for r in rows})
    v = np.zeros((len(docs), len(words)))
    for r in rows:
        v[docs.index(r["doc_id"]), words.index(r["term"])] = r["value"]
    return docs, words, v


def test_factors_equal_numpy_and_loss_falls(spark, df):
    entries = vectors.topic_entries(df)
    docs, words, v = matrix(entries.collect())
    assert docs == [*range(40), 103] and np.allclose((v * v).sum(axis=1), 1)
    seeds = lambda keys: np.array([spark.range(1).select(vectors._seeded(F.lit(k), 3)).first()[0] for k in keys])
    w, h = seeds(docs), seeds(words).T
    want = []
    for _ in range(5):
        w = w * (v @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        h = h * (w.T @ v) / np.maximum((w.T @ w) @ h, 1e-12)
        want.append(((v - w @ h) ** 2).sum())
    got_w, got_h, losses = vectors.factorise(entries, rounds=5)
    assert np.allclose(losses, want, rtol=1e-9) and all(a > b for a, b in zip(losses, losses[1:]))
    assert np.allclose([r["x"] for r in got_w.orderBy("doc_id").collect()], w, rtol=1e-8)
    assert np.allclose([r["x"] for r in got_h.orderBy("term").collect()], h.T, rtol=1e-8)


def test_topics_of_documents(df):
    best, shares = vectors.topics(df)
    rows = {r["doc_id"]: r for r in shares.collect()}
    assert set(rows) == {*range(40), 103}
    for r in rows.values():
        assert sum(r["shares"]) == pytest.approx(100) and r["shares"][r["main_topic"]] == max(r["shares"])
    assert best.groupBy("topic").count().where("count = 10").count() == 3
    # The first third of the documents and the last share few words.
    assert len({rows[i]["main_topic"] for i in range(0, 40, 3)} & {rows[i]["main_topic"] for i in range(2, 40, 3)}) == 0


def test_topics_of_nothing(spark, df):
    best, shares = vectors.topics(df.where("doc_id > 100 AND doc_id < 103"))
    assert best.isEmpty() and shares.isEmpty()
    codes = {(r["doc_id"], r["code"]) for r in terms.semantic_rules(df).collect()}
    unfocused = {r["doc_id"] for r in vectors.topics(df)[1].where("unfocused").collect()}
    assert {i for i, c in codes if c == "unfocused"} == unfocused


def test_similarity_is_the_cosine_of_weights(spark):
    df = ta.prepare(spark.createDataFrame([(1, "alpha alpha beta"), (2, "beta gamma"), (3, None)], "doc_id bigint, text string"))
    asked = spark.createDataFrame([(1, "Alpha"), (1, "beta unknown"), (1, "of"), (2, "delta"), (3, "alpha"), (2, "delta")], "doc_id bigint, phrase string")
    got = {(r[0], r[1]): r[2] for r in vectors.similarity(vectors.term_weights(df), asked).collect()}
    one, two, none = (math.log(4 / (1 + n)) + 1 for n in (1, 2, 0))
    size = math.hypot(2 * one, two)
    assert got == pytest.approx({(1, "Alpha"): 2 * one / size, (1, "beta unknown"): two * two / size / math.hypot(two, none), (1, "of"): 0, (2, "delta"): 0, (3, "alpha"): 0})


def test_relevance(spark):
    df = ta.prepare(spark.createDataFrame([(1, "green tea green tea"), (2, ""), (3, "black coffee")], "doc_id bigint, text string"))
    targets = spark.createDataFrame([(1, "tea"), (1, "sugar"), (2, "tea")], "doc_id bigint, phrase string")
    got = {r["doc_id"]: r for r in vectors.content_relevance(df, targets).collect()}
    assert got[1]["topic_coverage_ratio"] == 0.5 and got[1]["relevance_issues"] == ["thin_content", "low_relevance", "topics_not_covered"] and got[1]["relevance_score"] == 0.25
    assert got[2]["relevance_score"] == 0 and "no_content" in got[2]["relevance_issues"]
    assert got[3]["topical_relevance"] is None and got[3]["relevance_issues"] == ["thin_content"]
    assert got[1]["key_phrases"][:3] == ["green", "green tea", "tea"]


@pytest.mark.parametrize(("gap", "found"), [(1, True), (59, True), (60, False)])
@pytest.mark.parametrize("before", [0, 1, 58, 59])
def test_pairs_slide(spark, gap, before, found):
    """A pair counts wherever it stands, if less than sixty words are between."""
    text = " ".join(["so"] * before + ["Alpha"] + ["so"] * (gap - 1) + ["Beta"] + ["so"] * 30)
    rows = terms.entity_graph(ta.prepare(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).collect()
    assert [tuple(r) for r in rows] == ([("alpha", "beta", 1)] if found else [])


def test_pairs_count_once_a_sentence(spark):
    text = "Alpha Beta Alpha Beta Alpha. Beta near Alpha and Gamma."
    rows = terms.entity_graph(ta.prepare(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).collect()
    assert sorted(tuple(r) for r in rows) == [("alpha", "beta", 2), ("alpha", "gamma", 1), ("beta", "gamma", 1)]


@pytest.mark.parametrize(("text", "found"), [
    ("One. buy cheap green apples now. buy cheap green apples today", {"buy cheap green", "cheap green apples"}),
    ("buy cheap green apples. buy cheap green apples", set()),  # two sentences
    ("buy cheap green apples. buy cheap green apples. no", set()),  # the first one counts for nothing
    ("One. cheap green apples. no. cheap green apples", set()),  # not in a row
    ("One. cheap of apples. cheap of apples", set()), ("One. a bb ccc. a bb ccc", set()), ("", set()), (None, set()),
])
def test_phrases_that_sentences_repeat(spark, text, found):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert {r["term"] for r in terms.repeated_phrases(df).collect()} == found


def test_keywords_are_merged_whole(spark):
    """A word that is no list's best comes before one list's best if its sum is larger."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=150))) for i in range(6)]
    df = ta.prepare(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = terms.keywords(df, k=5).where("doc_id = 0").orderBy("rank").collect()
    w = {r["term"]: r for r in vectors.term_weights(df).where("doc_id = 0").collect()}
    size, total = math.sqrt(sum(r["weight"] ** 2 for r in w.values())), sum(r["tf"] for r in w.values())
    want = sorted(((-round(round(r["weight"] / size, 9) + round(r["tf"] / total, 9), 9), t) for t, r in w.items()))[:5]
    assert [(-r["score"], r["term"]) for r in got] == want


@pytest.mark.parametrize("most", [200_000, 20, 0])
def test_common_and_rare_terms_make_the_same_factors(spark, df, monkeypatch, most):
    """Entries of rare terms are joined, those of common ones are not; no table of entries is left, and what is exchanged for common terms are sums."""
    w, h, _ = vectors.factorise(vectors.topic_entries(df), rounds=3)
    monkeypatch.setattr(vectors, "MOST_TERMS", most)
    got_w, got_h, (common, x), _ = vectors.corpus_factors(df, "doc_id", 3, 3)
    of = lambda rows, key: {r[key]: r["x"] for r in rows.collect()}
    terms_ = of(got_h, "term") | dict(zip(common, x.tolist()))
    assert len(common) <= most and (most or not common) and got_h.isEmpty() == (most == 200_000)
    for got, want in ((of(got_w, "doc_id"), of(w, "doc_id")), (terms_, of(h, "term"))):
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-8) for i in want)
