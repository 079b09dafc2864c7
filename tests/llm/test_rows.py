"""Sharding, mixing, line rules, fingerprints, licenses and the classifier on small tables."""

import collections
import hashlib
import unicodedata
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm import classifier, fingerprints, jaccard, licenses, lines, mixing, packing, sharding, substrings
from webloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    c = sorted(got.columns)
    assert c == sorted(want.columns)
    pd.testing.assert_frame_equal(got[c].sort_values(c).reset_index(drop=True), want[c].sort_values(c).reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000])
def test_shards(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("x"))
    rows = sharding.shard_rows(df, ["doc_id", "x"], blocks=8, cells=4).toPandas()
    assert len(rows) == n and sorted(rows.doc_id) == list(range(n))
    sizes = collections.Counter(rows.shard)
    assert all(sorted(rows[rows.shard == s].slot) == list(range(k)) for s, k in sizes.items())
    assert n < 16 or len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1


def test_sharding_query(spark):
    got = QUERIES["op1_hypergeometric_shards"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text.fillna("")
    assert sorted(got.doc_id) == sorted(docs.index) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sorted(counts.index) == list(range(16)) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    assert abs(np.corrcoef(got.doc_id, got.shard)[0, 1]) < 0.2


def test_matrix_is_hypergeometric():
    draws = np.array([sharding.communication_matrix([6, 4], [5, 5], seed)[0, 0] for seed in range(4000)])
    assert all((sharding.communication_matrix([3, 0, 7], [4, 6], s).sum(axis=0) == [4, 6]).all() for s in range(20))
    want = {k: c / 210 for k, c in {1: 5, 2: 50, 3: 100, 4: 50, 5: 5}.items()}  # C(5,k) C(5,6-k) / C(10,6)
    assert all(abs((draws == k).mean() - p) < 0.03 for k, p in want.items())


def test_shards_of_awkward_rows(docs, none):
    keyed = docs.withColumn("size", F.lit(1)).withColumn("Shard", F.lit("own"))
    assert sharding.shard_rows(keyed, ["doc_id", "size"]).count() == keyed.count()
    assert sharding.shard_rows(none, ["doc_id"]).isEmpty()


def test_targets():
    """Water filling by rounds gives what the closed form gives."""

    def rounds(sizes, weights):
        target, open_, left = {}, set(range(len(sizes))), float(sum(sizes))
        while True:
            level = left / sum(weights[i] for i in open_) if open_ else 0
            capped = {i for i in open_ if level * weights[i] > 3 * sizes[i]}
            if not capped:
                return [target.get(i, level * weights[i]) for i in range(len(sizes))]
            for i in capped:
                target[i] = 3.0 * sizes[i]
                left -= 3 * sizes[i]
            open_ -= capped

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for sizes in ([10, 2000, 30], [5, 0, 5, 1000, 7, 9], [100, 100, 100, 100]):
        df = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "_mix_key string, source_size long")
        got = [r["target"] for r in mixing.source_targets(df).orderBy("_mix_key").collect()]
        np.testing.assert_allclose(got, rounds(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_mix_comes_near_its_targets(spark, prose):
    rows = [(i, prose(1 + i * 7 % 90, i), f"s{i % 4}" if i % 9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, buckets=16).toPandas()
    per = got.assign(taken=got.copies * got["size"]).groupby(got.source.fillna("~")).agg(t=("target", "first"), s=("source_size", "first"), k=("taken", "sum"), n=("size", "sum"))
    assert (per.s == per.n).all() and (abs(per.t - per.k) <= 0.01 * per.t + 2).all() and got.copies.max() <= 3
    assert abs(per.t.sum() - per.n.sum()) < 1e-6
    again = mixing.mix_sources(df.repartition(7), buckets=16).toPandas()
    assert got.set_index("doc_id").copies.to_dict() == again.set_index("doc_id").copies.to_dict()


def test_inclusion_frequencies(spark):
    """Over many sources of the same sizes, documents are in the sample as often as their probabilities say."""
    distinct = [1, 2, 3, 5, 8, 10, 13, 16, 20, 25, 30, 40, 50, 60, 80, 110, 150, 200]
    sizes, sources = [n for n in distinct for _ in range(9)], 72
    rows = [(1000 * s + i, " ".join(["w"] * n), f"s{s:04}") for s in range(sources) for i, n in enumerate(sizes)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for k, w in enumerate((5, 2, 1)):
        rest = (w / (8 / 3)) % 1 * sum(sizes)
        lo, hi = 0.0, 1.0
        for _ in range(60):  # the rate by bisection
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(1, c * n) * n for n in sizes) < rest else (lo, c)
        own = got[got.doc_id // 1000 % 3 == k]
        drawn = (own.copies - int(w / (8 / 3))).groupby(own["size"]).mean()
        off = np.abs(drawn - [min(1, c * n) for n in distinct])
        assert off.max() < 0.12 and off.mean() < 0.04


def test_mix_of_awkward_rows(docs, none):
    got = mixing.mix_sources(docs.withColumn("size", F.lit("own")).withColumn("Target", F.lit(1)))
    assert got.count() == docs.count() and got.where("copies IS NULL OR copies > 3 OR size IS NULL").isEmpty()
    assert mixing.mix_sources(none).isEmpty()


def test_line_rules(spark, docs, none, prose):
    menu = "Home | About | Contact | Shop | Blog | Login"
    clean = [prose(30, i) + "." for i in range(6)]
    rows = [(1, "\n".join(clean)), (2, "\n".join(f"{c}\n{menu} {i}" for i, c in enumerate(clean))), (3, "\n".join(f"{menu} | {prose(12, 50 + i)}" for i in range(9))), (4, "! ".join(prose(80, 9).upper().split(" ")).replace("!", "!!")), (5, None), (6, "a b c d " * 30)]
    got = {r["doc_id"]: r for r in lines.judge_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["kept"] for k in range(1, 7)] == [True, True, False, False, False, False]
    assert menu not in got[2]["clean_text"] and got[5]["n_words"] == 0 and got[6]["n_repeat_words"] == 120 and got[6]["base_failed"]
    assert lines.judge_lines(docs).count() == docs.count() and lines.judge_lines(none).isEmpty()


def test_boilerplate_lines(spark):
    rows = {"Read more": False, "Click here to read more!": False, "She bread more loaves than he could, and wished to read more.": True, "Mentions légales.": False, "Tous droits réservés © 2020.": False,
            "Er wollte mehr lesen, als an diesem Abend in der Stube auf dem Tisch lag.": True, "conditions d'utilisation": False, "Leer más.": False, "Proofread more.": True}
    got = {r["x"]: r["ok"] for r in spark.createDataFrame([(x,) for x in rows], "x string").withColumn("ok", lines.line_passes(F.col("x"))).collect()}
    assert got == rows


def test_repeated_windows(spark):
    import random

    rng = random.Random(2)
    rows = [" ".join(rng.choice("ab") + rng.choice("xyz") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    got = [r["n_repeat_words"] for r in lines.judge_lines(spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1)).collect()]
    for text, n in zip(rows, got):
        w = text.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(grams)
        assert n == len({j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)})


def canonical(text):
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def test_fingerprints(spark, docs, none, awkward):
    texts = ["Straße  X", "STRASSE x", "é a", "é A ", "ﬁne", "fine", "other", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["fingerprint"] for r in fingerprints.fingerprint(df).orderBy("doc_id").collect()]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (canonical(a) == canonical(b))
    first = xxhash.xxh64(canonical("other").encode(), seed=42).hexdigest()
    assert got[6].startswith(first) and got[6].endswith("-0")
    assert fingerprints.fingerprint(docs).count() == len(awkward) and fingerprints.fingerprint(none).isEmpty()


def test_next_rows(spark):
    df = spark.createDataFrame([(None, "none"), (1, "a"), (5, "b"), (5, "b"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, fingerprints.next_by_descending_id(df, {"next": F.coalesce("text", F.lit("-"))}, buckets=3).collect()), key=str)
    assert got == sorted([(9, None, "b"), (5, "b", "b"), (5, "b", "a"), (1, "a", "none"), (None, "none", "-")], key=str)
    assert fingerprints.next_by_descending_id(df.limit(0), {"next": F.col("text")}).isEmpty()


def test_clashing_names(docs):
    clash = docs.withColumns({c: F.lit("own") for c in ("fingerprint", "kept", "n_words", "score", "start", "length", "doc", "component_id")})
    assert fingerprints.fingerprint(clash).count() == lines.judge_lines(clash).count() == docs.count()
    assert jaccard.jaccard_components(clash).count() == packing.token_pieces(clash).where("piece = 0").count() == docs.count()
    assert substrings.repeated_passages(clash).count() == 2 and licenses.license_notices(clash).isEmpty()


def test_digest_conflicts_get_ordinals(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.concat(F.lit("d"), F.length(canon).cast("string")))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB"), (4, "xyz")], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert got == {1: "d2-0", 2: "d2-1", 3: "d2-0", 4: "d3-0"}


def test_edited_texts_are_compared_byte_by_byte(spark, monkeypatch):
    """Digests that collide on purpose: originals and edited texts get ordinals by their own bytes."""
    monkeypatch.setattr(fingerprints, "digest", lambda canon: F.concat(F.lit("d"), F.length(canon).cast("string")))
    rows = [(1, "abc"), (2, "abd"), (3, "xyzabc"), (3, "qrsabd"), (4, None), (5, ""), (6, "ab"), (7, "AB"), (None, "abc"), (7, "AB")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.asDict() for r in fingerprints.edited_fingerprints(df).collect()]
    assert len(got) == len(rows)
    whole = {}
    for r in got:
        texts = [t or "" for i, t in rows if i == r["doc_id"]]
        nexts = [t or "" for _, t in rows]
        ways = {hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest(): (t, t[: len(t) - len(t) // 3] + n[: len(t) // 3]) for t in texts for n in nexts}
        t, e = ways[r["edited_sha256"]]
        for text, mark in ((t, r["fingerprint"]), (e, r["edited_fingerprint"])):
            assert whole.setdefault(mark, canonical(text)) == canonical(text)
        assert r["near_edited"] == float(canonical(t) == canonical(e)) and r["n_chars"] == len(t)
    assert len(whole) == len(set(whole.values())) > 5


def test_fingerprint_query(spark):
    got = QUERIES["op6_canonical_digest"](spark, SF).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ascending=False)
    texts = docs.text.fillna("").tolist()
    for k, (doc_id, text) in enumerate(zip(docs.doc_id, texts)):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + texts[(k + 1) % len(texts)][:cut]
        assert got.edited_sha256[doc_id] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[doc_id] == len(text)
        assert got.near_edited[doc_id] == float(canonical(edited) == canonical(text))


def test_licenses(spark, docs, none):
    rows = [(1, "Some words. This work is licensed under the GNU General Public License, version 3.\nMore."), (2, "Licensed under the Apache license, version 2.0. And: All rights reserved."), (3, "A licence to print money, copyright of nobody."), (4, None), (5, ""), (6, "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without any limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software")]
    got = licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "GPL-3.0"), (2, "All-rights-reserved"), (2, "Apache-2.0"), (6, "MIT")]
    text = dict(rows)
    assert text[1][[r for r in got if r["doc_id"] == 1][0]["start"] :].startswith("This work")
    assert [r["extra"] for r in got if r["doc_id"] == 6] == [["any"]]
    assert licenses.license_notices(docs).isEmpty() and licenses.license_notices(none).isEmpty()


def test_more_notices_side_by_side(spark, prose):
    """Templates that rank low are confirmed too, own ones are found without a common word, and odd rows do no harm."""
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    both = "SPDX-License-Identifier: BSD-2-Clause\nLicensed under CC BY-NC-SA 3.0.\nReleased under the MIT License."
    long = prose(20_000, 3) + "\n" + isc + "\n" + prose(20_000, 4)
    rows = [(1, isc, "x"), (2, both, "x"), (2, both, "x"), (3, long, None), (None, isc, "y"), (4, "Sharing is fine as long as nobody sings.", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string").withColumn("start", F.lit(1))
    got = [(r["doc_id"], r["license"]) for r in licenses.license_notices(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "ISC"), (3, "ISC"), (None, "ISC")] + [(2, x) for x in ("BSD-2-Clause", "CC-BY-NC-SA-3.0", "MIT")] * 2, key=str)
    own = licenses.license_notices(df, templates=[("Own", "Sharing is fine as long as nobody sings.")]).collect()
    assert [(r["doc_id"], r["license"]) for r in own] == [(4, "Own")]


def test_licenses_on_the_table(spark):
    got = {r[0] for r in QUERIES["op5_conditional_compression"](spark, SF).select("doc_id").collect()}
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    plain = docs[docs.text.str.contains("Licensed under the Apache License, Version 2.0.|Released under the MIT License.|GNU General Public License, version 3.|Licensed under CC BY-NC 4.0.|All rights reserved.")]
    assert got == set(plain.doc_id)


def test_classifier(spark, docs, none, prose):
    got = QUERIES["op10_ftrl_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.93 and (got.score.between(0, 1)).all() and len(got) == 1000
    rank = held.score.rank()
    n1, n0 = (held.quality == 1).sum(), (held.quality == 0).sum()
    assert (rank[held.quality == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0 > 0.97
    weights = classifier.train(spark.createDataFrame([(1, prose(50, 1), 1), (2, "###&&& $$$ ***", 0), (3, None, 1), (4, "x", None)], "doc_id long, text string, label int"), bits=10)
    scored = classifier.score(docs.withColumn("score", F.lit(9)), weights).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert classifier.score(none, weights).isEmpty()
    assert not classifier.train(spark.createDataFrame([], "doc_id long, text string, label int")).any()


def test_ftrl_against_a_plain_version():
    """Coordinate by coordinate, as the algorithm is published."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(32, 6, replace=False)).astype("<i4"), rng.random(6).astype("<f4"), int(rng.integers(0, 2))) for _ in range(200)]
    rates = {"alpha": 0.7, "beta": 1.3, "l1": 0.6, "l2": 0.01}
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= rates["l1"]:
            return 0.0
        return -(z[i] - (rates["l1"] if z[i] > 0 else -rates["l1"])) / ((rates["beta"] + n[i] ** 0.5) / rates["alpha"] + rates["l2"])

    for places, values, label in rows * 2:
        x = dict(zip([*places.tolist(), 32], [*values.tolist(), 1.0]))
        w = {i: weight(i) for i in x}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / rates["alpha"] * w[i]
            n[i] += g * g
    got = classifier.fitted(rows, 5, 2, **rates).weights()
    np.testing.assert_allclose(got, [weight(i) for i in range(33)], rtol=1e-6, atol=1e-9)
    assert (got == 0).any() and (got != 0).sum() > 10


def test_score_replaces_a_column_in_any_case(docs):
    scored = classifier.score(docs.withColumn("Score", F.lit("own")).withColumn("held_out", F.lit(1)), np.zeros(9))
    assert scored.columns == [*docs.columns, "held_out", "score"] and {r["score"] for r in scored.select("score").collect()} == {0.5}
