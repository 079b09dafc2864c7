import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import neighbours as nb
from webloom.llm.common import scratch

from .test_vectors import ODD, SCHEMA, usable, vectors


def brute(rows, every=20, most=20):
    """(query, rank, id, score) by comparing all pairs; rows that repeat id and vector are one."""
    kept = sorted({(i, tuple(v)) for i, v in usable(rows) if i is not None and any(v)})
    d = max((len(v) for _, v in kept), default=0)
    ids, x = np.array([i for i, _ in kept]), np.array([list(v) + [0.0] * (d - len(v)) for _, v in kept])
    out = []
    for k in np.flatnonzero(ids % every == 0) if kept else []:
        score = x @ x[k]
        o = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[k]][:most]
        out += [(int(ids[k]), r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(o)]
    return out


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_op12_with_copies_and_odd_rows_is_exact_on_one_leaf(spark, tmp_path):
    rows = vectors(150, 3)
    rows += [(1000 + i, rows[7][1], 0) for i in range(60)] + [rows[20], (None, rows[4][1], 0), (960, [0.0] * 64, 1), (980, [0.25, -1.0], 1)] + ODD
    got = nb.op12_nn_descent(spark, saved(spark, tmp_path, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = sorted(tuple(r) for r in got.collect()), sorted(brute(rows))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


@pytest.mark.parametrize("rows", [[], ODD, [(20, [1.0, 0.0], 0)], [(20, [1.0, 0.0], 0), (40, [-1.0, 0.5], 0), (41, [0.0, -1.0], 0)]])
def test_op12_on_few_rows(spark, tmp_path, rows):
    got = nb.op12_nn_descent(spark, saved(spark, tmp_path, rows)).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted((*r[:3], round(r[3], 9)) for r in brute(rows))


SMALL = nb.Settings(near=24, trees=4, leaf=256, first=10, sample=12, rounds=4, beam=64, expand=32, entries=32)


@pytest.fixture(scope="module")
def uneven():
    """Vectors in 16 dimensions of very unequal lengths, a third of them near one place."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2400, 16)) * rng.lognormal(0, 0.5, 2400)[:, None]
    x[:800] = x[0] + 0.01 * rng.standard_normal((800, 16))
    return [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(rng.permutation(x))]


def test_descent_raises_recall_and_search_reaches_it(spark, uneven):
    with scratch(spark):
        df = spark.createDataFrame(uneven, SCHEMA)
        want = {}
        for q, _, i, _ in brute(uneven):
            want.setdefault(q, set()).add(i)

        def recall(index):
            got = {}
            for r in nb.nearest_rows(index, F.col("row") % 20 == 0).collect():
                got.setdefault(r["query_id"], set()).add(r["vec_id"])
            return np.mean([len(got[q] & w) / len(w) for q, w in want.items()])

        index = nb.build(df, settings=SMALL)
        assert index.n == len(uneven) and index.graph.count() == index.n
        assert index.graph.agg(F.max(F.size("adj"))).first()[0] <= 2 * SMALL.near
        assert recall(index) >= 0.95
        # Each round of descent makes the lists nearer.
        one = nb.neighbour_lists(index.points, index.n, nb.Settings(**{**SMALL.__dict__, "trees": 1, "rounds": 0}))
        total = [one.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda a, e: a + e["sim"]))).first()[0]]
        for _ in range(2):
            one = nb.written(nb.descend(one, index.n, SMALL), "near")
            total.append(one.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda a, e: a + e["sim"]))).first()[0])
        assert total[0] < total[1] < total[2]


def test_search_from_entries_alone(spark, uneven):
    """Queries that are no rows of the index."""
    with scratch(spark):
        index = nb.build(spark.createDataFrame(uneven, SCHEMA), settings=SMALL)
        asked = [(k, [float(np.float32(c)) for c in v], 0) for k, v in enumerate(np.random.default_rng(4).standard_normal((40, 16)))]
        packed, _, _ = nb.packed(spark.createDataFrame(asked, SCHEMA), "vec_id", "embedding", d=16)
        found = nb.search(index, packed.select(F.col("id").alias("q"), F.lit(None).cast("long").alias("start"), "vector"), 10)
        rows = {r["q"]: {e["row"] for e in r["best"]} for r in nb.with_rows(index, found, 10).collect()}
        x = np.array([v for _, v, _ in uneven])
        hit = [len(rows[k] & set(np.argsort(-(x @ np.array(v)))[:10].tolist())) / 10 for k, v, _ in asked]
        assert np.mean(hit) >= 0.9


def test_local_join_meets_pairs_once():
    import pyarrow as pa

    y = np.eye(4, 5, dtype="<f4") + np.float32(0.1)
    left = pa.table({"block": [0] * 5, "u": [1, 1, 1, 2, 2], "v": [10, 11, 12, 11, 12], "fresh": [True, False, False, True, True]})
    right = pa.table({"home": [0] * 4, "w": [13, 12, 11, 10], "y": nb.binaries(y), "worst": pa.array([-9.0, -9.0, 9.0, -9.0], pa.float32())})
    got = nb._local_join(left, right).to_pydict()
    # 11 is full of nearer ones; 10 meets the old ones, the old ones don't meet at 1 but at 2.
    assert sorted(zip(got["a"], got["b"])) == [(10, 11), (10, 12), (12, 10), (12, 11)]
