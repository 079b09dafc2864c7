import hashlib

import numpy as np
import pytest

from webloom.llm import centroids, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [], 1), (902, [None] * 64, 1), (903, [float("nan")] + [0.0] * 63, 1), (904, [float("inf")] * 64, 1)]


def vectors(n, seed, d=64):
    rng = np.random.default_rng(seed)
    scale = np.linspace(0.05, 0.4, d)
    return [(i, [float(np.float32(v)) for v in rng.standard_normal(d) * scale], i % 3) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Vectors, some of them repeated, and rows that can't be used; in a folder as the queries read it."""
    rows = vectors(300, 1)
    rows += [(300 + i, rows[7][1], 0) for i in range(100)] + [(7, rows[7][1], 0)] + ODD
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return path, rows


def usable(rows, d=None):
    def fine(v):
        return v is not None and all(c is not None and np.isfinite(c) for c in v) and (d is None or len(v) == d)

    return [(i, v) for i, v, _ in rows if fine(v)]


def whole(v, d=64):
    return [int(np.floor(256 * np.float64(c))) for c in v] + [0] * (d - len(v))


def test_op11_equals_an_eigendecomposition(spark, table):
    path, rows = table
    kept = [(i, whole(v)) for i, v in usable(rows)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    got = whitening.op11_lanczos_whitening(spark, path).collect()
    assert len(got) == 4 * len(kept)
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-10
    signs = {}
    want = {}
    for i, x in kept:
        want.setdefault(i, x)
    for r in got:
        c, x = r["component"] - 1, np.array(want[r["vec_id"]])
        exact = sum(int(n * a - s) ** 2 for a, s in zip(x.tolist(), sums.tolist()))
        assert (r["n"], r["deviation"]) == (n, exact)
        assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-10)
        z = float((x - sums / n) @ v[:, c] / np.sqrt(e[c]))
        sign = signs.setdefault(c, 1 if z * r["whitened"] >= 0 else -1)
        assert r["whitened"] == pytest.approx(sign * z, abs=1e-8)


@pytest.mark.parametrize("d", [3, 64, 150])
def test_components_of_any_width(spark, d):
    rows = vectors(400, 2, d)
    prepared, width = whitening.prepared(spark.createDataFrame(rows, SCHEMA), "embedding")
    model = whitening.fit(prepared, width)
    x = np.array([whole(v, d) for _, v, _ in rows])
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(model.deviations**2, e[::-1][: len(model.deviations)], rtol=1e-10)
    assert np.allclose(np.abs((model.components * v[:, ::-1][:, : len(model.deviations)]).sum(axis=0)), 1, atol=1e-8)


def test_equal_eigenvalues_and_lower_ranks(spark):
    corners = [(k, [float(s) if j == a else 0.0 for j in range(6)], 0) for k, (a, s) in enumerate((a, s) for a in range(6) for s in (-1, 1))]
    prepared, d = whitening.prepared(spark.createDataFrame(corners, SCHEMA), "embedding")
    model = whitening.fit(prepared, d)
    assert np.allclose(model.deviations**2, 256**2 / 6, rtol=1e-12) and len(model.deviations) == 4
    assert np.allclose(model.components.T @ model.components, np.eye(4), atol=1e-12)
    plane = [(k, [float(k % 5), float(k % 3), 0.0], 0) for k in range(30)]
    prepared, d = whitening.prepared(spark.createDataFrame(plane, SCHEMA), "embedding")
    assert len(whitening.fit(prepared, d).deviations) == 2


def test_odd_vectors_of_whitening(spark, tmp_path):
    def run(rows, name):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return whitening.op11_lanczos_whitening(spark, f"{tmp_path}/{name}").collect()

    assert run([], "none") == [] and run(ODD, "odd") == [] and run(vectors(1, 3) * 3, "one") == []
    uneven = run([(None, [0.5], 1), (1, [0.25, 0.5], 1), (2, [], 1), (3, [-3e38, 1.0], 1), (3, [-3e38, 1.0], 1)], "uneven")
    assert {r["vec_id"] for r in uneven} == {None, 1, 2, 3} and all(np.isfinite(r["whitened"]) for r in uneven)
    clashing = spark.createDataFrame([(1, [0.5, 0.0], "a", 7), (2, [0.0, 1.0], "b", 8), (3, [1.0, 1.0], "c", 9)], "vec_id bigint, v array<float>, Whitened string, n int")
    prepared, d = whitening.prepared(clashing, "v")
    out = whitening.transform(prepared, d, whitening.fit(prepared, d))
    assert out.columns == ["vec_id", "v", "n", "deviation", "whitened"] and out.count() == 3


def lloyd(rows):
    """Contract of op13, by plain loops."""
    kept = [(i, whole(v)) for i, v in usable(rows, 64)]
    order = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None))
    centroids_ = [x for _, x in order[:40]]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids_]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(5):
        at = assign()
        for c in range(len(centroids_)):
            own = [x for (_, x), (k, _) in zip(kept, at) if k == c]
            if own:
                centroids_[c] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = {}
    for k, d in at:
        inertia[k] = inertia.get(k, 0) + d
    return sorted((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids_[k])).encode()).hexdigest()) for (i, _), (k, d) in zip(kept, at))


@pytest.mark.parametrize("n", [0, 13, 300])
def test_op13_equals_plain_rounds(spark, tmp_path, n):
    rows = vectors(n, 5)
    rows += ([(400 + i, rows[3][1], 0) for i in range(60)] if n else []) + ODD + [(905, [0.1] * 63, 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op13_incremental_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == lloyd(rows)


def test_dot_products_follow_moves():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-300, 300, (50, 64)), rng.integers(-300, 300, (40, 64))
    move = rng.integers(-2, 3, (40, 64)) * (rng.random((40, 64)) < 0.2)
    assert (centroids.moved(x, x @ c.T, move) == x @ (c + move).T).all()


def test_odd_vectors_of_clustering(spark):
    rows = [(None, [1e30, 0.0], 0), (1, [-1e30, 0.5], 0), (1, [0.0, 0.25], 0), (2, [0.0, 0.25], 0)]
    found, at = centroids.cluster(spark.createDataFrame(rows, SCHEMA), width=2, k=2)
    got = sorted(found.collect(), key=str)
    assert len(got) == 4 and len(at) == 2 and all(r["distance"] >= 0 for r in got)
