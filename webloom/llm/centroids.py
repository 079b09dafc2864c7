"""Clustering around centroids with a distance matrix that is kept up to date.

Vectors become integers floor(256 * c). Each row keeps the exact dot products of its vector with all centroids in a written
table. When centroids move, a product changes by the components of the move that aren't zero, times the vector's: only those
are read, all others stay as they are; then the nearest centroid is the least of |x|^2 - 2 x.c + |c|^2. A round is one map over the
table and one sum over (cluster, component), of which the driver gets as many numbers as there are centroids and dimensions. The
table of the round before is deleted when the next one is written.

Defined results: rows whose vector is null, of another width or holds null or non-finite entries are dropped; repeated rows count each;
components beyond 2**27 stay there, so that no distance leaves a long (sums that do are null). Rows
without id are clustered but start no centroid; equal ids order by their vectors. With fewer rows than centroids there are fewer centroids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, read, shared_dir, tidy, written
from .vectors import finite, integers, matrix

CENTROIDS, ROUNDS, WIDTH, MOST = 40, 5, 64, 1 << 27
_LARGEST = (1 << 63) - 1


def nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid; of equals the smaller number."""
    away = (x * x).sum(axis=1)[:, None] - 2 * dots + (centroids * centroids).sum(axis=1)[None]
    at = away.argmin(axis=1)
    return at, away[np.arange(len(x)), at]


def moved(x: np.ndarray, dots: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The dot products after each centroid's move: only components that moved are read."""
    dots = dots.copy()
    for j in np.flatnonzero(move.any(axis=1)):
        at = np.flatnonzero(move[j])
        dots[:, j] += x[:, at] @ move[j, at]
    return dots


def _assigned(x, dots, centroids, ids) -> pa.RecordBatch:
    at, away = nearest(x, dots, centroids)
    columns = [ids, pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in dots.astype("<i8")], pa.binary()), pa.array(at.astype("i4")), pa.array(away)]
    return pa.record_batch(columns, names=["id", "x", "dots", "cluster", "distance"])


def _held(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(batch.num_rows, -1).astype(np.int64)


def _start(centroids: np.ndarray):
    @tidy
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), centroids.shape[1])
                yield _assigned(x, x @ centroids.T, centroids, batch.column(0))

    return run


def _round(centroids: np.ndarray, move: np.ndarray):
    @tidy
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _held(batch, "x", "<i4")
                yield _assigned(x, moved(x, _held(batch, "dots", "<i8"), move), centroids, batch.column("id"))

    return run


def _totals(batches):
    """(cluster, component, rows, sum) of each batch's clusters."""
    for batch in batches:
        if batch.num_rows:
            x, cluster = _held(batch, "x", "<i4"), batch.column("cluster").to_numpy()
            found, inverse, n = np.unique(cluster, return_inverse=True, return_counts=True)
            total = np.zeros((len(found), x.shape[1]), dtype=np.int64)
            np.add.at(total, inverse, x)
            d = x.shape[1]
            yield pa.record_batch([pa.array(np.repeat(found, d)), pa.array(np.tile(np.arange(d, dtype="i4"), len(found))), pa.array(np.repeat(n, d)), pa.array(total.ravel())], names=["cluster", "at", "n", "total"])


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty cluster's floor(sum / count) by component; empty clusters keep their centroid."""
    parts = state.select("x", "cluster").mapInArrow(_totals, "cluster int, at int, n bigint, total bigint")
    found = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).toArrow()
    out = centroids.copy()
    for c, at, n, total in zip(*(found.column(k).to_pylist() for k in ("cluster", "at", "n", "total"))):
        out[c, at] = int(total) // n
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), the final centroids): the start is the k rows of least sha256 of the seed and the id."""
    spark = df.sparkSession
    clip = lambda c: F.greatest(F.lit(-MOST).cast("long"), F.least(F.lit(MOST).cast("long"), c))
    usable = df.where((F.size(vector_col) == width) & finite(F.col(vector_col)))
    rows = usable.select(F.col(id_col).cast("long").alias("id"), F.transform(integers(F.col(vector_col)), clip).alias("x"))
    first = rows.where("id IS NOT NULL").select("x", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256).alias("h"))
    first = first.orderBy("h", "x").limit(k).toArrow()
    centroids = np.array(first.column("x").to_pylist(), dtype=np.int64).reshape(-1, width)
    if not len(centroids):
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint"), centroids
    schema = "id bigint, x binary, dots binary, cluster int, distance bigint"
    state = written(rows.mapInArrow(_start(centroids), schema), "products")
    for _ in range(rounds):
        to = means(state, centroids)
        before, state = state, written(state.mapInArrow(_round(to, to - centroids), schema), "products")
        for path in {f.rsplit("/", 1)[0] for f in before.inputFiles()}:
            delete(spark, path)
        centroids = to
    return state.select("id", "cluster", "distance"), centroids


def op13_incremental_centroids(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster(read(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    long = lambda v: F.lit(v if v <= _LARGEST else None).cast("long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, name: F.get(F.array(*values) if values else F.array(F.lit(None)), F.col("cluster")).alias(name)
    inertia = of([long(sums.get(c, 0)) for c in range(len(centroids))], "cluster_inertia").cast("long")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", inertia.alias("cluster_inertia"), long(sum(sums.values())).alias("inertia"), of([F.lit(h) for h in digest], "centroid_sha256").cast("string").alias("centroid_sha256"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> str:
    def assigned(n: int) -> str:
        away = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        pairs = f"SELECT v.r, c.c, {away} AS d FROM v CROSS JOIN c{n} c"
        return f"p{n} AS ({pairs}), a{n} AS (SELECT r, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM p{n} GROUP BY r)"

    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {width})""",
        "e AS (SELECT r, unnest(range(1, 65)) AS i, unnest(x) AS value FROM v)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT {k})", assigned(0)]
    for n in range(rounds):
        steps.append(f"""m{n} AS (SELECT c, i, sum(value) AS s, count(*) AS n FROM e JOIN a{n} USING (r) GROUP BY c, i),
l{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(l.x, o.x) AS x FROM c{n} o LEFT JOIN l{n} l USING (c)), {assigned(n + 1)}""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} k USING (c)"""


OP13_SQL = _sql()
