"""Whitening of embeddings by principal components, found by Golub-Kahan-Lanczos bidiagonalisation.

Components are rounded down to integers x = floor(256 * c). The fit list holds each distinct vector once, as blocks of
integers in a written table; its sums are exact. The bidiagonalisation alternates two passes over the centred
rows: products Xv with the coefficients of Xv over all left vectors so far, and products X'u of what is left. Left vectors are
as long as the table, so a row's part of them is computed anew from coefficients (u = Xg), never stored or collected; right vectors
have a number for each dimension and are kept by the driver. Both sides are orthogonalised against all earlier vectors, twice.
A pass sends the driver a number for each dimension and step. The singular values of the small
bidiagonal matrix over sqrt(n) are the deviations, its right singular vectors combine the right vectors into components. Up to
FULL dimensions it takes as many steps as there are dimensions, so that equal eigenvalues are all found; with more it stops
when the residuals of the components asked for are at rounding level.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; shorter vectors lack zeros (they are padded to the
longest); repeated ids and vectors are rows of their own, but fit once; integers stop at the range of a long. Directions
without variance are no components: an empty table, one vector or copies of it give an empty result, and data of rank two gives
two components. A deviation beyond a long is null. In transform() extra columns pass through, but for those of the output's names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, scratch, tidy, written
from .vectors import finite, integers, matrix, padded, width

FULL, ROUNDING = 128, 4e-16
#: Components whose deviation is less than this part of the largest are rounding.
NEGLIGIBLE = 1e-7
#: So many tasks send their partial sums to the driver (some KB each); more are summed by Spark first.
FEW_TASKS = 200
_LARGEST = (1 << 63) - 1


@dataclass
class Whitening:
    n: int
    sums: list[int]
    largest: int
    components: np.ndarray  # a column each
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(np.float64) - self.mean) @ self.components) / self.deviations

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2, exact; None beyond a long."""
        small = (2 * self.n * max(1, self.largest)) ** 2 * max(1, len(self.sums)) <= _LARGEST
        kind = np.int64 if small else object
        gap = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(v) if v <= _LARGEST else None for v in (gap * gap).sum(axis=1)]


def _blocks(d: int):
    @tidy
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), d).astype("<i8")
                yield pa.record_batch([pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["n", "x"])

    return run


def _passed(blocks: DataFrame, tasks: int, d: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of f(integers of a block), a vector."""

    def run(batches):
        total = None
        for batch in batches:
            for raw in batch.column("x"):
                part = f(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = blocks.select("x").mapInArrow(run, "part array<double>")
    if tasks <= FEW_TASKS:  # a short vector from each
        return np.sum([np.array(r) for r in parts.toArrow().column("part").to_pylist()], axis=0)
    sums = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    return sums.toArrow().sort_by("at").column("value").to_numpy()


def _sums(blocks: DataFrame, d: int) -> tuple[int, list[int], int]:
    """(rows, exact sum of each dimension, largest absolute entry); halves of 32 bits, so that no partial sum overflows."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("x"):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d)
                top = [max(-int(a), int(b)) for a, b in zip(x.min(axis=0), x.max(axis=0))]
                yield pa.record_batch(
                    [pa.array(np.arange(d)), pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0)), pa.array([min(t, _LARGEST) for t in top], pa.int64())],
                    names=["at", "high", "low", "top"],
                )

    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = blocks.select("x").mapInArrow(run, "at bigint, high bigint, low bigint, top bigint").groupBy("at").agg(whole("high"), whole("low"), F.max("top").alias("top"))
    rows = found.toArrow().sort_by("at").to_pylist()
    n = blocks.agg(F.sum("n")).first()[0] or 0
    return int(n), [(int(r["high"]) << 32) + int(r["low"]) for r in rows], max((r["top"] for r in rows), default=0) + 1


def bidiagonalise(blocks: DataFrame, d: int, mean: np.ndarray, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """(right singular vectors as columns, singular values, steps) of the centred rows, the `wanted` largest."""
    rng, tasks = np.random.default_rng(seed), blocks.rdd.getNumPartitions()
    right, coefficients, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    diagonal: list[float] = []
    above: list[float] = []

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    def fresh() -> np.ndarray:
        v = apart(rng.standard_normal(d))
        return v / np.linalg.norm(v)

    v = fresh()
    while True:
        right = np.column_stack([right, v])
        g, k = v, coefficients.shape[1]
        if k:  # Xv, as far as earlier left vectors hold it
            held, at = coefficients, v
            g = v - coefficients @ _passed(blocks, tasks, d, lambda x: ((x - mean) @ held).T @ ((x - mean) @ at))
        kept, left = coefficients, g

        def image(x, kept=kept, left=left):
            centred = x - mean
            u = centred @ left
            return np.concatenate([centred.T @ u, (centred @ kept).T @ u, [u @ u]])

        found = _passed(blocks, tasks, d, image)  # X'u, what is left over earlier left vectors, and its square
        product, again, square = found[:d], found[d : d + k], found[-1]
        alpha = float(np.sqrt(max(0.0, square - again @ again)))
        scale = max([alpha, *diagonal])
        if alpha <= 1e-12 * scale or not scale:
            alpha, g, product = 0.0, np.zeros(d), np.zeros(d)
        else:
            g, product = (g - coefficients @ again) / alpha, (product - images @ again) / alpha
        diagonal.append(alpha)
        coefficients, images = np.column_stack([coefficients, g]), np.column_stack([images, product])
        rest = apart(product - alpha * v)
        beta = float(np.linalg.norm(rest))
        if len(diagonal) == d or not scale:
            break
        small = np.diag(diagonal) + np.diag(above, 1) if above else np.diag(diagonal)
        u, s, _ = np.linalg.svd(small)
        if d > FULL and len(s) >= wanted and np.all(beta * np.abs(u[-1, :wanted]) <= ROUNDING * s[0]):
            break
        broken = beta <= 1e-12 * scale  # an invariant subspace: go on with a direction of another one
        v, beta = (fresh(), 0.0) if broken else (rest / beta, beta)
        above.append(beta)
    small = np.diag(diagonal) + np.diag(above, 1) if above else np.diag(diagonal)
    _, s, vt = np.linalg.svd(small)
    return right @ vt[:wanted].T, s[:wanted], len(diagonal)


def prepared(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows with a usable vector, its integers as column _x, all of one width."""
    rows = df.where(finite(F.col(vector))).withColumn("_x", integers(F.col(vector)))
    least, d = width(rows, "_x")
    return (rows.withColumn("_x", padded(F.col("_x"), d)) if least < d else rows), d


def fit(rows: DataFrame, d: int, wanted: int = 4) -> Whitening | None:
    """Fits the distinct vectors of prepared rows; None where nothing varies."""
    if not d:
        return None
    with scratch(rows.sparkSession):
        blocks = written(rows.select("_x").distinct().mapInArrow(_blocks(d), "n bigint, x binary"), "fit")
        n, sums, largest = _sums(blocks, d)
        if n < 2:
            return None
        mean = np.array([s / n for s in sums])
        vectors, values, steps = bidiagonalise(blocks, d, mean, min(wanted, d))
        some = values > NEGLIGIBLE * values[0] if values[0] > 0 else np.zeros(len(values), bool)
        if not some.any():
            return None
        vectors, deviations = vectors[:, some], values[some] / np.sqrt(n)

        def moments(x):
            centred = x - mean
            z = (centred @ vectors) / deviations
            return np.concatenate([[np.square(centred).sum()], (z.T @ z).ravel()])

        found = _passed(blocks, blocks.rdd.getNumPartitions(), d, moments)
        c = len(deviations)
        error = float(np.abs(found[1:].reshape(c, c) / n - np.eye(c)).max())
        return Whitening(n, sums, largest, vectors, deviations, deviations**2 / (found[0] / n), error, steps)


def transform(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """Prepared rows with columns deviation and whitened (a number for each component) in place of _x."""
    names = [c for c in rows.columns if c.lower() not in ("_x", "deviation", "whitened")]

    @tidy
    def run(batches):
        for batch in batches:
            x = matrix(batch.column(len(names)), d)
            made = [pa.array(model.deviation(x), pa.int64()), pa.array(list(model.whitened(x)), pa.list_(pa.float64()))]
            yield pa.record_batch([*batch.columns[:-1], *made], names=[*names, "deviation", "whitened"])

    kept = rows.select(*[rows[c] for c in names], rows["_x"])
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{kinds}deviation bigint, whitened array<double>")


OP11_SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def op11_lanczos_whitening(spark, sf_dir: str) -> DataFrame:
    rows, d = prepared(read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding"), "embedding")
    model = fit(rows, d)
    if model is None:
        return spark.createDataFrame([], OP11_SCHEMA)
    out = transform(rows.select("vec_id", "_x"), d, model)
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
