"""Approximate nearest neighbours by inner product: a neighbour graph by NN-descent, and greedy search in it.

Vectors are divided by the largest norm and get one more component that makes all of them unit vectors, so that a larger inner product
with a query always means a nearer point. Equal vectors are one point. Points are numbered from 0 in the order of their sides of random hyperplanes and fall into blocks of
neighbouring numbers: LEAST_BLOCKS for parallel work, or as many as keep a block to BLOCK_POINTS. A block (of queries: by hash, to BLOCK_QUERIES) is what one call of a Python
function holds, with each foreign vector that it asks for sent to it once.

The graph starts from random trees: points sorted by their sides of hyperplanes between random pairs of points are compared within stretches of LEAF. Then each round of
NN-descent joins, at every point, its new neighbours and the new points whose neighbour it is (SAMPLE nearest of each kind) with
one another and with as many old ones: neighbours of neighbours become candidates, and a pair is sent on where it beats the worst of a list.
Rounds end when few neighbours are new. A search keeps the BEAM nearest points found for each query, and each round visits the neighbours
of the EXPAND nearest ones not yet visited (joins of (block, point) with the graph, then with the vectors), until all of the beam are visited. It
starts at the query's own point where it has one, and at ENTRIES random points and as many of largest norm. Scores are inner products
of the original vectors in double precision. Copies of a point are put back at the end: the most that a list can hold for each.

The lists of the graph are bounded by NEAR, also of points that are near to very many; what a search returns is approximate, with recall
against brute force tested. Defined results: rows whose vector is null, zero or holds null or non-finite components, and rows without id, take no part; shorter vectors lack
zeros (they are padded to the longest); rows that repeat id and vector are one; a query never finds rows of its own id; with fewer candidates
than asked for all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_batches, read, scratch, tidy, written
from .vectors import finite, matrix, padded, width

LEAST_BLOCKS, BLOCK_POINTS, BLOCK_QUERIES = 64, 2048, 128
NEAREST, EVERY = 20, 20
NEAR_SCHEMA = "array<struct<b:bigint,sim:float,fresh:boolean>>"
POOL_SCHEMA = "array<struct<b:bigint,sim:float,open:boolean>>"


@dataclass(frozen=True)
class Settings:
    near: int = 40
    trees: int = 12
    leaf: int = 2048
    first: int = 16
    sample: int = 16
    rounds: int = 4
    few: float = 0.02
    beam: int = 96
    expand: int = 48
    entries: int = 64


@dataclass
class Index:
    points: DataFrame  # id, first (least row id), vector, norm, y
    placed: DataFrame  # row id, point
    graph: DataFrame  # id, adj
    kind: str
    n: int
    entries: list[int]
    settings: Settings


# Arrays in tasks.


def rows_of(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of an array."""
    if not len(column):
        return np.zeros((0, 0), dtype=kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def binaries(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def entries_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, then each field) of a column of lists of structs; null lists are empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    fields = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(fields.field(k).to_numpy(zero_copy_only=False) for k in range(fields.type.num_fields))


def lists_of(n: int, row: np.ndarray, names: list[str], fields: list[pa.Array]) -> pa.Array:
    """A column of n lists of structs, from entries in ascending order of their rows."""
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=names))


def best(row: np.ndarray, b: np.ndarray, sim: np.ndarray, flag: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each row the `most` entries of largest sim, each b once (as it stands first), nearest first."""
    o = np.lexsort((np.arange(len(b)), b, row))
    row, b, sim, flag = row[o], b[o], sim[o], flag[o]
    once = np.ones(len(b), dtype=bool)
    once[1:] = (row[1:] != row[:-1]) | (b[1:] != b[:-1])
    row, b, sim, flag = row[once], b[once], sim[once], flag[once]
    o = np.lexsort((b, -sim, row))
    row, b, sim, flag = row[o], b[o], sim[o], flag[o]
    some = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[some], b[some], sim[some], flag[some]


# Points.


def _packed(kind: str, d: int):
    @tidy
    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), d).astype(kind) + 0.0  # no negative zeros
            yield pa.record_batch([batch.column(0), binaries(x), pa.array(norms(x))], names=["id", "vector", "norm"])

    return run


def norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, initial=0.0)
    unit = x / np.where(top > 0, top, 1.0)[:, None]
    return top * np.sqrt((unit * unit).sum(axis=1))


def unit_points(x: np.ndarray, norm: np.ndarray, most: float) -> np.ndarray:
    part = norm / most
    return np.column_stack([x / most, np.sqrt(np.maximum(0.0, 1.0 - part * part))]).astype("<f4")


def _placing(kind: str, most: float, planes: np.ndarray):
    @tidy
    def run(batches):
        for batch in batches:
            y = unit_points(rows_of(batch.column("vector"), kind), batch.column("norm").to_numpy(), most) if batch.num_rows else np.zeros((0, len(planes)), "<f4")
            code = (y.astype(np.float32) @ planes > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64))
            yield pa.record_batch([*batch.columns, binaries(y), pa.array(code)], names=["vector", "first", "norm", "y", "code"])

    return run


def packed(df: DataFrame, id_col: str, vector_col: str, d: int | None = None) -> tuple[DataFrame, str, int]:
    """((id, vector, norm), the numbers' kind, width) of the rows that can be used."""
    element = df.schema[vector_col].dataType.elementType.simpleString()
    kind, zero = ("<f4", "float") if element == "float" else ("<f8", "double")
    rows = df.where(F.col(id_col).isNotNull() & finite(F.col(vector_col)) & F.exists(F.col(vector_col), lambda c: c != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{zero}>").alias("vector"))
    d = width(rows, "vector")[1] if d is None else d
    return rows.select("id", padded(F.col("vector"), d, zero).alias("vector")).mapInArrow(_packed(kind, d), "id bigint, vector binary, norm double"), kind, d


def _leaf_lists(settings: Settings):
    """Rows (tree, id, y) in the order of their codes: the nearest within stretches of a leaf's size."""

    def compared(ids, y):
        k = min(settings.first, len(ids) - 1)
        y = y.astype(np.float32)
        sim = y @ y.T
        np.fill_diagonal(sim, -np.inf)
        at = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), dtype=np.int64)
        near = np.take_along_axis(sim, at, 1)
        return pa.record_batch([pa.array(ids), lists_of(len(ids), np.repeat(np.arange(len(ids)), k), ["b", "sim"], [pa.array(ids[at].ravel()), pa.array(near.ravel())])], names=["id", "cand"])

    def leaves(ids, y, last):
        at = 0
        while len(ids) - at >= 2 * settings.leaf:
            yield at, at + settings.leaf
            at += settings.leaf
        if last and len(ids) > at:
            parts = math.ceil((len(ids) - at) / settings.leaf)
            cuts = np.linspace(at, len(ids), parts + 1).astype(int)
            yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())

    @tidy
    def run(batches):
        tree, ids, y = None, np.zeros(0, np.int64), None
        for batch in batches:
            trees = batch.column("tree").to_numpy()
            edges = [0, *(np.flatnonzero(trees[1:] != trees[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges, edges[1:]):
                if tree is not None and trees[a] != tree:
                    yield from (compared(ids[p:q], y[p:q]) for p, q in leaves(ids, y, True))
                    tree = None
                more, more_y = batch.column("id").slice(a, b - a).to_numpy(), rows_of(batch.column("y").slice(a, b - a), "<f4")
                ids, y = (more, more_y) if tree is None else (np.concatenate([ids, more]), np.concatenate([y, more_y]))
                tree, done = trees[a], 0
                for p, q in leaves(ids, y, False):
                    yield compared(ids[p:q], y[p:q])
                    done = q
                ids, y = ids[done:], y[done:]
        if tree is not None:
            yield from (compared(ids[p:q], y[p:q]) for p, q in leaves(ids, y, True))

    return run


def _codes(normals: list[np.ndarray], offsets: list[np.ndarray]):
    @tidy
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = rows_of(batch.column("y"), "<f4").astype(np.float32)
                for tree, (normal, offset) in enumerate(zip(normals, offsets)):
                    code = (y @ normal > offset) @ (1 << np.arange(normal.shape[1], dtype=np.int64))
                    yield pa.record_batch([pa.array(np.full(len(y), tree, "i4")), pa.array(code.astype(np.int64)), batch.column("id"), batch.column("y")], names=["tree", "code", "id", "y"])

    return run


def _merged(settings: Settings):
    """Rows (id, y, near, cand): new candidates join the neighbours; those sampled last are new no more."""

    @tidy
    def run(batches):
        for batch in batches:
            row, b, sim, fresh = entries_of(batch.column("near"))
            nth = np.cumsum(fresh) - 1
            before = np.concatenate([[0], np.cumsum(fresh)])[np.searchsorted(row, row)] if len(row) else nth
            fresh = fresh.astype(bool) & (nth - before >= settings.sample)
            more, mb, ms = entries_of(batch.column("cand"))
            found = best(np.concatenate([row, more]), np.concatenate([b, mb]), np.concatenate([sim, ms]), np.concatenate([fresh, np.ones(len(more), bool)]), settings.near)
            near = lists_of(batch.num_rows, found[0], ["b", "sim", "fresh"], [pa.array(found[1], pa.int64()), pa.array(found[2], pa.float32()), pa.array(found[3].astype(bool))])
            yield pa.record_batch([batch.column("id"), batch.column("y"), near], names=["id", "y", "near"])

    return run


def _local_join(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: (block, u, v, fresh), right: (block, w, y, worst). Pairs met at some u that beat the worst neighbour of the first."""
    ids = right.column("w").to_numpy()
    o = np.argsort(ids)
    ids, worst = ids[o], right.column("worst").to_numpy()[o]
    y = rows_of(right.column("y").combine_chunks(), "<f4").astype(np.float32)[o]
    u, fresh = left.column("u").to_numpy(), left.column("fresh").to_numpy(zero_copy_only=False)
    at = np.searchsorted(ids, left.column("v").to_numpy())
    o = np.argsort(u, kind="stable")
    u, at, fresh = u[o], at[o], fresh[o]
    cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), len(u)]
    keys, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for p, q in zip(cuts, cuts[1:]):
        new = np.unique(at[p:q][fresh[p:q]])
        if not len(new):
            continue
        old = np.setdiff1d(at[p:q][~fresh[p:q]], new)
        every = np.concatenate([new, old])
        sim = y[new] @ y[every].T
        better = sim > worst[new][:, None]
        np.fill_diagonal(better, False)
        i, j = np.nonzero(better)
        keys.append(new[i] * len(ids) + every[j])
        sims.append(sim[i, j])
        i, j = np.nonzero(sim[:, len(new) :] > worst[old][None])
        keys.append(old[j] * len(ids) + new[i])
        sims.append(sim[i, len(new) + j])
    key, first = np.unique(np.concatenate(keys), return_index=True)
    return pa.table({"a": ids[key // max(1, len(ids))], "b": ids[key % max(1, len(ids))], "sim": np.concatenate(sims)[first]})


def _links(state: DataFrame, settings: Settings) -> DataFrame:
    """(u, v, fresh): at u, its nearest new and old neighbours, and the nearest points that have it as theirs."""
    some = lambda fresh: F.slice(F.filter("near", lambda e: e["fresh"] == fresh), 1, settings.sample)
    ahead = state.select(F.col("id").alias("u"), F.explode(F.concat(some(True), some(False))).alias("e")).select("u", F.col("e.b").alias("v"), "e.fresh")
    return ahead.unionByName(_backward(state, settings.sample, "u", "fresh"))


def _backward(state: DataFrame, most: int, *keys: str) -> DataFrame:
    back = state.select(F.col("id").alias("v"), F.explode("near").alias("e")).select(F.col("e.b").alias("u"), "v", "e.sim", "e.fresh")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("sim"), "v"))
    return back.withColumn("nth", nth).where(F.col("nth") <= most).select("u", "v", "fresh")


def _block(point: Column, n: int) -> Column:
    return F.floor(point / F.lit(n / max(LEAST_BLOCKS, math.ceil(n / BLOCK_POINTS))))


def descend(state: DataFrame, n: int, settings: Settings) -> DataFrame:
    """One round of NN-descent over (id, y, near) of n points."""
    links = _links(state, settings).select(_block(F.col("u"), n).alias("block"), "u", "v", "fresh")
    worst = F.when(F.size("near") >= settings.near, F.get("near", F.lit(settings.near - 1))["sim"]).otherwise(F.lit(float("-inf"))).cast("float")
    vectors = links.select("block", "v").distinct().join(state.select(F.col("id").alias("v"), "y", worst.alias("worst")), "v").select(F.col("block").alias("home"), F.col("v").alias("w"), "y", "worst")
    met = links.groupBy("block").cogroup(vectors.groupBy("home")).applyInArrow(_local_join, "a bigint, b bigint, sim float")
    met = met.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    met = met.withColumn("nth", nth).where(F.col("nth") <= settings.near).groupBy("a").agg(F.collect_list(F.struct("b", "sim")).alias("cand"))
    return state.join(met, F.col("id") == F.col("a"), "left").select("id", "y", "near", "cand").mapInArrow(_merged(settings), f"id bigint, y binary, near {NEAR_SCHEMA}")


def neighbour_lists(points: DataFrame, n: int, settings: Settings, seed: int = 12) -> DataFrame:
    """(id, y, near) after NN-descent."""
    bits = max(0, math.ceil(math.log2(max(1, n / settings.leaf))))
    trees = settings.trees if bits else 1
    # Hyperplanes midway between pairs of a sample of two points for each plane.
    few = points.orderBy(F.xxhash64(F.lit(seed), "id")).limit(max(2, 2 * bits * trees)).select("y").toArrow()
    few = rows_of(few.column("y").combine_chunks(), "<f4").astype(np.float32)
    pairs = np.random.default_rng(seed).integers(0, len(few), (trees, max(1, bits), 2))
    normals = [(few[p[:, 0]] - few[p[:, 1]]).T for p in pairs]
    offsets = [((few[p[:, 0]] - few[p[:, 1]]) * (few[p[:, 0]] + few[p[:, 1]]) / 2).sum(axis=1) for p in pairs]
    order = ["tree", "code", F.xxhash64("id")]
    coded = points.select("id", "y").mapInArrow(_codes(normals, offsets), "tree int, code bigint, id bigint, y binary")
    lists = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_leaf_lists(settings), "id bigint, cand array<struct<b:bigint,sim:float>>")
    lists = lists.groupBy("id").agg(F.flatten(F.collect_list("cand")).alias("cand"))  # a list a tree
    empty = F.array().cast(NEAR_SCHEMA).alias("near")
    state = points.select("id", "y").join(lists, "id", "left").select("id", "y", empty, "cand")
    state = written(state.mapInArrow(_merged(settings), f"id bigint, y binary, near {NEAR_SCHEMA}"), "near")
    for _ in range(settings.rounds if bits else 0):  # one leaf compares all pairs
        state = written(descend(state, n, settings), "near")
        fresh = state.agg(F.sum(F.size(F.filter("near", lambda e: e["fresh"])))).first()[0]
        if fresh <= settings.few * settings.near * n:
            break
    return state


def numbered(ordered: DataFrame) -> tuple[DataFrame, int]:
    """Points with numbers from 0 without gaps in place of those that Spark counts in each partition: their counts, a row a partition, go by the driver."""
    part, start, n = F.shiftright("place", 33), [], 0
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():
        start.append((r["part"], n))
        n += r["count"]
    starts = ordered.sparkSession.createDataFrame(start, "part bigint, start bigint")
    points = ordered.join(F.broadcast(starts), part == F.col("part")).withColumn("id", F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("start"))
    return written(points.select("id", "first", "vector", "norm", "y"), "points"), n


def build(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None, seed: int = 12) -> Index | None:
    """Indexes every usable row; None if there is none. Its tables are written and belong to the scratch block that is open."""
    settings = settings or Settings()
    limit_batches(df.sparkSession)
    rows, kind, d = packed(df, id_col, vector_col)
    rows = written(rows.distinct(), "rows")
    most = rows.agg(F.max("norm")).first()[0]
    if not most:
        return None
    planes = np.random.default_rng(seed).standard_normal((d + 1, 24)).astype(np.float32)
    classes = rows.groupBy("vector").agg(F.min("id").alias("first"), F.max("norm").alias("norm"))
    classes = classes.mapInArrow(_placing(kind, most, planes), "vector binary, first bigint, norm double, y binary, code bigint")
    order = ["code", F.xxhash64("first")]
    points = classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    points, n = numbered(written(points.select("place", "first", "vector", "norm", "y"), "ordered"))
    placed = written(rows.select(F.col("id").alias("row"), "vector").join(points.select("vector", "id"), "vector").select("row", F.col("id").alias("point")), "placed")
    near = neighbour_lists(points, n, settings, seed)
    ahead = near.select(F.col("id").alias("u"), F.explode("near.b").alias("v"))
    graph = ahead.unionByName(_backward(near, settings.near, "u").drop("fresh")).groupBy("u").agg(F.collect_set("v").alias("adj"))
    graph = written(graph.select(F.col("u").alias("id"), "adj"), "graph")
    entries = [points.orderBy(o, "id").limit(settings.entries).select("id") for o in (F.xxhash64(F.lit(seed), "id"), F.desc("norm"))]
    return Index(points, placed, graph, kind, n, sorted({r["id"] for e in entries for r in e.collect()}), settings)


# Search.


def _reach(entries: list[int], expand: int, first: bool):
    """left: (block, q, start, vector, pool), right: (block, a, adj). Each query's points to look at, none of its beam."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        adjacent = dict(zip(right.column("a").to_pylist(), (np.asarray(x.values) for x in right.column("adj").combine_chunks()))) if right.num_rows else {}
        row, b, _, is_open = entries_of(left.column("pool").combine_chunks())
        cuts = np.searchsorted(row, np.arange(left.num_rows + 1))
        out = []
        for k, start in enumerate(left.column("start").to_pylist()):
            held = b[cuts[k] : cuts[k + 1]]
            asked = [start] * (start is not None) if first else held[is_open[cuts[k] : cuts[k + 1]].astype(bool)][:expand].tolist()
            extra = [np.array(entries + asked, dtype=np.int64)] if first else []
            met = np.unique(np.concatenate([np.zeros(0, np.int64), *extra, *(adjacent[a] for a in asked if a in adjacent)]))
            out.append(np.setdiff1d(met, held, assume_unique=True))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
        cands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))
        return left.append_column("cands", cands)

    return run


def _score(kind: str, settings: Settings):
    """left: (.., vector, pool, cands), right: (block, c, y). The beam of each query with what it has met."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("c").to_numpy()
        o = np.argsort(ids)
        ids = ids[o]
        y = rows_of(right.column("y").combine_chunks(), "<f4").astype(np.float32)[o]
        x = rows_of(left.column("vector").combine_chunks(), kind)
        x = (x / np.maximum(norms(x), np.finfo(np.float64).tiny)[:, None]).astype(np.float32)
        y = y if len(ids) else np.zeros((0, x.shape[1] + 1), np.float32)  # nothing new was met
        row, b, sim, is_open = entries_of(left.column("pool").combine_chunks())
        nth = np.cumsum(is_open) - 1
        before = np.concatenate([[0], np.cumsum(is_open)])[np.searchsorted(row, row)] if len(row) else nth
        is_open = is_open.astype(bool) & (nth - before >= settings.expand)
        cands = left.column("cands").combine_chunks()
        sizes = cands.value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        at = np.searchsorted(ids, cands.flatten().to_numpy())
        sims = [y[at[e - s : e]][:, :-1] @ x[k] for k, (s, e) in enumerate(zip(sizes.tolist(), ends.tolist()))]
        found = best(
            np.concatenate([row, np.repeat(np.arange(len(sizes)), sizes)]), np.concatenate([b, ids[at]]), np.concatenate([sim, *sims]).astype(np.float32), np.concatenate([is_open, np.ones(len(at), bool)]), settings.beam
        )
        pool = lists_of(left.num_rows, found[0], ["b", "sim", "open"], [pa.array(found[1], pa.int64()), pa.array(found[2], pa.float32()), pa.array(found[3].astype(bool))])
        return left.select(["block", "q", "start", "vector"]).append_column("pool", pool)

    return run


def _exact(kind: str, most: int):
    """left: (block, q, vector, pool), right: (block, b, vector, first). The beam's nearest by the original vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("b").to_numpy()
        o = np.argsort(ids)
        ids, first = ids[o], right.column("first").to_numpy()[o]
        y = rows_of(right.column("vector").combine_chunks(), kind).astype(np.float64)[o]
        x = rows_of(left.column("vector").combine_chunks(), kind).astype(np.float64)
        row, b, _, _ = entries_of(left.column("pool").combine_chunks())
        at = np.searchsorted(ids, b)
        score = (x[row] * y[at]).sum(axis=1)
        o = np.lexsort((first[at], -score, row))
        row, b, score = row[o], b[o], score[o]
        some = np.arange(len(row)) - np.searchsorted(row, row) < most
        return pa.table({"q": pa.array(left.column("q").to_numpy()[row[some]]), "point": pa.array(b[some]), "score": pa.array(score[some])})

    return run


def search(index: Index, queries: DataFrame, most: int = NEAREST) -> DataFrame:
    """(q, point, score): the nearest points found for each of queries (q bigint, start bigint, vector binary), q unique.
    start: the query's own point in the index, or null; vector: packed as the index's are."""
    settings, n = index.settings, max(1, queries.count())
    block = F.pmod(F.xxhash64("q"), F.lit(max(LEAST_BLOCKS, math.ceil(n / BLOCK_QUERIES)))).alias("block")
    beam = queries.select(block, "q", "start", "vector", F.array().cast(POOL_SCHEMA).alias("pool"))
    columns = f"block bigint, q bigint, start bigint, vector binary, pool {POOL_SCHEMA}"
    first = True
    while True:
        some = F.array_compact(F.array("start")) if first else F.slice(F.filter("pool", lambda e: e["open"]), 1, settings.expand)["b"]
        asked = beam.select("block", F.explode(some).alias("a")).distinct().join(index.graph, F.col("a") == F.col("id")).select(F.col("block").alias("home"), F.col("a").alias("a"), "adj")
        reach = _reach(index.entries, settings.expand, first)
        reached = written(beam.groupBy("block").cogroup(asked.groupBy("home")).applyInArrow(reach, f"{columns}, cands array<bigint>"), "reached")
        met = reached.select("block", F.explode("cands").alias("c")).distinct().join(index.points.select(F.col("id").alias("c"), "y"), "c").select(F.col("block").alias("home"), "c", "y")
        beam = written(reached.groupBy("block").cogroup(met.groupBy("home")).applyInArrow(_score(index.kind, settings), columns), "beam")
        first = False
        if beam.where(F.exists("pool", lambda e: e["open"])).isEmpty():
            break
    wanted = beam.select("block", F.explode("pool.b").alias("b")).distinct().join(index.points.select(F.col("id").alias("b"), "vector", "first"), "b").select(F.col("block").alias("home"), "b", "vector", "first")
    return beam.select("block", "q", "vector", "pool").groupBy("block").cogroup(wanted.groupBy("home")).applyInArrow(_exact(index.kind, most), "q bigint, point bigint, score double")


def with_rows(index: Index, found: DataFrame, most: int) -> DataFrame:
    """(q, best): the rows of the points found, (score, row) structs in their order. A point stands for the rows that share its vector, of which no more than `most` can matter."""
    nth = F.row_number().over(Window.partitionBy("point").orderBy("row"))
    rows = index.placed.withColumn("nth", nth).where(F.col("nth") <= most).select("point", "row")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))
    listed = found.join(rows, "point").withColumn("nth", nth).where(F.col("nth") <= most)
    return listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "row", "score"))).alias("best"))


def nearest_rows(index: Index, wanted: Column, most: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row of the index whose `row` id meets the condition."""
    asked = index.placed.where(wanted)
    queries = asked.select(F.col("point").alias("id")).distinct().join(index.points.select("id", "vector"), "id")
    found = search(index, queries.select(F.col("id").alias("q"), F.col("id").alias("start"), "vector"), most + 1)
    listed = written(with_rows(index, found, most + 1), "listed")
    own = F.slice(F.filter("best", lambda e: e["row"] != F.col("row")), 1, most)
    out = asked.join(listed, F.col("point") == F.col("q")).select(F.col("row").alias("query_id"), F.posexplode(own).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.row").alias("vec_id"), "e.score")


def op12_nn_descent(spark, sf_dir: str) -> DataFrame:
    with scratch(spark):
        index = build(read(spark, sf_dir, "embeddings"))
        if index is None:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        return written(nearest_rows(index, F.col("row") % EVERY == 0), "neighbours", outer=True)
