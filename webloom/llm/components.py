"""Connected components of links, with linear memory everywhere and no driver-side graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checkpoint, tidy


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the links a[i] - b[i]."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = inverse[: len(a)], inverse[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def contract(batches):
    """Replaces the links of a partition by stars on their least nodes."""
    held, rows = [], 0

    def stars(held):
        node, root = roots(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        other = node != root
        return node[other], root[other]

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows > 1 << 20:
            held = [stars(held)]
            rows = len(held[0][0])
            if rows > 1 << 19:
                yield pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1])], names=["a", "b"])
                held, rows = [], 0
    if held:
        node, root = stars(held)
        yield pa.record_batch([pa.array(node), pa.array(root)], names=["a", "b"])


#: Links beyond which their joins are by sorting, whatever the size of their files says: a row of two ids is 64 bytes in a broadcast.
MOST_SENT = BROADCAST_BYTES // 64


@tidy
def _contract(batches):
    yield from contract(batches)


def components(links: DataFrame, contracted: bool = False, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a bigint, b bigint): root is the least node of its component.

    Alternates large-star and small-star steps after contracting each partition by itself; each step sends a
    link at most twice and ends when every node has one neighbour, its root. Loops and repeated links are harmless.
    contracted: the partitions are contracted already."""
    edges = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = checkpoint(edges if contracted else edges.mapInArrow(_contract, "a bigint, b bigint"))
    for _ in range(rounds):
        joined = (lambda df: df.hint("merge")) if edges.count() > MOST_SENT else (lambda df: df)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(joined(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(joined(least), "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = checkpoint(small.where("a <> b").distinct().mapInArrow(_contract, "a bigint, b bigint").distinct())
        child = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if child.where("n > 1").isEmpty() and edges.select("b").distinct().join(joined(child), F.col("b") == F.col("a"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
