"""Uniform sharding by a hypergeometric communication matrix.

Rows are dealt to `blocks` virtual partitions by a hash. A seeded draw on the driver fixes how many rows
each block sends to each cell of each shard: a random matrix whose row sums are the blocks' counts and
whose column sums are the cells' exact sizes (multivariate hypergeometric, row after row). Every block
then puts its rows in a random order of its own and cuts that order by its matrix row; the rows are
exchanged, and every cell puts what it received in a second random order. The result is a uniform shuffle
in which shard sizes differ by one row at most, and no task holds more than a block or a cell. Shards are
made of `cells` ordered cells, so that a shard may be larger than a task.

The matrix has blocks * shards * cells entries: 131,072 for up to a billion rows, more of each for more rows, but a million
at most for 16 shards, so what the driver draws and what goes to the executors as a literal are bounded.

Defined results: null text counts as empty with size 1; rows with equal ids are ordered by size and
checksum, and rows equal in all three are interchangeable; an empty table gives an empty result. Columns
of the input pass through, but for shard and slot, which are replaced; names that start with `_sh_` are reserved.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, read, utf8_crc32

SHARDS = 16
#: Rows that a block or a cell holds, and the least and most blocks, and cells of a shard.
TASK_ROWS, BLOCKS, CELLS = 4_000_000, (256, 1024), (32, 64)


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """A uniform draw among the ways to send counts[p] rows of each block so that column c gets sizes[c]."""
    rng, left = np.random.default_rng(seed), np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        if n and left.sum() == n:
            out[p] = left
        elif n:
            out[p] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[p]
    return out


def even(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def shard_rows(df: DataFrame, keys: list[str], shards: int = SHARDS, blocks: int | None = None, cells: int | None = None, seed: int = 7) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 within the shard)."""
    tasks = -(-df.count() // TASK_ROWS) if not blocks or not cells else 0
    blocks, cells = blocks or min(BLOCKS[1], max(BLOCKS[0], tasks)), cells or min(CELLS[1], max(CELLS[0], -(-tasks // shards)))
    df = df.drop(*{"shard", "slot"}.difference(keys))
    block = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(blocks))
    tagged = df.withColumn("_sh_block", block)
    counts = dict(tagged.groupBy("_sh_block").count().collect())  # as many rows as blocks
    per_block = [counts.get(b, 0) for b in range(blocks)]
    sizes = [c for s in even(sum(per_block), shards) for c in even(s, cells)]
    matrix = communication_matrix(per_block, sizes, seed)
    upto = F.from_json(F.lit(json.dumps(np.cumsum(matrix, axis=1).tolist())), "array<array<bigint>>")
    start = np.concatenate([np.concatenate([[0], np.cumsum(sizes[s * cells : (s + 1) * cells])[:-1]]) for s in range(shards)]).astype(int)
    starts = F.from_json(F.lit(json.dumps(start.tolist())), "array<bigint>")

    first = Window.partitionBy("_sh_block").orderBy(F.xxhash64(F.lit(seed + 1), *keys), *keys)
    dealt = tagged.withColumn("_sh_at", F.row_number().over(first) - 1)
    # How many of the block's cells end at or before the row's place, by binary search.
    dealt = dealt.withColumn("_sh_ends", F.element_at(upto, (F.col("_sh_block") + 1).cast("int")))
    cell = F.lit(0)
    for k in reversed(range((shards * cells).bit_length())):
        step = F.lit(1 << k)
        dealt = dealt.withColumn("_sh_cell", cell)
        to = F.least(F.col("_sh_cell") + step, F.lit(shards * cells))
        cell = F.when((F.col("_sh_cell") + step <= shards * cells) & (F.element_at("_sh_ends", to) <= F.col("_sh_at")), to).otherwise(F.col("_sh_cell"))
    dealt = dealt.withColumn("_sh_cell", cell)
    second = Window.partitionBy("_sh_cell").orderBy(F.xxhash64(F.lit(seed + 2), *keys), *keys)
    placed = dealt.withColumn("slot", F.row_number().over(second) - 1 + F.element_at(starts, F.col("_sh_cell") + 1))
    return placed.withColumn("shard", F.floor(F.col("_sh_cell") / cells).cast("int")).select(*df.columns, "shard", "slot")


def op1_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1
    rows = checkpoint(docs.select("doc_id", size.alias("size"), utf8_crc32(F.col("text")).alias("text_crc32")))
    out = shard_rows(rows, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
