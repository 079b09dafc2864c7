"""Token files of directly addressable codes.

Ids are written in ascending document order as blocks. A block holds whole documents and is an image of

    magic "WDAC", n_docs, n_tokens, n_levels (32-bit), document ends (64-bit each), then for each level:
    n_chunks (64-bit), the chunks (8 bits of an id each, lowest first), the continuation bitmap (bit i: chunk
    i goes on in the next level) and its rank directory (32-bit count of set bits before each 512 bits).

So the token at any place is read by following one chunk a level, its place in the next level being the
rank of its bit; no block is decoded for that. Blocks are rows of a Parquet table (part, block, doc_ids, n_tokens,
image), committed by Spark's writer, so a lost executor's task is written anew and never twice.

Documents are exchanged once, by ranges of their ids; the tokens before a part are summed from one row a
part. Defined results: null text counts as empty (only the end id); null ids come first; rows that repeat an
id are ordered by text; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, checkpoint, limit_batches, read, tidy, written
from .tokens import END_ID, encoder
from .wordhash import word_slices

MAGIC = b"WDAC"
BLOCK_TOKENS = 1 << 18
RANK_BITS = 512
#: Blocks whose starts (24 bytes each) a broadcast may hold; places that one request of a block may hold.
MOST_BLOCKS, MOST_ASKED = 1_000_000, 4096


def encode_block(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The image of one block; ids: unsigned 32-bit, ends: where each document ends."""
    levels, left = [], ids.astype("<u4")
    while True:
        more = left > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(left) // RANK_BITS) * RANK_BITS, dtype=np.uint8)
        padded[: len(more)] = more
        ones = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        levels.append(struct.pack("<Q", len(left)) + (left & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        left = left[more] >> 8
    return MAGIC + struct.pack("<III", len(ends), len(ids), len(levels)) + np.asarray(ends, dtype="<u8").tobytes() + b"".join(levels)


class Block:
    """Reads an image; token(i) touches one chunk a level."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.n_docs, self.n_tokens, n_levels = struct.unpack_from("<III", image, 4)
        self.ends = np.frombuffer(image, "<u8", self.n_docs, 16)
        at, self.levels = 16 + 8 * self.n_docs, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", image, at)
            chunks = np.frombuffer(image, np.uint8, n, at + 8)
            bits = np.frombuffer(image, np.uint8, -(-n // 8), at + 8 + n)
            at += 8 + n + len(bits)
            ranks = np.frombuffer(image, "<u4", -(-n // RANK_BITS), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                return value
            first = i // RANK_BITS * (RANK_BITS // 8)
            before = int(np.unpackbits(bits[first:byte]).sum()) + bin(int(bits[byte]) & ((1 << bit) - 1)).count("1")
            i = int(ranks[i // RANK_BITS]) + before
        return value

    def ids(self) -> np.ndarray:
        """All ids, from the last level up."""
        above = None
        for chunks, bits, _ in reversed(self.levels):
            out = chunks.astype("<u4")
            if above is not None:
                out[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= above << 8
            above = out
        return above

    def documents(self):
        ids, start = self.ids(), 0
        for end in self.ends.tolist():
            yield ids[start:end]
            start = end


BLOCKS = "part int, block int, doc_ids array<bigint>, n_tokens bigint, image binary"


def write_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes the token blocks of df in the shared folder; returns the written table."""
    limit_batches(df.sparkSession)

    @tidy
    def blocks(batches):
        from pyspark import TaskContext

        part, block, own = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        held, sizes, names, total = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("image", pa.binary())])

        def image():
            ids, ends = np.concatenate(held), np.cumsum(np.concatenate(sizes), dtype=np.uint64)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([encode_block(ids, ends)], pa.binary())], schema=schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, words in word_slices(batch.column(1), fold=False):
                ids, ends = own.encode(words, END_ID)
                held.append(ids)
                sizes.append(np.diff(ends, prepend=0))
                names += doc_ids[a : a + words.n_docs]
                total += len(ids)
                if total >= block_tokens:
                    yield image()
                    block, held, sizes, names, total = block + 1, [], [], [], 0
        if held:
            yield image()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return written(docs.mapInArrow(blocks, BLOCKS), "tokens")


def block_starts(files: DataFrame) -> DataFrame:
    """(part, block, before, n_tokens): the ids before each block. As many rows as blocks, of BLOCK_TOKENS ids each."""
    thin = files.select("part", "block", "n_tokens")
    parts = thin.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a part
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    thin = thin.withColumn("within", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).join(parts, "part")
    return checkpoint(thin.select("part", "block", (F.col("before") + F.col("within")).alias("before"), "n_tokens"))


def read_tokens(files: DataFrame) -> DataFrame:
    """A row for each document of the written table: doc_id, start, n_tokens, ids_crc32."""
    starts = block_starts(files).select("part", "block", "before")

    @tidy
    def documents(batches):
        for batch in batches:
            for doc_ids, image, before in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = Block(image)
                n = np.diff(own.ends.astype(np.int64), prepend=0)
                crcs = [zlib.crc32(ids.tobytes()) for ids in own.documents()]
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(before + own.ends.astype(np.int64) - n), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # The starts go to the images, so that these are not exchanged again.
    found = files.select("part", "block", "doc_ids", "image").join(broadcast_if_small(starts, starts.count(), MOST_BLOCKS), ["part", "block"]).select("doc_ids", "image", "before")
    return found.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_at(files: DataFrame, places: DataFrame, place_col: str = "place") -> DataFrame:
    """places with the id at each place of the whole sequence, null beyond its ends: each is sent to its block and read
    there by one chunk a level. (The Parquet page that holds the image is still read whole.)"""
    starts = block_starts(files).where("n_tokens > 0")
    wanted = places.select(F.col(place_col).cast("long").alias("_tk_at")).where("_tk_at >= 0").distinct()
    # Joined by stretches of BLOCK_TOKENS places: a block stands in those that it touches.
    stretch = lambda c: F.floor(c / BLOCK_TOKENS)
    starts = starts.withColumn("stretch", F.explode(F.sequence(stretch(F.col("before")), stretch(F.col("before") + F.col("n_tokens") - 1))))
    held = wanted.withColumn("stretch", stretch(F.col("_tk_at"))).join(starts, "stretch").where((F.col("_tk_at") >= F.col("before")) & (F.col("_tk_at") < F.col("before") + F.col("n_tokens")))
    asked = held.groupBy("part", "block", F.floor((F.col("_tk_at") - F.col("before")) / MOST_ASKED).alias("slice")).agg(F.first("before").alias("before"), F.collect_set("_tk_at").alias("at"))

    @tidy
    def tokens(batches):
        for batch in batches:
            for image, before, at in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = Block(image)
                yield pa.record_batch([pa.array(at, pa.int64()), pa.array([own.token(a - before) for a in at], pa.int64())], names=["_tk_at", "token"])

    found = files.select("part", "block", "image").join(asked, ["part", "block"]).select("image", "before", "at").mapInArrow(tokens, "_tk_at bigint, token bigint")
    return places.join(found, F.col(place_col).cast("long") == F.col("_tk_at"), "left").drop("_tk_at")


def op2_directly_addressable(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(read(spark, sf_dir, "documents")))
