"""Shared helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Word separators of every contract: space and the controls U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: What the scratch blocks that are open have written, the innermost last.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes, when it ends, the tables that operators wrote in the shared folder meanwhile; results must have been written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for name in _OPEN.pop():
            delete(spark, name)


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back with its schema: lost executors cost no recomputation.
    outer: it outlives the innermost scratch block."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if len(_OPEN) > outer:
        _OPEN[-1 - outer].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a written table."""
    return written(df, "step")


def words(text: Column) -> Column:
    """The text's words, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def utf8_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


#: What a broadcast may take of the driver, which holds it several times while it is sent.
BROADCAST_BYTES = 24 << 20


def broadcast_if_small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A broadcast hint only where the counted rows are few and their bytes, by the schema, small; beyond that the join is by sorting. Without a hint Spark
    would go by the size of the files, which compress: 10 MB of them may hold millions of ids."""
    width = 48 + sum(8 if isinstance(f.dataType, NumericType) else 128 for f in df.schema.fields)
    return F.broadcast(df) if rows <= min(most, BROADCAST_BYTES // width) else df.hint("merge")


#: Bits of a bitmap in a row of it, and of a whole one at most (16 MB).
BITMAP_ROW, MOST_BITS = 1 << 15, 1 << 27


def perhaps_among(df: DataFrame, key: str, ids: DataFrame, id_col: str, rows: int) -> DataFrame:
    """df without most of the rows whose key is none of the ids (`rows` of them), so that a join by exchange moves less. All tasks get a bitmap of the
    ids' hashes, 16 bits or more an id up to MOST_BITS; a row that it lets through may still match nothing."""
    bits = min(MOST_BITS, max(BITMAP_ROW, 1 << (16 * rows).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    hashed = ids.select(place(id_col).alias("_bm_place"))
    maps = hashed.groupBy(F.floor(F.col("_bm_place") / BITMAP_ROW).alias("_bm_row")).agg(F.bitmap_construct_agg(F.col("_bm_place") % BITMAP_ROW).alias("_bm_bits"))
    at = (place(key) % BITMAP_ROW).cast("int")
    byte = F.conv(F.hex(F.substring("_bm_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(maps), (F.floor(place(key) / BITMAP_ROW) == F.col("_bm_row")) & there, "left_semi")


def dealt_anew(column: str) -> Column:
    """The same number as an expression of its own: an aggregate keyed by it is exchanged once more before a join, as
    one row a key, and the other side's exchange stands right below the join, so that AQE can split a hot key over tasks."""
    return F.col(column).bitwiseXOR(F.lit(0)).alias(column)


def limit_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Texts go to Python in batches of a few MB: the default (by rows, 64 MB) is held twice in the JVM and in each worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if now == "67108864":  # the default; a choice of the user's stays
        spark.conf.set(key, str(most))


def release() -> None:
    """Gives freed memory of this worker back to the system: several workers share an executor's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run):
    """A function for mapInArrow that leaves no unused memory behind when its task ends."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        release()

    return tidied
