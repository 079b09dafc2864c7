"""Sinks: upserts by key into Parquet tables, JSON, and compressed cache entries.

An upsert writes the new state of the table beside the old one and returns its place; readers switch when the writer
has committed, so a failed job leaves the old state whole."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master gets one of its own where that is unset."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return named or context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own in the shared folder: compressed, and read by the columns that are used."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_rows(df: DataFrame) -> DataFrame:
    """kept, for tables of many like rows: joins of it are by sorting. Spark estimates a table by its compressed files, of which a few MB hold millions of such rows,
    and would send them through the driver."""
    return kept(df).hint("merge")


def dropped(df: DataFrame) -> None:
    """Deletes the files of a kept table; df must be nothing but that table."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def upserted(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(spark: SparkSession, path: str, version: int, new: DataFrame, key: str) -> str:
    """Writes path/v=<version> from path/v=<version - 1> (if version > 0) and new."""
    old = spark.read.parquet(f"{path}/v={version - 1}") if version else None
    upserted(old, new, key).write.mode("overwrite").parquet(f"{path}/v={version}")
    return f"{path}/v={version}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def packed(value: Column) -> Column:
    """A struct as JSON bytes for a cache table; the table's codec compresses them."""
    return F.to_json(value).cast("binary")


def unpacked(raw: Column, schema: str) -> Column:
    return F.from_json(raw.cast("string"), schema)


class Conflict(Exception):
    """Another writer has committed that version."""


class Versions:
    """A table as numbered versions, each a folder of Parquet that a pointer file names. Data is written first, to a folder of its own; the pointer is made last,
    and only if no one has made it: of two writers of one version the second gets Conflict, and a job that fails leaves no version. Several parts (status and payload of one record) that go
    into one commit are seen together or not at all. Pointers carry an optional key (a stream's batch), so that a commit that is made again changes nothing.

    A version's file system must create files exclusively, as HDFS and local disks do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, version: int):
        return self._at(f"{self.path}/_versions/{version:012d}.json")

    def latest(self) -> int:
        """The last version's number, -1 before the first."""
        folder = self._at(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return -1
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n[:12].isdigit() and n.endswith(".json")), default=-1)

    def about(self, version: int) -> dict:
        stream = self._fs.open(self._pointer(version))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, part: str = "rows", version: int | None = None) -> DataFrame:
        about = self.about(self.latest() if version is None else version)
        return self.spark.read.parquet(f"{self.path}/{about['folder']}/{part}")

    def commit(self, version: int, key: str | None = None, **parts: DataFrame) -> int:
        """Makes the version of these parts. With a key, a version that has it already stands for this one."""
        if key is not None:
            done = self.with_key(key)
            if done is not None:
                return done
        folder = f"data-{version:012d}-{uuid.uuid4().hex}"
        for name, df in parts.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        text = json.dumps({"folder": folder, "key": key, "parts": sorted(parts)}).encode()
        try:
            out = self._fs.create(self._pointer(version), False)
        except Exception as e:
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)
            if self._fs.exists(self._pointer(version)):
                raise Conflict(f"{self.path}: version {version} is made") from e
            raise
        out.write(bytearray(text))
        out.close()
        return version

    def with_key(self, key: str) -> int | None:
        """The version that was committed with the key; the newest are looked at first."""
        return next((v for v in range(self.latest(), -1, -1) if self.about(v)["key"] == key), None)

    def upsert(self, new: DataFrame, by: str, key: str | None = None, part: str = "rows", tries: int = 5) -> int:
        """The latest version with the rows of new in place of those with the same key column; made again on what another writer committed meanwhile."""
        for _ in range(tries):
            last = self.latest()
            if key is not None and last >= 0 and (done := self.with_key(key)) is not None:
                return done
            old = self.read(part, last) if last >= 0 else None
            try:
                return self.commit(last + 1, key, **{part: upserted(old, new, by)})
            except Conflict:
                continue
        raise Conflict(f"{self.path}: others committed {tries} times meanwhile")


def each_batch(table: Versions, by: str, stream: str = "stream"):
    """A foreachBatch function that upserts batches by their ids: a batch that comes again changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch.dropDuplicates([by]), by, key=f"{stream}/{batch_id}")

    return run
