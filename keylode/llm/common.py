"""Helpers shared by the corpus operators: columns, scratch tables, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Python takes from an Arrow batch at once: so many bytes, or one row if that is longer.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, text, *extra) alone, so that other columns, however named, cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on one machine, where it is unset, a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.keylode.scratch", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keylode-")
        spark.conf.set("spark.keylode.scratch", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    What a result still reads stays until the driver ends, and goes then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
        self.n = 0
        p = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)

    def write(self, df: DataFrame, *, drop: list[DataFrame] | None = None) -> DataFrame:
        """Write df and read it back; then delete the tables of drop, which nothing may read any more."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        for old in drop or []:
            self.drop(old)
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """A worker outlives its tasks: what a task has freed goes back to the system, for the stages that follow."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # a C library without it


def small_batches(spark: SparkSession) -> None:
    """For queries and pipeline stages, whose session is their own: Spark sends batches no larger than Python takes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most some BATCH_BYTES, whatever the session's settings are."""
    for batch in batches:
        rows = batch.num_rows
        while rows > 1 and batch.nbytes * rows > BATCH_BYTES * batch.num_rows:
            rows = (rows + 1) // 2
        for at in range(0, max(1, batch.num_rows), max(1, rows)):
            yield from halved(batch.slice(at, rows))


def halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A slice that one long row makes too large is cut on."""
    if batch.num_rows <= 1 or batch.nbytes <= BATCH_BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half))
        yield from halved(batch.slice(half))


def map_arrow(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with byte-bounded batches.  make() runs once in each task and returns the mapper."""

    def run(batches):
        try:
            yield from make()(bounded(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
