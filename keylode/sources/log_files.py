"""Log files of checksummed records: a batch source (format ``keylode_log``) and an append sink.

A file is read by one task, piece by piece, through pyarrow's file systems; ``scan_records`` takes whole
files from any store that Spark reads.  ``write_log`` writes such files.  Files are ordered by name with numbers compared as numbers; a record's seq is its
file's rank and its offset.  A torn record ends its file; a wrong checksum fails the read, or, with
``mode`` = ``permissive``, ends its file.  A missing folder holds no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keylode.functions.codec import encode, records, stream
from keylode.schema import OP_LOG

SUFFIX = ".wal"
#: seq = rank of the file * 2^OFFSET_BITS + offset in it.
OFFSET_BITS = 36


def natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


class LogFile(InputPartition):
    def __init__(self, rank: int, path: str):
        self.rank, self.path = rank, path


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.strict = options.get("mode", "strict") != "permissive"

    def partitions(self):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted((x.path for x in found if x.is_file and x.path.endswith(SUFFIX)), key=lambda p: natural(p.rsplit("/", 1)[-1]))
        return [LogFile(k, p) for k, p in enumerate(names)] or [LogFile(-1, "")]

    def read(self, partition):
        from pyarrow import fs

        if partition.rank < 0:
            return
        store, _ = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), "")
        rows = ([], [], [], [])
        with store.open_input_stream(partition.path) as f:
            for at, key, value, tombstone in stream(f.read, strict=self.strict):
                for column, v in zip(rows, ((partition.rank << OFFSET_BITS) + at, key, value, tombstone), strict=True):
                    column.append(v)
                if len(rows[0]) >= 10_000:
                    yield self.batch(rows)
                    rows = ([], [], [], [])
        yield self.batch(rows)

    @staticmethod
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.bool_())], names=["seq", "key", "value", "tombstone"])


class LogSource(DataSource):
    @classmethod
    def name(cls):
        return "keylode_log"

    def schema(self):
        return OP_LOG

    def reader(self, schema):
        return LogReader(self.options)


def read_log(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.read.format("keylode_log").option("mode", "strict" if strict else "permissive").load(path)


def scan_records(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """The same rows from any store that Spark reads: whole files as binary, parsed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    names = sorted((r[0] for r in files.select("path").collect()), key=lambda p: natural(p.rsplit("/", 1)[-1]))
    ranks = {p: k for k, p in enumerate(names)}

    def parse(batches):
        for batch in batches:
            rows = ([], [], [], [])
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at, key, value, tombstone in records(data, strict=strict):
                    for column, v in zip(rows, ((ranks[p] << OFFSET_BITS) + at, key, value, tombstone), strict=True):
                        column.append(v)
            yield LogReader.batch(rows)

    return files.select("path", "content").mapInArrow(parse, "seq long, key binary, value binary, tombstone boolean")


def write_log(log: DataFrame, path: str, *, records_a_file: int = 1_000_000) -> int:
    """Write a log as files of records that read_log reads, in the order of seq; returns how many files.

    Files are cut by ranges of seq and written by tasks, each under a name of its own first; a task that
    runs again writes the same file again, so the last rename wins.  The folder must be new.
    """
    files = max(1, -(-log.count() // records_a_file))
    coded = with_records(log.select("seq", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "tombstone"))
    dealt = coded.repartitionByRange(files, "seq").sortWithinPartitions("seq").select("record")

    def write(batches):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        store.create_dir(folder, recursive=True)
        name, n = f"part_{TaskContext.get().partitionId():06d}{SUFFIX}", 0
        held = f"{folder}/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(held) as f:
            for batch in batches:
                for record in batch.column(0).to_pylist():
                    f.write(record)
                    n += 1
        store.move(held, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    return len(dealt.mapInArrow(write, "name string, n long").collect())


def parse_files(files: DataFrame, *, strict: bool = True) -> DataFrame:
    """files(rank, content): the records of whole files, wherever their bytes come from; seq as in read_log."""

    def parse(batches):
        for batch in batches:
            rows = ([], [], [], [])
            for rank, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at, key, value, tombstone in records(data, strict=strict):
                    for column, v in zip(rows, ((rank << OFFSET_BITS) + at, key, value, tombstone), strict=True):
                        column.append(v)
            yield LogReader.batch(rows)

    return files.select(F.col("rank").cast("long"), "content").mapInArrow(parse, "seq long, key binary, value binary, tombstone boolean")


def with_records(log: DataFrame) -> DataFrame:
    """The log with each row's encoded record."""
    return log.withColumn("record", encode(F.col("key"), F.col("value"), F.col("tombstone")))


def append_log(log: DataFrame, path: str) -> None:
    """Append a log's rows as encoded records, in the order of seq, as new Parquet part files (files are never appended to)."""
    with_records(log).select("seq", "record").sortWithinPartitions("seq").write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Log rows from append_log's folder; strict fails on a wrong checksum, else such rows are dropped."""
    from keylode.functions.codec import decode

    rows = decode(spark.read.schema("seq long, record binary").parquet(path))
    if strict:
        rows = rows.filter(F.coalesce(F.assert_true(F.col("valid"), F.lit("checksum mismatch")).isNull(), F.lit(True)))
    else:
        rows = rows.filter("valid")
    return rows.select("seq", "key", "value", "tombstone")
