"""Sorted runs: flush, sparse index, floor lookup, block scan, merge and compaction.

A run is the state at some moment, written as Parquet sorted by key with Bloom filters on the key, so
that equality and range predicates skip files, row groups and pages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from keylode.operators.order import numbered, ranged, totals
from keylode.operators.state import byte_length, lww
from keylode.schema import BLOOM_FPP, FLUSH_BYTES, HEADER_BYTES, RUN_TRIGGER, SEGMENT_BYTES, SPARSE_INTERVAL


def segments(log: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """seq, record bytes, the running total and the segment that a record falls in; segments are cut by total bytes."""
    sized = log.select("seq", (F.lit(HEADER_BYTES) + byte_length(F.col("key")) + F.when(F.col("tombstone"), 0).otherwise(byte_length(F.col("value")))).cast("long").alias("record_bytes"))
    total = numbered(sized, "seq", "total_bytes", amount=F.col("record_bytes"))
    return total.withColumn("segment", F.floor((F.col("total_bytes") - 1) / segment_bytes).cast("long"))


def run_of(log: DataFrame, run_id: int, level: int = 0) -> DataFrame:
    return lww(log).select(F.lit(run_id).cast("long").alias("run_id"), F.lit(level).cast("int").alias("level"), "key", "value", "tombstone", "seq")


def run_numbers(log: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """seq, run_id: the run that each operation is flushed with.

    The size of the current state decides, and overwrites change it, so this fold is sequential.  Only
    seq, a hash of the key and two lengths of each operation pass through its one task, which holds the
    hashes and lengths of one state of the threshold's size.
    """
    slim = log.select("seq", F.xxhash64("key").alias("h"), F.octet_length("key").cast("long").alias("k"), F.when(F.col("tombstone"), 0).otherwise(byte_length(F.col("value"))).cast("long").alias("v"))

    def fold(batches):
        import pyarrow as pa

        held, size, run = {}, 0, 0
        for batch in batches:
            numbers = []
            for h, k, v in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                old = held.get(h)
                size += v + k if old is None else v - old
                held[h] = v
                numbers.append(run)
                if size >= threshold:
                    held, size, run = {}, 0, run + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64())], names=["seq", "run_id"])

    return slim.coalesce(1).sortWithinPartitions("seq").mapInArrow(fold, "seq long, run_id long")


def flush_runs(log: DataFrame, threshold: int = FLUSH_BYTES) -> DataFrame:
    """The runs that flushing at a byte threshold makes: run_id, key, value, tombstone, seq.

    seq is unique in the log.  Runs are numbered in order (``run_numbers``) and then folded in parallel.
    """
    placed = log.select("seq", "key", "value", "tombstone").join(run_numbers(log, threshold), "seq")
    newest = placed.groupBy("run_id", "key").agg(F.max_by(F.struct("value", "tombstone", "seq"), "seq").alias("op"))
    return newest.select("run_id", "key", F.when(~F.col("op.tombstone"), F.col("op.value")).alias("value"), F.col("op.tombstone").alias("tombstone"), F.col("op.seq").alias("seq"))


def write_run(run: DataFrame, path: str, *, expected: int | None = None, fpp: float = BLOOM_FPP, files: int | None = None) -> None:
    """Write a run sorted by key; without a count of expected keys it is counted.  An existing path is an error."""
    expected = run.count() if expected is None else expected
    files = files or max(1, -(-expected // 5_000_000))
    dealt = run.repartitionByRange(files, "key").sortWithinPartitions("key")
    (
        dealt.write.mode("error")
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.expected.ndv#key", str(max(1, -(-expected // files))))
        .option("parquet.bloom.filter.fpp#key", str(fpp))
        .option("parquet.enable.dictionary#key", "false")
        .option("parquet.block.size", str(32 << 20))
        .parquet(path)
    )


def read_runs(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def sparse_index(state: DataFrame, interval: int = SPARSE_INTERVAL) -> DataFrame:
    """Every interval-th key of the state, from the first: key, its number, its byte offset and the next entry's.

    Offsets are those of records in key order; the last entry's end is the end of the data.
    """
    sized = state.select("key", (F.lit(HEADER_BYTES) + byte_length(F.col("key")) + byte_length(F.col("value"))).cast("long").alias("bytes"))
    placed = totals(sized, "key", {"number": F.lit(1).cast("long"), "ends": F.col("bytes")})
    # A block ends where the next one starts, which is where its own last record ends.
    blocks = placed.groupBy(F.expr(f"(number - 1) div {interval}").alias("block"))
    return blocks.agg(F.min("key").alias("key"), (F.min("number") - 1).alias("number"), F.min(F.col("ends") - F.col("bytes")).alias("offset"), F.max("ends").alias("block_end")).drop("block")


def floor_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """For every probe key the greatest index key at or below it (null below the first), by one sort of both.

    An as-of join as a window over ranges of keys would sort all in one task, so probes and entries
    meet in ranges whose borders are entries; the last entry of earlier ranges is carried in.
    """
    both = probes.select("key", F.lit(True).alias("probe")).distinct().unionByName(index.select("key", F.lit(False).alias("probe")).distinct())
    split = ranged(both, "key")
    last = split.filter(~F.col("probe")).groupBy("range").agg(F.max("key").alias("top"))
    ranges = split.select("range").distinct().join(last, "range", "left")
    carried = ranges.select("range", F.last("top", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = Window.partitionBy("range").orderBy("key", F.col("probe").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    seen = split.withColumn("own", F.last(F.when(~F.col("probe"), F.col("key")), ignorenulls=True).over(within))
    return seen.filter("probe").join(F.broadcast(carried), "range").select("key", F.coalesce("own", "carried").alias("index_key"))


def block_range(state: DataFrame, index: DataFrame, key) -> DataFrame:
    """The rows of the block that may hold a key: from its floor entry to the next entry."""
    low, high = index.agg(F.max(F.when(F.col("key") <= F.lit(key), F.col("key"))), F.min(F.when(F.col("key") > F.lit(key), F.col("key")))).first()
    if low is None:
        return state.filter(F.lit(False))
    out = state.filter(F.col("key") >= F.lit(low))
    return out if high is None else out.filter(F.col("key") < F.lit(high))


def merge(*runs: DataFrame) -> DataFrame:
    """Newest operation of each key over runs: the highest run_id, then seq, wins."""
    every = reduce(DataFrame.unionByName, runs)
    newest = every.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "seq", "run_id"), F.struct("run_id", "seq")).alias("op"))
    return newest.select("key", F.when(~F.col("op.tombstone"), F.col("op.value")).alias("value"), F.col("op.tombstone").alias("tombstone"), F.col("op.seq").alias("seq"), F.col("op.run_id").alias("run_id"))


def compact(*runs: DataFrame, bottom_level: bool = True) -> DataFrame:
    """Merge runs; deleted keys go only if no older level may hold them."""
    if not runs:
        raise ValueError("no runs to compact")
    merged = merge(*runs)
    return merged.filter(~F.col("tombstone")) if bottom_level else merged


def needs_compaction(runs: int, trigger: int = RUN_TRIGGER) -> bool:
    return runs >= trigger


def bloom_semi_join(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is among keys: exact; the optimizer may put a Bloom filter before the join."""
    return rows.join(keys.select("key").distinct(), "key", "left_semi")
