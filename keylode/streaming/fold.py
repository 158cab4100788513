"""State kept from a stream of log rows.

Last writer wins by seq is commutative and idempotent, so late, repeated and reordered rows need no
watermark; state is one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keylode.operators.state import lww


def read_log(spark: SparkSession, path: str, schema, *, files_a_batch: int = 100) -> DataFrame:
    """A folder of Parquet log files as a stream; files_a_batch bounds what a batch takes in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def state_stream(log: DataFrame) -> DataFrame:
    """The streaming form of the state; write it in complete or update mode."""
    return lww(log)


def write_changes(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's changed rows as log files: a sink that is itself reduced by seq, so a replayed batch changes nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.select("seq", "key", "value", "tombstone").write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return state_stream(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The current state from write_changes' folder."""
    return lww(spark.read.option("basePath", path).parquet(f"{path}/batch=*"))


def to_memory(log: DataFrame, name: str) -> StreamingQuery:
    """Run what is there through the stream and leave the state as a temporary table."""
    return state_stream(log).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
