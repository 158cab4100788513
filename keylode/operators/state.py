"""Current state from a change log: last writer wins by ``seq``.

A log has columns seq, key, value, tombstone (others pass unused).  All functions are plans: a predicate
on the key is pushed below the aggregate into the scan, and the aggregate combines before its shuffle,
so a hot key costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keylode.operators.order import numbered

def byte_length(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def put(rows: DataFrame) -> DataFrame:
    """Log rows of puts: seq, key, value."""
    return rows.select("seq", "key", "value", F.lit(False).alias("tombstone"))


def delete(rows: DataFrame) -> DataFrame:
    """Log rows of deletes: seq, key; the key need not exist."""
    value = rows.schema["key"].dataType.simpleString()
    return rows.select("seq", "key", F.lit(None).cast(value).alias("value"), F.lit(True).alias("tombstone"))


def lww(log: DataFrame) -> DataFrame:
    """One row a key: its newest operation, deletes included, their values hidden."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "seq"), "seq").alias("op"))
    value = F.when(~F.col("op.tombstone"), F.col("op.value"))
    return newest.select("key", value.alias("value"), F.col("op.tombstone").alias("tombstone"), F.col("op.seq").alias("seq"))


def live(log: DataFrame) -> DataFrame:
    """Keys and values that are not deleted.  The filter stands above the reduction: below, it would bring deleted keys back."""
    return lww(log).filter(~F.col("tombstone")).select("key", "value")


def get(state: DataFrame, key) -> DataFrame:
    """Point lookup: value and tombstone of one key; a deleted key is found."""
    return state.filter(F.col("key") == F.lit(key)).select("key", "value", "tombstone")


def multi_get(state: DataFrame, probes: DataFrame) -> DataFrame:
    """For every probe (column key): found, tombstone, value and the outcome."""
    hit = state.select(F.col("key").alias("k"), "value", "tombstone")
    out = probes.join(hit, F.col("key") == F.col("k"), "left")
    return out.select("key", F.col("k").isNotNull().alias("found"), F.coalesce("tombstone", F.lit(False)).alias("tombstone"), "value", outcome(F.col("k").isNotNull(), F.col("tombstone")).alias("outcome"))


def outcome(found: Column, tombstone: Column) -> Column:
    """live, deleted or absent."""
    return F.when(~found, "absent").when(tombstone, "deleted").otherwise("live")


def ordered_scan(state: DataFrame) -> DataFrame:
    """The state in ascending key order, deleted keys included; bytes compare unsigned."""
    return state.orderBy("key")


def range_scan(state: DataFrame, low=None, high=None) -> DataFrame:
    """Keys from low (inclusive) to high (exclusive)."""
    out = state
    if low is not None:
        out = out.filter(F.col("key") >= F.lit(low))
    if high is not None:
        out = out.filter(F.col("key") < F.lit(high))
    return out


def size_bytes(state: DataFrame) -> DataFrame:
    """Bytes of keys and current values."""
    return state.agg(F.coalesce(F.sum(byte_length(F.col("key")) + byte_length(F.col("value"))), F.lit(0)).cast("long").alias("memtable_bytes"))


def is_full(state: DataFrame, threshold: int) -> DataFrame:
    """Whether the state has reached the threshold (inclusive)."""
    return size_bytes(state).select("memtable_bytes", (F.col("memtable_bytes") >= threshold).alias("is_full"))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The state as it was after operation ``seq``."""
    return lww(log.filter(F.col("seq") <= seq))


def history(log: DataFrame) -> DataFrame:
    """Versions of each key in order, and the seq that ends each."""
    own = Window.partitionBy("key").orderBy("seq")
    return log.withColumn("version", F.row_number().over(own).cast("long")).withColumn("valid_to", F.lead("seq").over(own))


def write_counts(log: DataFrame) -> DataFrame:
    """Writes, deletes, first and last seq of each key."""
    return log.groupBy("key").agg(F.count("*").alias("writes"), F.count_if("tombstone").alias("deletes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def submit(requests: DataFrame, *, last_index: int = 0, term: int = 1, leader: int = 0, is_leader: bool = True) -> DataFrame:
    """Replies to puts and deletes (req_id, op, key, value) in the order of req_id: ok, index, term, leader.

    A leader gives each the next index after last_index; another node takes none, answers index -1 and
    names the leader.  Empty keys and other operations have no reply.
    """
    asked = requests.filter(F.col("op").isin("put", "delete") & (F.octet_length("key") > 0)).select("req_id", "op", "key", "value")
    if not is_leader:
        return asked.select("req_id", "op", "key", "value", F.lit(False).alias("ok"), F.lit(-1).cast("long").alias("index"), F.lit(term).cast("long").alias("term"), F.lit(leader).alias("leader"))
    placed = numbered(asked, "req_id", "index")
    return placed.select("req_id", "op", "key", "value", F.lit(True).alias("ok"), (F.col("index") + last_index).alias("index"), F.lit(term).cast("long").alias("term"), F.lit(leader).alias("leader"))


def submitted(replies: DataFrame) -> DataFrame:
    """The log rows of accepted puts and deletes; seq is the index."""
    gone = F.col("op") == "delete"
    return replies.filter("ok").select(F.col("index").alias("seq"), "key", F.when(~gone, F.col("value")).alias("value"), gone.alias("tombstone"))


def serve(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Replies to a batch of requests (req_id, op, key, value), as if run in the order of req_id.

    A get sees the newest put or delete of its key before it in the batch, else the state.  Operations
    other than put, get and delete have no reply, as have empty keys.
    """
    asked = requests.filter(F.col("op").isin("put", "get", "delete") & (F.octet_length("key") > 0))
    # Only asked keys leave the state: a batch costs its own size, and what the state's scan prunes.
    held = state.join(asked.select("key").distinct(), "key", "left_semi")
    old = held.select("key", F.lit(-1).cast("long").alias("req_id"), F.lit("old").alias("op"), "value", "tombstone")
    new = asked.select("key", "req_id", "op", "value", (F.col("op") == "delete").alias("tombstone"))
    every = new.unionByName(old)
    before = Window.partitionBy("key").orderBy("req_id").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("op") != "get", F.struct(F.when(~F.col("tombstone"), F.col("value")).alias("value"), "tombstone"))
    seen = every.withColumn("seen", F.last(written, ignorenulls=True).over(before)).filter(F.col("op") != "old")
    is_get = F.col("op") == "get"
    return seen.select("req_id", "op", "key", F.when(is_get, F.col("seen").isNotNull()).otherwise(F.lit(True)).alias("ok"), F.when(is_get, F.col("seen.value")).alias("value"), F.when(is_get, F.coalesce("seen.tombstone", F.lit(False))).otherwise(F.col("tombstone")).alias("tombstone"))
