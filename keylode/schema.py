"""Explicit schemas of the change log and of what is computed from it."""

from __future__ import annotations

from pyspark.sql import types as T

OP_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("tombstone", T.BooleanType(), False),
    ]
)
#: One row a key, deleted keys kept.
STATE = T.StructType([*OP_LOG.fields[1:], OP_LOG.fields[0]])
#: A sorted run adds where it comes from.
RUN = T.StructType([T.StructField("run_id", T.LongType(), False), T.StructField("level", T.IntegerType(), False), *STATE.fields])
REQUEST = T.StructType(
    [
        T.StructField("req_id", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)

# Defaults of the formats that results must agree with.
SEGMENT_BYTES = 8 << 20
FLUSH_BYTES = 2 << 20
SPARSE_INTERVAL = 8
BLOOM_FPP = 0.0001
BLOOM_FALLBACK_FPP = 0.001
RUN_TRIGGER = 4
HEADER_BYTES = 13
