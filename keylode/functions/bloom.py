"""Bloom filters: sizing, the standard 32-bit MurmurHash3, and a serialised filter over a table's keys.

Queries that only need the effect use Parquet's own filters and semi joins; this module is for filters
whose bits must agree with others'.  The bits of a table are set by position: each distinct key gives k
positions, positions are made distinct by a grouped aggregate, and the filter is their OR.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.schema import BLOOM_FALLBACK_FPP, BLOOM_FPP

# The seed of the first hash, and the constants of MurmurHash3 (32 bits).
SEED = 0x9747B28C
C1, C2 = 0xCC9E2D51, 0x1B873593
MASK = 0xFFFFFFFF
LEAST_BITS = 64


def murmur3_32(data: bytes, seed: int = 0) -> int:
    h = seed
    whole = len(data) // 4
    for (k,) in struct.iter_unpack("<I", data[: 4 * whole]):
        k = k * C1 & MASK
        k = (k << 15 | k >> 17) * C2 & MASK
        h ^= k
        h = ((h << 13 | h >> 19) & MASK) * 5 + 0xE6546B64 & MASK
    if tail := data[4 * whole :]:
        k = int.from_bytes(tail, "little") * C1 & MASK
        h ^= (k << 15 | k >> 17) * C2 & MASK
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & MASK
    h = (h ^ h >> 13) * 0xC2B2AE35 & MASK
    return h ^ h >> 16


def sizing(expected: int, fpp: float = BLOOM_FPP) -> tuple[int, int]:
    """Bits and hashes for so many keys."""
    n = max(1, expected)
    p = fpp if 0 < fpp < 1 else BLOOM_FALLBACK_FPP
    bits = max(LEAST_BITS, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / n * math.log(2)))


def murmur3_32_of(data: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """murmur3_32 of the rows of a byte matrix, each with its own seed."""
    u = np.uint32
    turn = lambda x, r: x << u(r) | x >> u(32 - r)
    n, length = data.shape
    h, whole = seed.astype(u), length // 4
    words = np.ascontiguousarray(data[:, : 4 * whole]).view("<u4") if whole else np.zeros((n, 0), u)
    for i in range(whole):
        h = turn(h ^ turn(words[:, i] * u(C1), 15) * u(C2), 13) * u(5) + u(0xE6546B64)
    if length % 4:
        k = np.zeros(n, u)
        for i in range(length % 4):
            k |= data[:, 4 * whole + i].astype(u) << u(8 * i)
        h = h ^ turn(k * u(C1), 15) * u(C2)
    h = h ^ u(length)
    h = (h ^ h >> u(16)) * u(0x85EBCA6B)
    h = (h ^ h >> u(13)) * u(0xC2B2AE35)
    return h ^ h >> u(16)


def positions_of(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """A row of positions for each key; keys of one length are worked on together."""
    out = np.zeros((len(keys), hashes), np.int64)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    for length, at in by_length.items():
        data = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), length)
        a = murmur3_32_of(data, np.full(len(at), SEED, np.uint32))
        b = murmur3_32_of(data, a)
        out[at] = (a[:, None] + np.arange(hashes, dtype=np.uint32) * b[:, None]).astype(np.int64) % bits
    return out


def positions(key: bytes, bits: int, hashes: int) -> list[int]:
    a = murmur3_32(key, SEED)
    b = murmur3_32(key, a)
    return [(a + i * b & MASK) % bits for i in range(hashes)]


class Bloom:
    """A filter's bits; serialised as bits u64, hashes u64 (little-endian), then the bytes."""

    def __init__(self, bits: int, hashes: int, data: bytearray | None = None):
        self.bits, self.hashes = bits, hashes
        self.data = data if data is not None else bytearray(-(-bits // 8))

    @classmethod
    def of(cls, keys: Iterable[bytes], expected: int, fpp: float = BLOOM_FPP) -> Bloom:
        out = cls(*sizing(expected, fpp))
        for k in keys:
            out.add(k)
        return out

    def add(self, key: bytes) -> None:
        for p in positions(key, self.bits, self.hashes):
            self.data[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in positions(key, self.bits, self.hashes))

    def serialized_size(self) -> int:
        return 16 + len(self.data)

    def serialize(self) -> bytes:
        return struct.pack("<QQ", self.bits, self.hashes) + bytes(self.data)

    @classmethod
    def deserialize(cls, data: bytes) -> Bloom | None:
        """None if the bytes are too few."""
        if len(data) < 16:
            return None
        bits, hashes = struct.unpack_from("<QQ", data)
        if len(data) < 16 + -(-bits // 8):
            return None
        return cls(bits, hashes, bytearray(data[16 : 16 + -(-bits // 8)]))


def _positions(bits: int, hashes: int):
    @F.pandas_udf("array<long>")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(list(positions_of([bytes(k) for k in keys], bits, hashes)), index=keys.index)

    return of


def filter_bits(keys: DataFrame, expected: int, fpp: float = BLOOM_FPP) -> DataFrame:
    """position: the bits that the keys (column key, binary) set, each once."""
    bits, hashes = sizing(expected, fpp)
    return keys.select(F.explode(_positions(bits, hashes)(F.col("key").cast("binary"))).alias("position")).distinct()


def build(keys: DataFrame, expected: int, fpp: float = BLOOM_FPP) -> Bloom:
    """The filter of a table's keys; bytes with set bits (as many as the filter has at most) reach the driver."""
    bits, hashes = sizing(expected, fpp)
    rows = filter_bits(keys, expected, fpp).groupBy(F.expr("position div 8").alias("byte")).agg(F.expr("bit_or(1 << CAST(position % 8 AS INT))").alias("v"))
    data = bytearray(-(-bits // 8))
    for r in rows.toLocalIterator():
        data[r["byte"]] = r["v"]
    return Bloom(bits, hashes, data)


def probe(keys: DataFrame, filled: DataFrame, expected: int, fpp: float = BLOOM_FPP) -> DataFrame:
    """key, maybe for each distinct key: held against filled (filter_bits' rows) by a join, for filters too large to send."""
    bits, hashes = sizing(expected, fpp)
    at = keys.select("key").distinct().select("key", F.explode(F.array_distinct(_positions(bits, hashes)(F.col("key").cast("binary")))).alias("position"))
    found = at.join(filled.withColumn("set", F.lit(True)), "position", "left")
    return found.groupBy("key").agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("maybe"))


#: A filter that goes to every task has at most so many bytes.
SENT_BYTES = 64 << 20


def might_contain(bloom: Bloom):
    """A column function of binary keys: False only for keys that were never added.  Larger filters are for ``probe``."""
    if bloom.serialized_size() > SENT_BYTES:
        raise ValueError(f"a filter of {bloom.serialized_size()} bytes is not sent to every task; use probe")

    @F.pandas_udf("boolean")
    def check(keys: pd.Series) -> pd.Series:
        at = positions_of([bytes(k) for k in keys], bloom.bits, bloom.hashes)
        held = np.frombuffer(bloom.data, np.uint8)
        return pd.Series(((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1), index=keys.index)

    return check
