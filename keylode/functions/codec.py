"""Checksummed byte records: ``crc32 | key length | value length | tombstone | key | value``, big-endian.

Encoding and checking stay in the JVM.  The checksum covers all that follows it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylode.schema import HEADER_BYTES


class CorruptRecord(ValueError):
    """A record whose checksum does not match its bytes."""


def u32(n: Column) -> Column:
    """Four big-endian bytes of a number."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def body(key: Column, value: Column, tombstone: Column) -> Column:
    k = F.coalesce(key.cast("binary"), F.lit(b""))
    v = F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(u32(F.octet_length(k)), u32(F.octet_length(v)), F.when(tombstone, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), k, v)


def encode(key: Column, value: Column, tombstone: Column) -> Column:
    b = body(key, value, tombstone)
    return F.concat(u32(F.crc32(b)), b)


def encoded_bytes(key: Column, value: Column) -> Column:
    return (F.lit(HEADER_BYTES) + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def is_valid(record: Column) -> Column:
    """Whether the stored checksum is that of the rest."""
    return F.conv(F.hex(F.substring(record, 1, 4)), 16, 10).cast("long") == F.crc32(F.substring(record, F.lit(5), F.octet_length(record)))


def decode(records: DataFrame, column: str = "record") -> DataFrame:
    """key, value (null where deleted), tombstone and valid of each record; other columns stay."""
    r = F.col(column)
    at = lambda start, n: F.conv(F.hex(F.substring(r, start, n)), 16, 10).cast("int")
    k, v = at(5, 4), at(9, 4)
    deleted = F.substring(r, 13, 1) == F.lit(b"\x01")
    return records.withColumns({"key": F.substring(r, F.lit(HEADER_BYTES + 1), k), "value": F.when(~deleted, F.substring(r, F.lit(HEADER_BYTES + 1) + k, v)), "tombstone": deleted, "valid": is_valid(r)})


def encode_one(key: bytes, value: bytes | None, tombstone: bool = False) -> bytes:
    b = struct.pack(">IIB", len(key), len(value or b""), int(tombstone)) + key + (value or b"")
    return struct.pack(">I", zlib.crc32(b)) + b


def stream(read, *, strict: bool = True, size: int = 1 << 20) -> Iterator[tuple[int, bytes, bytes | None, bool]]:
    """records of a file that read(n) gives piece by piece: one piece and one record are held at a time."""
    held, base = b"", 0
    while True:
        more = read(size)
        held += more
        at = 0
        while at + HEADER_BYTES <= len(held):
            crc, k, v, t = struct.unpack_from(">IIIB", held, at)
            end = at + HEADER_BYTES + k + v
            if end > len(held):
                break
            if zlib.crc32(memoryview(held)[at + 4 : end]) != crc:
                if strict:
                    raise CorruptRecord(f"checksum mismatch at byte {base + at}")
                return
            key = held[at + HEADER_BYTES : at + HEADER_BYTES + k]
            yield base + at, key, None if t == 1 else held[at + HEADER_BYTES + k : end], t == 1
            at = end
        held, base = held[at:], base + at
        if not more:
            return  # what is left is a torn record


def records(data: bytes, *, strict: bool = True) -> Iterator[tuple[int, bytes, bytes | None, bool]]:
    """(offset, key, value, tombstone) of a file's records.

    A torn record at the end stops the scan.  A wrong checksum raises; unless strict, it ends the scan.
    Lengths are held against the file's rest before they are used.
    """
    at = 0
    while at + HEADER_BYTES <= len(data):
        crc, k, v, t = struct.unpack_from(">IIIB", data, at)
        end = at + HEADER_BYTES + k + v
        if end > len(data):
            return
        if zlib.crc32(memoryview(data)[at + 4 : end]) != crc:
            if strict:
                raise CorruptRecord(f"checksum mismatch at byte {at}")
            return
        key = data[at + HEADER_BYTES : at + HEADER_BYTES + k]
        yield at, key, None if t == 1 else data[at + HEADER_BYTES + k : end], t == 1
        at = end
