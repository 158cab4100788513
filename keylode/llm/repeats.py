"""Suffix-array dedup: find every unit covered by a string of units that starts twice in the corpus.

A unit is a byte (op2: strings of LENGTH bytes), or a word (the pipeline: strings of so many words, white
space between them not counting).  ``Strings`` says which, and how long the strings are.

1. Each string has an anchor: its gram of least hash, the first of equals.  Equal strings have equal
   anchors at equal offsets, so strings are gathered by anchors.  A run is the strings in a row that share
   one anchor's place (some two runs in a string's length).  Copies of a whole run are merged first and
   carry their count, so that a passage which very many documents hold is one row.
2. Runs that share an anchor but differ are cut into pieces of PIECE strings; all strings of a piece hold
   its core, which becomes one symbol, and pieces become short symbol strings.  A suffix array of them,
   built by linear grouping (``suffix``), brings equal strings side by side and so finds which repeat.
3. A group is settled by one array.  One of over GROUP runs is dealt out again by longer common parts
   until it fits: first by the cores of its pieces, then pieces are halved, each half taking the units
   that all its strings hold into its core.  Equal pieces are merged with their count each time; pieces
   of one string that share a core are equal, so this ends for any group.
4. Repeated strings are united into spans of each document and cut out.

Hashes of 64 bits and more stand for units within an anchor's group, itself a hash of 64 bits.

Defined results: a null text is empty; texts shorter than a string keep all; equal texts no shorter than
a string (repeated rows too) are repeated whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import Scratch, map_arrow, partitions, small_batches, table
from keylode.llm.suffix import suffix_array

LENGTH = 400
#: Passages of over so many words are told of too.
PASSAGE_WORDS = 50
#: Units of an anchor, or fewer for short strings: longer ones are seldom shared by strings that differ.
K = 64
WORD_K = 8
PIECE = 16
#: Differing runs, or pieces, that one suffix array takes of a group.
GROUP = 512
#: Bytes of units that are worked on at once, so that their hashes stay in a core's cache; longer texts
#: are taken in parts that overlap.
CHUNK = 1 << 16
#: Symbols of a suffix array.
SYMBOLS = 80_000
BROADCAST_ROWS = 100_000
NO_ID = -(1 << 62)

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


@dataclass(frozen=True)
class Strings:
    """Strings of ``length`` units: bytes, or words."""

    length: int
    words: bool = False

    def __post_init__(self):
        if self.length < self.gram + PIECE:
            raise ValueError(f"length is {self.length}, under {self.gram + PIECE}")

    @property
    def gram(self) -> int:
        """Units of an anchor: a power of two, at most a third of a string."""
        k = WORD_K if self.words else K
        while k > 4 and 3 * k > self.length:
            k //= 2
        return k

    @property
    def size(self) -> int:
        """Bytes of a unit."""
        return 8 if self.words else 1


def word_units(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in a row, each followed by a line end: hashes of all words, their first bytes and ends, and each text's first word."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = _IS_WORD[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    origin = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) + 1 for x in parts])])
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(origin), np.int64)
    at = np.flatnonzero(inside)
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, ends - starts)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * (_PLACE[place & 1023] ^ (place >> 10).astype(np.uint64) << np.uint64(1))
    h = np.add.reduceat(value, first)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31)), starts, ends, np.searchsorted(starts, origin)


def units_of(texts: list[str | None], strings: Strings) -> list:
    """Each text's units: its bytes, or its words' hashes."""
    parts = [x.encode() if x else b"" for x in texts]
    if not strings.words:
        return parts
    out, at = [], 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and held < CHUNK:
            held += len(parts[end])
            end += 1
        h, _, _, bounds = word_units(parts[at:end])
        out += [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        at = end
    return out


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams (k: a power of two), each of two halves."""
    g, s = _BYTE[data] if data.dtype == np.uint8 else data, 1
    while s < k:
        n = max(0, len(g) - s)
        x = g[:n] * np.uint64(0x9E3779B97F4A7C15) + g[s:]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        g = x ^ (x >> np.uint64(32))
        s *= 2
    return g


def runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each run of strings, its anchor's place and hash."""
    k = Strings(length, words=data.dtype != np.uint8).gram
    n, width = len(data) - length + 1, length - k + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    g = grams(data, k)
    low = np.uint64((1 << 28) - 1)  # places within a chunk; longer texts are worked on in parts
    m = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    s = 1
    while 2 * s <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if width > s:
        m = np.minimum(m[: len(m) - (width - s)], m[width - s :])
    at = (m[:n] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.append(first[1:] - 1, n - 1), at[first], g[at[first]]


def runs_of(texts: list, length: int = LENGTH):
    """Of each text (its units) in turn: a list of (first start, strings, anchor's offset, anchor's hash)."""
    whole = lambda x: np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    long = [i for i, x in enumerate(texts) if len(x) >= length]
    at = 0
    while at < len(long):
        most = CHUNK if isinstance(texts[long[at]], bytes) else CHUNK // 8
        part, held = [], 0
        while at < len(long) and (not part or held < most):
            part.append(long[at])
            held += len(texts[long[at]])
            at += 1
        if len(part) == 1 and held > most:
            text, base = texts[part[0]], 0
            while base + length <= len(text):  # every string lies in one of the parts
                end = min(len(text), base + most + length - 1)
                for a, b, p, h in zip(*(x.tolist() for x in runs(whole(text)[base:end], length)), strict=True):
                    out[part[0]].append((base + a, b - a + 1, p - a, h))
                base += most
            continue
        joined = np.concatenate([whole(texts[i]) for i in part])
        edges = np.cumsum([0, *[len(texts[i]) for i in part]])
        first, last, place, h = runs(joined, length)
        owner = np.searchsorted(edges, first, side="right") - 1
        for a, b, p, x, k in zip(first.tolist(), last.tolist(), place.tolist(), h.tolist(), owner.tolist(), strict=True):
            while a <= b:  # a run over a border of texts: only its strings within one text count
                end = int(edges[k + 1])
                to = min(b, end - length)
                if a <= to:
                    out[part[k]].append((a - int(edges[k]), to - a + 1, p - a, x))
                a, k = end, k + 1
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(docs: DataFrame, *extra) -> DataFrame:
    own = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(own).alias("th"), own.alias("text"), *extra)


def anchored(docs: DataFrame, strings: Strings) -> DataFrame:
    """h (anchor), p (hash of the run), id, th, m strings, o (anchor's offset), at: where the document has the run."""
    schema = pa.schema([("h", pa.int64()), ("p", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("m", pa.int32()), ("o", pa.int32()), ("at", pa.list_(pa.int64()))])

    def make():
        import xxhash

        digest, size, more = xxhash.xxh3_64_intdigest, strings.size, strings.length - 1

        def run(batches):
            for batch in batches:
                columns = tuple([] for _ in schema)
                units = units_of(batch.column(2).to_pylist(), strings)
                for id_, th, own, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), units, runs_of(units, strings.length), strict=True):
                    data, seen = memoryview(own).cast("B") if found else b"", {}
                    for a, m, o, h in found:
                        seen.setdefault((h, digest(data[size * a : size * (a + m + more)], o), m, o), []).append(a)
                    for (h, p, m, o), at in seen.items():
                        for column, v in zip(columns, (signed(h), signed(p), id_, th, m, o, at), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(schema, columns, strict=True)], schema=schema)

        return run

    return map_arrow(keyed(docs), make, "h long, p long, id long, th long, m int, o int, at array<long>")


def pieces(units: bytes, start: int, m: int, o: int, strings: Strings):
    """(block, first string's start, strings, core, left, right) of a run; units holds the run's from start on."""
    anchor, length, size = start + o, strings.length, strings.size
    cut = lambda x, y: units[size * (x - start) : size * (y - start)]
    for j in range(max(0, o - m + 1) // PIECE, o // PIECE + 1):
        high, low = anchor - PIECE * j, anchor - PIECE * j - PIECE + 1
        a, b = max(start, low), min(start + m - 1, high)
        if a <= b:
            yield j, a, b - a + 1, cut(high, low + length), cut(a, high), cut(low + length, b + length)


class Open:
    """Pieces of several groups, to be settled by one suffix array.  All strings have ``width`` symbols."""

    def __init__(self, width: int, size: int):
        self.width, self.size = width, size
        self.clear()

    def clear(self):
        self.symbols: list[int] = []
        self.owner: list[int] = []  # of each symbol: the piece if a string starts there, else -1
        self.pieces: list[tuple | None] = []  # (id, th, start) of pieces to report
        self.starts: list[int] = []
        self.number: dict[int, int] = {}  # words' hashes, numbered as they come: any order of symbols will do
        self.cores = 0

    def units(self, data: bytes) -> list[int]:
        if self.size == 1 or not data:
            return [2 * x for x in data]
        number = self.number
        return [2 * number.setdefault(x, len(number)) for x in memoryview(data).cast("Q")]

    def add(self, core: int, left: bytes, right: bytes, strings: int, owner: tuple | None):
        k = len(self.pieces)
        self.pieces.append(owner)
        self.starts.append(len(self.symbols))
        left, right = self.units(left), self.units(right)
        self.symbols += [*left, 2 * core + 1, *right]
        self.owner += [k] * strings + [-1] * (len(left) + 1 + len(right) - strings)
        self.symbols.append(-1 - k)  # of its own: no string runs over it
        self.owner.append(-1)

    def group(self, wholes):
        """wholes: (left, right, strings, owner or None) of each differing piece of one core."""
        for left, right, n, owner in wholes:
            self.add(self.cores, left, right, n, owner)
        self.cores += 1

    def settle(self):
        """(id, th, first, last start) of the repeated strings."""
        s, owner = self.symbols, self.owner
        found: dict[int, set[int]] = {}
        order = suffix_array(s)
        for x, y in zip(order, order[1:], strict=False):
            if owner[x] >= 0 and owner[y] >= 0 and s[x : x + self.width] == s[y : y + self.width]:
                for z in (x, y):
                    if self.pieces[owner[z]] is not None:
                        found.setdefault(owner[z], set()).add(z - self.starts[owner[z]])
        for k, at in found.items():
            id_, th, start = self.pieces[k]
            at = sorted(at)
            a = at[0]
            for x, y in zip(at, [*at[1:], None], strict=True):
                if y != x + 1:
                    yield id_, th, start + a, start + x
                    a = y
        self.clear()


FOUND = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
FOUND_SQL = "id long, th long, first long, last long"


def arrays(rows: DataFrame, keys: list[str], close, width: int, size: int) -> DataFrame:
    """Deal rows by keys, and settle the groups of a task in arrays of some SYMBOLS symbols.

    close(group, open, done) adds a group's pieces to open, and to done what copies alone decide.
    """

    def make():
        def run(batches):
            open_, done = Open(width, size), []

            def out():
                done.extend(open_.settle())
                got = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.int64()) for i in range(4)], schema=FOUND)
                done.clear()
                return got

            group, current = [], None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key, rest = row[: len(keys)], row[len(keys) :]
                    if key != current:
                        close(group, open_, done)
                        group, current = [], key
                        if len(open_.symbols) >= SYMBOLS or len(done) >= SYMBOLS:
                            yield out()
                    group.append(rest)
            close(group, open_, done)
            yield out()

        return run

    return map_arrow(rows.repartition(partitions(rows), *keys).sortWithinPartitions(*keys), make, FOUND_SQL)


def settled(runs: DataFrame, strings: Strings) -> DataFrame:
    """runs: h, id, th, s, m, o, c, units of differing runs -> id, th, first, last start of repeated strings."""

    def close(group, open_, done):
        import xxhash

        by_core: dict[tuple, dict[tuple, list]] = {}
        for id_, th, s, m, o, c, units in group:
            for j, a, n, core, left, right in pieces(units, s, m, o, strings):
                by_core.setdefault((j, xxhash.xxh3_128_digest(core)), {}).setdefault((left, right, n), []).append((id_, th, a, n, c))
        for wholes in by_core.values():
            for members in wholes.values():
                if len(members) > 1 or members[0][4] > 1:
                    done.extend((id_, th, a, a + n - 1) for id_, th, a, n, c in members if c == 1)
            if len(wholes) > 1:
                open_.group((left, right, n, members[0][:3] if len(members) == 1 and members[0][4] == 1 else None) for (left, right, n), members in wholes.items())

    return arrays(runs.select("h", "id", "th", "s", "m", "o", "c", "units"), ["h"], close, PIECE, strings.size)


def split(rows: DataFrame, strings: Strings, scratch: Scratch) -> list[DataFrame]:
    """rows: g1, g2 (core), id, th, a, n, c, left, right of pieces of groups that were too large -> the same."""
    out, width, key, size = [], PIECE, ["g1", "g2"], strings.size

    def close(group, open_, done):
        open_.group((left, right, n, None if c > 1 else (id_, th, a)) for id_, th, a, n, c, left, right in group)

    while True:
        named = rows.withColumn("w1", F.xxhash64("left", F.lit(1), "right", "n")).withColumn("w2", F.xxhash64(F.lit(7), "right", F.lit(2), "left", "n"))
        merged = scratch.write(named.groupBy(*key, "w1", "w2").agg(F.sum(F.least("c", F.lit(2))).alias("c"), F.min(F.struct("id", "th", "a")).alias("ref"), F.first("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right")))
        again = scratch.write(merged.filter("c > 1").select(*key, "w1", "w2"))
        out.append(named.filter("c = 1").join(sent(again), [*key, "w1", "w2"], "left_semi").select("id", "th", F.col("a").alias("first"), (F.col("a") + F.col("n") - 1).alias("last")))
        groups = scratch.write(merged.groupBy(*key).agg(F.count("*").alias("k")).filter("k > 1"))
        open_ = merged.join(sent(groups), key).select(*key, "ref.id", "ref.th", "ref.a", "n", F.least("c", F.lit(2)).cast("int").alias("c"), "left", "right", "k")
        out.append(arrays(open_.filter(F.col("k") <= GROUP).drop("k"), key, close, width, size))
        if width == 1 or not groups.filter(F.col("k") > GROUP).limit(1).count():
            return out
        # Halves: the strings that start ``half`` units or more before the core, and all others.
        half = width // 2
        left, n = F.expr(f"octet_length(left) div {size}"), F.col("n")
        before, rest = F.greatest(F.lit(0), F.least(n, left - half + 1)), F.greatest(F.lit(0), left - half + 1)
        part = lambda c, start, units=None: F.expr(f"substring({c}, {start} * {size} + 1" + (f", {units} * {size})" if units is not None else ")"))
        sides = open_.filter(F.col("k") > GROUP).withColumn("l", left.cast("int")).withColumn("na", before.cast("int")).withColumn("ib", rest.cast("int"))
        a = sides.filter("na > 0").select(*key, F.lit(0).alias("side"), part("left", f"(l - {half})").alias("common"), "id", "th", "a", F.col("na").alias("n"), "c", part("left", "0", f"(l - {half})").alias("left"), part("right", "0", f"greatest(0, {width} - 2 - l + na)").alias("right"))
        b = sides.filter("n > ib").select(*key, F.lit(1).alias("side"), part("right", "0", str(half)).alias("common"), "id", "th", (F.col("a") + F.col("ib")).alias("a"), (n - F.col("ib")).alias("n"), "c", part("left", "ib").alias("left"), part("right", str(half)).alias("right"))
        both = a.unionByName(b)
        rows = scratch.write(both.select(F.xxhash64(*key, "side", "common").alias("g1"), F.xxhash64("common", "side", *reversed(key)).alias("g2"), "id", "th", "a", "n", "c", "left", "right"))
        width = half


def sent(written: DataFrame) -> DataFrame:
    """A written table for a join: sent everywhere if it has been counted as small, else shuffled."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def repeated_spans(docs: DataFrame, strings: Strings | int = LENGTH) -> DataFrame:
    """id, th (key of a text) and spans: what of it is repeated, as merged (start, end) in units."""
    strings = strings if isinstance(strings, Strings) else Strings(strings)
    length = strings.length
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(anchored(docs, strings))
    # All firsts are of one row.  Numbers alone, and no struct, are summed in a hash table without a sort.
    by_run = scratch.write(found.withColumn("s", F.get("at", F.lit(0))).groupBy("h", "p").agg(F.sum(F.size("at")).alias("c"), *[F.first(x).alias(x) for x in ("id", "th", "s", "m", "o")]))
    again = by_run.filter("c > 1").select("h", "p")
    whole = found.join(again, ["h", "p"], "left_semi").select("id", "th", "m", F.explode("at").alias("first")).select("id", "th", "first", (F.col("first") + F.col("m") - 1).alias("last"))
    whole = scratch.write(whole, drop=[found])
    differing = scratch.write(by_run.groupBy("h").agg(F.count("*").alias("k"), F.count_if(F.col("c") == 1).alias("single")).filter("k > 1 AND single > 0").select("h", "k"))
    wanted = by_run.join(sent(differing), "h").select("id", "th", F.struct("h", "s", "m", "o", F.least("c", F.lit(2)).cast("int").alias("c"), (F.col("k") > GROUP).alias("hot")).alias("run"))
    per_doc = scratch.write(wanted.groupBy("id", "th").agg(F.collect_list("run").alias("runs")), drop=[by_run, differing])

    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("m", pa.int32()), ("o", pa.int32()), ("c", pa.int32()), ("units", pa.binary()), ("hot", pa.bool_()), ("g1", pa.int64()), ("g2", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])

    def make():
        import xxhash

        def run(batches):
            for batch in batches:
                columns, held = tuple([] for _ in schema), 0
                texts = units_of(batch.column(2).to_pylist(), strings)
                for id_, th, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist(), strict=True):
                    data = memoryview(data).cast("B")
                    for r in wanted:
                        h, s, m, o, c = r["h"], r["s"], r["m"], r["o"], r["c"]
                        own = bytes(data[strings.size * s : strings.size * (s + m - 1 + length)])
                        if not r["hot"]:
                            rows = [(h, id_, th, s, m, o, c, own, False, 0, 0, 0, 0, b"", b"")]
                        else:
                            rows = []
                            for j, a, n, core, left, right in pieces(own, s, m, o, strings):
                                x = xxhash.xxh3_128_intdigest(core + h.to_bytes(8, "little", signed=True) + j.to_bytes(4, "little"))
                                rows.append((h, id_, th, 0, 0, 0, c, b"", True, signed(x >> 64), signed(x & (1 << 64) - 1), a, n, left, right))
                        for row in rows:
                            held += len(row[7]) + 100
                            for column, v in zip(columns, row, strict=True):
                                column.append(v)
                    if held > 4 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(schema, columns, strict=True)], schema=schema)
                        columns, held = tuple([] for _ in schema), 0
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(schema, columns, strict=True)], schema=schema)

        return run

    held = keyed(docs).filter("text IS NOT NULL").join(per_doc, ["id", "th"]).select("id", "th", "text", "runs")
    cut = scratch.write(map_arrow(held, make, "h long, id long, th long, s long, m int, o int, c int, units binary, hot boolean, g1 long, g2 long, a long, n int, left binary, right binary"), drop=[per_doc])
    every = whole.unionByName(settled(cut.filter("NOT hot"), strings))
    if cut.filter("hot").limit(1).count():
        hot = scratch.write(cut.filter("hot").select("g1", "g2", "id", "th", "a", "n", "c", "left", "right"))
        for part in split(hot, strings, scratch):
            every = every.unionByName(part)
    spans = every.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("strings"))
    merged = F.aggregate(
        "strings",
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["first"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["last"] + length).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(x["first"].alias("start"), (x["last"] + length).alias("end"))))),
    )
    return spans.select("id", "th", merged.alias("spans"))


def removed(docs: DataFrame, *extra, strings: Strings | int = LENGTH) -> DataFrame:
    """doc_id, text, extra columns and the spans (in units) that are to go, for every document."""
    # The document's own null id is kept apart from the key.
    own = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), *extra)
    return own.join(repeated_spans(docs, strings), ["id", "th"], "left").select("doc_id", "text", "spans", *[x for x in own.columns if x not in ("id", "th", "doc_id", "text")])


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of repeated strings of LENGTH bytes, then what of the text lies in repeated
    passages of over PASSAGE_WORDS words: n_passages and passage_words.

    Many such passages are shorter than LENGTH bytes, so that nothing of them is removed here.
    """
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    passages = repeated_spans(docs, Strings(PASSAGE_WORDS + 1, words=True)).withColumnRenamed("spans", "passages")
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(repeated_spans(docs), ["id", "th"], "left").join(passages, ["id", "th"], "left").select("doc_id", "text", "spans", "passages")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("passage_words", pa.int64())])

    def make():
        def run(batches):
            for batch in batches:
                columns = tuple([] for _ in schema)
                for doc_id, text, spans, passages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    text, kept, at = (text or "").encode(), hashlib.sha256(), 0
                    view = memoryview(text)
                    for x in spans or []:
                        kept.update(view[at : x["start"]])
                        at = x["end"]
                    kept.update(view[at:])
                    lengths = [[x["end"] - x["start"] for x in found or []] for found in (spans, passages)]
                    for column, v in zip(columns, (doc_id, len(text), sum(lengths[0]), len(lengths[0]), kept.hexdigest(), len(lengths[1]), sum(lengths[1])), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(schema, columns, strict=True)], schema=schema)

        return run

    return map_arrow(rows, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long")


def without_repeats(docs: DataFrame, words: int | None = None) -> DataFrame:
    """doc_id, text, lang, source, n_chars of every document, its repeated spans cut out of the text.

    Spans are made of repeated strings of LENGTH bytes; a character of which only some bytes are repeated
    stays.  With ``words``, spans are made of repeated strings of words + 1 words, so that every passage of
    over so many words that repeats is cut, from its first word to its last.
    """
    strings = Strings(LENGTH) if words is None else Strings(words + 1, words=True)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])

    def make():
        def run(batches):
            for batch in batches:
                out, sizes = [], []
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if spans:
                        data, kept, at = text.encode(), [], 0
                        for start, end in byte_spans(data, [(x["start"], x["end"]) for x in spans], strings):
                            while start < end and data[start] & 0xC0 == 0x80:
                                start += 1
                            while start < end < len(data) and data[end] & 0xC0 == 0x80:
                                end -= 1
                            kept.append(data[at:start])
                            at = end
                        text = b"".join([*kept, data[at:]]).decode()
                    out.append(text)
                    sizes.append(len(text or ""))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3), batch.column(4), pa.array(sizes, pa.int64())], schema=schema)

        return run

    return map_arrow(removed(docs, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), strings=strings), make, "doc_id long, text string, lang string, source string, n_chars long")


def byte_spans(data: bytes, spans: list[tuple[int, int]], strings: Strings) -> list[tuple[int, int]]:
    """The bytes of spans of units; white space beside a span of words belongs to it, but not that at the text's ends."""
    if not strings.words:
        return spans
    _, starts, ends, _ = word_units([data])
    return [(int(ends[a - 1] if a else starts[a]), int(starts[b] if b < len(starts) else ends[b - 1])) for a, b in spans]
