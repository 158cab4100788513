"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

Lines are paragraphs; a paragraph's leaves are its sentences (long ones cut every LEAF characters); a
section is a run of paragraphs that ends where a paragraph's own hash says so, or at a blank line, so
that an edit moves no other border.  A node's hash covers its children's.  The fingerprint writes the
tree down: ``root|section:paragraph=leaves,...|...``.  Equal roots mean equal texts; otherwise the
comparison descends only into sections and paragraphs whose hashes differ, and so locates the edits.
Likeness is twice the characters of matched leaves over those of all leaves of both trees.

Defined results: a null text is empty and has the fingerprint of the empty tree; two empty trees are
alike (1); documents of the same doc_id are ordered by their texts' checksums; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import map_arrow, partitions, small_batches, table, texts

LEAF = 48
#: One paragraph in so many ends a section.
SECTION = 8
LEAVES = re.compile(rf"[^\n.!?]{{0,{LEAF}}}[.!?]+[ \n]*|[^\n.!?]{{1,{LEAF}}}\n*|\n+").findall
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
SQL_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def short(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=5).hexdigest()


def leaf(text: str) -> str:
    """Four bytes of hash, and the length, in hexadecimal."""
    return f"{hashlib.blake2b(text.encode(), digest_size=4).hexdigest()}{min(255, len(text)):02x}"


def weight(leaves: list[str]) -> int:
    return sum(int(x[8:], 16) for x in leaves)


class Tree:
    """sections: (hash, [(hash, [leaf, ...]), ...]) in the order of the text."""

    __slots__ = ("root", "sections", "n")

    def __init__(self, text: str):
        self.sections, self.n = [], 0
        section: list[tuple[str, list[str]]] = []
        leaves: list[str] = []

        def end_section():
            if section:
                self.sections.append((short("".join(x[0] for x in section).encode()), section.copy()))
                section.clear()

        def end_paragraph():
            if leaves:
                own = short("".join(leaves).encode())
                section.append((own, leaves.copy()))
                self.n += weight(leaves)
                leaves.clear()
                if int(own[:4], 16) % SECTION == 0:
                    end_section()

        for x in LEAVES(text):
            leaves.append(leaf(x))
            if x[-1] == "\n":
                end_paragraph()
                if x[-2:] == "\n\n":
                    end_section()
        end_paragraph()
        end_section()
        # The root covers the whole text beside its children: equal roots stand for equal texts.
        self.root = hashlib.sha256(hashlib.sha256(text.encode()).digest() + "".join(x[0] for x in self.sections).encode()).hexdigest()[:32]

    def fingerprint(self) -> str:
        return "|".join([self.root, *[f"{s}:" + ",".join(f"{p}={''.join(leaves)}" for p, leaves in paragraphs) for s, paragraphs in self.sections]])

    @classmethod
    def read(cls, fingerprint: str) -> Tree:
        tree = cls.__new__(cls)
        tree.root, *sections = fingerprint.split("|")
        tree.sections, tree.n = [], 0
        for x in sections:
            own, _, rest = x.partition(":")
            paragraphs = []
            for y in rest.split(","):
                p, _, z = y.partition("=")
                paragraphs.append((p, [z[i : i + 10] for i in range(0, len(z), 10)]))
                tree.n += weight(paragraphs[-1][1])
            tree.sections.append((own, paragraphs))
        return tree


def unmatched(a: list, b: list) -> tuple[int, list, list]:
    """Characters of the children of a that b has too (by hash, each once), and both sides' other children."""
    have = Counter(x[0] for x in b)
    shared, left = 0, []
    taken: Counter = Counter()
    for x in a:
        if taken[x[0]] < have[x[0]]:
            taken[x[0]] += 1
            shared += sum(weight(y[1]) for y in x[1]) if isinstance(x[1][0], tuple) else weight(x[1])
        else:
            left.append(x)
    right = []
    for x in b:
        if taken[x[0]]:
            taken[x[0]] -= 1
        else:
            right.append(x)
    return shared, left, right


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    shared, a_sections, b_sections = unmatched(a.sections, b.sections)
    more, a_paragraphs, b_paragraphs = unmatched([p for s in a_sections for p in s[1]], [p for s in b_sections for p in s[1]])
    leaves = Counter(x for p in a_paragraphs for x in p[1]) & Counter(x for p in b_paragraphs for x in p[1])
    return min(1.0, 2 * (shared + more + weight(list(leaves.elements()))) / max(1, a.n + b.n))


def differing(a: str, b: str) -> list[int]:
    """Numbers of a's leaves (in the text's order) that stand in branches which b lacks: where edits are."""
    x, y = Tree.read(a), Tree.read(b)
    if x.root == y.root:
        return []
    sections, paragraphs, leaves = {s[0] for s in y.sections}, {p[0] for s in y.sections for p in s[1]}, {z for s in y.sections for p in s[1] for z in p[1]}
    out, n = [], 0
    for s in x.sections:
        for p in s[1]:
            for z in p[1]:
                if s[0] not in sections and p[0] not in paragraphs and z not in leaves:
                    out.append(n)
                n += 1
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document: no shuffle."""

    def make():
        def run(batches):
            for batch in batches:
                out = [Tree(x or "").fingerprint() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

        return run

    return map_arrow(texts(docs), make, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Documents in ranges of doc_id, sorted in each, and after each range the row that follows it.

    Columns: bucket, doc_id, text, tail.  Borders come from a bounded sample of ids (40 a range), which
    moves work but no result.  The row that opens a range is sent to the range before it as its tail;
    the first row of all closes the last range.
    """
    own = texts(docs)
    ids = own.select("doc_id")
    n = ids.count()
    ranges = max(partitions(docs), -(-n // 50_000))
    sample = sorted(r[0] for r in ids.filter("doc_id IS NOT NULL").sample(min(1.0, 40 * ranges / max(n, 1)), seed=7).collect())
    borders = np.unique([sample[i * len(sample) // ranges] for i in range(1, ranges)]) if sample else np.array([], "int64")

    @F.pandas_udf("int")
    def bucket(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, x.fillna(-(1 << 63)).to_numpy("int64"), side="right").astype("int32"))

    own = own.withColumn("bucket", bucket("doc_id")).withColumn("text_key", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)))
    # The first row of each range (doc_id, then checksum): as many rows as ranges.
    first = ids.withColumn("bucket", bucket("doc_id")).groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect()
    order = sorted((r["bucket"], r["doc_id"]) for r in first)
    before = {doc_id: order[k - 1][0] for k, (_, doc_id) in enumerate(order)}
    tails = own.filter(F.col("doc_id").isin([x for x in before if x is not None]) | (F.col("doc_id").isNull() if None in before else F.lit(False)))
    least = tails.groupBy("doc_id").agg(F.min_by(F.struct("doc_id", "text"), "text_key").alias("row"))
    moved = F.create_map(*[F.lit(v) for k, x in before.items() if k is not None for v in (k, x)]) if any(k is not None for k in before) else None
    to = F.coalesce(F.element_at(moved, F.col("row.doc_id")) if moved is not None else F.lit(None).cast("int"), F.lit(before.get(None, 0)).cast("int"))
    tails = least.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), to.alias("bucket"), F.lit(1 << 40).cast("long").alias("text_key"), F.lit(True).alias("tail"))
    both = own.withColumn("tail", F.lit(False)).unionByName(tails)
    return both.repartition(ranges, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text_key").select("bucket", "doc_id", "text", "tail")


def edits_and_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text with the next document's start in place of its end, and likenesses."""

    def make():
        def run(batches):
            held = None  # bucket, doc_id, text, tree
            for batch in batches:
                columns = {f.name: [] for f in SCHEMA}
                for bucket, doc_id, text, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    text = text or ""
                    tree = Tree(text)
                    if held is not None and held[0] == bucket:
                        n = len(held[2])
                        edited = held[2][: n - n // 4] + text[: n // 4]
                        other = Tree(edited) if n // 4 else held[3]
                        made = (held[1], n, hashlib.sha256(edited.encode()).hexdigest(), held[3].fingerprint(), other.fingerprint(), likeness(held[3], other), likeness(held[3], tree))
                        for k, v in zip(columns, made, strict=True):
                            columns[k].append(v)
                    held = None if tail else (bucket, doc_id, text, tree)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in SCHEMA], schema=SCHEMA)

        return run

    return map_arrow(in_order(docs), make, SQL_SCHEMA)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return edits_and_neighbours(table(spark, sf_dir, "documents"))
