"""Quality classifier: hierarchical empirical Bayes over document, site and path.

A document classifier (logistic, over hashed words and shape features) gives evidence in log odds.
Sites form a tree: all documents, host, path.  ``sites`` takes both from the document's source: the host
is its part before the first slash, the path all of it (``path`` gives another column instead, such as
that of a URL).  A source without a slash is a host of one path.  Labelled rows are counted by host and
path in grouped sums.  A host's rate of good rows shrinks to the global rate by n / (n + strength), a
path's to its host's; each strength comes from the spread between sites beyond what chance makes
(method of moments of the beta-binomial), so sparse sites stay near their parent, and all do where sites
say nothing.  A document's own label is left out of its site's counts.  The score adds to the document's
evidence what its path's log odds differ from the global ones.

The classifier learns from at most about TRAIN_DOCS labelled rows chosen by a hash of doc_id; counts of
sites cover all labelled rows they are given.

Defined results: a null or empty text has the evidence of one without words; a null source is a host
of its own; with one class or none to learn from the score is the labels' share (0.5 without labels);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import Scratch, held_out, map_arrow, small_batches, table

TRAIN_DOCS = 20_000
WIDTH = 1 << 12
SHAPES = 12
#: So many sites' counts, once counted, are sent everywhere; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def shape(text: str) -> list[float]:
    """Features of a text's form, each about 0 to 1."""
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    marks = len(re.findall(r"[^\w\s]", text))
    return [
        np.log1p(len(words)) / 10,
        len(set(words)) / w,
        marks / n * 5,
        sum(1 for c in text if c.isupper()) / n,
        sum(1 for c in text if c.isdigit()) / n * 5,
        sum(map(len, words)) / w / 12,
        len(set(lines)) / len(lines),
        text.count("|") / n * 10,
        (text.count("!") + text.count("%") + text.count("$") + text.count("&") + text.count("#") + text.count("*")) / n * 5,
        max((words.count(x) for x in words[:1]), default=0) / w,
        float(text[-1:] in ".!?"),
        len(set(zip(words, words[1:], strict=False))) / w,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the hashed distinct words, and shapes."""
    import xxhash

    return np.array(sorted({xxhash.xxh32_intdigest(x.lower()) % WIDTH for x in text.split()}), np.uint16), np.array(shape(text))


def vector(words: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values: words (of unit length together), then shapes."""
    return np.concatenate([words, np.arange(WIDTH, WIDTH + SHAPES)]), np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words)))), shapes])


class Model:
    def __init__(self, beta: np.ndarray | None, prior: float):
        self.beta, self.prior = beta, prior

    def evidence(self, text: str) -> float:
        if self.beta is None:
            return float(np.log(self.prior / (1 - self.prior)))
        at, value = vector(*features(text))
        return float(np.clip(self.beta[-1] + self.beta[at] @ value, -12, 12))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, epochs: int = 12, rate: float = 0.5, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression by AdaGrad in a fixed order."""
    beta, square = np.zeros(WIDTH + SHAPES + 1), np.full(WIDTH + SHAPES + 1, 1e-2)
    order = np.random.default_rng(3).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            at, value = vector(*rows[i])
            z = beta[-1] + beta[at] @ value
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            step = g * value + ridge * beta[at]
            square[at] += step * step
            beta[at] -= rate * step / np.sqrt(square[at])
            square[-1] += g * g
            beta[-1] -= rate * g / np.sqrt(square[-1])
    return beta


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one row a document; of several labels the greatest."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def learn(docs: DataFrame, labels: DataFrame, *, bound: int = TRAIN_DOCS) -> Model:
    marks = marks_of(labels)
    n, good = marks.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    prior = (good + 1) / (n + 2)
    if not 0 < good < n:
        return Model(None, prior)
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, bound / n) * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")
    schema = pa.schema([("words", pa.binary()), ("shapes", pa.list_(pa.float64())), ("y", pa.int32())])

    def make():
        def run(batches):
            for batch in batches:
                got = [features(x or "") for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0].tobytes() for x in got], pa.binary()), pa.array([x[1] for x in got], schema.field(1).type), batch.column(1).cast(pa.int32())], schema=schema)

        return run

    # At most about ``bound`` rows of at most WIDTH two-byte numbers and SHAPES values each reach the driver.
    seen = map_arrow(rows, make, "words binary, shapes array<double>, y int").toArrow()
    examples = [(np.frombuffer(w, np.uint16), np.array(v)) for w, v in zip(seen["words"].to_pylist(), seen["shapes"].to_pylist(), strict=True)]
    return Model(fit(examples, seen["y"].to_numpy().astype(float)), prior)


def sites(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """doc_id, text, host, path; without a source both are empty."""
    own = F.coalesce((F.col("source") if path is None else path).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.substring_index(own, "/", 1).alias("host"), own.alias("path"))


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, host, path, x (log odds from the text alone)."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("x", pa.float64())])

    def make():
        def run(batches):
            for batch in batches:
                x = [model.evidence(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(x, pa.float64())], schema=schema)

        return run

    return map_arrow(rows, make, "doc_id long, host string, path string, x double")


def strength(rate: float, spread: float, groups: int, parents: int, n: float, squares: float) -> float:
    """How many rows a parent's rate weighs: spread is the sum of n * (own rate - parent's rate) ** 2."""
    chance = rate * (1 - rate)
    between = (spread - (groups - parents) * chance) / max(1e-9, n - squares / max(1.0, n))
    return chance / between if between > chance / MOST else MOST


#: A parent never weighs more rows than this; so much it does where sites differ by chance alone.
MOST = 1e6


def counts_of(rows: DataFrame, marks: DataFrame, scratch: Scratch) -> tuple[DataFrame, float, float, float]:
    """host, path, n, g (good), hn, hg of each labelled site; the global rate, and the strengths of it and of hosts."""
    by_path = scratch.write(rows.select("doc_id", "host", "path").join(marks, "doc_id").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("g")))
    by_host = scratch.write(by_path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("g").alias("hg")))
    counts = scratch.write(by_path.join(by_host, "host"))
    n, g, k, squares = by_host.agg(F.coalesce(F.sum("hn"), F.lit(0)), F.coalesce(F.sum("hg"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.col("hn") * F.col("hn")), F.lit(0))).first()
    rate = (g + 1) / (n + 2)
    off = F.col("hg") / F.col("hn") - F.lit(rate)
    spread = by_host.agg(F.coalesce(F.sum(F.col("hn") * off * off), F.lit(0.0))).first()[0]
    off = F.col("g") / F.col("n") - F.col("hg") / F.col("hn")
    p = counts.agg(F.coalesce(F.sum(F.col("n") * off * off), F.lit(0.0)), F.count("*"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()
    return counts, rate, strength(rate, spread, k, 1, n, squares), strength(rate, p[0], p[1], k, n, p[2])


def classify(docs: DataFrame, model: Model, labels: DataFrame | None = None, *, path: Column | None = None) -> DataFrame:
    """doc_id, score (0 to 1), and the posterior rates of its host and path; without labels sites say nothing."""
    scratch = Scratch(docs.sparkSession)
    rows = sites(docs, path)
    found = evidence(rows, model)
    if labels is None:
        return found.select("doc_id", (1 / (1 + F.exp(-F.col("x")))).alias("score"), F.lit(model.prior).alias("host_mean"), F.lit(model.prior).alias("path_mean"))
    marks = scratch.write(marks_of(labels))
    counts, rate, of_host, of_path = counts_of(rows, marks, scratch)
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    out = scratch.write(found).join(counts, ["host", "path"], "left").join(marks, "doc_id", "left").fillna(0, ["n", "g", "hn", "hg"])
    one, good = F.col("quality").isNotNull().cast("int"), F.coalesce("quality", F.lit(0))
    out = out.withColumn("host_mean", (F.col("hg") - good + of_host * rate) / (F.col("hn") - one + of_host))
    out = out.withColumn("path_mean", (F.col("g") - good + of_path * F.col("host_mean")) / (F.col("n") - one + of_path))
    odds = lambda p: F.log(p / (1 - p))
    z = F.col("x") + odds(F.least(F.greatest("path_mean", F.lit(1e-6)), F.lit(1 - 1e-6))) - odds(F.lit(rate))
    return out.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "host_mean", "path_mean")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.filter(~held_out(F.col("doc_id")))
    out = classify(docs, learn(docs.filter(~held_out(F.col("doc_id"))), known), known)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
