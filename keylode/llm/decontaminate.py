"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are runs of digits, a-z and all that is not ASCII, A-Z lower-cased.  Every five words have a
hash; of each six neighbouring hashes the least is kept, so that two texts which share ten words share
a kept hash.  Kept hashes of documents are joined with those of benchmark items; around each joined hash
the windows of ten words that hold it are formed and joined with the items' windows (two hashes of 64
bits), which extends the hits to every shared span.  An item of fewer words is one window, found by the
hash of all its words at every place of a document.

Scale: pass 1 sends only joined hashes; texts are never shuffled unless the contaminated documents are
too many to broadcast their keys (BROADCAST_ROWS, counted first).  Words of a hit are counted per
document from its window starts.

Defined results: null and empty texts have no words and no hits; items without words have no windows; a
null item_id is not listed; rows of equal doc_id and text have equal results; an empty table on either
side gives no hits; other columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import Scratch, table

K = 5
WINDOW = 10
BROADCAST_ROWS = 200_000
#: Between words, before A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z alone lower-cased; the quick way where the word is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def span(n: Column, length: int) -> Column:
    """Starts 0 .. n - length, or none."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def gram(hashes: str, at: Column, length: int, salt: int = 0) -> Column:
    """Hash of so many words from a start on."""
    return F.xxhash64(F.lit(length + 1000 * salt), *[F.get(F.col(hashes), at + k) for k in range(length)])


def grams_at(hashes: str, length: int, salt: int):
    """A lambda of one argument: the gram that starts there."""
    return lambda at: gram(hashes, at, length, salt)


def hashed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n words, and the words' hashes."""
    split = rows.select(*keys, F.split(F.coalesce("text", F.lit("")), GAP).alias("parts"))
    # Only the first and the last part can be empty.
    skip, n = (F.get("parts", F.lit(0)) == "").cast("int"), F.size("parts")
    last = (F.get("parts", n - 1) == "").cast("int")
    words = split.select(*keys, F.slice("parts", skip + 1, F.greatest(F.lit(0), n - skip - last)).alias("words"))
    return words.select(*keys, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(lowered(w))).alias("h"))


def fingerprints(rows: DataFrame, *keys: str, short: list[int]) -> DataFrame:
    """keys and fp: kept hashes of each text, each once, and its grams of the short items' lengths."""
    grams = rows.select(*keys, "n", "h", F.transform(span(F.col("n"), K), lambda i: gram("h", i, K)).alias("g"))
    least = F.transform(span(F.col("n"), WINDOW), lambda i: F.least(*[F.get(F.col("g"), i + k) for k in range(WINDOW - K + 1)]))
    others = [F.transform(span(F.col("n"), s), grams_at("h", s, 1)) for s in short]
    return grams.select(*keys, F.explode(F.array_distinct(F.concat(least, *others))).alias("fp"))


def windows_of_items(items: DataFrame) -> DataFrame:
    """a, b (hashes), length, start, n, h and item_id: every window of every item."""
    here = items.filter("n > 0").select("item_id", "n", "h", F.least("n", F.lit(WINDOW)).alias("length"))
    parts = []
    for length in range(1, WINDOW + 1):
        own = here.filter(F.col("length") == length)
        at = own.select("item_id", "h", "length", F.explode(span(F.col("n"), length) if length == WINDOW else F.array(F.lit(0))).alias("start"))
        parts.append(at.select("item_id", "length", gram("h", F.col("start"), length, 2).alias("a"), gram("h", F.col("start"), length, 3).alias("b")))
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, benchmark: DataFrame, *, keyed: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document; keyed: also th (hash of its text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))

    items = scratch.write(hashed(bench, "item_id"))
    windows = scratch.write(windows_of_items(items).distinct())
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    short = [x for x in lengths if x < WINDOW]
    bounded = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    marks = fingerprints(items.filter(F.col("n") >= WINDOW), short=[])
    for s in short:
        marks = marks.unionByName(items.filter(F.col("n") == s).select(gram("h", F.lit(0), s, 1).alias("fp")))
    marks = scratch.write(marks.distinct())
    distinct_windows = scratch.write(windows.select("a", "b", "length").distinct())

    # Pass 1: kept hashes of documents that items have too.
    counted = hashed(own, "doc_id", "th")
    joined = fingerprints(counted, "doc_id", "th", short=short).join(bounded(marks), "fp")
    found = scratch.write(joined.groupBy("doc_id", "th").agg(F.collect_set("fp").alias("fps")))

    # Pass 2: windows around them, in those documents alone.  A document's hashes are joined by place, so
    # that work stays in proportion to its words however many of them are hit.
    key = lambda df: df.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 62)))).drop("doc_id")
    marked = scratch.write(key(found).select("id", "th", F.explode("fps").alias("fp")))
    near = key(own).join(bounded(scratch.write(marked.select("id", "th").distinct())), ["id", "th"])
    # Written, so that no filter below can take the words' hashes apart again for each word.
    near = scratch.write(hashed(near, "id", "th"))
    starts = []
    places = near.select("id", "th", F.posexplode(F.transform(span(F.col("n"), K), grams_at("h", K, 0))).alias("p", "fp")).join(bounded(marked), ["id", "th", "fp"], "left_semi")
    places = scratch.write(places.groupBy("id", "th").agg(F.collect_set("p").alias("places")))
    at = near.join(places, ["id", "th"])
    around = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(p - (WINDOW - K), F.lit(0)), p))))
    inside = at.select("id", "th", "n", "h", F.explode(around).alias("start")).filter(F.col("start") + WINDOW <= F.col("n"))
    starts.append(inside.select("id", "th", "start", F.lit(WINDOW).alias("length"), gram("h", F.col("start"), WINDOW, 2).alias("a"), gram("h", F.col("start"), WINDOW, 3).alias("b")))
    for s in short:
        here = near.select("id", "th", F.posexplode(F.transform(span(F.col("n"), s), grams_at("h", s, 1))).alias("start", "fp")).join(bounded(marked), ["id", "th", "fp"], "left_semi")
        here = here.groupBy("id", "th").agg(F.collect_set("start").alias("places"))
        here = near.join(here, ["id", "th"]).select("id", "th", "h", F.explode("places").alias("start"))
        starts.append(here.select("id", "th", "start", F.lit(s).alias("length"), gram("h", F.col("start"), s, 2).alias("a"), gram("h", F.col("start"), s, 3).alias("b")))
    hits = scratch.write(reduce(DataFrame.unionByName, starts).join(bounded(distinct_windows), ["a", "b", "length"]))

    # Words inside any hit: starts of a document in order, each adding what the last did not cover.
    spans = hits.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    cover = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["length"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["end"], x["start"]))).alias("sum")),
        lambda acc: acc["sum"],
    )
    covered = spans.select("id", "th", cover.cast("long").alias("n_hit"))
    listed = hits.select("id", "th", "a", "b").distinct().join(bounded(windows.select("a", "b", "item_id").distinct()), ["a", "b"])
    listed = listed.select("id", "th", "item_id").distinct().groupBy("id", "th").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    result = covered.join(listed, ["id", "th"], "left")
    sizes = hashed(own, "doc_id", "th").select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"), "th", F.col("n").cast("long").alias("n_words"))
    out = sizes.join(result, ["id", "th"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *(["th"] if keyed else []))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by brute force: every window of every document against every item's.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
