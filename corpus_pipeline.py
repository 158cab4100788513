"""The corpus pipeline: documents to packed sequences in five stages.

Every stage takes all that the one before it kept.  The first four return the columns of documents.

Defined results: decisions hold for rows, told apart by doc_id (null counts as one) and text, so that a
row which shares another's doc_id is judged by its own text.  A null or empty text is clean, has no near
copy and no repeats, and is packed as one end mark.  Of rows that are near copies or repeat each other
one stays: the one of smallest doc_id (null last), of these the one whose text has the smallest hash;
rows without words all stay.  Other columns are ignored, whatever their names; missing labels and items
reject nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylode.llm import decontaminate, near, packing, repeats, toxicity
from keylode.llm.common import Scratch, held_out, small_batches, table

#: Near copies have at least so many percent of their five-word shingles in common.
NEAR_PERCENT = 80
#: Passages of over so many words that repeat are cut.
REPEATED_WORDS = 50
#: Ids to drop are sent everywhere up to so many rows; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


NO_ID = -(1 << 62)


def own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, hash of text) is not in gone: own_id, th."""
    gone = Scratch(docs.sparkSession).write(gone.select(F.col("own_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct())
    hint = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.select(*COLUMNS).join(hint, (own_id() == F.col("gone_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("gone_th")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go."""
    small_batches(spark)
    scorer = toxicity.learn(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    return toxicity.accepted(docs.select(*COLUMNS), scorer)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one of smallest id."""
    small_batches(spark)
    scratch = Scratch(spark)
    found = near.near_duplicates(docs, NEAR_PERCENT, keyed=True).filter("label IS NOT NULL")
    rows = scratch.write(found.select("label", own_id().alias("own_id"), F.col("doc_id").isNull().alias("nameless"), "th"))
    row = F.struct("nameless", "own_id", "th")
    groups = scratch.write(rows.groupBy("label").agg(F.count("*").alias("n"), F.min(row).alias("best")).filter("n > 1").select("label", "best"))
    several = scratch.write(rows.join(near.sent(groups), "label").select("own_id", "th", (row == F.col("best")).alias("best")))
    kept = without(docs, several.filter("NOT best"))
    # The row that stays may stand there several times; such rows are few texts, and only they are shuffled.
    again = scratch.write(several.filter("best").groupBy("own_id", "th").agg(F.count("*").alias("n")).filter("n > 1").select("own_id", "th"))
    if not again.limit(1).count():
        return kept
    once = docs.select(*COLUMNS).withColumn("own_id", own_id()).withColumn("th", F.xxhash64(F.col("text").cast("string"))).join(near.sent(again), ["own_id", "th"])
    once = once.groupBy("own_id", "th").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return without(kept, again).unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat are cut out of the texts; documents stay."""
    small_batches(spark)
    return repeats.without_repeats(docs, REPEATED_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keyed=True).filter("contaminated")
    return without(docs, found.select(own_id().alias("own_id"), "th"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    small_batches(spark)
    return packing.digest(packing.pack_documents(docs))


STAGES = [("toxicity", drop_toxic), ("near_dedup", keep_one_of_near), ("suffix_array_dedup", cut_repeats), ("decontamination", drop_contaminated), ("packing", pack)]

#: The toxicity model and token ids are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
