"""Sharding: a K-d tree over metadata, split at distributed weighted medians.

Each node splits along its widest dimension (extent over the whole table's) at a weighted median, so
that the bytes on both sides are in proportion to the leaves below them.  A dimension's key is the
value's code above 32 bits of a hash of the row, which makes ties divisible: copies and rows of one
source still split at any weight.  The medians of all nodes of a level are found at once by refining
histograms (BINS a node and pass, summed before the shuffle); only bins reach the driver.

Defined results: a null text has 8 bytes; a null dimension has code 0; rows equal in every column stay
together; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from keylode.llm.common import Scratch, table

BINS = 1 << 12
KEY_BITS = 62
#: A split's weight may be off by this share of a leaf, or by one bin that cannot be refined.
TOLERANCE = 0.002
ROWS_A_BUCKET = 20_000
LEAST_BUCKETS = 64


def rows_of(docs: DataFrame) -> DataFrame:
    """Sizes, checksums and the dimensions' keys: all that a shard's choice needs of a document."""
    text, own = F.col("text").cast("string"), F.col("doc_id").cast("long")
    spread = F.xxhash64(own, F.crc32(text)).bitwiseAND(F.lit((1 << 32) - 1))
    code = {
        "id_key": F.xxhash64(own).bitwiseAND(F.lit((1 << 30) - 1)),
        "size_key": F.least(F.coalesce(F.octet_length(text), F.lit(0)), F.lit((1 << 30) - 1)).cast("long"),
        "source_key": F.when(F.col("source").isNull(), F.lit(0)).otherwise(F.xxhash64(F.col("source").cast("string")).bitwiseAND(F.lit((1 << 30) - 1))),
        "lang_key": F.when(F.col("lang").isNull(), F.lit(0)).otherwise(F.xxhash64(F.col("lang").cast("string")).bitwiseAND(F.lit((1 << 30) - 1))),
    }
    keys = [(F.shiftleft(v.cast("long"), 32).bitwiseOR(spread)).alias(k) for k, v in code.items()]
    return docs.select(own.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), *keys)


DIMENSIONS = ("id_key", "size_key", "source_key", "lang_key")


def kd_tree(rows: DataFrame, leaves: int) -> dict:
    """The tree over rows_of(...): nested {dim, at, low, high} (keys below ``at`` go low), or {shard}."""
    tree: dict = {"leaves": leaves, "first": 0}
    open_nodes = [tree]
    extent = None
    while open_nodes:
        nodes, open_nodes = [x for x in open_nodes if x["leaves"] > 1], []
        if not nodes:
            break
        for k, x in enumerate(nodes):
            x["node"] = k
        placed = rows.withColumn("node", node_of(tree))
        stats = {r["node"]: r for r in placed.filter("node >= 0").groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        wanted = {}
        if extent is None:
            r = stats.get(0)
            extent = {d: max(1, r[f"hi_{d}"] - r[f"lo_{d}"]) if r else 1 for d in DIMENSIONS}
        for x in nodes:
            r = stats.get(x["node"])
            low = x["leaves"] // 2
            x["low"], x["high"] = {"leaves": low, "first": x["first"]}, {"leaves": x["leaves"] - low, "first": x["first"] + low}
            if r is None:
                x["dim"], x["at"] = DIMENSIONS[0], 0
                continue
            x["dim"] = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / extent[d])
            wanted[x["node"]] = {"node": x, "lo": r[f"lo_{x['dim']}"], "hi": r[f"hi_{x['dim']}"] + 1, "below": 0, "goal": r["w"] * low / x["leaves"], "slack": TOLERANCE * r["w"] / x["leaves"]}
        while wanted:
            choose = lambda f: F.element_at(F.create_map(*[F.lit(v) for k, x in wanted.items() for v in (k, f(x))]), F.col("node"))
            key = F.coalesce(*[F.when(F.col("node").isin([k for k, x in wanted.items() if x["node"]["dim"] == d] or [-1]), F.col(d)) for d in DIMENSIONS])
            step = {k: max(1, -(-(x["hi"] - x["lo"]) // BINS)) for k, x in wanted.items()}
            here = placed.filter(F.col("node").isin(list(wanted))).select("node", "size", key.alias("key"), choose(lambda x: x["lo"]).alias("lo"), choose(lambda x: x["hi"]).alias("hi"), F.element_at(F.create_map(*[F.lit(v) for k in wanted for v in (k, step[k])]), F.col("node")).alias("step"))
            bins = here.filter("key >= lo AND key < hi").groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("w"), F.min("key").alias("least"), F.max("key").alias("most")).collect()
            by: dict[int, list] = {}
            for r in bins:
                by.setdefault(r["node"], []).append((r["bin"], r["w"], r["least"], r["most"]))
            for k in list(wanted):
                x = wanted[k]
                run = x["below"]
                for _, w, least, most in sorted(by[k]):
                    if run + w >= x["goal"]:
                        break
                    run += w
                if least == most or w <= x["slack"]:  # the bin itself goes to the nearer side
                    x["node"]["at"] = least if x["goal"] - run <= run + w - x["goal"] else most + 1
                    del wanted[k]
                else:
                    x |= {"lo": least, "hi": most + 1, "below": run}
        for x in nodes:
            del x["node"]
            open_nodes += [x["low"], x["high"]]
    return tree


def node_of(tree: dict):
    """The number of the open node that a row is in; -1 where its node is a leaf."""
    if "dim" in tree:
        return F.when(F.col(tree["dim"]) < tree["at"], node_of(tree["low"])).otherwise(node_of(tree["high"]))
    return F.lit(tree.get("node", -1))


def shard_of(tree: dict):
    if "dim" in tree:
        return F.when(F.col(tree["dim"]) < tree["at"], shard_of(tree["low"])).otherwise(shard_of(tree["high"]))
    return F.lit(tree["first"])


def shard_documents(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: into so many shards, or as many as the target bytes need."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(rows_of(docs))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    leaves = shards or max(1, -(-total // (target_bytes or 128 << 20)))
    placed = rows.withColumn("shard", shard_of(kd_tree(rows, leaves)) if n else F.lit(0))
    # Slots: rows are dealt to buckets of a bounded size; a bucket's slots start where those before it end.
    buckets = max(LEAST_BUCKETS, -(-n // (leaves * ROWS_A_BUCKET)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").count()
    starts = sizes.withColumn("start", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("shard", "bucket", F.coalesce("start", F.lit(0)).alias("start"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1)
    out = ranked.join(F.broadcast(starts) if leaves * buckets <= 200_000 else starts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank")).cast("long").alias("slot"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
