"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its five-word shingles.  Fast similarity sketching fills COORDS
coordinates in rounds: in round i every element throws itself into a hashed bin with a hashed value
above i, and the bin keeps its least; after as many rounds as bins, round COORDS + b puts all elements
into bin b, so every coordinate is filled.  Work is proportional to the set and to COORDS log COORDS.
Bands of some coordinates each make buckets; ``banding`` chooses both for the least likeness of a link.

Equal sets are one class; classes that share buckets (each with the bucket's first class, transitively)
form a cluster.  What links within a cluster connect is then found exactly, by spanning links:

1. Every member is compared with the cluster's pivot (the class with the fullest buckets) on full sets.
   Clusters are dealt out in parts of PART members, each with a copy of the pivot.
2. Let D(x) be the difference of x's set and the pivot's.  Sets differ as their D's differ, and if x and
   y link while their D's share nothing, then both link to the pivot already.  So only pairs whose D's
   share an element matter, one of them not linked to the pivot.  A prefix filter over the elements,
   rarest first, with bounds by sizes and by elements that no other member has, leaves lists of members
   that share an element of their prefixes.
3. Members known to be connected are one group.  Every member of a list that holds several groups is
   compared with that list's hub (a member with few own elements) alone, on whole D's; groups that link
   are merged.  Then the nearest hub takes the pivot's place, D's and lists are made anew, and members
   are compared with the hubs of these.  Both take about as many comparisons as there are list entries.
4. In lists that still hold several groups, members outside the largest are compared with the members of
   all other groups.  This is exact whatever the hubs have merged; one link of two groups is enough.  Comparisons
   here grow with the square only of members that share a prefix and are not connected by hubs.

Two classes at the least likeness of a link miss each other in all bands with a chance of about 1 in 100,000.

Defined results: without words or text a document's set is empty and it is linked with nothing; fewer
than five words are one shingle; repeated rows are equal sets; rows of one doc_id count as one document
in a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import Scratch, map_arrow, partitions, small_batches, table, texts
from keylode.llm.components import components

SHINGLE = 5
PART = 500
BROADCAST_ROWS = 100_000
#: Links of op9: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Chance that a pair at the least likeness of a link shares no bucket.
MISS = 1.1e-5
CHUNK = 1 << 18


def banding(percent: int) -> tuple[int, int]:
    """Bands, and coordinates of each, for links at percent."""
    if not 50 <= percent <= 100:
        raise ValueError(f"percent is {percent}, not within 50 and 100")
    rows = 8 if percent >= 85 else 6 if percent >= 75 else 4
    miss = 1 - (percent / 100) ** rows
    return (math.ceil(math.log(MISS) / math.log(miss)) if miss else 1), rows


BANDS, ROWS = banding(PERCENT)
COORDS = BANDS * ROWS

_rng = np.random.default_rng(0x5EED)
_PLACE = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROUND = _rng.integers(1, 1 << 63, 2048, dtype=np.uint64)  # two for each coordinate
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out, part, held = [], [], 0
    for t in texts:
        data = (t or "").encode()
        part.append(data)
        held += len(data)
        if held >= CHUNK:
            out += _sets(part)
            part, held = [], 0
    return out + _sets(part)


def _sets(parts: list[bytes]) -> list[np.ndarray]:
    if not parts:
        return []
    data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    inside = _IS_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begin)
    origin = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) + 1 for x in parts])])
    bounds = np.searchsorted(starts, origin)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in parts]
    at = np.flatnonzero(inside)
    word = np.cumsum(begin)[at] - 1
    place = at - starts[word]
    value = (data[at].astype(np.uint64) + np.uint64(1)) * (_PLACE[place & 1023] ^ (place >> 10).astype(np.uint64) << np.uint64(1))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = mix(np.add.reduceat(value, first))
    long = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        long += words[k : k + len(long)] * _WORD[k]
    long = mix(long)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(long[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.add.reduce(words[a:b] * _WORD[: b - a], keepdims=True) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(elements: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """So many coordinates; equal for equal sets, and equal in each with a chance of the sets' likeness."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(coords, empty, np.uint64)
    n, i = len(elements), 0
    while i < coords:
        rounds = min(coords - i, max(1, 7 * coords // n))
        h = mix(elements[None, :] ^ _ROUND[i : i + rounds, None])
        where = ((h >> np.uint64(32)) * np.uint64(coords) >> np.uint64(32)).ravel()
        value = ((h & np.uint64(0xFFFFFFFF)) | (np.arange(i, i + rounds, dtype=np.uint64) << np.uint64(32))[:, None]).ravel()
        np.minimum.at(bins, where.astype(np.int64), value)
        i += rounds
        if not (bins == empty).any():
            return bins
    for b in np.flatnonzero(bins == empty):
        h = mix(elements ^ _ROUND[coords + b])
        bins[b] = (h & np.uint64(0xFFFFFFFF)).min() | np.uint64(coords + int(b)) << np.uint64(32)
    return bins


def band_keys(bins: np.ndarray, rows: int = ROWS) -> np.ndarray:
    return mix((mix(bins).reshape(-1, rows) * _BAND[:rows]).sum(1, dtype=np.uint64))


def links(inter: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def described(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, class (digest of the set), bands (keys, little-endian) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])
    bands, size = banding(percent)

    def make():
        import xxhash

        def run(batches):
            known: dict[bytes, np.ndarray] = {}
            for batch in batches:
                rows = ([], [], [], [], [])
                for doc_id, th, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1).to_pylist()), strict=True):
                    digest = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                    if digest and digest not in known:
                        if len(known) > 2000:
                            known.clear()
                        known[digest] = band_keys(sketch(own, bands * size), size).view(np.int64)
                    for column, v in zip(rows, (doc_id, th, len(own), digest, known[digest] if digest else None), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(schema, rows, strict=True)], schema=schema)

        return run

    return map_arrow(texts(docs, F.xxhash64(F.col("text").cast("string")).alias("th")), make, "doc_id long, th long, n_shingles long, class binary, bands array<long>")


def sent(written: DataFrame) -> DataFrame:
    """A written table for a join: sent everywhere if it is small, so that no hot key is dealt to one task.

    A larger one is shuffled; both sides are plain tables, so adaptive execution can split a hot key.
    """
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def edges_of(members: DataFrame) -> DataFrame:
    """(a, b): edges that connect each class with all first classes of its buckets, all through the least of them.

    Classes with the same firsts share the edges between these, so that a class of a large cluster adds
    about one edge, however many of its buckets are full.
    """
    return members.select(F.explode(F.array_union(F.array("class"), "firsts")).alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def clusters_of(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """class, cluster, pivot (of the cluster) for classes that share a bucket with another."""
    rows = classes.select("class", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("class").alias("first")).filter("size > 1")
    joined = rows.join(buckets, ["band", "key"]).groupBy("class").agg(F.sum("size").alias("weight"), F.collect_set("first").alias("firsts"))
    members = scratch.write(joined.withColumn("least", F.array_min("firsts")))
    labels = components(edges_of(members), scratch)
    placed = scratch.write(labels.join(members, labels["node"] == members["class"]).select("class", F.col("label").alias("cluster"), "weight"), drop=[members])
    pivots = scratch.write(placed.groupBy("cluster").agg(F.max_by("class", F.struct("weight", "class")).alias("pivot"), F.count("*").alias("members")))
    return placed.join(sent(pivots), "cluster").select("class", "cluster", "pivot", "members")


def compared(docs: DataFrame, classes: DataFrame, clusters: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """class, cluster, pivot, members, n, linked (to the pivot), delta (sorted; the low bit marks what the pivot has)."""
    schema = pa.schema([("class", pa.binary()), ("cluster", pa.binary()), ("pivot", pa.binary()), ("members", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("delta", pa.list_(pa.int64()))])
    parts = F.ceil(F.col("members") / PART).cast("int")
    part = F.when(F.col("class") == F.col("pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), parts.cast("long")).cast("int")))
    wanted = clusters.join(classes.select("class", "doc_id"), "class").select("class", "cluster", "pivot", "members", "doc_id", F.explode(part).alias("part"))
    wanted = scratch.write(wanted)
    dealt = texts(docs).filter("text IS NOT NULL").join(sent(wanted), "doc_id").withColumn("lead", (F.col("class") != F.col("pivot")).cast("int"))
    dealt = dealt.repartition(partitions(docs), "cluster", "part").sortWithinPartitions("cluster", "part", "lead", "class")

    def make():
        import xxhash

        def run(batches):
            pivot, base, done = None, None, None
            for batch in batches:
                rows = tuple([] for _ in schema)
                names = batch.schema.names
                columns = [batch.column(names.index(x)).to_pylist() for x in ("text", "class", "cluster", "pivot", "members", "part")]
                for own, _, cls, cluster, center, members, k in zip(shingle_sets(columns[0]), *columns, strict=True):
                    if xxhash.xxh3_128_digest(own.tobytes()) != cls:
                        continue  # another text of the same doc_id
                    if cls == center:
                        if pivot == (center, k):
                            continue
                        pivot, base = (center, k), own
                        if k:
                            continue  # the first part speaks for the pivot
                    elif done == (cls, k):
                        continue  # a repeated row
                    done = (cls, k)
                    inter = len(np.intersect1d(own, base, assume_unique=True))
                    one = np.uint64(1)
                    added, lost = np.setdiff1d(own, base, assume_unique=True) & ~one, np.setdiff1d(base, own, assume_unique=True) | one
                    delta = np.sort(np.concatenate([added, lost])).view(np.int64)
                    for column, v in zip(rows, (cls, cluster, center, members, len(own), links(inter, len(own), len(base), percent), delta), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(schema, rows, strict=True)], schema=schema)

        return run

    return map_arrow(dealt, make, "class binary, cluster binary, pivot binary, members long, n long, linked boolean, delta array<long>")


def links_of(members: DataFrame, scratch: Scratch, percent: int, *, hubs: bool = True) -> DataFrame:
    """(a, b): links that connect all linked classes of each cluster, spanning ones rather than all.

    hubs: merge by hubs first; without it all is left to the comparison of groups, with the same components.
    """
    # 100 * intersection >= percent * union says as much as plus * difference <= minus * (n + m).
    plus, minus = 100 + percent, 100 - percent
    found = members.filter("linked AND class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    open_clusters = scratch.write(members.filter("NOT linked AND members > 2").select("cluster").distinct())
    rows = members.join(sent(open_clusters), "cluster", "left_semi")
    group = F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("class")).alias("group")
    rows = scratch.write(rows.select("class", "cluster", "linked", group, "n", "delta", F.size("delta").alias("d")))
    fields = ["class", "cluster", "linked", "group", "n", "d"]
    elements = rows.select(*fields, F.explode("delta").alias("e"))
    counts = scratch.write(elements.groupBy("cluster", "e").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = elements.join(sent(counts), ["cluster", "e"])
    # own: elements that no other member has.  A pair differs by those at least, and links only if
    # plus * difference <= minus * (n + m); a partner has at most n * 100 / percent shingles.
    kept = shared.groupBy(*fields).agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s"))
    kept = kept.withColumn("own", F.col("d") - F.size("s")).withColumn("most", F.floor(F.expr(f"{minus} * (n + n * 100 / {percent}D) / {plus} + 1e-6D")).cast("int"))
    kept = kept.filter("own <= most").withColumn("prefix", F.slice("s", 1, F.least(F.size("s"), F.col("most") + 1 - F.col("own"))))
    kept = scratch.write(kept.select(*fields, "own", F.col("prefix.e").alias("prefix")), drop=[counts])
    able = f"{plus} * (ad + bd - 2 * least(ad - ao, bd - bo)) <= {minus} * (an + bn) AND {plus} * abs(ad - bd) <= {minus} * (an + bn)"

    def side(x: str, of: str = "") -> list:
        return [F.col(f"{of}{name}").alias(x + short) for name, short in (("class", ""), ("group", "g"), ("n", "n"), ("d", "d"), ("own", "o"))]

    full = rows.select(F.col("class").alias("a"), F.col("delta").alias("da"), F.col("n").alias("na"))
    other = rows.select(F.col("class").alias("b"), F.col("delta").alias("db"), F.col("n").alias("nb"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ag, bg) with the difference of their sets, on whole D's, and the most that links."""
        pairs = scratch.write(pairs.select("a", "b", "ag", "bg").distinct())
        differ = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
        both = pairs.join(full, "a").join(other, "b")
        return scratch.write(both.select("a", "b", "ag", "bg", (plus * differ).alias("differ"), (minus * (F.col("na") + F.col("nb"))).alias("most")), drop=[pairs])

    def with_hubs(probe: DataFrame, key: str) -> DataFrame:
        """Members of each list of probe (key, e) that holds several groups, compared with its hub."""
        hub = F.min(F.struct("linked", "own", "d", "class", "group", "n")).alias("hub")
        lists = probe.groupBy(key, "e").agg(hub, F.min("group").alias("least"), F.max("group").alias("greatest")).filter("least <> greatest")
        lists = scratch.write(lists.select(key, "e", "hub"))
        out = verified(probe.join(sent(lists), [key, "e"]).select(*side("a"), *side("b", "hub.")).filter("ag <> bg").filter(able))
        scratch.drop(lists)
        return out

    def merged(kept: DataFrame, more: DataFrame) -> DataFrame:
        labels = components(more.select(F.col("ag").alias("a"), F.col("bg").alias("b")), scratch)
        placed = kept.join(sent(labels), kept["group"] == labels["node"], "left").withColumn("group", F.coalesce("label", "group"))
        return scratch.write(placed.select(*kept.columns), drop=[kept, labels])

    if hubs:
        near = with_hubs(kept.select(*fields, "own", F.explode("prefix").alias("e")), "cluster")
        more = near.filter("differ <= most").select("a", "b", "ag", "bg")
        found, kept = found.union(more.select("a", "b")), merged(kept, more)
        # The nearest hub takes the pivot's place: what is common to its copies leaves their D's.
        bases = scratch.write(near.filter("differ <= 2 * most").groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b")))
        moved = kept.join(bases, kept["class"] == bases["a"]).join(full.select("a", "da"), "a").join(other.select("b", "db"), "b")
        moved = moved.withColumn("delta", F.concat(F.array_except("da", "db"), F.array_except("db", "da")))
        moved = scratch.write(moved.select("class", F.col("b").alias("base"), "linked", "group", "n", F.size("delta").alias("d"), F.lit(0).alias("own"), "delta"))
        more = with_hubs(moved.select("class", "base", "linked", "group", "n", "d", "own", F.explode("delta").alias("e")), "base").filter("differ <= most").select("a", "b", "ag", "bg")
        found, kept = found.union(more.select("a", "b")), merged(kept, more)
        scratch.drop(moved)
        scratch.drop(bases)
    probe = kept.select(*fields, "own", F.explode("prefix").alias("e"))
    sizes = probe.groupBy("cluster", "e", "group").agg(F.count("*").alias("size")).groupBy("cluster", "e")
    lists = scratch.write(sizes.agg(F.max_by("group", F.struct("size", "group")).alias("largest"), F.count("*").alias("groups")).filter("groups > 1").select("cluster", "e", "largest"))
    listed = scratch.write(probe.join(sent(lists), ["cluster", "e"]).withColumn("outer", F.col("group") != F.col("largest")).select(*fields, "own", "e", "outer"), drop=[lists])
    x = listed.filter("outer").select("cluster", "e", *side("a"))
    y = listed.select("cluster", "e", F.col("outer").alias("b_outer"), *side("b"))
    pairs = x.join(y, [x["cluster"] == y["cluster"], x["e"] == y["e"], F.expr(f"ag <> bg AND (NOT b_outer OR a < b) AND {able}")])
    more = verified(pairs).filter("differ <= most")
    return found.union(more.groupBy("ag", "bg").agg(F.min(F.struct("a", "b")).alias("link")).select("link.*"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, *, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; links at a likeness of percent or more.

    keyed: also th (hash of the row's text) and label (of its component; null for an empty set), which
    tell rows of one or of no doc_id apart.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(described(docs, percent))
    classes = scratch.write(rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    clusters = scratch.write(clusters_of(classes, scratch))
    members = scratch.write(compared(docs, classes, clusters, scratch, percent))
    found = components(links_of(members, scratch, percent), scratch)
    named = classes.select("class", "doc_id").join(found, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch.write(named.select("class", "label").join(least, "label").select("class", "component_id", "label"))
    out = rows.select("doc_id", "th", "n_shingles", "class").join(of_class, "class", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), *(["th", "label"] if keyed else []))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by joining all shingles and walking the links.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
walk AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT walk.a, links.b FROM walk JOIN links ON walk.b = links.a)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM walk GROUP BY a) USING (doc_id)
"""
