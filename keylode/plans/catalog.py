"""The registered queries over the driver's tables, and the SQL that each must agree with.

The change log is made of ``events``: seq is event_id (ids rise with time), key the user, value the
properties, and an ``error`` event deletes.  Keys are strings here, so that any engine can read results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from keylode.functions import bloom, codec
from keylode.operators import consensus, order, runs, state
from keylode.operators.store import RunStore
from keylode.scratch import shared_folder

SEGMENT = 64 << 10
RUN_EVENTS = 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log.  Names are given before any reduction, so that predicates on key reach the scan."""
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.when(~gone, F.col("props")).alias("value"), gone.alias("tombstone"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("key"), F.when(~gone, F.col("o_orderpriority")).alias("value"), gone.alias("tombstone"))


LOG = "log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_type = 'error' AS tombstone FROM events)"
STATE = LOG + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log), state AS (SELECT key, value, tombstone, seq FROM ranked WHERE rn = 1)"
RUNS = LOG + f", runs AS (SELECT *, (seq // {RUN_EVENTS}) AS run_id FROM log), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rn FROM runs) WHERE rn = 1), merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) AS r2 FROM newest) WHERE r2 = 1)"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {STATE} SELECT key, value, tombstone, seq FROM state")
def lww_state(spark, d):
    return state.lww(events_log(spark, d))


@query(f"WITH {STATE} SELECT key, value FROM state WHERE NOT tombstone")
def live_scan(spark, d):
    return state.live(events_log(spark, d))


@query(f"WITH {STATE} SELECT key, value, tombstone FROM state ORDER BY key")
def ordered_scan(spark, d):
    return state.ordered_scan(state.lww(events_log(spark, d))).select("key", "value", "tombstone")


@query("WITH log AS (SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value, o_orderstatus = 'F' AS tombstone FROM orders) SELECT key, value, tombstone, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1")
def orders_state(spark, d):
    return state.lww(orders_log(spark, d))


@query(f"WITH {STATE}, probes AS (SELECT DISTINCT CAST(user_id * 2 AS VARCHAR) AS key FROM events) SELECT p.key, s.key IS NOT NULL AS found, coalesce(s.tombstone, false) AS tombstone, s.value, CASE WHEN s.key IS NULL THEN 'absent' WHEN s.tombstone THEN 'deleted' ELSE 'live' END AS outcome FROM probes p LEFT JOIN state s ON p.key = s.key")
def multi_get(spark, d):
    probes = table(spark, d, "events").select((F.col("user_id") * 2).cast("string").alias("key")).distinct()
    return state.multi_get(state.lww(events_log(spark, d)), probes)


@query(f"WITH {STATE} SELECT key, value, tombstone FROM state WHERE key = '7'")
def point_get(spark, d):
    return state.get(state.lww(events_log(spark, d)), "7")


@query(f"WITH {STATE} SELECT key, value, tombstone, seq FROM state WHERE key >= '1' AND key < '3'")
def range_scan(spark, d):
    return state.range_scan(state.lww(events_log(spark, d)), "1", "3")


@query(f"WITH {STATE} SELECT CASE WHEN tombstone THEN 'deleted' ELSE 'live' END AS outcome, count(*) AS keys FROM state GROUP BY 1")
def outcome_counts(spark, d):
    s = state.lww(events_log(spark, d))
    return s.groupBy(state.outcome(F.lit(True), F.col("tombstone")).alias("outcome")).agg(F.count("*").alias("keys"))


@query(f"WITH {STATE} SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS memtable_bytes FROM state")
def memtable_bytes(spark, d):
    return state.size_bytes(state.lww(events_log(spark, d)))


@query(f"WITH {STATE} SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS memtable_bytes, sum(strlen(key) + coalesce(strlen(value), 0)) >= {runs.FLUSH_BYTES} AS is_full FROM state")
def flush_due(spark, d):
    return state.is_full(state.lww(events_log(spark, d)), runs.FLUSH_BYTES)


@query(f"WITH {LOG}, total AS (SELECT seq, CAST(13 + strlen(key) + CASE WHEN tombstone THEN 0 ELSE strlen(value) END AS BIGINT) AS record_bytes FROM log), s AS (SELECT *, CAST(sum(record_bytes) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes FROM total) SELECT seq, record_bytes, total_bytes, CAST(floor((total_bytes - 1) / {SEGMENT}) AS BIGINT) AS segment FROM s")
def wal_segments(spark, d):
    return runs.segments(events_log(spark, d), SEGMENT)


@query(f"WITH {STATE}, sized AS (SELECT key, 13 + strlen(key) + coalesce(strlen(value), 0) AS b FROM state), placed AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS number, sum(b) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) - b AS start, sum(b) OVER () AS total FROM sized), entries AS (SELECT * FROM placed WHERE number % 8 = 0) SELECT key, CAST(number AS BIGINT) AS number, CAST(start AS BIGINT) AS offset, CAST(coalesce(lead(start) OVER (ORDER BY number), total) AS BIGINT) AS block_end FROM entries".replace("AS offset", 'AS "offset"'))
def sparse_index(spark, d):
    return runs.sparse_index(state.lww(events_log(spark, d)))


@query(f"WITH {STATE}, idx AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n FROM state) WHERE n % 8 = 0), probes AS (SELECT DISTINCT CAST(user_id * 2 AS VARCHAR) AS key FROM events) SELECT p.key, (SELECT max(i.key) FROM idx i WHERE i.key <= p.key) AS index_key FROM probes p")
def floor_lookup(spark, d):
    s = state.lww(events_log(spark, d))
    probes = table(spark, d, "events").select((F.col("user_id") * 2).cast("string").alias("key")).distinct()
    return runs.floor_lookup(runs.sparse_index(s).select("key"), probes)


@query(f"WITH {STATE}, idx AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n FROM state) WHERE n % 8 = 0) SELECT key, value, tombstone, seq FROM state WHERE key >= (SELECT max(key) FROM idx WHERE key <= '40') AND key < coalesce((SELECT min(key) FROM idx WHERE key > '40'), 'zzz')")
def block_range(spark, d):
    s = state.lww(events_log(spark, d))
    return runs.block_range(s, runs.sparse_index(s).select("key"), "40")


def runs_of_events(spark, d):
    """The newest operation of each key in each run of RUN_EVENTS events."""
    log = events_log(spark, d).withColumn("run_id", F.expr(f"seq div {RUN_EVENTS}"))
    newest = log.groupBy("run_id", "key").agg(F.max_by(F.struct("value", "tombstone", "seq"), "seq").alias("op"))
    return newest.select("run_id", F.lit(0).alias("level"), "key", "op.value", "op.tombstone", "op.seq")


@query(f"WITH {RUNS} SELECT CAST(run_id AS BIGINT) AS run_id, key, value, tombstone, seq FROM newest")
def sorted_runs(spark, d):
    return runs_of_events(spark, d).select("run_id", "key", "value", "tombstone", "seq")


@query(f"WITH {RUNS} SELECT key, value, tombstone, seq, CAST(run_id AS BIGINT) AS run_id FROM merged WHERE NOT tombstone")
def compact_runs(spark, d):
    return runs.compact(runs_of_events(spark, d))


@query(f"WITH {RUNS} SELECT key, value, tombstone, seq, CAST(run_id AS BIGINT) AS run_id FROM merged")
def merge_runs(spark, d):
    return runs.compact(runs_of_events(spark, d), bottom_level=False)


@query(f"WITH {STATE} SELECT key, seq FROM state WHERE tombstone")
def tombstone_keys(spark, d):
    return state.lww(events_log(spark, d)).filter("tombstone").select("key", "seq")


@query(f"WITH {LOG} SELECT key, count(*) AS writes, CAST(count(*) FILTER (tombstone) AS BIGINT) AS deletes, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY key")
def write_counts(spark, d):
    return state.write_counts(events_log(spark, d))


@query(f"WITH {LOG} SELECT key, value, tombstone, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log)) WHERE rn = 1")
def as_of_middle(spark, d):
    log = events_log(spark, d)
    return state.as_of(log, log.agg(F.expr("max(seq) div 2")).first()[0])


@query(f"WITH {LOG} SELECT seq, key, value, tombstone, row_number() OVER (PARTITION BY key ORDER BY seq) AS version, coalesce(lead(seq) OVER (PARTITION BY key ORDER BY seq), -1) AS valid_to FROM log")
def key_history(spark, d):
    return state.history(events_log(spark, d)).withColumn("valid_to", F.coalesce("valid_to", F.lit(-1).cast("long")))


@query(f"WITH {STATE} SELECT l.seq, l.key, l.value, l.tombstone FROM log l WHERE EXISTS (SELECT 1 FROM state s WHERE s.key = l.key AND NOT s.tombstone)")
def bloom_semi_join(spark, d):
    log = events_log(spark, d)
    return runs.bloom_semi_join(log, state.live(log)).select("seq", "key", "value", "tombstone")


@query(f"WITH {STATE} SELECT l.seq, l.key, l.value, l.tombstone FROM log l WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.key = l.key AND s.tombstone)")
def tombstone_anti_join(spark, d):
    log = events_log(spark, d)
    gone = state.lww(log).filter("tombstone").select("key")
    return log.join(gone, "key", "left_anti").select("seq", "key", "value", "tombstone")


def probe_requests(spark, d):
    """Gets, puts and deletes made of events: purchases ask, errors delete, all others put."""
    op = F.when(F.col("event_type") == "purchase", "get").when(F.col("event_type") == "error", "delete").otherwise("put")
    return table(spark, d, "events").select(F.col("event_id").alias("req_id"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.when(op == "put", F.col("props")).alias("value"))


@query(
    """WITH r AS (SELECT event_id AS req_id, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'purchase' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'put' END AS op, props FROM events),
    w AS (SELECT *, max(CASE WHEN op <> 'get' THEN req_id END) OVER (PARTITION BY key ORDER BY req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r)
    SELECT w.req_id, w.op, w.key, CASE WHEN w.op = 'get' THEN w.last IS NOT NULL ELSE true END AS ok, CASE WHEN w.op = 'get' AND p.op = 'put' THEN p.props END AS value, CASE WHEN w.op = 'get' THEN coalesce(p.op = 'delete', false) ELSE w.op = 'delete' END AS tombstone
    FROM w LEFT JOIN r p ON p.req_id = w.last"""
)
def serve_requests(spark, d):
    none = spark.createDataFrame([], "key string, value string, tombstone boolean, seq long")
    return state.serve(probe_requests(spark, d), none)


#: A record's body in hexadecimal, its bytes as numbers, and the checksum's table, made by its rule.
BODY = "upper(lpad(hex(strlen(key)), 8, '0') || lpad(hex(coalesce(strlen(value), 0)), 8, '0') || CASE WHEN tombstone THEN '01' ELSE '00' END || hex(key) || coalesce(hex(value), ''))"
DIGIT = "(instr('0123456789ABCDEF', substr({}, {}, 1)) - 1)"
BYTES = "list_transform(range(0, len(body) // 2), lambda i: CAST(" + DIGIT.format("body", "2 * i + 1") + " * 16 + " + DIGIT.format("body", "2 * i + 2") + " AS BIGINT))"
CRC_TABLE = "crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


@query(f"WITH {LOG}, {CRC_TABLE}, coded AS (SELECT seq, {BODY} AS body FROM log), numbers AS (SELECT seq, {BYTES} AS b FROM coded) SELECT seq, CAST(len(b) + 4 AS BIGINT) AS record_bytes, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc, true AS valid FROM numbers, crc_table")
def crc_valid(spark, d):
    """Every record encoded, and its checksum."""
    log = events_log(spark, d)
    coded = log.withColumn("record", codec.encode(F.col("key"), F.col("value"), F.col("tombstone")))
    return coded.select("seq", F.octet_length("record").cast("long").alias("record_bytes"), F.crc32(codec.body(F.col("key"), F.col("value"), F.col("tombstone"))).alias("crc"), codec.is_valid(F.col("record")).alias("valid"))


@query(f"WITH {LOG} SELECT seq, upper(lpad(hex(strlen(key)), 8, '0') || lpad(hex(coalesce(strlen(value), 0)), 8, '0') || CASE WHEN tombstone THEN '01' ELSE '00' END || hex(key) || coalesce(hex(value), '')) AS body FROM log")
def record_body(spark, d):
    log = events_log(spark, d)
    return log.select("seq", F.hex(codec.body(F.col("key"), F.col("value"), F.col("tombstone"))).alias("body"))


@query(f"WITH {LOG} SELECT seq, key, value, tombstone, true AS valid FROM log")
def record_round_trip(spark, d):
    log = events_log(spark, d)
    coded = log.select("seq", codec.encode(F.col("key"), F.col("value"), F.col("tombstone")).alias("record"))
    return codec.decode(coded).select("seq", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tombstone", "valid")


FLUSH = 1024


@query(
    f"""WITH RECURSIVE {LOG}, sized AS MATERIALIZED (SELECT seq, key, strlen(key) AS k, CASE WHEN tombstone THEN 0 ELSE strlen(value) END AS v, lag(seq) OVER w AS old_seq, lag(CASE WHEN tombstone THEN 0 ELSE strlen(value) END) OVER w AS old_v FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)),
    cut AS (SELECT CAST(0 AS BIGINT) AS run_id, (SELECT min(seq) FROM log) AS first_seq
    UNION ALL SELECT run_id + 1, last_seq + 1 FROM (SELECT run_id, min(seq) AS last_seq FROM (SELECT c.run_id, z.seq, sum(z.v + CASE WHEN z.old_seq >= c.first_seq THEN -z.old_v ELSE z.k END) OVER (ORDER BY z.seq) AS size FROM cut c JOIN sized z ON z.seq >= c.first_seq AND z.seq < c.first_seq + {FLUSH}) WHERE size >= {FLUSH} GROUP BY 1) WHERE last_seq < (SELECT max(seq) FROM log)),
    placed AS (SELECT l.*, c.run_id FROM log l ASOF JOIN cut c ON l.seq >= c.first_seq)
    SELECT run_id, key, CASE WHEN tombstone THEN NULL ELSE value END AS value, tombstone, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rn FROM placed) WHERE rn = 1"""
)
def flush_runs_by_threshold(spark, d):
    """Runs cut where the live bytes reach a threshold.  Every operation has a byte at least, and seq has no gaps, so a run ends within FLUSH of them."""
    return runs.flush_runs(events_log(spark, d), FLUSH)


M32 = 0xFFFFFFFF


def murmur_sql(b: str, seed: str) -> str:
    """The 32-bit hash of a list of byte numbers, in wide integers."""
    mul = lambda x, c: f"(({x}) * {c} & {M32})"
    let = lambda value, name, body: f"list_transform([CAST({value} AS HUGEINT)], lambda {name}: {body})[1]"
    turn = lambda x, r: f"((({x} << {r}) | ({x} >> {32 - r})) & {M32})"
    mixed = lambda word: mul(let(mul(word, bloom.C1), "q", turn("q", 15)), bloom.C2)
    words = f"list_transform(range(0, len({b}) // 4), lambda i: {mixed(f'CAST({b}[4 * i + 1] + 256 * {b}[4 * i + 2] + 65536 * {b}[4 * i + 3] + 16777216 * {b}[4 * i + 4] AS HUGEINT)')})"
    step = mul(let("xor(g, w)", "y", turn("y", 13)), 5)
    whole = f"list_reduce(list_concat([CAST({seed} AS HUGEINT)], {words}), lambda g, w: ({step} + {0xE6546B64} & {M32}))"
    rest = f"list_sum(list_transform(range(0, len({b}) % 4), lambda i: {b}[len({b}) - len({b}) % 4 + 1 + i] * CAST(256 ** i AS BIGINT)))"
    tail = f"CASE WHEN len({b}) % 4 = 0 THEN 0 ELSE {mixed(f'CAST({rest} AS HUGEINT)')} END"
    last = let(f"xor(xor({whole}, {tail}), len({b}))", "x", let(mul("xor(x, x >> 16)", 0x85EBCA6B), "y", let(mul("xor(y, y >> 13)", 0xC2B2AE35), "z", "xor(z, z >> 16)")))
    return f"CAST({last} AS HUGEINT)"


def positions_sql(keys: str, expected: int) -> str:
    """CTEs from keys (a query of key) to positions (key, position): a list's bytes, both hashes, and each position."""
    bits, hashes = bloom.sizing(expected)
    return f"keyed AS (SELECT key, list_transform(range(0, strlen(key)), lambda i: CAST(" + DIGIT.format("hex(key)", "2 * i + 1") + " * 16 + " + DIGIT.format("hex(key)", "2 * i + 2") + f" AS BIGINT)) AS b FROM ({keys})), first AS (SELECT key, b, {murmur_sql('b', str(bloom.SEED))} AS h1 FROM keyed), second AS (SELECT key, h1, {murmur_sql('b', 'h1')} AS h2 FROM first), positions AS (SELECT key, CAST((h1 + i * h2 & {M32}) % {bits} AS BIGINT) AS position FROM second, range(0, {hashes}) r(i))"


@query(f"WITH {positions_sql('SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events', 10_000)} SELECT DISTINCT position FROM positions")
def bloom_bits(spark, d):
    """Positions that the keys' filter sets, bit for bit."""
    keys = state.lww(events_log(spark, d)).select(F.col("key").cast("binary").alias("key"))
    return bloom.filter_bits(keys, 10_000)


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, true AS maybe FROM events")
def bloom_might_contain(spark, d):
    keys = state.lww(events_log(spark, d)).select("key")
    filled = bloom.build(keys, 2_000)
    return keys.withColumn("maybe", bloom.might_contain(filled)(F.col("key").cast("binary")))


PROBES = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events UNION SELECT DISTINCT CAST(user_id * 7 AS VARCHAR) || '-absent' FROM events"


@query(f"WITH {positions_sql(PROBES, 64)}, own AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events), filled AS (SELECT DISTINCT position FROM positions WHERE key IN (SELECT key FROM own)) SELECT p.key, bool_and(f.position IS NOT NULL) AS maybe FROM positions p LEFT JOIN filled f ON f.position = p.position GROUP BY p.key")
def bloom_probes(spark, d):
    """Keys that were added and keys that were not, against a filter sized too small, so that some of those pass too."""
    keys = state.lww(events_log(spark, d)).select("key")
    absent = table(spark, d, "events").select(F.concat((F.col("user_id") * 7).cast("string"), F.lit("-absent")).alias("key"))
    return bloom.probe(keys.union(absent), bloom.filter_bits(keys, 64), 64)


@query("WITH v AS (SELECT user_id // 10 AS term, user_id % 3 AS candidate, event_id % 7 AS voter, event_type IN ('view', 'click') AS granted FROM events), g AS (SELECT term, candidate, count(DISTINCT voter) AS granted FROM v WHERE granted GROUP BY ALL) SELECT term, candidate, granted, granted >= 7 // 2 + 1 AS won FROM g")
def vote_majority(spark, d):
    votes = table(spark, d, "events").select(F.expr("user_id div 10").alias("term"), (F.col("user_id") % 3).alias("candidate"), (F.col("event_id") % 7).alias("voter"), F.col("event_type").isin("view", "click").alias("granted"))
    members = votes.select("term").distinct().withColumn("n", F.lit(7))
    return consensus.vote_majority(votes, members)


@query("WITH m AS (SELECT o_custkey AS leader, o_orderkey AS match FROM orders), r AS (SELECT leader, match, row_number() OVER (PARTITION BY leader ORDER BY match DESC) AS rn, count(*) OVER (PARTITION BY leader) AS n FROM m), t AS (SELECT o_custkey AS leader, min(o_orderkey) FILTER (o_orderstatus = 'O') AS first_index FROM orders GROUP BY 1) SELECT r.leader, CAST(CASE WHEN match >= first_index THEN match ELSE 0 END AS BIGINT) AS commit_index FROM r JOIN t ON r.leader = t.leader WHERE rn = n // 2 + 1")
def commit_index(spark, d):
    orders = table(spark, d, "orders")
    matches = orders.select(F.col("o_custkey").alias("leader"), F.col("o_orderkey").alias("peer"), F.col("o_orderkey").alias("match"))
    terms = orders.groupBy(F.col("o_custkey").alias("leader")).agg(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("first_index"))
    return consensus.commit_index(matches, terms)


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS last_term, l_partkey AS last_index, l_partkey % 100 AS own_term, l_orderkey AS own_index, (l_suppkey > l_partkey % 100 OR (l_suppkey = l_partkey % 100 AND l_partkey >= l_orderkey)) AS ok FROM lineitem")
def up_to_date(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("last_term"), F.col("l_partkey").alias("last_index"), (F.col("l_partkey") % 100).alias("own_term"), F.col("l_orderkey").alias("own_index"))
    return consensus.up_to_date(rows)


OWN = "own AS (SELECT user_id % 5 AS node, event_id AS log_index, event_id // 100 AS term FROM events), sent AS (SELECT user_id % 5 AS node, event_id AS log_index, event_id // 100 + CASE WHEN event_id % 500 > 450 AND event_id > 600 THEN 1 ELSE 0 END AS term FROM events WHERE event_id > 300)"


def replica_logs(spark, d):
    e = table(spark, d, "events")
    node, i = (F.col("user_id") % 5).alias("node"), F.col("event_id")
    own = e.select(node, i.alias("log_index"), F.expr("event_id div 100").alias("term"))
    sent = e.filter(i > 300).select(node, i.alias("log_index"), (F.expr("event_id div 100") + F.when((i % 500 > 450) & (i > 600), 1).otherwise(0)).alias("term"))
    return own, sent


@query(f"WITH {OWN}, c AS (SELECT o.node, min(o.log_index) AS conflict_index FROM own o JOIN sent s ON o.node = s.node AND o.log_index = s.log_index WHERE o.term <> s.term GROUP BY 1) SELECT n.node, c.conflict_index FROM (SELECT DISTINCT node FROM own) n LEFT JOIN c ON c.node = n.node")
def log_conflict(spark, d):
    return consensus.log_conflict(*replica_logs(spark, d))


@query(f"WITH {OWN}, c AS (SELECT o.node, min(o.log_index) AS ci FROM own o JOIN sent s ON o.node = s.node AND o.log_index = s.log_index WHERE o.term <> s.term GROUP BY 1), kept AS (SELECT o.node, o.log_index, o.term FROM own o LEFT JOIN c ON c.node = o.node WHERE ci IS NULL OR log_index < ci) SELECT node, log_index, CAST(term AS BIGINT) AS term FROM kept UNION ALL SELECT s.node, s.log_index, CAST(s.term AS BIGINT) FROM sent s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.node = s.node AND k.log_index = s.log_index)")
def append_entries(spark, d):
    return consensus.appended(*replica_logs(spark, d))


@query("WITH e AS (SELECT user_id % 5 AS node, user_id AS peer, event_id AS log_index, props AS value FROM events), m AS (SELECT node, peer, max(log_index) AS match FROM e GROUP BY ALL), r AS (SELECT node, match, row_number() OVER (PARTITION BY node ORDER BY match DESC) AS rn, count(*) OVER (PARTITION BY node) AS n FROM m), f AS (SELECT node, min(log_index) AS first_index FROM e GROUP BY 1) SELECT e.node, e.log_index, e.value FROM e JOIN r ON r.node = e.node AND r.rn = n // 2 + 1 JOIN f ON f.node = e.node WHERE e.log_index > f.first_index AND e.log_index <= r.match")
def apply_majority(spark, d):
    """All after each node's first entry up to what a majority of its users have reached."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("node"), F.col("user_id").alias("peer"), F.col("event_id").alias("log_index"), F.col("props").alias("value"))
    first = e.groupBy("node").agg(F.min("log_index").alias("first_index"))
    matches = e.groupBy(F.col("node").alias("leader"), "peer").agg(F.max("log_index").alias("match"))
    held = consensus.commit_index(matches, first.withColumnRenamed("node", "leader")).withColumnRenamed("leader", "node")
    commits = held.join(first, "node").select("node", F.col("first_index").alias("last_applied"), "commit_index")
    return consensus.applied(e.select("node", "log_index", "value"), commits)


@query(f"WITH {LOG} SELECT seq, key, row_number() OVER (ORDER BY seq) AS position FROM log")
def log_positions(spark, d):
    return order.numbered(events_log(spark, d).select("seq", "key"), "seq", "position", rows_a_range=4000)


@query(f"WITH {STATE} SELECT key, value, tombstone, seq FROM state")
def stream_state(spark, d):
    """The state kept from the log read as a stream; its changes are written out, batch by batch, and read back."""
    from keylode.streaming import fold

    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    gone = F.col("event_type") == "error"
    log = source.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.when(~gone, F.col("props")).alias("value"), gone.alias("tombstone"))
    folder = shared_folder(spark)
    fold.write_changes(log, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return fold.read_changes(spark, f"{folder}/out").select("key", "value", "tombstone", "seq")


def blocks_of(log: DataFrame, n: int) -> list[DataFrame]:
    """The log in n parts of even seq ranges."""
    top = log.agg(F.max("seq")).first()[0] or 0
    part = F.expr(f"least({n - 1}, seq * {n} div {top + 1})")
    return [log.filter(part == k) for k in range(n)]


def stored(spark, d, blocks: int = 4) -> RunStore:
    store = RunStore(spark, shared_folder(spark))
    for block in blocks_of(events_log(spark, d), blocks):
        store.flush(block)
    return store


@query(f"WITH {STATE} SELECT key, value, tombstone, seq FROM state")
def stored_state(spark, d):
    """Four runs written, the store opened again, and their state."""
    return RunStore(spark, stored(spark, d).path).state()


@query(f"WITH {STATE} SELECT key, value, tombstone FROM state WHERE key = '7'")
def stored_get(spark, d):
    """A point lookup in stored runs; the key's predicate reaches their files and Bloom filters."""
    return stored(spark, d).get("7")


@query(f"WITH {STATE}, b AS (SELECT max(seq) + 1 AS n FROM log), r AS (SELECT l.key, l.tombstone, least(3, seq * 4 // n) AS run_id, row_number() OVER (PARTITION BY l.key, least(3, seq * 4 // n) ORDER BY seq DESC) AS rn FROM log l, b) SELECT CAST(run_id AS BIGINT) AS run_id, CAST(0 AS INTEGER) AS level, count(*) AS keys, CAST(count(*) FILTER (tombstone) AS BIGINT) AS deletes FROM r WHERE rn = 1 GROUP BY run_id")
def stored_runs(spark, d):
    """What each stored run holds."""
    return stored(spark, d).read().groupBy("run_id", "level").agg(F.count("*").alias("keys"), F.count_if("tombstone").alias("deletes"))


@query(f"WITH {STATE} SELECT key, value, tombstone, seq, CAST(3 AS BIGINT) AS run_id, CAST(1 AS INTEGER) AS level FROM state WHERE NOT tombstone")
def stored_compaction(spark, d):
    """Four stored runs reach the trigger and become one of level 1; their folders go, and it is read again."""
    store = stored(spark, d)
    store.compact()
    store.vacuum()
    return store.read().select("key", "value", "tombstone", "seq", "run_id", "level")


@query(f"WITH {STATE} SELECT key, value, tombstone FROM state")
def record_files(spark, d):
    """The log written as files of checksummed records, read back, and its state."""
    from keylode.sources.log_files import read_log, write_log

    folder = shared_folder(spark)
    write_log(events_log(spark, d), folder, records_a_file=3000)
    return state.lww(read_log(spark, folder)).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tombstone")


def record_blocks(spark, d):
    """rank, content: each 100 records in a row as one file's bytes; last: how many bytes its last record has."""
    log = events_log(spark, d)
    coded = log.select("seq", F.expr("seq div 100").alias("rank"), codec.encode(F.col("key"), F.col("value"), F.col("tombstone")).alias("record"))
    files = coded.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("seq", "record"))).alias("rows"))
    content = F.aggregate("rows", F.lit(b""), lambda acc, x: F.concat(acc, x["record"]))
    return files.select("rank", content.alias("content"), F.octet_length(F.get("rows", F.size("rows") - 1)["record"]).alias("last"))


READ_BACK = "SELECT seq // 100 AS rank, key, value, tombstone FROM log"


@query(f"WITH {LOG} {READ_BACK} QUALIFY seq < max(seq) OVER (PARTITION BY seq // 100)")
def torn_files(spark, d):
    """Files whose last record is cut within its header or body: all whole records are read, without an error."""
    from keylode.sources.log_files import OFFSET_BITS, parse_files

    files = record_blocks(spark, d)
    cut = F.when(F.col("rank") % 2 == 0, F.col("last") - 5).otherwise(F.lit(2))  # bytes that go
    torn = files.select("rank", F.substring("content", F.lit(1), F.octet_length("content") - cut).alias("content"))
    return parse_files(torn).select(F.shiftright("seq", OFFSET_BITS).alias("rank"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tombstone")


@query(f"WITH {LOG} {READ_BACK} QUALIFY seq < max(seq) OVER (PARTITION BY seq // 100)")
def corrupt_files(spark, d):
    """Files whose last record has a changed byte: permissive reading ends there, and keeps what stands before it."""
    from keylode.sources.log_files import OFFSET_BITS, parse_files

    files = record_blocks(spark, d)
    end = F.octet_length("content")
    changed = F.unhex(F.lpad(F.hex(F.lit(255) - F.conv(F.hex(F.substring("content", end, F.lit(1))), 16, 10).cast("long")), 2, "0"))
    bad = files.select("rank", F.concat(F.substring("content", F.lit(1), end - 1), changed).alias("content"))
    return parse_files(bad, strict=False).select(F.shiftright("seq", OFFSET_BITS).alias("rank"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tombstone")


@query("SELECT event_id AS req_id, CASE event_type WHEN 'error' THEN 'delete' ELSE 'put' END AS op, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type <> 'error' THEN props END AS value, true AS ok, CAST(1000 + row_number() OVER (ORDER BY event_id) AS BIGINT) AS index, CAST(3 AS BIGINT) AS term, 2 AS leader FROM events WHERE event_type <> 'purchase'".replace("AS index", 'AS "index"'))
def write_replies(spark, d):
    """Puts and deletes as a leader answers them: each takes the next place of the log."""
    return state.submit(probe_requests(spark, d), last_index=1000, term=3, leader=2)


@query("SELECT event_id AS req_id, false AS ok, CAST(-1 AS BIGINT) AS index, CAST(3 AS BIGINT) AS term, 2 AS leader FROM events WHERE event_type <> 'purchase'".replace("AS index", 'AS "index"'))
def refused_writes(spark, d):
    """The same sent to a node that does not lead."""
    return state.submit(probe_requests(spark, d), term=3, leader=2, is_leader=False).select("req_id", "ok", "index", "term", "leader")


WRITES = "w AS (SELECT row_number() OVER (ORDER BY event_id) AS seq, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_type = 'error' AS tombstone FROM events WHERE event_type <> 'purchase')"


@query(f"WITH {WRITES} SELECT key, value, tombstone, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM w) WHERE rn = 1")
def submitted_state(spark, d):
    """The state that accepted puts and deletes leave."""
    return state.lww(state.submitted(state.submit(probe_requests(spark, d))))


@query("WITH g AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, props AS value FROM events WHERE event_type <> 'error') SELECT key, value, false AS tombstone, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM g) WHERE rn = 1")
def put_state(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'error'")
    return state.lww(state.put(e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))))


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS value, true AS tombstone, max(event_id) AS seq FROM events GROUP BY user_id")
def delete_state(spark, d):
    """Puts of all keys, then deletes of all: every key is found, and is a tombstone."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))
    return state.lww(state.put(e.withColumn("seq", F.col("seq") - 1)).unionByName(state.delete(e)))


SERVED = """r AS (SELECT event_id AS req_id, CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'purchase' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'put' END AS op, props FROM events),
    w AS (SELECT *, max(CASE WHEN op <> 'get' THEN req_id END) OVER (PARTITION BY key ORDER BY req_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r)
    SELECT w.req_id, w.op, w.key, CASE WHEN w.op = 'get' THEN w.last IS NOT NULL ELSE true END AS ok, CASE WHEN w.op = 'get' AND p.op = 'put' THEN p.props END AS value, CASE WHEN w.op = 'get' THEN coalesce(p.op = 'delete', false) ELSE w.op = 'delete' END AS tombstone
    FROM w LEFT JOIN r p ON p.req_id = w.last"""


@query(f"WITH {SERVED} WHERE w.req_id > (SELECT max(event_id) // 2 FROM events)")
def serve_stored(spark, d):
    """The later half of all requests, served from stored runs that the earlier half's writes made."""
    asked = probe_requests(spark, d)
    middle = asked.agg(F.expr("max(req_id) div 2")).first()[0]
    store = RunStore(spark, shared_folder(spark))
    early = state.submitted(state.submit(asked.filter(F.col("req_id") <= middle)))
    for block in blocks_of(early, 2):
        store.flush(block)
    return state.serve(asked.filter(F.col("req_id") > middle), store.state())


@query("WITH q AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS candidate, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_suppkey % 5 END AS voted_for, l_partkey % 30 AS term, CAST(l_quantity AS BIGINT) % 30 AS own_current, l_suppkey % 9 AS last_term, l_partkey AS last_index, l_partkey % 8 AS own_term, l_orderkey AS own_index FROM lineitem) SELECT l_orderkey, l_linenumber, term >= own_current AND (term > own_current OR voted_for IS NULL OR voted_for = candidate) AND (last_term > own_term OR (last_term = own_term AND last_index >= own_index)) AS granted FROM q")
def vote_requests(spark, d):
    """Votes as nodes grant them: the term, the vote already given in it, and the candidate's log decide."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 4).alias("candidate"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_suppkey") % 5).alias("voted_for"),
        (F.col("l_partkey") % 30).alias("term"), (F.col("l_quantity").cast("long") % 30).alias("own_current"), (F.col("l_suppkey") % 9).alias("last_term"),
        F.col("l_partkey").alias("last_index"), (F.col("l_partkey") % 8).alias("own_term"), F.col("l_orderkey").alias("own_index"),
    )
    return consensus.votes_granted(rows).select("l_orderkey", "l_linenumber", "granted")


#: Five requests to each of five logs: entries that agree, that differ, of an old term, after a wrong entry, after a gap.
SENT = """one AS (SELECT user_id % 5 AS log, CAST(row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS BIGINT) AS log_index FROM events),
    ends AS (SELECT log, max(log_index) AS n FROM one GROUP BY log),
    own AS (SELECT log * 5 + r AS node, log_index, 1 + log_index // 50 AS term FROM one, range(0, 5) q(r)),
    requests AS (SELECT log * 5 + r AS node, r, CASE WHEN r = 2 THEN 0 ELSE 1000 END AS term, CASE WHEN r = 4 THEN n + 5 ELSE n // (r + 1) END AS prev_index, n FROM ends, range(0, 5) q(r)),
    asked AS (SELECT *, 1 + prev_index // 50 + CASE WHEN r = 3 THEN 1 ELSE 0 END AS prev_term, prev_index + 2 AS leader_commit, prev_index // 2 AS commit_index FROM requests),
    sent AS (SELECT node, prev_index + k AS log_index, 1 + (prev_index + k) // 50 + CASE WHEN r = 1 THEN 1 ELSE 0 END AS term FROM asked, range(1, 4) q(k)),
    ok AS (SELECT a.*, a.term >= 1 AND EXISTS (SELECT 1 FROM own o WHERE o.node = a.node AND o.log_index = a.prev_index AND o.term = a.prev_term) AS ok FROM asked a),
    cut AS (SELECT o.node, min(o.log_index) AS at FROM own o JOIN sent s ON s.node = o.node AND s.log_index = o.log_index JOIN ok ON ok.node = o.node AND ok.ok WHERE s.term <> o.term GROUP BY o.node),
    kept AS (SELECT o.* FROM own o LEFT JOIN cut c ON c.node = o.node WHERE c.at IS NULL OR o.log_index < c.at),
    logs AS (SELECT * FROM kept UNION ALL SELECT s.* FROM sent s JOIN ok ON ok.node = s.node AND ok.ok WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.node = s.node AND k.log_index = s.log_index))"""


def append_requests(spark, d):
    """own, nodes, requests, sent as in SENT; logs are numbered without gaps."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("log"), "event_id")
    one = e.select("log", F.row_number().over(Window.partitionBy("log").orderBy("event_id")).cast("long").alias("log_index"))
    r = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")
    own = one.select("log", "log_index", r).select((F.col("log") * 5 + F.col("r")).alias("node"), "log_index", (F.expr("log_index div 50") + 1).alias("term"))
    ends = one.groupBy("log").agg(F.max("log_index").alias("n")).select("log", "n", r)
    prev = F.when(F.col("r") == 4, F.col("n") + 5).otherwise(F.expr("n div (r + 1)"))
    asked = ends.select((F.col("log") * 5 + F.col("r")).alias("node"), "r", F.when(F.col("r") == 2, 0).otherwise(1000).cast("long").alias("term"), prev.alias("prev_index"))
    asked = asked.withColumn("prev_term", F.expr("1 + prev_index div 50 + if(r = 3, 1, 0)")).withColumn("leader_commit", F.col("prev_index") + 2)
    nodes = asked.select("node", F.lit(1).cast("long").alias("current_term"), F.expr("prev_index div 2").alias("commit_index"))
    sent = asked.select("node", "r", F.explode(F.sequence(F.col("prev_index") + 1, F.col("prev_index") + 3)).alias("log_index"))
    sent = sent.select("node", "log_index", F.expr("1 + log_index div 50 + if(r = 1, 1, 0)").alias("term"))
    return own, nodes, asked.select("node", "term", "prev_index", "prev_term", "leader_commit"), sent


@query(f"WITH {SENT} SELECT ok.node, CAST(greatest(ok.term, 1) AS BIGINT) AS term, ok.ok AS success, CAST(CASE WHEN ok.ok THEN greatest(ok.commit_index, least(ok.leader_commit, l.last_index)) ELSE ok.commit_index END AS BIGINT) AS commit_index, CAST(l.last_index AS BIGINT) AS last_index FROM ok JOIN (SELECT node, max(log_index) AS last_index FROM logs GROUP BY node) l ON l.node = ok.node")
def append_replies(spark, d):
    """Answers to append requests: the previous-entry test, gaps, old terms, and how far each node commits."""
    return consensus.append_replies(*append_requests(spark, d))


@query(f"WITH {SENT} SELECT node, CAST(log_index AS BIGINT) AS log_index, CAST(term AS BIGINT) AS term FROM logs")
def append_logs(spark, d):
    """The logs after those requests: refused ones change nothing."""
    return consensus.append_entries(*append_requests(spark, d))
