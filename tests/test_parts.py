"""Stores with several writers, record files, append requests, submitted writes, Bloom probes, many ranges."""

import io
import os
import random

import duckdb
import pytest

from keylode.functions import bloom, codec
from keylode.operators import consensus, order, runs, state
from keylode.operators.store import RunStore
from keylode.sources import log_files

LOG = "seq long, key string, value string, tombstone boolean"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_no_flush_is_lost(spark, tmp_path, monkeypatch):
    store, other = (RunStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    write, first = runs.write_run, []

    def slow(run, path, **more):
        write(run, path, **more)
        if not first:  # another writer publishes while this one still writes
            first.append(1)
            other.flush(log_of(spark, [(1, "theirs", "1", False), (1, "both", "1", False)]))

    monkeypatch.setattr(runs, "write_run", slow)
    store.flush(log_of(spark, [(2, "mine", "2", False), (2, "both", "2", False)]))
    assert {r["key"]: r["value"] for r in store.state().collect()} == {"theirs": "1", "mine": "2", "both": "2"}
    assert [x["run_id"] for x in store.runs()] == [0, 1]


def test_a_flush_beside_a_compaction_stays(spark, tmp_path, monkeypatch):
    store, other = (RunStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    for i in range(2):
        store.flush(log_of(spark, [(i, "k", str(i), False)]))
    write, first = runs.write_run, []

    def slow(run, path, **more):
        write(run, path, **more)
        if not first:
            first.append(1)
            other.flush(log_of(spark, [(9, "k", "9", False), (9, "new", "9", False)]))

    monkeypatch.setattr(runs, "write_run", slow)
    assert store.compact(force=True)
    assert {r["key"]: r["value"] for r in store.state().collect()} == {"k": "9", "new": "9"}
    assert [(x["run_id"], x["level"]) for x in store.runs()] == [(1, 1), (2, 0)]


def test_vacuum_leaves_what_a_writer_has_pending(spark, tmp_path, monkeypatch):
    store, other = (RunStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    write, gone = runs.write_run, []

    def slow(run, path, **more):
        write(run, path, **more)
        gone.append(other.vacuum())

    monkeypatch.setattr(runs, "write_run", slow)
    store.flush(log_of(spark, [(1, "k", "v", False)]))
    assert gone == [0] and store.state().first()["value"] == "v"
    os.makedirs(tmp_path / "store/runs/abandoned")
    assert other.vacuum() == 1


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_records_are_read_piece_by_piece(size):
    rng = random.Random(size)
    rows = [(rng.randbytes(rng.randint(0, 9)), rng.choice([None, rng.randbytes(rng.randint(0, 40))])) for _ in range(60)]
    blob = b"".join(codec.encode_one(k, v, v is None) for k, v in rows)
    for end in (len(blob), len(blob) - 1, len(blob) - 20, 5, 0):
        assert list(codec.stream(io.BytesIO(blob[:end]).read, size=size)) == list(codec.records(blob[:end]))
    bad = bytearray(blob)
    bad[len(blob) // 2] ^= 1
    assert list(codec.stream(io.BytesIO(bytes(bad)).read, size=size, strict=False)) == list(codec.records(bytes(bad), strict=False))


def test_written_files_are_read_in_order(spark, tmp_path):
    rows = [(i, f"k{i % 7}", None if i % 5 == 0 else f"v{i}", i % 5 == 0) for i in range(200)]
    assert log_files.write_log(log_of(spark, rows), str(tmp_path / "log"), records_a_file=40) > 1
    got = log_files.read_log(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [(bytes(r["key"]).decode(), r["value"] and bytes(r["value"]).decode(), r["tombstone"]) for r in got] == [r[1:] for r in rows]
    assert log_files.write_log(log_of(spark, []), str(tmp_path / "none")) <= 1
    assert log_files.read_log(spark, str(tmp_path / "none")).count() == 0


def handled(own, current, commit, term, prev, prev_term, leader_commit, sent):
    """One node, by a plain loop: success, log, commit; logs start at place 1."""
    log = [0, *own]
    if term < current or prev >= len(log) or log[prev] != prev_term:
        return False, log[1:], commit
    for i, t in enumerate(sent):
        at = prev + 1 + i
        if at < len(log) and log[at] != t:
            log = log[:at]
        if at >= len(log):
            log.append(t)
    return True, log[1:], max(commit, min(leader_commit, len(log) - 1))


def test_append_requests_against_a_plain_loop(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(80):
        own = sorted(rng.randint(1, 3) for _ in range(rng.randint(0, 6)))
        prev = rng.randint(0, 7)
        prev_term = ([0, *own][prev] if prev <= len(own) and rng.random() < 0.8 else rng.randint(1, 3)) if prev else 0
        sent = sorted(rng.randint(1, 4) for _ in range(rng.randint(0, 4)))
        cases.append((own, rng.randint(1, 3), rng.randint(0, 3), rng.randint(1, 4), prev, prev_term, rng.randint(0, 9), sent))
    logs = lambda at: spark.createDataFrame([(n, i, t) for n, c in enumerate(cases) for i, t in at(c)], "node long, log_index long, term long")
    own, sent = logs(lambda c: enumerate(c[0], 1)), logs(lambda c: enumerate(c[7], c[4] + 1))
    nodes = spark.createDataFrame([(n, c[1], c[2]) for n, c in enumerate(cases)], "node long, current_term long, commit_index long")
    requests = spark.createDataFrame([(n, c[3], c[4], c[5], c[6]) for n, c in enumerate(cases)], "node long, term long, prev_index long, prev_term long, leader_commit long")
    expected = [handled(c[0], c[1], c[2], *c[3:]) for c in cases]
    replies = {r["node"]: r for r in consensus.append_replies(own, nodes, requests, sent).collect()}
    for n, (ok, log, commit) in enumerate(expected):
        assert (replies[n]["success"], replies[n]["commit_index"], replies[n]["last_index"], replies[n]["term"]) == (ok, commit, len(log), max(cases[n][1], cases[n][3]))
    got = sorted(tuple(r) for r in consensus.append_entries(own, nodes, requests, sent).collect())
    assert got == sorted((n, i, t) for n, (_, log, _) in enumerate(expected) for i, t in enumerate(log, 1))


def test_votes(spark):
    rows = [(5, 5, 1, None, 2, 9, 2, 9), (5, 5, 1, 1, 2, 9, 2, 8), (5, 5, 1, 2, 2, 9, 2, 8), (6, 5, 1, 2, 2, 9, 2, 8), (4, 5, 1, None, 9, 9, 1, 1), (5, 5, 1, None, 2, 7, 2, 8), (5, 5, 1, None, 3, 1, 2, 8)]
    df = spark.createDataFrame(rows, "term long, own_current long, candidate long, voted_for long, last_term long, last_index long, own_term long, own_index long")
    assert [r["granted"] for r in consensus.votes_granted(df).collect()] == [True, True, False, True, False, False, True]


def test_submitted_writes(spark):
    asked = spark.createDataFrame([(3, "put", "a", "1"), (1, "delete", "b", None), (2, "get", "a", None), (9, "put", "b", "2"), (4, "put", "", "x")], "req_id long, op string, key string, value string")
    replies = state.submit(asked, last_index=10, term=2, leader=1)
    assert sorted((r["req_id"], r["ok"], r["index"], r["term"], r["leader"]) for r in replies.collect()) == [(1, True, 11, 2, 1), (3, True, 12, 2, 1), (9, True, 13, 2, 1)]
    assert {r["key"]: (r["value"], r["tombstone"], r["seq"]) for r in state.lww(state.submitted(replies)).collect()} == {"a": ("1", False, 12), "b": ("2", False, 13)}
    refused = state.submit(asked, last_index=10, term=2, leader=1, is_leader=False)
    assert {(r["ok"], r["index"]) for r in refused.collect()} == {(False, -1)} and state.submitted(refused).count() == 0


def test_bloom_vectors_and_probes(spark):
    rng = random.Random(8)
    keys = [rng.randbytes(rng.randint(0, 21)) for _ in range(400)]
    assert [list(x) for x in bloom.positions_of(keys, 9586, 14)] == [bloom.positions(k, 9586, 14) for k in keys]
    df = spark.createDataFrame([(bytearray(k),) for k in set(keys[:200])], "key binary")
    every = spark.createDataFrame([(bytearray(k),) for k in set(keys)], "key binary")
    one = bloom.Bloom.of(keys[:200], 20)  # so small that others pass
    got = {bytes(r["key"]): r["maybe"] for r in bloom.probe(every, bloom.filter_bits(df, 20), 20).collect()}
    assert got == {k: k in one for k in set(keys)} and set(got.values()) == {True, False}
    with pytest.raises(ValueError):
        bloom.might_contain(bloom.Bloom(8 * bloom.SENT_BYTES + 8, 1, bytearray(bloom.SENT_BYTES + 1)))


def test_many_ranges(spark):
    df = spark.range(5000).selectExpr("cast(id * 7 % 5000 as string) AS k", "id % 5 + 1 AS w")
    got = {r["k"]: (r["n"], r["s"]) for r in order.totals(df, "k", {"n": df["w"] * 0 + 1, "s": df["w"]}, rows_a_range=3).collect()}
    total = 0
    for i, r in enumerate(sorted(df.collect()), 1):
        total += r["w"]
        assert got[r["k"]] == (i, total)


def test_state_is_asked_only_for_keys_of_the_batch(spark):
    held = spark.range(1000).selectExpr("concat('k', id) AS key", "'v' AS value", "false AS tombstone", "id AS seq")
    asked = spark.createDataFrame([(1, "get", "k7", None), (2, "get", "none", None)], "req_id long, op string, key string, value string")
    df = state.serve(asked, held)
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["req_id"]: (r["ok"], r["value"]) for r in df.collect()} == {1: (True, "v"), 2: (False, None)}


@pytest.mark.parametrize("name", ["flush_runs_by_threshold", "bloom_bits", "crc_valid", "stored_compaction", "append_replies"])
def test_queries_on_another_log(spark, tmp_path, name):
    from keylode.plans import catalog

    made = spark.range(1500).selectExpr("id AS event_id", "id * 7 % 45 AS user_id", "if(id % 11 = 0, 'error', 'view') AS event_type", "repeat(concat('p', id), cast(id % 9 as int)) AS props")
    made.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df, r = catalog.QUERIES[name](spark, str(tmp_path)), con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(map(str, df.select(*columns).collect())) == sorted(str(df.select(*columns).collect()[0].__class__(**dict(zip(columns, x, strict=True)))) for x in r.fetchall())
