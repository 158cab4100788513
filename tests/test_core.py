"""State, codec, runs, Bloom filters, consensus, streaming: inputs with known outputs."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keylode.functions import bloom, codec
from keylode.operators import consensus, order, runs, state
from keylode.operators.store import RunStore
from keylode.schema import OP_LOG


def log_of(spark, rows):
    return spark.createDataFrame([(i, bytearray(k), None if v is None else bytearray(v), t) for i, (k, v, t) in enumerate(rows)], OP_LOG)


def plain(rows):
    return {bytes(r["key"]): None if r["value"] is None else bytes(r["value"]) for r in rows}


def test_state_transitions(spark):
    log = log_of(spark, [(b"a", b"1", False), (b"a", b"2", False), (b"b", b"", False), (b"a", None, True), (b"c", None, True)])
    rows = {bytes(r["key"]): (r["tombstone"], r["value"]) for r in state.lww(log).collect()}
    assert rows[b"a"] == (True, None) and rows[b"c"] == (True, None)
    assert rows[b"b"][0] is False and bytes(rows[b"b"][1]) == b""
    assert plain(state.live(log).collect()) == {b"b": b""}
    probes = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"z"),)], "key binary")
    got = {bytes(r["key"]): r["outcome"] for r in state.multi_get(state.lww(log), probes).collect()}
    assert got == {b"a": "deleted", b"b": "live", b"z": "absent"}
    assert state.as_of(log, 1).count() == 1


def test_state_under_shuffle_and_repeats(spark):
    rng = random.Random(5)
    ops = [(i, rng.choice("abcdef"), rng.choice([None, "x", "y"])) for i in range(200)]
    expected = {}
    for _, k, v in ops:
        expected[k] = v
    mixed = ops + rng.sample(ops, 60)
    rng.shuffle(mixed)
    log = spark.createDataFrame([(i, k, v, v is None) for i, k, v in mixed], "seq long, key string, value string, tombstone boolean")
    assert {r["key"]: r["value"] for r in state.lww(log).collect()} == expected


def test_unsigned_key_order(spark):
    keys = [b"\x7f", b"\x80", b"\xff", b"", b"a", b"ab"]
    log = log_of(spark, [(k, b"v", False) for k in keys])
    assert [bytes(r["key"]) for r in state.ordered_scan(state.lww(log)).collect()] == sorted(keys)


def test_sizes_and_threshold(spark):
    log = log_of(spark, [(b"alpha_row", b"x" * 44, False)])
    assert state.is_full(state.lww(log), 100).first() == (53, False)
    log = log_of(spark, [(b"alpha_row", b"x" * 44, False), (b"beta_row", b"y" * 39, False)])
    assert state.is_full(state.lww(log), 100).first() == (100, True)
    assert state.is_full(state.lww(log), 101).first() == (100, False)


def test_key_predicate_reaches_the_scan(spark, sf_dir):
    from keylode.plans.catalog import events_log

    plan = state.get(state.lww(events_log(spark, sf_dir)), "7")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter"), plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=9), st.one_of(st.none(), st.binary(max_size=30))), max_size=6), st.data())
def test_codec_files(rows, data):
    blob = b"".join(codec.encode_one(k, v, v is None) for k, v in rows)
    assert [(k, v, t) for _, k, v, t in codec.records(blob)] == [(k, v, v is None) for k, v in rows]
    if rows:
        cut = data.draw(st.integers(0, len(blob) - 1))
        whole = [r[1:3] for r in codec.records(blob[:cut])]
        assert whole == rows[: len(whole)]
        at = data.draw(st.integers(0, len(blob) - 1))
        bad = bytearray(blob)
        bad[at] ^= 0x41
        try:
            got = list(codec.records(bytes(bad)))
        except codec.CorruptRecord:
            return
        assert len(got) < len(rows)  # a changed length may tear the rest off


def test_codec_in_the_engine(spark):
    log = log_of(spark, [(b"tulip", b"red", False), (b"fern", None, True), (b"", b"", False)])
    coded = log.withColumn("record", codec.encode(log["key"], log["value"], log["tombstone"]))
    for r in coded.collect():
        assert bytes(r["record"]) == codec.encode_one(bytes(r["key"]), None if r["value"] is None else bytes(r["value"]), r["tombstone"])
        assert int.from_bytes(r["record"][:4], "big") == zlib.crc32(bytes(r["record"][4:]))
    back = codec.decode(coded.select("seq", "record"))
    assert [(bytes(r["key"]), r["value"] if r["value"] is None else bytes(r["value"]), r["tombstone"], r["valid"]) for r in back.orderBy("seq").collect()] == [(b"tulip", b"red", False, True), (b"fern", None, True, True), (b"", b"", False, True)]


def test_log_source(spark, tmp_path):
    from keylode.sources.log_files import append_log, read_appended, read_log, scan_records

    assert read_log(spark, str(tmp_path / "none")).count() == 0
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "part_2.wal").write_bytes(codec.encode_one(b"k", b"old") + codec.encode_one(b"x", b"1") + codec.encode_one(b"torn", b"tail")[:-3])
    (folder / "part_10.wal").write_bytes(codec.encode_one(b"k", b"new") + codec.encode_one(b"x", None, True))
    for read in (read_log, scan_records):
        assert plain(state.lww(read(spark, str(folder))).collect()) == {b"k": b"new", b"x": None}
    (folder / "part_11.wal").write_bytes(codec.encode_one(b"ok", b"1") + b"\xff" + codec.encode_one(b"bad", b"2")[1:])
    with pytest.raises(Exception, match="checksum|CorruptRecord"):
        read_log(spark, str(folder)).count()
    assert read_log(spark, str(folder), strict=False).count() == 5
    log = log_of(spark, [(b"a", b"1", False), (b"b", None, True)])
    append_log(log, str(tmp_path / "sink"))
    append_log(log.selectExpr("seq + 2 AS seq", "key", "CAST('z' AS BINARY) AS value", "false AS tombstone"), str(tmp_path / "sink"))
    assert plain(state.lww(read_appended(spark, str(tmp_path / "sink"))).collect()) == {b"a": b"z", b"b": b"z"}


def test_numbering_over_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS k", "id % 5 + 1 AS w")
    got = sorted((r["k"], r["n"]) for r in order.numbered(df, "k", "n", rows_a_range=90).collect())
    assert got == [(k, k + 1) for k in range(1000)]
    total = 0
    weights = {r["k"]: r["w"] for r in df.collect()}
    for r in sorted(order.numbered(df, "k", "s", amount=df["w"], rows_a_range=130).collect()):
        total += weights[r["k"]]
        assert r["s"] == total


def test_sparse_index_and_floor(spark):
    log = spark.createDataFrame([(i, f"key/{i:03d}", "v", False) for i in range(50)], "seq long, key string, value string, tombstone boolean")
    index = runs.sparse_index(state.lww(log), 8)
    rows = index.orderBy("key").collect()
    assert [r["number"] for r in rows] == list(range(0, 50, 8))
    assert rows[0]["offset"] == 0 and all(a["block_end"] == b["offset"] for a, b in zip(rows, rows[1:], strict=False))
    probes = spark.createDataFrame([("a",), ("key/000",), ("key/007",), ("key/009x",), ("zzz",)], "key string")
    got = {r["key"]: r["index_key"] for r in runs.floor_lookup(index, probes).collect()}
    assert got == {"a": None, "key/000": "key/000", "key/007": "key/000", "key/009x": "key/008", "zzz": "key/048"}
    assert runs.block_range(state.lww(log), index, "key/009x").count() == 8
    assert runs.block_range(state.lww(log), index, "a").count() == 0


def test_flush_fold(spark):
    rng = random.Random(2)
    ops = [(i, f"k{rng.randint(0, 20)}", "v" * rng.randint(0, 9), rng.random() < 0.2) for i in range(300)]
    log = spark.createDataFrame(ops, "seq long, key string, value string, tombstone boolean")
    expected, current, run = [], {}, 0
    for i, k, v, t in ops:
        current[k] = (None if t else v, t, i)
        if sum(len(k) + len(v[0] or "") for k, v in current.items()) >= 60:
            expected += [(run, k, *v) for k, v in current.items()]
            current, run = {}, run + 1
    expected += [(run, k, *v) for k, v in current.items()]
    assert sorted(tuple(r) for r in runs.flush_runs(log, 60).collect()) == sorted(expected)


def test_compaction(spark):
    parts = []
    for i in range(3):
        ops = [(b"common", b"v%d" % i, False), (b"unique%d" % i, b"u%d" % i, False), (b"gone", b"x", False) if i == 0 else (b"other", b"y", False)]
        if i == 2:
            ops.append((b"gone", None, True))
        parts.append(runs.run_of(log_of(spark, ops), i))
    merged = plain(runs.compact(*parts).collect())
    assert merged == {b"common": b"v2", b"unique0": b"u0", b"unique1": b"u1", b"unique2": b"u2", b"other": b"y"}
    kept = {bytes(r["key"]) for r in runs.compact(*parts, bottom_level=False).collect()}
    assert b"gone" in kept
    with pytest.raises(ValueError):
        runs.compact()
    dead = runs.run_of(log_of(spark, [(b"a", None, True)]), 0)
    assert runs.compact(dead).count() == 0


def test_run_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/store")
    assert store.state().count() == 0 and not store.compact()
    for i in range(4):
        rows = [(100 * i + j, f"k{j:02d}", f"{i}-{j}", False) for j in range(i, 20)] + [(100 * i + 50, f"k{i:02d}", None, True)]
        store.flush(spark.createDataFrame(rows, "seq long, key string, value string, tombstone boolean"))
    before = {r["key"]: r["value"] for r in store.state().filter("NOT tombstone").collect()}
    assert len(before) == 16 and before["k19"] == "3-19"
    assert store.get("k00").first()["tombstone"] and store.compact()
    assert {r["key"]: r["value"] for r in store.state().collect()} == before
    assert store.vacuum() == 4 and {r["key"]: r["value"] for r in store.state().collect()} == before
    plan = store.get("k05")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k05)" in plan


def test_murmur3_vectors():
    assert bloom.murmur3_32(b"", 0) == 0
    assert bloom.murmur3_32(b"test", 0) == 0xBA6BD213
    assert bloom.murmur3_32(b"Hello, world!", 0) == 0xC0363E43
    assert bloom.murmur3_32(b"abc", 42) == 1313807976


def test_bloom(spark):
    assert [bloom.sizing(n, 1e-4) for n in (1, 4, 500, 10000)] == [(64, 45), (77, 14), (9586, 14), (191702, 14)]
    keys = [b"key_%05d" % i for i in range(500)]
    one = bloom.Bloom.of(keys, 500)
    assert all(k in one for k in keys)
    assert sum(b"missing_%d" % i in one for i in range(5000)) <= 5
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    assert bloom.build(df, 500).serialize() == one.serialize()
    back = bloom.Bloom.deserialize(one.serialize())
    assert back.data == one.data and bloom.Bloom.deserialize(one.serialize()[:-1]) is None
    assert one.serialized_size() == len(one.serialize())


def test_consensus(spark):
    matches = spark.createDataFrame([(1, 0, 9), (1, 1, 7), (1, 2, 4), (2, 0, 9), (2, 1, 8), (2, 2, 5), (2, 3, 1), (3, 0, 9), (3, 1, 7), (3, 2, 4)], "leader int, peer int, match long")
    terms = spark.createDataFrame([(1, 3), (2, 1), (3, 8)], "leader int, first_index long")
    assert {r["leader"]: r["commit_index"] for r in consensus.commit_index(matches, terms).collect()} == {1: 7, 2: 5, 3: 0}
    rows = spark.createDataFrame([(2, 1, 1, 9), (1, 9, 1, 9), (1, 8, 1, 9), (0, 99, 1, 1)], "last_term long, last_index long, own_term long, own_index long")
    assert [r["ok"] for r in consensus.up_to_date(rows).collect()] == [True, True, False, False]
    own = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2)], "node long, log_index long, term long")
    sent = spark.createDataFrame([(1, 2, 1), (1, 3, 3), (1, 4, 3)], "node long, log_index long, term long")
    assert consensus.log_conflict(own, sent).first()["conflict_index"] == 3
    assert sorted(tuple(r) for r in consensus.appended(own, sent).collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3)]
    votes = spark.createDataFrame([(1, 0, 0, True), (1, 0, 0, True), (1, 0, 1, True), (1, 1, 2, True)], "term int, candidate int, voter int, granted boolean")
    members = spark.createDataFrame([(1, 3)], "term int, n int")
    assert {r["candidate"]: r["won"] for r in consensus.vote_majority(votes, members).collect()} == {0: True, 1: False}


def test_serve(spark):
    requests = spark.createDataFrame([(1, "put", "a", "1"), (2, "get", "a", None), (3, "delete", "a", None), (4, "get", "a", None), (5, "get", "b", None), (6, "get", "old", None), (7, "jump", "a", None), (8, "get", "", None)], "req_id long, op string, key string, value string")
    old = spark.createDataFrame([("old", "kept", False, 0)], "key string, value string, tombstone boolean, seq long")
    got = {r["req_id"]: (r["ok"], r["value"], r["tombstone"]) for r in state.serve(requests, old).collect()}
    assert got == {1: (True, None, False), 2: (True, "1", False), 3: (True, None, True), 4: (True, None, True), 5: (False, None, False), 6: (True, "kept", False)}


def test_stream_equals_batch(spark, tmp_path):
    from keylode.streaming import fold

    schema = "seq long, key string, value string, tombstone boolean"
    rng = random.Random(9)
    rows = [(i, f"k{rng.randint(0, 9)}", str(i), rng.random() < 0.3) for i in range(120)]
    mixed = rows + rows[:30]
    rng.shuffle(mixed)
    for i in range(5):
        spark.createDataFrame(mixed[30 * i : 30 * i + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    expected = sorted(map(str, state.lww(spark.createDataFrame(rows, schema)).collect()))
    source = fold.read_log(spark, str(tmp_path / "in"), schema, files_a_batch=1)
    fold.write_changes(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = fold.read_changes(spark, str(tmp_path / "out"))
    assert sorted(map(str, got.select("key", "value", "tombstone", "seq").collect())) == expected
