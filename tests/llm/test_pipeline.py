"""The pipeline's stages, each on its own input, against brute force where a stage is exact."""

import collections
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from keylode.llm import near
from tests.llm.test_operators import brute_repeats, docs_of, shingles, words


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == names
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    ids = [collections.Counter(r["doc_id"] for r in rows) for rows in seen]
    assert all(not (b - a) for a, b in zip(ids[:4], ids[1:4], strict=False))

    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.col("toxic") == 0).collect()}
    assert not (ids[0] - ids[1]).keys() & toxic  # none labelled clean goes

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    kept = [shingles(r["text"]) for r in seen[2]]
    for i, a in enumerate(kept):
        assert not any(a and b and 100 * len(a & b) >= 85 * len(a | b) for b in kept[:i])

    removed = {i: n for i, n, _, _ in brute_repeats([(r["doc_id"], r["text"]) for r in seen[2]])}
    after = {r["doc_id"]: r for r in seen[3]}
    for r in seen[2]:
        left = len(r["text"].encode()) - len(after[r["doc_id"]]["text"].encode())
        assert removed[r["doc_id"]] - 6 * 8 <= left <= removed[r["doc_id"]]
        assert after[r["doc_id"]]["n_chars"] == len(after[r["doc_id"]]["text"])

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = split(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = {r["doc_id"] for r in seen[3] if not any(tuple(w[i : i + 10]) in windows for w in [split(r["text"])] for i in range(len(w) - 9))}
    assert {r["doc_id"] for r in seen[4]} == clean
    assert {r["doc_id"] for r in seen[5]} == clean
    assert corpus_pipeline.run(spark, sf_dir).count() == len(seen[5])


def test_near_stage_takes_copies_at_80_percent(spark):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        base = words(rng, 120).split()
        rows.append((2 * i, " ".join(base)))
        for at in rng.sample(range(5, 110, 10), i % 5):  # each change takes five shingles of 116
            base[at] = f"x{i}-{at}"
        rows.append((2 * i + 1, " ".join(base)))
    sets = {i: shingles(t) for i, t in rows}
    link = lambda a, b, percent: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    assert any(link(i, i + 1, 80) and not link(i, i + 1, 85) for i in range(0, 80, 2))
    docs = docs_of(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'x' AS source", "length(text) AS n_chars")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near(spark, docs, None).collect()}
    assert kept == {i for i in sets if i % 2 == 0 or not link(i - 1, i, 80)}
    kept = {r["doc_id"] for r in near.near_duplicates(docs).filter("kept").collect()}
    assert kept == {i for i in sets if i % 2 == 0 or not link(i - 1, i, 85)}


def test_repeats_stage_cuts_passages_of_over_50_words(spark):
    rng = random.Random(12)
    passages = {n: words(rng, n) for n in (45, 50, 51, 60)} | {0: " ".join("abcdefghijklm"[rng.randrange(13)] for _ in range(51))}
    assert all(len(x) < 400 for x in passages.values()) and len(passages[0]) == 101
    rows, left = [], {}
    for n, x in passages.items():
        for k in (0, 1):
            before, after = f"b{n}-{k} {words(rng, 20)} B{n}{k} ", f" {'AC'[k]}{n}{k} {words(rng, 20)}"
            rows.append((2 * n + k, before + x + after))
            left[2 * n + k] = (before + x + after) if 0 < n <= 50 else before.rstrip(" ") + after.lstrip(" ")
    docs = docs_of(spark, rows).selectExpr("doc_id", "text", "'en' AS lang", "'x' AS source", "length(text) AS n_chars")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, None).collect()} == left
