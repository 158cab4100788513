"""Groups of any size, long texts, odd rows of the pipeline: against brute force and bounds."""

import collections
import random
import subprocess
import sys
import time
from array import array

import corpus_pipeline
import pytest

from keylode.llm import decontaminate, near, packing, repeats
from keylode.llm.common import Scratch
from tests.llm.test_operators import brute_repeats, docs_of, words


@pytest.mark.parametrize("group", [512, 3, 1])
def test_repeated_words_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng, length = random.Random(5), 51
    shared = [*[words(rng, 80) for _ in range(3)], "the " * 120]
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(0, 40))
        if rng.random() < 0.7:
            part = rng.choice(shared).split()
            a = rng.randint(0, 30)
            text += " " + " ".join(part[a : a + rng.choice([40, 50, 51, 52, 60])]) + rng.choice(["\n", " ", "  "])
        rows.append((i, text + words(rng, rng.randint(0, 30))))
    rows += [(100, rows[3][1]), (101, None), (102, "")]
    split = {i: (t or "").split() for i, t in rows}
    count = collections.Counter(tuple(w[k : k + length]) for w in split.values() for k in range(len(w) - length + 1))
    expected = {}
    for i, w in split.items():
        covered = [False] * len(w)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k : k + length])] > 1:
                covered[k : k + length] = [True] * length
        expected[i] = [k for k, x in enumerate(covered) if x]
    got = {r["doc_id"]: [k for x in r["spans"] or [] for k in range(x["start"], x["end"])] for r in repeats.removed(docs_of(spark, rows), strings=repeats.Strings(length, words=True)).collect()}
    assert got == expected


def test_short_common_phrases_gather_few_strings():
    rng = random.Random(14)
    phrases = [words(rng, 6) for _ in range(400)]
    for strings in (repeats.Strings(400), repeats.Strings(51, words=True)):
        held = []
        for _ in range(2):
            text = " ".join(rng.choice(phrases) for _ in range(3000))
            held.append({h for *_, h in repeats.runs_of(repeats.units_of([text], strings), strings.length)[0]})
        assert len(held[0] & held[1]) < 0.05 * len(held[0])


@pytest.mark.parametrize("length", [20, 32, 64, 400])
def test_anchors_of_strings_of_any_length(length):
    rng = random.Random(length)
    data = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 3 * length))) for _ in range(6)]
    data += [data[0][3:] + data[1], b"c" + data[2]]
    anchors = collections.defaultdict(set)
    for own, found in zip(data, repeats.runs_of(data, length), strict=True):
        assert [k for a, m, _, _ in found for k in range(a, a + m)] == list(range(len(own) - length + 1))
        for a, m, o, h in found:
            for k in range(a, a + m):
                anchors[own[k : k + length]].add((o - (k - a), h))
    assert anchors and all(len(x) == 1 for x in anchors.values())


def test_op2_tells_of_passages_that_bytes_leave(spark, tmp_path):
    rng = random.Random(3)
    passage = words(rng, 60)
    assert len(passage) < 390
    rows = [(1, f"{words(rng, 30)} A {passage} B {words(rng, 30)}"), (2, f"{words(rng, 30)} C {passage} D {words(rng, 30)}"), (3, words(rng, 100)), (4, None)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in repeats.op2_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r["n_removed"], r["n_passages"], r["passage_words"]) for i, r in got.items()} == {1: (0, 1, 60), 2: (0, 1, 60), 3: (0, 0, 0), 4: (0, 0, 0)}
    assert [(i, n, s, h) for i, n, s, h in brute_repeats(rows)] == [(i, r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in sorted(got.items())]


def test_documents_are_packed_in_their_tiers():
    packed = packing.tiers_of([100] * 1000)
    tokens = collections.Counter()
    for tier, parts in packed:
        tokens[tier] += sum(n for _, _, n in parts)
    assert tokens[128] > 0.99 * sum(tokens.values())
    rng = random.Random(1)
    lengths = [rng.randint(1, 1500) for _ in range(2000)] + [rng.randint(130, 250) for _ in range(6000)]
    packed = packing.tiers_of(lengths)
    assert sum(n for _, parts in packed for _, _, n in parts) == sum(lengths)
    tiers = collections.Counter(tier for tier, _ in packed)
    assert all(tiers[t] > 50 for t in (256, 512, 1024)) and all(sum(n for _, _, n in parts) == tier for tier, parts in packed)
    for tier, parts in packed:  # a window is opened by a document that no shorter tier holds
        if tier >= packing.LEAST_TIER and tiers[tier] > 50:
            assert packing.tier_of(parts[0][2]) == tier


def test_texts_without_spaces_take_bounded_memory():
    code = """
import random, resource, sys
from keylode.llm import packing
encoder, rng = packing.Encoder(), random.Random(1)
encoder.ids(["warm up"])
texts = ["".join(rng.choices("abcdefghij0123", k=18_000)) for _ in range(150)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
encoder.ids([*texts, "".join(texts)])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(encoder.known))
"""
    grown, known = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert grown < 120 and known <= 2


def test_cuts_change_no_ids():
    encoder, rng = packing.Encoder(), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", " \n", "\x1c", "\x85", "'s", "'", ".", "!", "1", "23", "a", "Bc", "é", "漢", "½", "<|endoftext|>", "'ll"]
    for size in (1 << 18, 30):
        packing.SLICE, old = size, packing.SLICE
        try:
            for _ in range(1500):
                text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
                ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
                assert encoder.ids([text])[0] == b"".join(x.to_bytes(4, "little") for x in ids)
        finally:
            packing.SLICE = old


def test_rows_of_one_doc_id_are_judged_apart(spark):
    rng = random.Random(2)
    a, other = words(rng, 100), words(rng, 100)
    rows = [(5, a), (5, other), (1, a), (1, a), (None, a), (None, None), (7, None), (7, None), (8, "")]
    docs = docs_of(spark, rows)
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near(spark, docs, None).collect()), key=str)
    assert kept == sorted([(1, a), (5, other), (None, None), (7, None), (7, None), (8, "")], key=str)
    assert corpus_pipeline.keep_one_of_near(spark, docs.limit(0), None).count() == 0


def test_contaminated_rows_go_by_text(spark, tmp_path):
    rng = random.Random(4)
    item, other = words(rng, 30), words(rng, 50)
    spark.createDataFrame([("1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(5, f"x {item} y"), (5, other), (None, item), (None, None), (6, other)]
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs_of(spark, rows), str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(5, other), (None, None), (6, other)], key=str)


def test_hit_words_take_linear_time(spark):
    rng = random.Random(6)
    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
        docs, bench = docs_of(spark, [(1, text)]), spark.createDataFrame([("1", text)], "item_id string, text string")
        start = time.perf_counter()
        assert [(r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect()] == [(n, n)]
        took.append(time.perf_counter() - start)
    assert took[1] < 4 * took[0] + 10


def cluster_of(spark, sets):
    """near.links_of's input: all sets in one cluster, whose pivot is the first."""
    one, pivot = 1, min(sets)
    rows = []
    for name, own in sets.items():
        delta = [x & ~one for x in own - sets[pivot]] + [x | one for x in sets[pivot] - own]
        rows.append((name, b"c", pivot, len(sets), len(own), near.links(len(own & sets[pivot]), len(own), len(sets[pivot])), sorted(delta)))
    return spark.createDataFrame(rows, "class binary, cluster binary, pivot binary, members long, n long, linked boolean, delta array<long>")


def near_copies(rng, base, n, changes):
    """Copies in which so many runs of five elements are others."""
    out, base = [], list(base)
    for _ in range(n):
        own = base.copy()
        for at in rng.sample(range(0, len(base) - 5, 5), rng.randint(1, changes)):
            own[at : at + 5] = [2 * rng.randrange(1 << 60) for _ in range(5)]
        out.append(set(own))
    return out


def connected(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_links_grow_with_members(spark):
    rng = random.Random(8)
    p, q = ([2 * rng.randrange(1 << 60) for _ in range(200)] for _ in range(2))
    for n in (50, 200):
        every = [set(p), *near_copies(rng, p, n, 3), *near_copies(rng, q, n, 3)]
        sets = {bytes([0, k >> 8, k & 255]): x for k, x in enumerate(every)}
        got = [(bytes(a), bytes(b)) for a, b in near.links_of(cluster_of(spark, sets), Scratch(spark), 85).collect()]
        assert len(got) <= 12 * n
        assert all(near.links(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in got)
        names = sorted(sets)
        assert connected(got) == connected((a, b) for i, a in enumerate(names) for b in names[:i] if near.links(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])))


@pytest.mark.parametrize("percent", [80, 85])
def test_edges_of_a_cluster_grow_with_members(spark, monkeypatch, percent):
    rng = random.Random(10)
    base = words(rng, 100).split()
    texts = []
    for i in range(300):
        own = base.copy()
        for at in rng.sample(range(100), rng.randint(1, 2)):
            own[at] = f"x{i}-{at}"
        texts.append(" ".join(own))
    scratch, seen, inner = Scratch(spark), [], near.components

    def components(edges, scratch):
        seen.extend((bytes(a), bytes(b)) for a, b in edges.collect())
        return inner(edges, scratch)

    monkeypatch.setattr(near, "components", components)
    classes = near.described(docs_of(spark, list(enumerate(texts))), percent).select("class", "doc_id", "bands")
    clusters = {bytes(r["class"]): bytes(r["cluster"]) for r in near.clusters_of(scratch.write(classes), scratch).collect()}
    assert len({frozenset(x) for x in seen if x[0] != x[1]}) <= 2 * len(clusters)
    by_key = collections.defaultdict(list)
    for r in classes.collect():
        for place in enumerate(r["bands"]):
            by_key[place].append(bytes(r["class"]))
    assert clusters == connected((x[0], y) for x in by_key.values() if len(x) > 1 for y in x)


@pytest.mark.parametrize("hubs", [False, True])
def test_links_of_chains_against_brute_force(spark, hubs):
    rng = random.Random(9)
    own = [2 * rng.randrange(1 << 60) for _ in range(100)]
    every = [set(own)]
    for _ in range(60):  # each changes the one before it, so that links form chains
        own = list(own)
        for at in rng.sample(range(100), rng.choice([2, 5, 9, 14])):
            own[at] = 2 * rng.randrange(1 << 60)
        every += [set(own), *near_copies(rng, own, 2, 2)]
    rng.shuffle(every)
    sets = {bytes([0, 0, k]): x for k, x in enumerate(every)}
    got = [(bytes(a), bytes(b)) for a, b in near.links_of(cluster_of(spark, sets), Scratch(spark), 85, hubs=hubs).collect()]
    names = sorted(sets)
    assert connected(got) == connected((a, b) for i, a in enumerate(names) for b in names[:i] if near.links(len(sets[a] & sets[b]), len(sets[a]), len(sets[b])))


def test_encoder_gives_the_tokenizers_own_ids():
    rng = random.Random(21)
    parts = [" ", " ", " ", "  ", "\n", "\t", " ", "word", "Straße", "élan", "Ÿž", "中文", "ы", "😀", "'s", "12", "a1", ".", ",", ".\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["", " ", "a ", " a", "a  b", "é" * 500, f"x {'y' * 5000} z"]
    for bound in (0, 1 << 20):  # nothing remembered, and something
        encoder = packing.Encoder(None, bound)
        assert encoder.model
        direct = [array("I", x.ids).tobytes() for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert encoder.ids(texts) == direct
        assert encoder.ids(texts) == direct
