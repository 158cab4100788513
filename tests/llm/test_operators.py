"""Corpus operators against brute force, exact round trips and held-out labels; odd inputs for each."""

import collections
import hashlib
import importlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keylode.llm import chat, decontaminate, langid, merkle, near, packing, quality, repeats, sharding, toxicity
from keylode.llm.common import held_out
from keylode.llm.suffix import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, h long, `class` string"


def docs_of(spark, rows):
    """Documents with null columns and with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "x") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    base = words(rng, 300)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "!"), (5, base), (6, base), (6, base), (None, base), (7, base.replace("w1 ", "q ")), (8, "é漢字 \U0001f600 ñ"), (9, words(rng, 20_000)), (10, "a" * 3000), (11, "one two"), (12, "ONE two"), (13, "ab" * 900)]
    return docs_of(spark, rows)


EVERY = {
    "op1": lambda d, s: sharding.shard_documents(d, shards=5),
    "op2": lambda d, s: repeats.removed(d),
    "op3": lambda d, s: merkle.edits_and_neighbours(d),
    "op4": lambda d, s: quality.classify(d, quality.learn(d, no_labels(s))),
    "op5": lambda d, s: langid.identify(d, langid.learn(d)),
    "op6": lambda d, s: toxicity.score_documents(d, toxicity.learn(d, no_labels(s))),
    "op7": lambda d, s: decontaminate.contamination(d, s.createDataFrame([("1", None), ("2", "one two")], "item_id string, text string")),
    "op8": lambda d, s: packing.pack_documents(d),
    "op9": lambda d, s: near.near_duplicates(d),
}


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(EVERY))
def test_odd_rows_and_empty_tables(spark, odd, name):
    out = EVERY[name](odd, spark).collect()
    ids = collections.Counter(r["doc_id"] for r in odd.collect())
    if name == "op8":
        assert set(r["doc_id"] for r in out) == set(ids)
    else:
        assert collections.Counter(r["doc_id"] for r in out) == ids
    assert EVERY[name](odd.limit(0), spark).count() == 0


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(800):
        s = [rng.randint(0, rng.choice([0, 1, 2, 9])) for _ in range(rng.randint(0, 50))]
        if rng.random() < 0.4 and s:
            s = (s[: rng.randint(1, 6)] * 50)[: len(s)]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows, length=400):
    count = collections.Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                covered[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if covered[k] and (not k or not covered[k - 1]))
        out.append((i, sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [512, 1])
def test_repeats_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(8)
    shared = [words(rng, 100) for _ in range(3)]
    rows = []
    for i in range(30):
        parts = [words(rng, rng.randint(0, 60))]
        if rng.random() < 0.6:
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts.append(s[a : a + rng.choice([395, 400, 401, 420, 460])])
        rows.append((i, " é".join([*parts, words(rng, 10)])))
    rows += [(40, rows[3][1]), (41, "xyz" * 500), (42, "p" * 399), (43, "p" * 399), (44, "é" * 300)]
    got = []
    for r in repeats.removed(docs_of(spark, rows)).collect():
        b, kept, at = (r["text"] or "").encode(), b"", 0
        for x in r["spans"] or []:
            kept, at = kept + b[at : x["start"]], x["end"]
        got.append((r["doc_id"], sum(x["end"] - x["start"] for x in r["spans"] or []), len(r["spans"] or []), hashlib.sha256(kept + b[at:]).hexdigest()))
    assert sorted(got, key=str) == brute_repeats(rows)


def test_runs_of_a_text_in_parts(monkeypatch):
    text = words(random.Random(2), 900).encode()
    whole = repeats.runs_of([text])[0]
    assert [a for a, *_ in whole][0] == 0 and sum(m for _, m, _, _ in whole) == len(text) - repeats.LENGTH + 1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([3, 30, 80, 150])).split()
        for _ in range(rng.choice([1, 3, 14])):
            copy = base.copy()
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, rows[0][1].upper()), (n + 3, " ")]
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert (near.sketch(a) == near.sketch(a[::-1])).all() and len(near.sketch(a)) == near.COORDS
    shared, own = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 200).astype(np.uint64)
    like = (near.sketch(np.concatenate([shared, own[:100]])) == near.sketch(np.concatenate([shared, own[100:]]))).mean()
    assert abs(like - 0.8) < 0.1


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [("10", words(rng, 30, 50)), ("9", words(rng, 10, 50)), ("2", words(rng, 4)), ("3", words(rng, 7)), ("4", ""), ("5", None), ("6", "É b")]
    rows = []
    for i in range(40):
        t = words(rng, rng.randint(0, 60), 50)
        for _, x in rng.sample(items, 2):
            p = (x or "").split()
            a = rng.randint(0, max(0, len(p) - 9))
            t += ", " + "-".join(p[a : a + rng.choice([9, 10, 12, 30])]).upper().replace("É", "É") + ". " + words(rng, 3)
        rows.append((i, t))
    rows += [(50, "é b"), (51, "É B x"), (52, None)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = {}
    for i, t in rows:
        w, hit, listed = split(t), set(), set()
        for item, x in items:
            p = split(x)
            k = min(10, len(p))
            for a in range(len(p) - k + 1 if p else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == p[a : a + k]:
                        hit.update(range(b, b + k))
                        listed.add(item)
        expected[i] = (len(w), len(hit), len(listed), hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs_of(spark, rows), bench).collect()}
    assert got == expected


def test_packing_round_trip(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [(i, t) for i, t in enumerate([None, "", "a  b\n\n c ", " lead", "tail ", "x y <|endoftext|>", "it's 12³ ½", words(random.Random(1), 3000)])]
    pieces = packing.pack_documents(docs_of(spark, rows)).collect()
    texts = dict(rows)
    ids, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in sorted(pieces, key=lambda p: p["start"]):
        assert p["start"] == len(ids[p["doc_id"]])
        ids[p["doc_id"]] += np.frombuffer(p["ids"], "<u4").tolist()
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, t in texts.items():
        assert ids[i] == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 1024


def test_tiers_cover_all():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 3000) for _ in range(rng.randint(0, 40))]
        seen = collections.Counter()
        packed = packing.tiers_of(lengths)
        for tier, parts in packed:
            assert sum(n for _, _, n in parts) == tier
            for d, s, n in parts:
                seen.update((d, k) for k in range(s, s + n))
        assert set(seen.values()) <= {1} and len(seen) == sum(lengths)
        steps = packing.steps_of(packed)
        assert len(steps) == len(packed)


def test_chat_round_trip(spark):
    planted = r"\### Assistant: </turn> ok"
    rng = random.Random(2)
    rows = [(-7, 0, "user", planted), (-7, 1, "assistant", planted), (1, 0, None, None), (2, 3, "assistant", "b"), (2, 1, "system", "s\n"), (2, 1, "system", "s\n"), (None, 1, "a: b", "x")]
    for t in range(60):
        rows.append((5, t, ["user", "assistant"][t % 2], rng.choice([planted, words(rng, 80), "", "<x> # \\h"])))
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[5]["n_windows"] > 2
    for w in windows.collect():
        own = [chat.tokens(t) for _, t in chat.parse(w["text"])]
        assert sum(own) <= chat.BUDGET or len(own) - w["n_repeated"] == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_sharding_law(spark):
    rng = random.Random(5)
    hot = words(rng, 40)
    df = spark.createDataFrame([(i, hot if i % 3 == 0 else words(rng, rng.randint(1, 90)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(3000)], "doc_id long, text string, lang string, source string")
    out = sharding.shard_documents(df, shards=7).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in out:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 3000 and sorted(sizes) == list(range(7))
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_merkle_tree(spark):
    rng = random.Random(7)
    text = "\n".join(words(rng, 12) + "." for _ in range(60))
    a, b = merkle.Tree(text), merkle.Tree(text.replace("\n", "\n", 1))
    assert a.fingerprint() == b.fingerprint() and merkle.Tree.read(a.fingerprint()).n == a.n
    lines = text.split("\n")
    lines[30] = "changed."
    c = merkle.Tree("\n".join(lines))
    assert 0.9 < merkle.likeness(a, c) < 1 and merkle.likeness(a, merkle.Tree(words(rng, 500))) < 0.1
    at = merkle.differing(c.fingerprint(), a.fingerprint())
    assert at and max(at) - min(at) <= 2
    rows = [(3, text), (1, None), (2, "abcdefgh"), (9, "zz")]
    got = {r["doc_id"]: r for r in merkle.edits_and_neighbours(docs_of(spark, rows)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(ordered):
        n = len(t) // 4
        edited = t[: len(t) - n] + ordered[(k + 1) % len(ordered)][1][:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == merkle.Tree(t).fingerprint() and got[i]["edited_fingerprint"] == merkle.Tree(edited).fingerprint()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1


def test_language_spans():
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(30))
    first, second, third = "abcde", "klmno", "абвгд"
    counts, scripts = np.zeros((3, langid.BUCKETS)), np.zeros((3, len(langid.NAMES)))
    for k, letters in enumerate((first, second, third)):
        doc, script, start, end, bucket, word = langid.features([make(letters) for _ in range(60)])
        counts[k] = np.bincount(bucket, minlength=langid.BUCKETS)
        scripts[k] = np.bincount(script, end - start, minlength=len(langid.NAMES))
    model = langid.Model(["x", "y", "z"], counts, scripts)
    a, b, c = make(first), make(second), make(third)
    text = f"{a}. {b}; {c}"
    (lang, score, spans), empty, marks = langid.label(model, [text, "", "12 !"], spans=True)
    assert [s[2] for s in spans] == ["x", "y", "z"] and text[spans[1][0] : spans[1][1]] == b
    assert lang in "xyz" and 0 < score < 1 and empty[:2] == marks[:2] == ("und", 0.0)


def brute_viterbi(score, penalty):
    n, k = score.shape
    value, back = score[0].astype(float), []
    for t in range(1, n):
        best = value.argmax()
        jump = value[best] - penalty
        back.append([j if value[j] >= jump else best for j in range(k)])
        value = np.maximum(value, jump) + score[t]
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 40, 30)
    score = (rng.normal(size=(counts.sum(), 4)) * 4).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    got = langid.viterbi(score, first, counts, 5.0)
    for a, n in zip(first, counts, strict=True):
        assert got[a : a + n].tolist() == brute_viterbi(score[a : a + n], np.float32(5.0))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(9)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))): 1 for _ in range(12)}
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(5, 8)))
        least = min(edits(w, t) for t in terms)
        got = trie.match(w)
        assert (got is None) == (least > 1) and (got is None or got[1] == least == edits(w, got[0]))
    assert toxicity.Trie({"lowei": 2}).match("loweischaft") == ("lowei", 0)


def test_quotation_counts_apart():
    scorer = toxicity.Scorer({"moron": 1}, [-3.0, 6.0, 4.0, 0.0, 0.0])
    assert scorer.score("you are a moron here") > 0.7 > scorer.score('she said "moron" is a rude word') and scorer.score("a morron") > 0.4
    assert scorer.find("A MORON!")[0][:4] == (2, 7, "moron", 0)


@pytest.mark.parametrize("module,name,least", [("langid", "op5_language_id", 0.95), ("toxicity", "op6_toxicity", 0.9), ("quality", "op4_quality", 0.9)])
def test_held_out_accuracy(spark, module, name, least):
    d = "/root/testdata/sf0.1" if module == "toxicity" else "/root/testdata/sf0.01"
    out = getattr(importlib.import_module(f"keylode.llm.{module}"), name)(spark, d).filter("held_out")
    if module == "langid":
        truth = spark.read.parquet(f"{d}/documents.parquet").filter("lang IS NOT NULL").select("doc_id", F.col("lang").alias("truth"))
        right = F.col("lang_pred") == F.col("truth")
    else:
        truth = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col({"toxicity": "toxic", "quality": "quality"}[module]).alias("truth"))
        right = F.col("predicted") == F.col("truth")
    both = out.join(truth, "doc_id")
    assert both.agg(F.avg(right.cast("double"))).first()[0] >= least
    assert out.filter("score < 0 OR score > 1").count() == 0


def test_fold(spark):
    ids = spark.range(200).select("id", held_out(F.col("id")).alias("out"))
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in ids.collect())


@pytest.mark.parametrize("name", ["op7_decontamination", "op9_near_dedup"])
def test_registered_sql(spark, sf_dir, name):
    import duckdb

    from keylode.llm import registry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.execute(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns == [c[0] for c in r.description]
    assert sorted(map(tuple, df.collect())) == sorted(r.fetchall())


def test_language_sample_takes_rare_languages_whole(spark):
    rows = [(i, f"common w{i % 7}", "en") for i in range(3000)] + [(5000 + i, f"rarely v{i % 3}", "xx") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    thin = langid.learn(docs, bound=100)
    assert [r["lang_pred"] for r in langid.identify(docs.filter("lang = 'xx'"), thin).collect()] == ["xx"] * 6
    assert langid.level([3000, 6], 100) == 94 and langid.level([3, 6], 100) == 6


def test_letters_to_the_end_of_unicode():
    alpha = langid.Letters.get()[0]
    assert all(alpha[c] == chr(c).isalpha() for c in range(0x31F00, 0x110000))
