"""Language ID: script ranges narrow candidates, then Viterbi over per-word scores.

Words are runs of letters.  A word's score for a language is the sum of its letter trigrams' log
probabilities (trigrams are hashed to BUCKETS counts); languages that do not use the word's script are
out.  Viterbi with a switching penalty labels every word, and so marks spans of each language; the
document's language is that of most letters on the path.  All documents of a batch are worked on in
step, word by word, whole texts.

Learning counts trigrams of at most TRAIN_DOCS labelled documents, chosen by a hash of doc_id.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to the first
language by name; documents without a language are not learnt from; with nothing to learn from all are
``und``; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import held_out, map_arrow, small_batches, table

TRAIN_DOCS = 60_000
BUCKETS = 1 << 16
SWITCH = 9.0
SMOOTH = 0.5
#: A language uses a script if at least this share of its letters is of it.
SCRIPT_SHARE = 0.001
# First code points of the ranges of scripts.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x31A0, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han")]
NAMES = sorted({x[1] for x in SCRIPTS})
#: Code points whose letters are worked on at once: this bounds memory, however long texts are.
PIECE = 1 << 19


class Letters:
    """Tables over code points, made once in each worker."""

    made = None

    @classmethod
    def get(cls):
        if cls.made is None:
            n = 0x110000
            alpha = np.zeros(n, bool)
            lower = np.arange(n, dtype=np.uint32)
            for c in [*range(0xD800), *range(0xE000, n)]:
                x = chr(c)
                if x.isalpha():
                    alpha[c] = True
                    y = x.lower()
                    if len(y) == 1:
                        lower[c] = ord(y)
            starts = np.array([x[0] for x in SCRIPTS])
            codes = np.array([NAMES.index(x[1]) for x in SCRIPTS], np.uint8)
            cls.made = (alpha, lower, starts, codes)
        return cls.made


def pieces(texts: list[str]):
    """Groups of (text number, offset, part) of about PIECE code points.

    Texts are cut before a character that is no letter, so words and their trigrams stay whole.
    """
    alpha = Letters.get()[0]
    group, size = [], 0
    for d, x in enumerate(texts):
        a = 0
        while a < len(x):
            b = min(len(x), a + PIECE - size)
            while b < len(x) and alpha[ord(x[b])]:
                b += 1
            group.append((d, a, x[a:b]))
            size += b - a
            a = b
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def features(texts: list[str]):
    """Of all words of the texts: text number, first letter's script, start, end; and of all letters: bucket, word number."""
    alpha, lower, starts, codes = Letters.get()
    lengths = np.array([len(x) for x in texts], np.int64)
    cp = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), "<u4")
    is_letter = alpha[cp]
    at = np.flatnonzero(is_letter)
    begin = is_letter.copy()
    begin[1:] &= ~is_letter[:-1]
    low = np.where(is_letter, lower[cp], 0).astype(np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), low[:-1]])[at]
    after = low[np.minimum(at + 1, len(low) - 1)]
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) ^ low[at] * np.uint64(0xC2B2AE3D27D4EB4F) ^ after * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    bucket = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(begin)
    word = np.cumsum(begin)[at] - 1
    ends = first + np.bincount(word, minlength=len(first)) if len(first) else first
    origin = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths + 1)])
    doc = np.searchsorted(origin, first, side="right") - 1
    script = codes[np.searchsorted(starts, cp[first], side="right") - 1]
    return doc, script, first - origin[doc], ends - origin[doc], bucket, word


def features_by_piece(texts: list[str]):
    """The features of all texts, piece by piece; pieces without a word are left out."""
    for group in pieces(texts):
        part, script, start, end, bucket, word = features([x[2] for x in group])
        if len(part):
            number, moved = (np.array([x[i] for x in group], np.int64)[part] for i in (0, 1))
            yield number, script, start + moved, end + moved, bucket, word


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: languages by buckets; scripts: languages by scripts."""
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.score = np.log((counts + SMOOTH) / (total + SMOOTH * BUCKETS)).T.astype(np.float32).copy()
        used = scripts / np.maximum(1, scripts.sum(1, keepdims=True)) >= SCRIPT_SHARE
        used |= ~used.any(0)  # a script of no language leaves all
        self.barred = np.where(used, 0, -1e4).T.astype(np.float32).copy()


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of all sequences at once; score: words by labels; first, count: of each sequence."""
    n, k = score.shape
    labels = np.zeros(n, np.int64)
    if k < 2 or not n:
        return labels
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    active = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right") if len(count) else []
    stay = np.zeros((n, k), bool)
    jump = np.zeros(n, np.int64)
    value = score[first[: active[0]]].copy()
    for t in range(1, len(active)):
        m = active[t]
        at = first[:m] + t
        v = value[:m]
        best = v.argmax(1)
        moved = v[np.arange(m), best] - penalty
        keeps = v >= moved[:, None]
        stay[at] = keeps
        jump[at] = best
        value[:m] = np.where(keeps, v, moved[:, None]) + score[at]
    last = np.zeros(len(first), np.int64)
    last[: active[0]] = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        labels[at] = last[:m]
        if t:
            rows = np.arange(m)
            last[:m] = np.where(stay[at, last[:m]], last[:m], jump[at])
    return labels


def label(model: Model, texts: list[str], penalty: float = SWITCH, spans: bool = False):
    """(language, score, spans) of each text; a span is (start, end, language) in code points."""
    out = [("und", 0.0, [])] * len(texts)
    if not model.langs:
        return out
    parts = []
    for doc, script, start, end, bucket, word in features_by_piece(texts):
        score = np.empty((len(doc), len(model.langs)), np.float32)
        borders = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        for k in range(len(model.langs)):
            score[:, k] = np.add.reduceat(model.score[bucket, k], borders)
        parts.append((doc, start, end, score + model.barred[script]))
    if not parts:
        return out
    doc, start, end, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    docs, first, count = np.unique(doc, return_index=True, return_counts=True)
    path = viterbi(score, first, count, penalty)
    weight = np.bincount(doc * len(model.langs) + path, end - start, minlength=len(texts) * len(model.langs)).reshape(-1, len(model.langs))
    best = weight.argmax(1)
    share = weight[np.arange(len(texts)), best] / np.maximum(1, weight.sum(1))
    borders = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])])) if spans else []
    found: dict[int, list] = {}
    for i, a in enumerate(borders):
        b = (borders[i + 1] if i + 1 < len(borders) else len(path)) - 1
        found.setdefault(int(doc[a]), []).append((int(start[a]), int(end[b]), model.langs[path[a]]))
    for d in docs:
        out[d] = (model.langs[best[d]], float(share[d]), found.get(int(d), []))
    return out


def level(counts: list[int], bound: int) -> float:
    """The most documents of a language, so that all take about ``bound``: those with fewer are taken whole."""
    left = bound
    for i, n in enumerate(sorted(counts)):
        even = left / (len(counts) - i)
        if n > even:
            return even
        left -= n
    return max(counts)


def learn(docs: DataFrame, *, bound: int = TRAIN_DOCS) -> Model:
    """Counts over at most about ``bound`` of the given documents, rare languages whole; the sums are made by Spark."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(NAMES))))
    most = level(list(per_lang.values()), bound)
    thinned = [F.lit(x) for lang, n in per_lang.items() if n > most for x in (lang, int(most / n * (1 << 20)))]
    if thinned:
        share = F.coalesce(F.try_element_at(F.create_map(*thinned), F.col("lang")), F.lit(1 << 20))
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def make():
        def run(batches):
            counts = np.zeros((len(langs), BUCKETS + len(NAMES)), np.int64)
            number = {x: i for i, x in enumerate(langs)}
            for batch in batches:
                lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
                for doc, script, start, end, bucket, word in features_by_piece(batch.column(0).to_pylist()):
                    width = counts.shape[1]
                    counts += np.bincount(lang[doc[word]] * width + bucket, minlength=counts.size).reshape(counts.shape)
                    counts += np.bincount(lang[doc] * width + BUCKETS + script, end - start, minlength=counts.size).reshape(counts.shape).astype(np.int64)
            a, b = counts.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[a, b], pa.int64())], schema=schema)

        return run

    sums = map_arrow(own.select("text", "lang"), make, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    counts[sums["lang"], sums["bucket"]] = sums["n"]
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, *, penalty: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and the spans of each language."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])

    def make():
        def run(batches):
            for batch in batches:
                got = label(model, [x or "" for x in batch.column(1).to_pylist()], penalty, spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in got], schema.field(3).type)], schema=schema)

        return run

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs, model, spans=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
