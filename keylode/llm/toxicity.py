"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learnt: whole words and word beginnings (STEM letters) that stand in toxic documents in
many different contexts and hardly in clean ones.  Counting contexts, not documents, keeps words of a
single copied text out.  A trie holds the lexicon; a word's Levenshtein automaton (at most one edit;
terms of FUZZY letters or more, of one letter less if the word holds a digit or mark) walks it and so
meets misspelled terms.  Each hit is weighed by its window of words: within quotation marks, or after a
word of reporting in the same sentence, it counts as quotation.  Words keep inner digits and marks, an
apostrophe between letters is no quotation mark.  A logistic model of the hits' evidence (exact, misspelled, quoted, and the share of words hit) gives the score.

Learning takes at most about TRAIN_TOXIC toxic and TRAIN_CLEAN clean documents, chosen by a hash of
doc_id.  Scoring reads whole texts of all documents.

Defined results: null and empty texts have no hits and the score of a document without; a doc_id with
several labels counts as toxic if any says so; with no toxic row to learn from every score is 0; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import held_out, map_arrow, small_batches, table, texts

TRAIN_TOXIC = 3000
TRAIN_CLEAN = 6000
STEM = (4, 5, 6, 7)
FUZZY = 5
#: A lexicon entry: so many toxic documents (also as a share of those learnt from) and contexts at least, and so small a share of clean ones among them.
LEAST_DOCS = 4
LEAST_SHARE = 0.005
LEAST_CONTEXTS = 4
CLEAN_SHARE = 0.02
CONTEXTS = 12
WINDOW = 6
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W_]+(?:[*@$#]+[^\W_]+)*")
QUOTES = re.compile(r"[\"“”„«»]|(?<![^\W_])[‘’]|[‘’](?![^\W_])")
SENTENCE = re.compile(r"[.!?\n]")
#: After one of these a term is reported, not used.
REPORTING = frozenset("said says say saying called calls call calling wrote writes write writing quoted quotes quote quoting told tells reported reports reporting word words term terms".split())
#: Distinct words a task remembers to be no hit; beyond it the memory starts anew.
REMEMBERED = 200_000


class Trie:
    """Children by letter; at a term's end its kind: 1 whole word, 2 word beginning."""

    def __init__(self, terms: dict[str, int]):
        self.root: dict = {}
        for term, kind in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, kind)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits: the automaton of the word runs along the trie's paths.

        A state is two bit sets of positions in the word, reached with no edit and with one.
        """
        n = len(word)
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        least = FUZZY if word.isalpha() else FUZZY - 1
        fuzzy = n >= FUZZY - 1
        best = None
        stack = [(self.root, 1, 3 if fuzzy else 0, 0)]
        while stack:
            node, zero, one, depth = stack.pop()
            if "" in node:
                term, kind = node[""]
                if kind == 2:
                    # Beginnings allow an edit only if they are long, and never in their first letter.
                    edits = 0 if zero else 1 if one and depth > FUZZY and word[0] == term[0] else None
                else:
                    edits = 0 if zero >> n & 1 else 1 if one >> n & 1 and depth >= least else None
                if edits == 0:
                    return term, 0
                if edits is not None:
                    best = (term, 1)
            for c, child in node.items():
                if c:
                    mask = at.get(c, 0)
                    next_zero = (zero & mask) << 1
                    next_one = ((one & mask) << 1 | zero | zero << 1 | next_zero << 1) if fuzzy else 0
                    if next_zero or next_one:
                        stack.append((child, next_zero, next_one, depth + 1))
        return best


class Scorer:
    """Finds and weighs the hits of texts."""

    def __init__(self, terms: dict[str, int], beta: list[float]):
        self.trie, self.beta = Trie(terms), beta
        self.hits: dict[str, tuple[str, int]] = {}
        self.seen: set[str] = set()

    def find(self, text: str) -> list[tuple[int, int, str, int, bool]]:
        """(start, end, term, edits, quoted) of every hit."""
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = set(WORDS.findall(low))
        new = words - self.seen
        if new:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
                self.hits.clear()
                new = words
            for w in new:
                if len(w) >= 4 and (m := self.trie.match(w)):
                    self.hits[w] = m
            self.seen |= new
        if self.hits.keys().isdisjoint(words):
            return []
        found = []
        spans = [(m.start(), m.end()) for m in WORDS.finditer(low)]
        for i, (a, b) in enumerate(spans):
            if hit := self.hits.get(low[a:b]):
                begin, end = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
                quoted = len(QUOTES.findall(low, begin, a)) % 2 == 1 and QUOTES.search(low, b, end) is not None
                if not quoted:
                    begin = max([begin, *(m.end() for m in SENTENCE.finditer(low, begin, a))])
                    quoted = any(x >= begin and low[x:y] in REPORTING for x, y in spans[max(0, i - WINDOW) : i])
                found.append((a, b, *hit, quoted))
        return found

    def evidence(self, text: str) -> list[float]:
        found = self.find(text)
        exact = sum(1 for x in found if not x[3] and not x[4])
        fuzzy = sum(1 for x in found if x[3] and not x[4])
        quoted = sum(1 for x in found if x[4])
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), min(1.0, 40 * (exact + fuzzy) / (len(text) / 6 + 40))]

    def score(self, text: str) -> float:
        if not self.beta:
            return 0.0
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], self.evidence(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> list[float]:
    """Logistic regression by Newton's method, with a ridge and without negative weights for hits.

    The ridge draws weights to 0, but that of misspelled terms to half that of exact ones: where the
    rows learnt from hold none, a misspelling still counts, and less than the term itself.
    """
    x = np.column_stack([np.ones(len(x)), x])
    centre = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))

    def newton() -> np.ndarray:
        beta = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (y - p) - penalty @ (beta - centre))
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        return beta

    centre[2] = max(0.0, float(newton()[1])) / 2
    return [float(b) if i == 0 else max(0.0, float(b)) for i, b in enumerate(newton())]


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs: (doc_id, text) that may be learnt from; labels: (doc_id, toxic)."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marks.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    if not totals.get(1):
        return Scorer({}, [])
    keep = [int(min(1.0, bound / max(1, totals.get(k, 0))) * (1 << 20)) for k, bound in ((0, TRAIN_CLEAN), (1, TRAIN_TOXIC))]
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.when(F.col("toxic") > 0, keep[1]).otherwise(keep[0]))
    # At most TRAIN_TOXIC + TRAIN_CLEAN rows (and a few by chance): small enough to send everywhere.
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL").select("text", "toxic")
    schema = pa.schema([("term", pa.string()), ("kind", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64()), ("contexts", pa.list_(pa.int64()))])

    def count():
        import xxhash

        def run(batches):
            counts, contexts = (Counter(), Counter()), {}
            for batch in batches:
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = WORDS.findall(text.lower())
                    own = set()
                    for i, w in enumerate(words):
                        if len(w) < STEM[0] or w.isdigit():
                            continue
                        terms = [(w, 1), *[(w[:k], 2) for k in STEM if len(w) > k]]
                        own.update(terms)
                        if toxic > 0:
                            near = xxhash.xxh64_intdigest(" ".join(words[max(0, i - 1) : i] + ["_"] + words[i + 1 : i + 2])) >> 1
                            for t in terms:
                                if len(c := contexts.setdefault(t, set())) < CONTEXTS:
                                    c.add(near)
                    counts[toxic > 0].update(own)
            terms = [*counts[1], *(t for t in counts[0] if t not in counts[1])]
            for k in range(0, len(terms), 50_000):
                part = terms[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for f, v in zip(schema, ([t[0] for t in part], [t[1] for t in part], [counts[1][t] for t in part], [counts[0][t] for t in part], [list(contexts.get(t, ())) for t in part]), strict=True)], schema=schema)

        return run

    sums = map_arrow(rows, count, "term string, kind int, toxic long, clean long, contexts array<long>").groupBy("term", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts"))
    found = sums.filter((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * min(TRAIN_TOXIC, totals[1]))) & (F.col("contexts") >= F.greatest(F.lit(LEAST_CONTEXTS), F.least(F.lit(CONTEXTS), (F.col("toxic") * 0.3).cast("int")))) & (F.col("clean") <= F.col("toxic") * CLEAN_SHARE)).collect()
    terms = lexicon({(r["term"], r["kind"]): (r["toxic"], r["contexts"]) for r in found})
    scorer = Scorer(terms, [])
    schema2 = pa.schema([("x", pa.list_(pa.float64())), ("toxic", pa.int32())])

    def weigh():
        def run(batches):
            for batch in batches:
                x = [scorer.evidence(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, schema2.field(0).type), batch.column(1).cast(pa.int32())], schema=schema2)

        return run

    seen = map_arrow(rows, weigh, "x array<double>, toxic int").toPandas()
    y = (seen["toxic"] > 0).to_numpy(float)
    return Scorer(terms, fit(np.array(seen["x"].tolist()).reshape(len(seen), -1), y) if 0 < y.sum() < len(y) else [])


def lexicon(found: dict[tuple[str, int], tuple[int, int]]) -> dict[str, int]:
    """Term to kind: of nested beginnings and words, the shortest that says as much."""
    out: dict[str, int] = {}
    for (term, kind), (toxic, _) in sorted(found.items(), key=lambda x: (len(x[0][0]), -x[0][1])):
        shorter = max((found[(term[:k], 2)][0] for k in STEM if k < len(term) and out.get(term[:k]) == 2), default=0)
        # A beginning says more than the word that it begins only if it stands for several words.
        longer = max((v[0] for (t, kd), v in found.items() if kd == 1 and t.startswith(term)), default=0) if kind == 2 else 0
        if not shorter and (kind == 1 or toxic > 1.25 * longer):
            out[term] = kind
    return out


def score_documents(docs: DataFrame, scorer: Scorer, *, hits: bool = False) -> DataFrame:
    """doc_id, score, and (asked for) every hit: start, end, term, edits, quoted."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", kind)])
    terms, beta = scorer_terms(scorer), scorer.beta

    def make():
        own = Scorer(terms, beta)

        def run(batches):
            for batch in batches:
                rows = [x or "" for x in batch.column(1).to_pylist()]
                found = [[dict(zip(("start", "end", "term", "edits", "quoted"), h, strict=True)) for h in own.find(x)] if hits else [] for x in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([own.score(x) for x in rows], pa.float64()), pa.array(found, kind)], schema=schema)

        return run

    return map_arrow(texts(docs), make, "doc_id long, score double, hits array<struct<start:long,end:long,term:string,edits:int,quoted:boolean>>")


def accepted(docs: DataFrame, scorer: Scorer, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole, whose text scores under the threshold."""
    terms, beta = scorer_terms(scorer), scorer.beta

    def make():
        own = Scorer(terms, beta)

        def run(batches):
            for batch in batches:
                rows = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([own.score(x or "") < threshold for x in rows], pa.bool_()))

        return run

    return map_arrow(docs, make, docs.schema)


def scorer_terms(scorer: Scorer) -> dict[str, int]:
    terms, stack = {}, [scorer.trie.root]
    while stack:
        node = stack.pop()
        for c, x in node.items():
            if c:
                stack.append(x)
            else:
                terms[x[0]] = x[1]
    return terms


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = learn(docs.filter(~held_out(F.col("doc_id"))), labels.filter(~held_out(F.col("doc_id"))))
    out = score_documents(docs, scorer)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
