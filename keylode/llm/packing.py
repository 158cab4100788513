"""Packing: hierarchical multi-length packing into power-of-two context tiers.

Documents become token ids (byte-level BPE, then id 0 as the end mark).  Whole windows of the longest
tier are cut off first; what is left of each document is routed to the smallest of the tiers that holds
it.  Tiers are packed from the longest down: a window takes one document of its own tier, its gap is
filled with whole documents of shorter tiers, the longest that fit first, and only what is then left of
the gap takes a piece cut from the shortest document.  The last window is cut into full powers of two.
Every sequence therefore has exactly a power of two of ids and needs no padding.  Full sequences are
dealt to step groups of equal token counts, each of one tier.

Packing is local to an input partition and needs no shuffle: a block of at most BLOCK_TOKENS ids is
held at once, and sequence ids hold the partition's number, so a task that runs again repeats them.

Memory: texts are encoded in slices of SLICE bytes, cut only where the tokenizer always cuts (before
white space, and between letters and digits), as its own objects take some thirty times a text's size;
remembered chunks are bounded in bytes.

Defined results: a null or empty text is one id (the end mark); repeated rows and equal ids are packed
as rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_right, insort
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylode.llm.common import map_arrow, small_batches, table, texts

WINDOW = 1024
BLOCK_TOKENS = 1 << 21
BLOCK_DOCS = 8192
STEP_TOKENS = 8 * WINDOW
#: Windows of documents under this are packed with others of the same tier.
LEAST_TIER = 128
#: Bytes that a worker's remembered chunks take at most; those beyond, and chunks over LONG characters, are encoded each time.
REMEMBERED = 48 << 20
LONG = 48
#: The bytes for a worker that does nothing but packing, as in op8.
ALONE = 144 << 20
#: Characters that go to the tokenizer at once.
SLICE = 1 << 18
#: How the vocabulary writes a space.
SPACE = "\u0120"
#: Places where the tokenizer cuts, whatever stands around them.
CUT = re.compile(r"(?<=\S)(?=[ \t-\r])")
FINE = re.compile(r"(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])")
#: A mark at a chunk's end, after a letter, is a pre-token of its own: the chunk's ids are its stem's and the mark's.
MARKED = re.compile(r"[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][.,]$(?!\n)")
#: Chunks that are one pre-token with the space before them.
WORD = re.compile(r"[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{1,%d}" % LONG)
#: Byte-level vocabularies write a byte that prints as itself, and the others as characters from 256 on; the line end is not needed here.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
WRITTEN = np.arange(256, dtype=np.uint32)
for _k, _b in enumerate(b for b in range(256) if b not in PRINTED):
    WRITTEN[_b] = 256 + _k if _b != 10 else 10
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
SQL_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def slices(strings: list[str], most: int):
    """Runs of strings of at most so many characters in all, or one string."""
    part, held = [], 0
    for x in strings:
        if part and held + len(x) > most:
            yield part
            part, held = [], 0
        part.append(x)
        held += len(x)
    if part:
        yield part


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A chunk between two single spaces is split into pre-tokens without regard to its neighbours, so its
    ids are worked out once and remembered.  A text in which a space stands beside other white space is
    cut before each run of white space instead, which the tokenizer does too.
    """

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        split = self.tokenizer.pre_tokenizer
        bytewise = isinstance(self.tokenizer.model, models.BPE) and isinstance(split, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        #: The model alone, for words that need no splitting.
        self.model = self.tokenizer.model if bytewise and [x for x, _ in split.pre_tokenize_str(" ab cd")] == [f"{SPACE}ab", f"{SPACE}cd"] else None
        self.known: dict[str, bytes] = {}
        self.held, self.most = 0, remembered
        self.marks = {x: array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for x in ".,"}

    def encode(self, strings: list[str]) -> list[bytes]:
        out = []
        for part in slices(strings, SLICE):  # the encoder's own objects are many times as large as the ids
            if len(part) == 1 and len(part[0]) > SLICE:
                out.append(self.long(part[0]))
            else:
                out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def long(self, text: str) -> bytes:
        """One string in parts; a part without any place to cut is encoded whole."""
        whole = lambda x: array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes()
        out = []
        for part in slices(CUT.split(text), SLICE):
            joined = "".join(part)
            out += [whole("".join(x)) for x in slices(FINE.split(joined), SLICE)] if len(joined) > SLICE else [whole(joined)]
        return b"".join(out)

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for part in slices(texts, 4 * SLICE):
            out += self._ids(part)
        return out

    def chunks(self, new: list[str]) -> list[bytes]:
        """Ids of chunks, each with a space before it; none of them odd.  Many are encoded as one text."""
        out = []
        for part in slices(new, SLICE):
            if len(part[0]) > SLICE:
                out.append(self.long(f" {part[0]}"))
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(self.spaced[ids]) * 4  # a chunk has its only space in front
            if len(starts) != len(part):
                raise ValueError("the tokenizer joins spaces to what stands before them")
            data = ids.tobytes()
            out += [data[i:k] for i, k in zip(starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True)]
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks that WORD matches, each with a space before it: their bytes go straight to the model."""
        tokenize = self.model.tokenize
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        written = WRITTEN[data].tobytes().decode("utf-32-le").split("\n")
        return [array("I", [t.id for t in tokenize(SPACE + x)]).tobytes() for x in written[: len(words)]]

    def learn(self, distinct: list[str]) -> tuple[list[bytes], set[str]]:
        """Ids of these chunks, and the odd ones among them, which have none."""
        known = self.known
        got = list(map(known.get, distinct))
        unknown = [x for x, ids in zip(distinct, got, strict=True) if ids is None]
        odd = {x for x in unknown if not x or x[0].isspace() or x[-1].isspace()}
        marked = [x for x in unknown if MARKED.search(x)]
        new = set(unknown).difference(odd, marked)
        new.update({x[:-1] for x in marked}.difference(known))
        new = list(new)
        words = [x for x in new if WORD.fullmatch(x)] if self.model else []
        known.update(zip(words, self.words(words), strict=True))
        rest = list(set(new).difference(words))
        known.update(zip(rest, self.chunks(rest), strict=True))
        for x in marked:
            known[x] = known[x[:-1]] + self.marks[x[-1]]
        got = [known.get(x, b"") if ids is None else ids for x, ids in zip(distinct, got, strict=True)]
        for x in chain(new, marked):  # those beyond the bound are forgotten
            if len(x) <= LONG and self.held < self.most:
                self.held += 4 * len(x) + len(known[x]) + 180
            else:
                del known[x]
        return got, odd

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Chunks are told apart by Arrow; Python looks up each distinct one of these texts once."""
        lists = pc.split_pattern(pa.array([x if len(x) <= 16 * SLICE else "" for x in texts], pa.string()), " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        first = [x if len(x) > 16 * SLICE else head for x, head in zip(texts, lists.values.take(lists.offsets[:-1]).to_pylist(), strict=True)]
        is_part = np.ones(len(lists.values), bool)
        is_part[at[:-1]] = False
        parts = lists.values.filter(pa.array(is_part)).dictionary_encode()
        at -= np.arange(len(at))  # where each text's chunks begin, without its first
        distinct, chunk = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        known, odd = self.learn(distinct)
        strange = np.zeros(len(texts), bool)
        if odd:
            strange = np.diff(np.concatenate([[0], np.cumsum(np.array([x in odd for x in distinct])[chunk])])[at]) > 0
        pool = np.frombuffer(b"".join(known), np.uint32)
        sizes = np.array([len(x) for x in known], np.int64) // 4
        size = sizes[chunk]
        end = np.cumsum(size)
        all_ids = pool[np.repeat((np.cumsum(sizes) - sizes)[chunk] - end + size, size) + np.arange(len(size) and end[-1])]
        border = np.concatenate([[0], end])[at].tolist()
        out = []
        for k, (text, start, head) in enumerate(zip(texts, first, self.encode(first), strict=True)):
            if at[k] < at[k + 1] and (start[-1:].isspace() or not start or strange[k]):
                out.append(self.encode([text])[0])
            else:
                out.append(head + all_ids[border[k] : border[k + 1]].tobytes())
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str | None, remembered: int) -> Encoder:
    """The worker's own encoder: what one task has worked out, its next tasks need not."""
    return Encoder(path, remembered)


def tier_of(n: int, window: int = WINDOW) -> int:
    """The smallest tier that holds so many tokens."""
    return min(window, max(LEAST_TIER, 1 << (n - 1).bit_length()))


def tiers_of(lengths: list[int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Pack documents of these token counts: (tier, [(document, start, length), ...]) of each sequence."""
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    rest: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for d, n in enumerate(lengths):
        full = n - n % window
        out.extend((window, [(d, s, window)]) for s in range(0, full, window))
        if n > full:
            rest.append((n - full, d, full))
    rest.sort()
    while rest:
        n, d, s = rest.pop()  # the longest left opens a window of its own tier
        tier = tier_of(n, window)
        gap, pieces = tier - n, [(d, s, n)]
        while gap and rest:
            at = bisect_right(rest, (gap, 1 << 62, 0))
            if at:  # the longest that fits whole
                n, d, s = rest.pop(at - 1)
                pieces.append((d, s, n))
                gap -= n
            else:  # none fits: a piece of the shortest
                n, d, s = rest.pop(0)
                pieces.append((d, s, gap))
                insort(rest, (n - gap, d, s + gap))
                gap = 0
        if not gap:
            out.append((tier, pieces))
            continue
        size = tier - gap  # the last window: cut to full powers of two
        while pieces:
            part, want = [], 1 << (size.bit_length() - 1)
            size -= want
            while want:
                d, s, n = pieces.pop(0)
                take = min(n, want)
                part.append((d, s, take))
                want -= take
                if n > take:
                    pieces.insert(0, (d, s + take, n - take))
            out.append((sum(x[2] for x in part), part))
    return out


def steps_of(packed: list[tuple[int, list]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each sequence: groups hold one tier, equal token counts and evened-out piece counts."""
    groups, first = [0] * len(packed), 0
    by_tier: dict[int, list[int]] = {}
    for i, (tier, _) in enumerate(packed):
        by_tier.setdefault(tier, []).append(i)
    for tier, members in sorted(by_tier.items(), reverse=True):
        each = max(1, step_tokens // tier)
        n = -(-len(members) // each)
        members.sort(key=lambda i: -len(packed[i][1]))
        for at, i in enumerate(members):  # to and fro, so that many-piece sequences spread
            lap, k = divmod(at, n)
            groups[i] = first + (k if lap % 2 == 0 else n - 1 - k)
        first += n
    return groups


def pack_documents(docs: DataFrame, *, tokenizer_path: str | None = None, window: int = WINDOW, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents, with their ids (little-endian unsigned 32 bits).

    remembered: bytes of chunks that each worker keeps; more spend memory to save time.
    """

    def make():
        encoder = encoder_of(tokenizer_path, remembered)
        base = TaskContext.get().partitionId() << 36
        made = {"sequence": 0, "group": 0}

        def flush(block):
            packed = tiers_of([len(x[1]) // 4 for x in block], window)
            steps = steps_of(packed)
            columns = {f.name: [] for f in SCHEMA}
            for (tier, pieces), step in zip(packed, steps, strict=True):
                offset = 0
                for d, s, n in pieces:
                    doc_id, ids = block[d]
                    for k, v in (("doc_id", doc_id), ("start", s), ("length", n), ("ids", ids[4 * s : 4 * (s + n)]), ("doc_tokens", len(ids) // 4), ("sequence_id", base + made["sequence"]), ("offset", offset), ("tier", tier), ("step_group", base + made["group"] + step)):
                        columns[k].append(v)
                    offset += n
                made["sequence"] += 1
            made["group"] += max(steps, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in SCHEMA], schema=SCHEMA)

        def run(batches):
            block, held = [], 0
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    block.append((doc_id, ids))
                    held += len(ids) // 4
                    if held >= BLOCK_TOKENS or len(block) >= BLOCK_DOCS:
                        yield flush(block)
                        block, held = [], 0
            if block:
                yield flush(block)

        return run

    return map_arrow(texts(docs), make, SQL_SCHEMA)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digest(pack_documents(table(spark, sf_dir, "documents"), remembered=ALONE))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
