"""Alignment of two tokenizers' tokens.

A text, with a space before it, is cut by a byte-level BPE (A) and by a piece model (B). The documents of a whole Arrow batch, up to CHARS characters, are concatenated with their byte offsets; the tokens' ends are counted once for each side; where both sides have an end the batch is cut into groups. Segmented prefix sums give each document's groups, and which token of either side covers a byte; so each stretch between neighbouring ends is one link, a pair of tokens that overlap.

How many documents hold a pair of ids linked is counted over the whole corpus: a chunk of documents sends each of its distinct pairs once, with the number of its documents that have it, and gets each pair's count back the same way. So a pair that every document has is one row a chunk, and no row is sent for each token. The highest count of each A id, at most one row for each id of A's vocabulary, is the only table that is broadcast.

Null and empty texts, and texts whose tokens of A or of B don't join to the text's bytes, have no tokens: all numbers are 0 and the groups are ''. Rows are never merged: repeated rows count as documents of their own; a null id stays. Long texts are read whole, each in a chunk of its own beyond CHARS. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import lean, packed, released, texts, unpacked, written
from logloom.llm.packing import chunked
from logloom.llm.pieces import SPACED

CHARS = 1_000_000
#: Below this code point the library's classes of letters and numbers are those of every version of Unicode.
SETTLED = re.compile("[^\x00-ɏ]")
CHUNKS = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pairs array<long>, docs array<int>, each binary, which binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _strings(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a large binary array."""
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = a.buffers()
    bounds = np.frombuffer(bounds, np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8), bounds - bounds[0]


class Tokenizers:
    """A and B: ids of texts, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a_path = a_path
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        a_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            a_bytes[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        self.a_bytes = pa.array(a_bytes, pa.large_binary())
        ranks = {a_bytes[i]: i for t, i in vocab.items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # ids in the order of merges, and the usual cuts: then the ids are ranks
        pre = spec.get("pre_tokenizer") or {}
        self.ranked = [vocab.get(x + y) for x, y in pairs] == list(range(256, 256 + len(pairs))) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = tiktoken.Encoding("a", pat_str=SPACED, mergeable_ranks=ranks, special_tokens={}) if self.ranked else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.pieces.get_piece_size()
        b_bytes = [bytes.fromhex(p[3:5]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.pieces.id_to_piece, range(n)))]
        self.b_bytes = pa.array(b_bytes, pa.large_binary())

    @functools.cached_property
    def library(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.a_path)
        t.encode_special_tokens = True
        return t

    def a(self, own: list[str]) -> list[np.ndarray]:
        """own: texts with the space before them."""
        by_rank = lambda t: self.fast is not None and not SETTLED.search(t)
        return [self.fast.encode_to_numpy(t, disallowed_special=()).astype(np.int64) if by_rank(t) else np.array(self.library.encode(t, add_special_tokens=False).ids, np.int64) for t in own]

    def b(self, own: list[str]) -> list[np.ndarray]:
        """own: texts without it, which B adds."""
        return [np.array(ids, np.int64) for ids in self.pieces.encode(own, num_threads=1)]


@functools.lru_cache(1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _sizes(ids: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(len, ids), np.int64, len(ids))


def _flat(ids: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *ids])


def _faithful(want: list[bytes], tokens: pa.Array, ids: list[np.ndarray]) -> np.ndarray:
    """Which documents' tokens join to their bytes."""
    data, bounds = _strings(tokens.take(pa.array(_flat(ids))))
    ends = bounds[np.cumsum(_sizes(ids))]
    return np.array([x == data[s:e].tobytes() for x, s, e in zip(want, np.concatenate(([0], ends[:-1])), ends, strict=True)], bool)


_COMMA, _BAR, _SEMICOLON, _NOTHING = range(4)


@functools.lru_cache(2)
def _decimals(n: int) -> list[str]:
    """Every id's decimals before each of the marks that can follow."""
    return [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(n)]


def aligned_batch(a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray):
    """Numbers of each document (n_a, n_b, n_groups, n_links), its groups as text, and the links: distinct pairs, and for each document its pairs with how often each is linked. a_sizes, b_sizes: bytes of every id."""
    n = len(a)
    n_a, n_b, ids_a, ids_b = _sizes(a), _sizes(b), _flat(a), _flat(b)
    ends_a, ends_b = np.cumsum(a_sizes[ids_a]), np.cumsum(b_sizes[ids_b])
    total = int(ends_a[-1]) if len(ends_a) else 0
    at_a, at_b = np.bincount(ends_a - 1, minlength=total), np.bincount(ends_b - 1, minlength=total)
    sum_a, sum_b = np.cumsum(at_a), np.cumsum(at_b)
    both = (at_a > 0) & (at_b > 0)
    cuts = np.cumsum(both)
    doc_ends = np.concatenate(([0], ends_a))[np.cumsum(n_a)]
    segment = lambda c: np.diff(np.concatenate(([0], np.concatenate(([0], c))[doc_ends])))  # noqa: E731  a prefix sum, by document
    n_groups = segment(cuts)
    stretch = np.flatnonzero((at_a > 0) | (at_b > 0))
    n_links = np.diff(np.searchsorted(stretch, np.concatenate(([0], doc_ends))))

    # groups as text: A's tokens of a group stand before B's
    group_a, group_b = cuts[ends_a - 1] - both[ends_a - 1], cuts[ends_b - 1] - both[ends_b - 1]
    per_a, per_b = np.bincount(group_a, minlength=cuts[-1] if total else 0), np.bincount(group_b, minlength=cuts[-1] if total else 0)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    k = max(len(a_sizes), len(b_sizes))
    last_a = both[ends_a - 1]
    order[np.arange(len(ids_a)) + (np.cumsum(per_b) - per_b)[group_a]] = ids_a + np.where(last_a, _BAR, _COMMA) * k
    ended = both[ends_b - 1]
    closing = np.where(ended, _SEMICOLON, _COMMA)
    closing[np.cumsum(n_b)[n_b > 0] - 1] = _NOTHING
    order[np.arange(len(ids_b)) + np.cumsum(per_a)[group_b]] = ids_b + closing * k
    words, decimals = order.tolist(), _decimals(k)
    at = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    groups = ["".join(map(decimals.__getitem__, words[x:y])) for x, y in zip(at[:-1], at[1:], strict=True)]

    pairs = ids_a[sum_a[stretch] - at_a[stretch]] * len(b_sizes) + ids_b[sum_b[stretch] - at_b[stretch]]
    distinct, which = np.unique(pairs, return_inverse=True)
    own, times = np.unique(np.repeat(np.arange(n), n_links) * max(1, len(distinct)) + which, return_counts=True)
    doc, which = own // max(1, len(distinct)), own % max(1, len(distinct))
    return (n_a, n_b, n_groups, n_links), groups, distinct, np.bincount(doc, minlength=n), which, times


def _chunks(a_path: str, b_path: str, contents: bool):
    def run(batches):
        t = tokenizers(a_path, b_path)
        a_sizes, b_sizes = np.diff(_strings(t.a_bytes)[1]), np.diff(_strings(t.b_bytes)[1])
        part = TaskContext.get().partitionId()
        for number, (ids, own) in enumerate(chunked(batches, CHARS)):
            spaced = [" " + x for x in own]
            a, b = t.a(spaced), t.b(own)
            want = [x.encode() for x in spaced]
            good = _faithful(want, t.a_bytes, a) & _faithful(want, t.b_bytes, b) & np.array([x != "" for x in own], bool)
            del spaced, own, want
            a, b = ([x if ok else x[:0] for x, ok in zip(side, good, strict=True)] for side in (a, b))
            numbers, groups, distinct, each, which, times = aligned_batch(a, b, a_sizes, b_sizes)
            docs = np.bincount(which, minlength=len(distinct))
            if not contents:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            longs = pa.list_(pa.int64())
            cols = [[part << 32 | number], [ids], *([x] for x in numbers), [groups], [distinct], [docs], [packed(each)], [packed(which)], [packed(times)]]
            kinds = [pa.int64(), *[longs] * 5, pa.list_(pa.string()), longs, pa.list_(pa.int32()), *[pa.binary()] * 3]
            row = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])
            del a, b, numbers, groups, distinct, each, which, times, docs, cols
            released()
            yield row

    return run


def _counted(b_vocab: int, contents: bool):
    """A chunk and its pairs' counts to its documents' results."""

    def put(key, chunk, answers):
        top = {c: chunk.column(c)[0] for c in chunk.column_names}
        ids = top["doc_ids"].as_py()
        pairs = top["pairs"].values.to_numpy()
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = answers.column("at").to_numpy()
        count[at], best[at] = answers.column("n").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
        each, which, times = (unpacked(top[c].as_py()) for c in ("each", "which", "times"))
        ends = np.cumsum(each)
        segment = lambda x: np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(x)))[ends])))
        groups = top["groups"].as_py()
        digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if contents else groups
        long = lambda x: pa.array(x, pa.int64())
        out = {"doc_id": long(ids)} | {c: long(top[c].values.to_numpy()) for c in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"n_best": long(segment(times * best[which])), "count_sum": long(segment(times * count[which])), "groups_sha256": pa.array(digests, pa.string())}
        if contents:
            out["groups"] = pa.array(groups, pa.string())
            links = pa.StructArray.from_arrays([long(pairs[which] // b_vocab), long(pairs[which] % b_vocab), long(times), long(count[which])], ["a", "b", "times", "docs"])
            out["links"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), links)
        return pa.table(out)

    return put


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", contents: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with contents, groups and links (a, b, times, docs)."""
    b_vocab = len(tokenizers(a_path, b_path).b_bytes)
    chunks = written(texts(docs, id_col, text_col).mapInArrow(lean(_chunks(a_path, b_path, contents)), CHUNKS), "align-chunks")
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    counts = written(counts.withColumn("a", F.floor(F.col("pair") / b_vocab)), "align-counts")
    most = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))  # not more rows than A has ids
    counts = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(counts, "pair").select(F.col("chunk").alias("of"), "at", "n", "best")
    tops = chunks.drop("docs")
    schema = RESULT + (", groups string, links array<struct<a: long, b: long, times: long, docs: long>>" if contents else "")
    return tops.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_counted(b_vocab, contents), schema)
