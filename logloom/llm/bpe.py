"""Byte-level BPE encoding and decoding: the ranked merges are folded by Spark's higher-order functions over the byte arrays of distinct words.

Each distinct word of the corpus is folded once. A run of documents becomes a row: its distinct words, and its documents as numbers of those. The words go, packed, to buckets by their hash; a bucket keeps one of each, Spark folds the merges over its bytes, and every run gets the ids of its words back. The ranks are a constant of the plan: the rank of two neighbouring tokens' join lies in one array at a place that a second array shifts, so that no two pairs share one. Decoding looks up each id's bytes and concatenates them.

Null texts count as empty; an empty text has no ids. Repeated rows and ids are encoded one by one, a null id stays null; other columns are ignored, whatever their names. An empty table gives no rows. A word of more than LONG_PIECE bytes is merged by a heap instead, since the fold takes the square of a word's length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, bucketed, lean, lean_group, packed, ranges, released, texts, unpacked
from logloom.llm.packing import chunked
from logloom.llm.pieces import sliced, starts, string_hashes

#: A run of documents ends after so many characters.
RUN_CHARS = 8 << 20
#: Words of runs in a bucket; MOST_WORDS where that would make more than MANY buckets.
WORDS, MOST_WORDS, MANY = 20_000, 1_000_000, 4096
LONG_PIECE = 4096
#: Bits of a token's id, of a pair's rank, and the id and rank that none has.
BITS = 17
NONE = (1 << BITS) - 1
#: Bits below a rank in an element of the fold's state: the id, and above it where the token begins.
LOW = 41

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string, decoded binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file has lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# ---------------------------------------------------------------- the ranks as constants of the plan


def shifted_places(keys: list[int], room: int) -> tuple[list[int], int]:
    """(shifts, number of shifts): key % room + shift[key % number], modulo room, is another place for each key. room is a prime."""
    number = len(keys) // 3 | 1
    while True:
        groups: dict[int, list[int]] = {}
        for k in keys:
            groups.setdefault(k % number, []).append(k % room)
        if all(len(set(g)) == len(g) for g in groups.values()):
            break
        number += 2
    taken, shifts = bytearray(room), [0] * number
    for g, own in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        d = 0
        while any(taken[(x + d) % room] for x in own):
            d += 1
        shifts[g] = d
        for x in own:
            taken[(x + d) % room] = 1
    return shifts, number


def _prime(n: int) -> int:
    n |= 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


class Ranks:
    """The ranks of all pairs of tokens whose join is a token, as two arrays, and the ids of single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:i]] << BITS) + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        #: Ids travel in two bytes, less by `shift`, if all fit.
        self.kind, self.shift = ("smallint", 1 << 15) if max(ranks.values(), default=0) < 1 << 16 else ("int", 0)
        self.room = _prime(2 * len(pairs) + 64)
        shifts, self.number = shifted_places(list(pairs), self.room)
        places = [0] * self.room
        for k, r in pairs.items():
            places[(k % self.room + shifts[k % self.number]) % self.room] = (k + 1 << BITS) + r
        literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")  # noqa: E731  the optimizer parses it once
        self.literals = [literal(places, "bigint"), literal(shifts, "int"), literal([ranks.get(bytes([b]), NONE - 1) for b in range(256)], "int")]

    def of(self, left: Column, right: Column, places: Column, shifts: Column) -> Column:
        """The rank of two tokens' join; NONE or more without one."""
        key = left * (1 << BITS) + right
        place = (key % self.room + F.get(shifts, (key % self.number).cast("int"))) % self.room
        # an entry holds the key plus one above the rank: what differs from this key is too large for a rank
        return F.least(F.get(places, place.cast("int")).bitwiseXOR(F.shiftleft(key + 1, BITS)), F.lit(NONE))


def bind(x: Column, then) -> Column:
    """then(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def folded(word: Column, ranks: Ranks, places: Column, shifts: Column, bytes_: Column) -> Column:
    """The ids, less by ranks.shift, of one word, an array of its bytes: again and again the leftmost pair of least rank is merged.

    The fold's state has an element for each token: the rank of its pair with the next one, where it begins, and its id. So the least element is the pair to merge. One element before the first token and two after the last have no pair.
    """
    low, own, none = (1 << LOW) - 1, (1 << BITS) - 1, NONE << LOW
    n = F.size(word)
    edge = F.lit(none + NONE)

    def start(ids: Column) -> Column:
        pair = lambda i: F.shiftleft(ranks.of(F.get(ids, i), F.coalesce(F.get(ids, i + 1), F.lit(NONE).cast("long")), places, shifts), LOW)
        tokens = F.transform(F.sequence(F.lit(0), n - 1), lambda i: pair(i) + F.shiftleft(i.cast("long"), BITS) + F.get(ids, i))
        return F.concat(F.array(edge), tokens, F.array(edge, edge))

    def merge_at(a: Column, m: Column, i: Column) -> Column:  # m is the i-th element, 1-based
        new = F.shiftright(m, LOW)

        def put(p: Column) -> Column:  # the element before without its rank, and the id after the pair
            left = F.shiftleft(ranks.of(p[0].bitwiseAND(F.lit(own)), new, places, shifts), LOW) + p[0]
            here = F.shiftleft(ranks.of(new, p[1], places, shifts), LOW) + m.bitwiseAND(F.lit(low - own)) + new
            return F.concat(F.slice(a, F.lit(1), i - 2), F.array(left, here), F.slice(a, i + 2, n + 3))

        return bind(F.array(F.get(a, i - 2).bitwiseAND(F.lit(low)), F.get(a, i + 1).bitwiseAND(F.lit(own))), put)

    def step(a: Column, _: Column) -> Column:
        return bind(F.array_min(a), lambda m: F.when(m >= none, a).otherwise(bind(F.array_position(a, m).cast("int"), lambda i: merge_at(a, m, i))))

    def ids_of(a: Column) -> Column:
        return F.transform(F.slice(a, F.lit(2), F.size(a) - 3), lambda x: (x.bitwiseAND(F.lit(own)) - ranks.shift).cast(ranks.kind))

    first = bind(F.transform(word, lambda b: F.get(bytes_, b.cast("int")).cast("long")), start)
    none_at_all = F.array().cast(f"array<{ranks.kind}>")
    return F.when(n == 0, none_at_all).otherwise(F.aggregate(F.sequence(F.lit(1), n), first, step, ids_of))


def encoded(words: Column, known: Column, ranks: Ranks) -> Column:
    """The ids, less by ranks.shift, of each of the words, arrays of bytes; known: those of words that need no fold, null for others."""
    places, shifts, bytes_ = ranks.literals
    return bind(places, lambda p: bind(shifts, lambda s: bind(bytes_, lambda b: F.transform(words, lambda w, i: F.coalesce(F.get(known, i), folded(w, ranks, p, s, b))))))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that an array of ids stands for, their pieces concatenated."""
    by_id: list = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = base64.b64encode(token).decode()
    tokens = F.from_json(F.lit(json.dumps(by_id)), "array<binary>")
    return bind(tokens, lambda t: F.aggregate(ids, F.lit(b"").cast("binary"), lambda acc, i: F.concat(acc, F.get(t, i))))


def heap_merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as `folded` gives, in n log n for a very long piece."""
    if piece in ranks:
        return [ranks[piece]]
    parts: list = [piece[i : i + 1] for i in range(len(piece))]
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != len(both) or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
            if (r := ranks.get(both + parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, both + parts[after[i]]))
        if before[i] >= 0 and (r := ranks.get(parts[before[i]] + both)) is not None:
            heapq.heappush(heap, (r, before[i], parts[before[i]] + both))
    return [ranks[p] for p in parts if p is not None]


# ---------------------------------------------------------------- runs of documents, buckets of words

RUNS = "run long, doc_ids array<long>, sizes binary, numbers binary, places binary, words binary, lengths binary, n_words long"
DEALT = "bucket long, run long, words binary, lengths binary"
FOUND = "bucket long, words array<array<smallint>>, known array<array<KIND>>, runs array<struct<run: long, at: array<int>>>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _pressed(data) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(memoryview(data))


def _unpressed(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def _strings(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a large binary array."""
    _, bounds, data = a.buffers()
    bounds = np.frombuffer(bounds, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def _taken(data: np.ndarray, bounds: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of some of the strings."""
    lengths = np.diff(bounds)[order]
    return data[ranges(bounds[:-1][order], lengths)], lengths


def _runs(pattern: str):
    """(doc_id, text) to runs: distinct words by hash, and the documents' words as numbers, frequent ones low, with the place of each number."""

    def cut(batches):
        part = TaskContext.get().partitionId()
        for number, (ids, own) in enumerate(chunked(batches, RUN_CHARS)):
            bounds, sizes = starts(own, pattern)
            words = sliced("".join(own).encode(), bounds).dictionary_encode()
            del own, bounds
            at = words.indices.to_numpy() if len(words) else np.zeros(0, np.int32)
            data, ends = _strings(words.dictionary)
            n = len(ends) - 1
            by_hash = np.argsort(string_hashes(data, ends))
            place = np.empty(n, np.int64)
            place[by_hash] = np.arange(n)
            often = np.argsort(-np.bincount(at, minlength=n), kind="stable")
            rank = np.empty(n, np.int32)
            rank[often] = np.arange(n)
            text, lengths = _taken(data, ends, by_hash)
            cols = [[part << 32 | number], [ids], [packed(sizes)], [packed(rank[at])], [packed(place[often])], [_pressed(text)], [packed(lengths)], [n]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64()]
            row = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_names(RUNS))
            del cols, words, at, data, ends, text, lengths
            released()
            yield row

    return cut


def _dealt(buckets: int):
    """Runs' words to buckets, ranges of their hashes, in the runs' order."""

    def deal(batches):
        for b in batches:
            for r in b.to_pylist():
                data, lengths = _unpressed(r["words"]), unpacked(r["lengths"])
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                own = (string_hashes(data, bounds) >> U64(32)).astype(np.int64) * buckets >> 32
                cut = np.searchsorted(own, np.arange(buckets + 1)).tolist()
                rows = [(i, r["run"], _pressed(data[bounds[x] : bounds[y]]), packed(lengths[x:y])) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=_names(DEALT))

    return deal


def _gathered(ranks, kind: str, shift: int):
    """A bucket's words from all runs: one of each, and each run's as numbers of those."""

    def gather(key, t):
        runs = t.column("run").to_pylist()
        data = [_unpressed(w) for w in t.column("words").to_pylist()]
        lengths = [unpacked(x) for x in t.column("lengths").to_pylist()]
        every = sliced(np.concatenate(data), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))).dictionary_encode()
        at = np.split(every.indices.to_numpy(), np.cumsum([len(x) for x in lengths])[:-1])
        words = every.dictionary.to_pylist()
        known = [[r - shift] if r is not None else None for r in map(ranks.value[0].get, words)]
        for i, w in enumerate(words):
            if known[i] is None and len(w) > LONG_PIECE:
                known[i] = [r - shift for r in heap_merged(w, ranks.value[0])]
        bytes_, bounds = _strings(every.dictionary)
        sizes = np.where([k is None for k in known], np.diff(bounds), 0)
        flat = pa.array(bytes_[ranges(bounds[:-1], sizes)].astype(np.int16))
        arrays = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)
        listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), arrays)
        members = [{"run": r, "at": x} for r, x in zip(runs, at, strict=True)]
        kinds = [pa.list_(pa.list_(pa.int16() if kind == "smallint" else pa.int32())), pa.list_(pa.struct([("run", pa.int64()), ("at", pa.list_(pa.int32()))]))]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), listed, pa.array([known], kinds[0]), pa.array([members], kinds[1])], names=["bucket", "words", "known", "runs"])

    return gather


def _assembled(ranks, names: list[str], shift: int, most: int = 1 << 20):
    """A run's documents and its words' ids to the columns of RESULT that are named."""

    def put(key, runs, t):
        top = runs.to_pylist()[0]
        order = np.argsort(t.column("bucket").to_numpy()).tolist()
        numbers = unpacked(top["places"]).astype(np.int32)[unpacked(top["numbers"]).astype(np.int32)]
        sizes = unpacked(top["sizes"])
        joined = lambda c: np.concatenate([np.zeros(0, np.int32), *(t.column(c)[i].values.to_numpy().astype(np.int32) for i in order)])
        counts, ids = joined("counts"), joined("ids") + np.int32(shift)
        first = np.cumsum(counts) - counts
        tokens = np.concatenate(([0], np.cumsum(counts[numbers])))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        written_, bytes_ = ranks.value[1]
        out: dict[str, list] = {n: [] for n in names}
        n_docs, x = len(sizes), 0
        while x < n_docs:  # documents of at most so many tokens together
            y = max(x + 1, int(np.searchsorted(tokens[ends], tokens[ends[x]] + most, side="right")) - 1)
            own = numbers[ends[x] : ends[y]]
            flat = pa.array(ids[ranges(first[own], counts[own])])
            text, text_at = _strings(written_.take(flat))
            data, data_at = _strings(bytes_.take(flat))
            cut = (tokens[ends[x : y + 1]] - tokens[ends[x]]).tolist()
            for i, a, b in zip(top["doc_ids"][x:y], cut[:-1], cut[1:], strict=True):
                listed, back = text[text_at[a] + 1 : text_at[b]] if b > a else text[:0], data[data_at[a] : data_at[b]]
                got = {"doc_id": i, "n_tokens": b - a, "ids_sha256": hashlib.sha256(listed).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()}
                if "ids" in out:
                    got |= {"ids": listed.tobytes().decode(), "decoded": back.tobytes()}
                for n in names:
                    out[n].append(got[n])
            x = y
        released()
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "decoded": pa.binary()}
        return pa.table({n: pa.array(out[n], kinds.get(n, pa.string())) for n in names})

    return put


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", contents: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 and, with contents, ids as text and the decoded bytes) for each row.

    pattern: the expression that cuts a text into words and leaves nothing out.
    """
    spark = docs.sparkSession
    by_id = sorted((r, t) for t, r in ranks.items())
    tokens = [b""] * (by_id[-1][0] + 1 if by_id else 0)
    for r, t in by_id:
        tokens[r] = t
    shared = spark.sparkContext.broadcast((ranks, (pa.array([f" {i}".encode() for i in range(len(tokens))], pa.large_binary()), pa.array(tokens, pa.large_binary()))))
    runs = bucketed(texts(docs, id_col, text_col).mapInArrow(lean(_runs(pattern)), RUNS), "bpe-runs", "run")
    n = runs.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-n // MOST_WORDS), min(MANY, -(-n // WORDS)))
    dealt = runs.select("run", "words", "lengths").mapInArrow(lean(_dealt(buckets)), DEALT)
    constants = Ranks(ranks)
    found = dealt.groupBy("bucket").applyInArrow(lean_group(_gathered(shared, constants.kind, constants.shift)), FOUND.replace("KIND", constants.kind))
    enc = found.withColumn("enc", encoded(F.col("words"), F.col("known"), constants)).select("bucket", "enc", F.explode("runs").alias("r"))
    own = F.transform("r.at", lambda i: F.get("enc", i))
    answers = enc.select("bucket", F.col("r.run").alias("run"), own.alias("own"))
    answers = answers.select("run", "bucket", F.transform("own", lambda x: F.size(x).cast("int" if LONG_PIECE >= 1 << 15 else "smallint")).alias("counts"), F.flatten("own").alias("ids"))
    tops = runs.select("run", "doc_ids", "sizes", "numbers", "places")
    schema = RESULT if contents else RESULT.split(", ids ")[0]
    return tops.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_assembled(shared, _names(schema), constants.shift), schema)
