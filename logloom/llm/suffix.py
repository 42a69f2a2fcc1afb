"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes when a string of `length` bytes that covers it also starts anywhere else. Where such strings can lie is found first, without loss: every window of `length` bytes has an anchor, the `anchor`-byte string in it with the least hash, and equal windows have equal anchors at the same place. The windows that share one occurrence of an anchor make a segment, known by the anchor's and its own hash, 64 bits each.

- A segment that occurs twice is repeated as a whole: equal hashes decide that, its bytes aren't compared. One whose anchor occurs nowhere else isn't repeated at all.
- The segments in question have an anchor with company but differ from it. Their bytes go to the tasks by anchor, one copy of each, with the anchor itself as a single symbol. Each task cuts them into shards, sorts each shard's suffixes into a Burrows-Wheeler transform, and merges all shards by refining their interleave: a round takes every entry to the suffix that begins one symbol earlier (last-to-first mapping) and deals the entries stably by that symbol. After r rounds entries lie in the order of their first r symbols, and the places where neighbours part in round r are those where the common prefix has r-1 symbols. Entries alone in their block are settled and leave. The blocks left after `length` bytes are the repeated intervals.
- An anchor with many segments is split further, by the bytes that all of a few neighbouring windows share, at last by the windows themselves.

The same search runs over words (runs without ASCII white space) for passages of PASSAGE words that another document has too: nothing is removed for them, their words are counted. A passage can have many words and fewer than `length` bytes.

A null text counts as empty; a text shorter than `length` loses nothing. Rows are known by id and text: a null id, or an id that repeats with several texts, has its own result for each row, and rows that repeat both have the same. For passages, rows of one id and text are one document. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, Bloom, boundaries, dropped, lean, mix, ranges, texts, written
from logloom.llm.pieces import powers, slice_hashes

LENGTH = 400
ANCHOR = 256
#: Words of a passage, and of its anchor.
PASSAGE = 51
WORD_ANCHOR = 8
BYTES, WORDS = 0, 1
#: Symbols looked at together; positions among them take 22 bits. A longer text is cut into overlapping spans.
SPAN = 1 << 18
#: Symbols in a shard, and in what a task merges at once unless one anchor alone has more.
SHARD = 1 << 16
MERGE = 1 << 18
#: From so many different segments on, an anchor is split by blocks of SPLIT windows, then by single windows.
CROWD = (256, 1 << 16)
SPLIT = 16
#: Blocks that the windows of a string are compared in before it is merged.
PARTS = 8

_GEAR = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOW = U64((1 << 22) - 1)
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of a text."""
    out, at = [np.zeros(0, U64)], 0
    while at < len(data):
        end = min(at + SPAN, len(data))
        while end < len(data) and not _WHITE[data[end]]:  # no word is cut
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate(([False], ~_WHITE[b], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        out.append(slice_hashes(b.astype(U64), edge[::2], edge[1::2]))
        at = end
    return np.concatenate(out)


def words_of(texts_: list[bytes]) -> list[np.ndarray]:
    """The same for many texts at once."""
    own, at = [], 0
    while at < len(texts_):
        size, end = len(texts_[at]), at + 1
        while end < len(texts_) and size + len(texts_[end]) < SPAN:
            size, end = size + len(texts_[end]) + 1, end + 1
        some = texts_[at:end]
        if len(some) == 1:
            own.append(word_hashes(some[0]))
        else:
            b = np.frombuffer(b" ".join(some), np.uint8)
            inside = np.concatenate(([False], ~_WHITE[b], [False]))
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            ends = np.cumsum([len(t) + 1 for t in some])
            own += np.split(slice_hashes(b.astype(U64), edge[::2], edge[1::2]), np.searchsorted(edge[::2], ends[:-1]))
        at = end
    return own


def segments(values: list[np.ndarray], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, own hash, first window, number of windows, anchor's place) of each segment of texts, lists of 64-bit symbols."""
    out: list[tuple] = []
    some: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, v in enumerate(values):
        for at in range(0, len(v) - length + 1, SPAN):
            x = v[at : at + SPAN + length - 1]
            if size + len(x) > SPAN and some:
                out.append(_segments(some, length, anchor))
                some, size = [], 0
            some.append((i, at, x))
            size += len(x)
    if some:
        out.append(_segments(some, length, anchor))
    kinds = (np.int64, U64, U64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, k) for k in kinds)


def _segments(some: list[tuple[int, int, np.ndarray]], length: int, anchor: int):
    v = np.concatenate([x for _, _, x in some])
    sizes = np.array([len(x) for _, _, x in some], np.int64)
    ends = np.cumsum(sizes)
    m = len(v) - anchor + 1
    up, down = powers(len(v) + 1)
    total = np.zeros(len(v) + 1, U64)  # sums of symbols times powers of an odd number: a slice's hash is a difference, turned back to its start
    np.cumsum(v * up[:-1], out=total[1:])
    hashed = mix((total[anchor:] - total[:m]) * down[:m])
    key = hashed & ~_LOW | np.arange(m, dtype=U64)
    width, wanted = 1, length - anchor + 1
    while width * 2 <= wanted:
        key, width = np.minimum(key[:-width], key[width:]), width * 2
    if wanted > width:
        key = np.minimum(key[: len(key) - (wanted - width)], key[wanted - width :])
    # windows that end in the text they begin in
    start = np.flatnonzero(np.arange(len(key)) + length <= np.repeat(ends, sizes)[: len(key)])
    place = (key[start] & _LOW).astype(np.int64)
    new = boundaries(place)
    count = np.diff(np.append(new, len(place)))
    first, place = start[new], place[new]
    span = np.searchsorted(ends, first, side="right")
    text, at = np.array([i for i, _, _ in some])[span], np.array([a for _, a, _ in some])[span] - (ends - sizes)[span]
    end = first + count + length - 1
    own = mix(mix((total[end] - total[first]) * down[first]) + (end - first).astype(U64))
    return text, hashed[place], own, first + at, count, place + at


_SEGMENT = "id long, key long, unit byte, h long, seg long, first long, count int, shift int"


def _found(length: int, anchor: int, passage: int, word_anchor: int):
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def find(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                b = batch.slice(x, 500)
                ids, keys = b.column("id").to_numpy(), b.column("key").to_numpy()
                own = b.column("text").cast(pa.binary()).to_pylist()
                for unit, size, part in ((BYTES, length, anchor), (WORDS, passage, word_anchor)):
                    values = [_GEAR[np.frombuffer(t, np.uint8)] for t in own] if unit == BYTES else words_of(own)
                    text, h, seg, first, count, place = segments(values, size, part)
                    cols = (ids[text], keys[text], np.full(len(text), unit, np.int8), h.view(np.int64), seg.view(np.int64), first, count, place - first)
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return find


# ---------------------------------------------------------------- shards, transforms, their merge


def _ranks(x: np.ndarray) -> np.ndarray:
    """Places of numbers among the different ones."""
    low, room = (int(x.min()), int(x.max()) - int(x.min()) + 1) if len(x) else (0, 0)
    if room > 8 * len(x) + 256:
        return np.unique(x, return_inverse=True)[1].astype(np.int64)
    there = np.zeros(room, bool)
    there[x - low] = True
    return (np.cumsum(there) - 1)[x - low]


class Shard:
    """Strings of symbols (int64 arrays) with their suffixes sorted, to `depth` symbols, and the transform of that order."""

    def __init__(self, strings: list[np.ndarray], depth: int):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.text = np.concatenate(strings) if strings else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        self.first = ends - sizes
        self.inside = np.arange(len(self.text)) - np.repeat(self.first, sizes)  # symbols from the string's start
        n = len(self.text)
        left = np.repeat(ends, sizes) - np.arange(n)  # symbols up to the string's end
        # prefix doubling over strings that end differently: a suffix that runs into its end has a rank of its own
        rank = _ranks(self.text)
        done, order = 1, None

        def ranked(key: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
            order = np.argsort(key)
            at = key[order]
            new = alone[order]
            new[:1], new[1:] = True, new[1:] | (at[1:] != at[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            return order, rank, bool(new.all())

        settled = False
        room = int(rank.max(initial=0)) + 2
        many = min(depth, int(62 // np.log2(room)))
        if many > 1 and n:  # the first symbols as one number; nothing beyond a string's end, where each suffix is another
            key = rank + 1
            for i in range(1, many):
                key = key * room + np.where(left > i, np.concatenate((rank[i:], np.zeros(i, np.int64)))[:n] + 1, 0)
            (order, rank, settled), done = ranked(key, left < many), many
        while done < depth and not settled:
            step = min(done, depth - done)
            inside = left > step
            second = np.where(inside, np.concatenate((rank[step:], np.zeros(step, np.int64)))[:n], -1 - np.arange(n))
            order, rank, settled = ranked(rank * (2 * n + 1) + second + n, np.zeros(n, bool))
            done += step
        self.suffixes = np.argsort(rank) if order is None else order
        row = np.empty(n, np.int64)
        row[self.suffixes] = np.arange(n)
        before = self.suffixes - 1
        at_start = self.inside[self.suffixes] == 0
        self.bwt = np.where(at_start, -1, self.text[before])  # the symbol before each suffix; -1 at a string's start
        self.last_to_first = np.where(at_start, -1, row[before])


def _strides(shards: list[Shard], depth: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(k, the k symbols before each entry as one number below 2^16, the entry k symbols before it or -1): several refinements in one."""
    offset = np.cumsum([0, *(len(s.text) for s in shards)])
    one = np.concatenate([np.where(s.last_to_first < 0, -1, s.last_to_first + o) for s, o in zip(shards, offset[:-1], strict=True)])
    single = _ranks(np.concatenate([s.bwt for s in shards]))
    k, symbol, before = 1, single, one
    while k < min(8, depth - 1):
        far = np.where(before < 0, -1, one[before])
        wider = _ranks(symbol * (single.max() + 1) + np.where(before < 0, 0, single[before]))
        if wider.max(initial=0) >= 1 << 16:
            break
        k, symbol, before = k + 1, wider, far
    return k, symbol.astype(np.uint16 if symbol.max(initial=0) < 1 << 16 else np.int64), before  # numpy deals 16-bit keys by radix


def repeated_intervals(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries (numbered through the shards) and their blocks: the suffixes that share their first `depth` symbols with another one.

    The entries start in the shards' order, dealt by their first symbol. A round deals them by the k symbols before each. Only those that end a window of `depth` symbols begin, since the others would run over their string's start; each gets to the window's start in the last round.
    """
    k, symbols, lf = _strides(shards, depth)
    entry = np.flatnonzero(np.concatenate([s.inside[s.suffixes] >= depth - 1 for s in shards]))
    head = _ranks(np.concatenate([s.text[s.suffixes] for s in shards])[entry])
    head = head.astype(np.uint16 if head.max(initial=0) < 1 << 16 else np.int64)
    block = np.zeros(len(head), np.int64)
    for symbol, step in [(head, 1)] + [(None, 1)] * ((depth - 1) % k) + [(None, k)] * ((depth - 1) // k):
        if symbol is None:
            key, before = (symbols, lf) if step == k else _strides(shards, 2)[1:]
            symbol, to = key[entry], before[entry]
        else:
            to = entry
        order = np.argsort(symbol, kind="stable")
        symbol, source, entry = symbol[order], block[order], to[order]
        new = np.ones(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1])
        lone = new.copy()
        lone[:-1] &= new[1:]
        block = np.cumsum(new)[~lone]
        entry = entry[~lone]
    return entry, block


def repeats(strings: list[tuple[np.ndarray, int, bool, int]], depth: int, across: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """strings: (symbols, number of windows of `depth` symbols, whether others are equal, owner). Runs of windows that start elsewhere too, as (string, first window, number); across: in a string of another owner."""
    shards, part, size = [], [], 0
    for i, (s, *_) in enumerate(strings):
        part.append(s)
        size += len(s)
        if size >= SHARD or i == len(strings) - 1:
            shards.append(Shard(part, depth))
            part, size = [], 0
    sizes = np.array([len(s) for s, *_ in strings], np.int64)
    origin = np.repeat(np.arange(len(strings)), sizes)
    inside = np.arange(len(origin)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.concatenate([s.suffixes + o for s, o in zip(shards, np.concatenate(([0], np.cumsum([len(s.text) for s in shards])))[:-1], strict=True)])
    entry, block = repeated_intervals(shards, depth)
    place = at[entry]
    windows = np.array([n for _, n, _, _ in strings], np.int64)
    ends = np.cumsum(windows)
    out = np.repeat(np.array([equal for _, _, equal, _ in strings], bool), windows)
    if across and len(place):
        owner = np.array([o for *_, o in strings], np.int64)[origin[place]]
        equal = np.array([e for _, _, e, _ in strings])[origin[place]]
        first = boundaries(block)
        mixed = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) | np.logical_or.reduceat(equal, first)
        place = place[np.repeat(mixed, np.diff(np.append(first, len(block))))]
    own = origin[place]
    out[(ends - windows)[own] + inside[place]] = True
    # a gap after each string ends its runs
    first = ends - windows + np.arange(len(strings))
    marks = np.zeros(len(out) + len(strings) + 1, np.int8)
    marks[np.arange(len(out)) + np.repeat(np.arange(len(strings)), windows) + 1] = out
    edge = np.diff(marks)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(first, begin, side="right") - 1
    return of, begin - first[of], end - begin


# ---------------------------------------------------------------- the operator


def _asked(sizes: dict[int, tuple[int, int]], crowd: tuple[int, int], split: int):
    """Documents with the segments in question to strings, in the columns of _STRING; a word is eight bytes. sizes: length and anchor of each unit."""

    def ask(batches):
        for b in batches:
            rows = []
            for t, asked in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("asked").to_pylist(), strict=True):
                words = word_hashes(t).tobytes() if any(q["unit"] == WORDS for q in asked or ()) else b""
                for q in asked or ():
                    unit, (length, anchor) = q["unit"], sizes[q["unit"]]
                    data, w = (t, 1) if unit == BYTES else (words, 8)
                    cut = lambda x, y: data[x * w : y * w]  # noqa: B023, E731
                    first, count, place = q["first"], q["count"], q["first"] + q["shift"]
                    known = (unit, q["h"], q["seg"], q["equal"], q["owner"])
                    size = 0 if q["variants"] < crowd[0] else split if q["variants"] < crowd[1] else 1
                    if not size:
                        rows.append((q["h"], *known, 0, count, cut(first, place), cut(place + anchor, first + count + length - 1), length - anchor + 1))
                        continue
                    # windows start at place - d, d from 0 on; those of a block share the symbols between its last start and its first end
                    for blk in range((place - first - count + 1) // size, (place - first) // size + 1):
                        lo, hi = max(first, place - blk * size - size + 1), min(first + count - 1, place - blk * size)
                        core, end = place - blk * size, place - blk * size - size + 1 + length
                        key = xxhash.xxh3_64_intdigest(cut(core, end), q["h"] + blk & (1 << 64) - 1) - (1 << 63)
                        rows.append((key, *known, lo - first, hi - lo + 1, cut(lo, core), cut(end, hi + length), length - (end - core) + 1))
            kinds = [pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=_names(_STRING))

    return ask


_STRING = "key long, unit byte, h long, seg long, equal boolean, owner long, from int, windows int, left binary, right binary, depth int"
_ANSWER = "unit byte, h long, seg long, from int, windows int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _thinned(rows: list[dict]) -> list[dict]:
    """Strings of one unit and depth, cut to the windows that another one of the same key can have, without loss.

    Equal windows have their anchor at the same place. Neighbouring windows make a block, by places that are the same for all strings; what the windows of a block share must be in another string too, else the block goes (by a hash: a collision only leaves more). A string keeps what lies between its first and last block that is left.
    """
    w, depth = 1 if rows[0]["unit"] == BYTES else 8, rows[0]["depth"]
    size = -(-depth // PARTS)
    met: dict[int, int] = {}
    known = []
    for r in rows:
        key, left, right = r["key"], r["left"], r["right"]
        n = len(left) // w  # a window starts so many symbols before the anchor, or fewer
        own = [(at, hash((key, at, left[len(left) - at * w :], right[: max(depth - size - at, 0) * w]))) for at in range((n - r["windows"] + 1) // size * size, n + 1, size)]
        known.append(own)
        for _, h in own:
            met[h] = met.get(h, 0) + 1
    out = []
    for r, own in zip(rows, known, strict=True):
        kept = [at for at, h in own if met[h] > 1]
        if kept:
            n = len(r["left"]) // w
            least, most = max(n - r["windows"] + 1, kept[0]), min(n, kept[-1] + size - 1)
            out.append({**r, "left": r["left"][(n - most) * w :], "right": r["right"][: (depth - 1 - least) * w], "from": r["from"] + n - most, "windows": most - least + 1})
    return out


def _answered(batches):
    """Sorted by unit, depth and key: strings to the repeated windows of those that aren't repeated as a whole."""

    def answer(rows):
        names: dict[int, int] = {}
        strings = []
        unit, depth = rows[0]["unit"], rows[0]["depth"]
        kind = np.uint8 if unit == BYTES else np.int64
        rows = _thinned(rows)
        for r in rows:
            # an anchor is a symbol of its own: beyond the bytes, or one more word, which no other anchor's strings have
            mark = 256 + names.setdefault(r["key"], len(names)) if unit == BYTES else r["key"]
            s = np.concatenate((np.frombuffer(r["left"], kind).astype(np.int64), [mark], np.frombuffer(r["right"], kind).astype(np.int64)))
            strings.append((s, r["windows"], r["equal"], r["owner"]))
        of, first, windows = repeats(strings, depth, unit == WORDS) if strings else [np.zeros(0, np.int64)] * 3
        part = ~np.array([r["equal"] for r in rows], bool)[of]
        of, first, windows = of[part], first[part], windows[part]
        h, seg, start = (np.array([r[c] for r in rows], np.int64)[of] for c in ("h", "seg", "from"))
        kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip((np.full(len(of), unit), h, seg, start + first, windows), kinds, strict=True)], names=_names(_ANSWER))

    rows, size = [], 0
    for b in batches:
        for x in range(0, b.num_rows, 500):
            for r in b.slice(x, 500).to_pylist():
                if rows and ((r["unit"], r["depth"]) != (rows[0]["unit"], rows[0]["depth"]) or size >= MERGE and r["key"] != rows[-1]["key"]):
                    yield answer(rows)
                    rows, size = [], 0
                rows.append(r)
                size += (len(r["left"]) + len(r["right"])) // (1 if r["unit"] == BYTES else 8) + 1
    if rows:
        yield answer(rows)


def _covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) that windows, given as (first, number), cover."""
    out: list[tuple[int, int]] = []
    for first, windows in sorted(spans):
        end = first + windows + length - 1
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, kept binary"


def _removed(length: int, passage: int):
    def remove(batches):
        for b in batches:
            rows = []
            for i, t, spans in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                of = lambda unit: [(s["first"], s["windows"]) for s in spans or () if s["unit"] == unit]  # noqa: B023, E731
                gone = _covered(of(BYTES), length)
                kept = b"".join(t[x:y] for x, y in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(t)], strict=True))
                rows.append((i, len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(e - s for s, e in _covered(of(WORDS), passage)), kept))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=_names(_RESULT))

    return remove


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, crowd: tuple[int, int] = CROWD, split: int = SPLIT, passage: int = PASSAGE, word_anchor: int = WORD_ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (words in runs of `passage` words that another document has) and kept (the bytes that stay) for each row."""
    rows = texts(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("key"), "text")
    found = written(rows.select("id", "key", "text").mapInArrow(lean(_found(length, anchor, passage, word_anchor)), _SEGMENT), "suffix-found")
    same = ["unit", "h", "seg"]
    owner = F.xxhash64("id", "key")
    # one occurrence stands for equal ones, that of the least hash; numbers only, so that they are summed by hash before the shuffle
    mark = F.xxhash64("id", "key", "first")
    one = [F.min_by(c, mark).alias(c) for c in ("id", "key", "first")]
    copies = found.groupBy(*same).agg(F.count("*").alias("copies"), F.min(owner).alias("owner"), F.max(owner).alias("last"), *one, F.min("count").alias("count"), F.min("shift").alias("shift"))
    equal = F.when(F.col("unit") == BYTES, F.col("copies") > 1).otherwise(F.col("owner") != F.col("last"))
    copies = written(copies.select(*same, equal.alias("equal"), "owner", "last", "id", "key", "first", "count", "shift"), "suffix-copies")
    crowds = copies.groupBy("unit", "h").agg(F.count("*").alias("variants"), F.min("owner").alias("lo"), F.max("last").alias("hi"))
    # a passage needs another document
    crowds = crowds.where((F.col("variants") > 1) & ((F.col("unit") == BYTES) | (F.col("lo") != F.col("hi")))).select("unit", "h", "variants")
    company = copies.drop("last").join(crowds, ["unit", "h"], "left").where("equal or variants is not null")
    company = written(company.withColumn("variants", F.coalesce("variants", F.lit(1))), "suffix-company")

    dropped(copies)  # the largest table beside found
    asked = company.where("variants > 1").groupBy("id", "key").agg(F.collect_list(F.struct(*same, "first", "count", "shift", "equal", "owner", "variants")).alias("asked"))
    asked = written(asked, "suffix-asked")
    some = Bloom(asked.select("key"), "key").may_have(rows.select("id", "key", "text"), "key")
    sizes = {BYTES: (length, anchor), WORDS: (passage, word_anchor)}
    strings = some.join(asked, ["id", "key"]).select("text", "asked").mapInArrow(lean(_asked(sizes, crowd, split)), _STRING)
    order = ("unit", "depth", "key")
    answers = strings.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).mapInArrow(lean(_answered), _ANSWER)
    verdicts = written(answers.distinct().union(company.where("equal").select(*same, F.lit(0).alias("from"), F.col("count").alias("windows"))), "suffix-verdicts")

    spans = found.join(verdicts, same).select("id", "key", "unit", (F.col("first") + F.col("from")).alias("first"), F.col("windows").cast("long").alias("windows"))
    spans = written(spans.distinct().groupBy("id", "key").agg(F.collect_list(F.struct("unit", "first", "windows")).alias("spans")), "suffix-spans")
    touched = Bloom(spans.select("key"), "key")
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    cut = touched.may_have(rows, "key").join(spans, ["id", "key"], "left").select("doc_id", "text", "spans")
    rest = touched.cannot_have(rows, "key").select("doc_id", "text", none.alias("spans"))
    return cut.union(rest).mapInArrow(lean(_removed(length, passage)), _RESULT)
