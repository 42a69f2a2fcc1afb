"""Sequence packing by Karmarkar-Karp multiway differencing.

Each task walks its own documents once: it encodes them, cuts off whole sequences, and gathers what is left of the documents into blocks. A block is packed by differencing: at first each piece is a partition of its own, with one full window and k-1 empty ones; the two partitions of largest spread are merged, the fullest window of one with the emptiest of the other, until one partition is left. If a window exceeds the capacity, k rises by one and the block is packed anew. Nothing is shuffled and no group grows with the data; a block is bounded by a number of pieces.

Null texts count as empty; an empty document is the end id alone. A null id stays null on its pieces. A long text is encoded in portions and cut like any other; an empty table gives no rows. Rows that repeat an id or a text are packed row by row. Other columns are ignored. Windows of a block have near-equal lengths, and k starts at the least number that can hold them; a rest of more than half a window is cut in two, so that differencing has enough pieces.
"""

from __future__ import annotations

import functools
import heapq
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logloom.llm.common import lean, ranges, texts
from logloom.llm.pieces import SPACE, Points, WordEndBpe, bare_starts, portions, sliced

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces in a block.
BLOCK = 512
#: A rest is cut into pieces of at most this share of a window: the finer, the nearer to equal the windows become, and the more documents are cut.
FINE = 2

#: Characters that are encoded together, and distinct pieces that are merged together.
CHARS = 3 << 20
PIECES_AT_ONCE = 1 << 14
#: Longer pieces are merged by the library, since a round here merges one pair of a piece.
LONG = 512

#: The characters below U+0250 whose small letter is one character in every library; texts of these and ASCII's white space are plain.
_PLAIN = re.compile("[\\t-\\r -~\\xa1-\\xac\\xae-\\u012f\\u0131-\\u024f]*")


class WordTokenizer:
    """ids of texts by a tokenizers file that lowers letters and drops white space. Plain texts are cut and merged together, each distinct piece of a call once; others go through the library, which is loaded when it is needed. Nothing is kept between calls."""

    def __init__(self, path: str):
        self.path, self.words = path, WordEndBpe(path)
        #: Texts that contain one of these, in any case, are encoded by the library.
        self.added = [t.lower() for t in self.words.added]

    @functools.cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def plain(self, text: str, low: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and unicodedata.is_normalized("NFC", text) and not any(a in low for a in self.added)

    def _ids(self, low: list[str]):
        """The ids of each text, in order. What is held at once, beside the texts, is their distinct pieces and eight bytes a piece."""
        found, white, sizes, done = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], 0
        for some in portions(low):
            points = Points(some)
            at = np.flatnonzero(bare_starts(points)) if len(points.cp) else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(points.byte_sizes(), dtype=np.int32)))
            found.append(ends[at] + done)
            white.append(points.kind[at] == SPACE)
            sizes.append(np.bincount(np.searchsorted(points.ends, at, side="right"), minlength=len(some)))
            done += int(ends[-1])
            del points, at, ends
        known = sliced("".join(low).encode(), np.append(np.concatenate(found), done)).dictionary_encode()
        del found
        place, distinct = known.indices.to_numpy() if len(known) else np.zeros(0, np.int32), known.dictionary
        blank = np.zeros(len(distinct), bool)
        blank[place] = np.concatenate(white)
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64)
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
        counts, first = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        long = ~blank & (np.diff(offsets) > LONG)
        own, parts, total = np.flatnonzero(~blank & ~long), [np.zeros(0, np.uint32)], 0
        for x in range(0, len(own), PIECES_AT_ONCE):
            some = own[x : x + PIECES_AT_ONCE]
            ids, counts[some] = self.words.encode(data, offsets[some], offsets[some + 1])
            first[some] = total + np.cumsum(counts[some]) - counts[some]
            parts.append(ids.astype(np.uint32))
            total += len(ids)
        for i in np.flatnonzero(long).tolist():
            parts.append(self._whole(distinct[i].as_py().decode()))
            first[i], counts[i] = total, len(parts[-1])
            total += counts[i]
        ids = np.concatenate(parts)
        ends = np.cumsum(np.concatenate(sizes))
        x = y = 0
        while x < len(low):
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + (1 << 18), side="right")))
            some = place[ends[x - 1] if x else 0 : ends[y - 1]]
            total = np.concatenate(([0], np.cumsum(counts[some])))
            flat = ids[ranges(first[some], counts[some])]
            yield from np.split(flat, total[ends[x : y - 1] - (ends[x - 1] if x else 0)])
            x = y

    def batch(self, texts_: list[str]):
        """One array for each text."""
        low = [t.lower() for t in texts_]
        plain = [self.plain(t, x) for t, x in zip(texts_, low, strict=True)]
        own = self._ids([x for x, ok in zip(low, plain, strict=True) if ok])
        del low
        for t, ok in zip(texts_, plain, strict=True):
            yield next(own) if ok else self._whole(t)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def chunked(batches, most: int = CHARS):
    """(ids, texts) of documents, of `most` characters together unless one alone has more."""
    ids: list = []
    texts_: list[str] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if size + len(t) > most and ids:
                yield ids, texts_
                ids, texts_, size = [], [], 0
            ids.append(i)
            texts_.append(t)
            size += len(t)
    if ids:
        yield ids, texts_


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in k windows with near-equal sums, by Karmarkar-Karp multiway differencing; ties go to the earlier piece.

    A partition holds its windows that aren't empty, the fullest first, each as (-sum, node); a node beyond the pieces joins two others.
    """
    nodes: list[tuple[int, int]] = []
    heap = [(-s, i, [(-s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k  # so many windows of each meet one of the other that isn't empty
        if over > 0:
            both = a[: len(a) - over] + b[: len(b) - over]
            for (s, x), (t, y) in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True):
                both.append((s + t, n + len(nodes)))
                nodes.append((x, y))
        else:
            both = a + b
        both.sort()
        heapq.heappush(heap, (both[0][0] - (both[-1][0] if len(both) == k else 0), order, both))
        order += 1
    windows = []
    for _, node in heap[0][2] if heap else []:
        todo, pieces = [node], []
        while todo:
            x = todo.pop()
            if x < n:
                pieces.append(x)
            else:
                todo += nodes[x - n]
        windows.append(pieces)
    return windows


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """pieces: (document, start, length); windows of pieces, none longer than the capacity."""
    if not pieces:
        return []
    k = max(1, -(-sum(p[2] for p in pieces) // capacity))
    while True:
        windows = difference([p[2] for p in pieces], k)
        if all(sum(pieces[i][2] for i in w) <= capacity for w in windows):
            return [[pieces[i] for i in sorted(w)] for w in windows]
        k += 1


def _cut(start: int, length: int, most: int) -> list[tuple[int, int]]:
    n = -(-length // most)
    at = [start + length * i // n for i in range(n + 1)]
    return [(x, y - x) for x, y in zip(at[:-1], at[1:], strict=True)]


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each piece of a document: where it starts and how long it is, and its place in a sequence."""

    def run(batches):
        tokenizer = WordTokenizer(tokenizer_path)
        part = TaskContext.get().partitionId()
        number = 0
        names = [x.split()[0] for x in PIECES.split(", ")]
        out: list[tuple] = []
        rest: list[tuple[int, int, int]] = []
        held: dict[int, tuple[int, np.ndarray]] = {}

        def put(windows, of):
            nonlocal number
            for w in windows:
                at = 0
                for d, start, length in w:
                    i, ids = of[d]
                    out.append((i, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), (part << 33) | number, at))
                    at += length
                number += 1

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        count = 0
        for own, texts_ in chunked(batches):
            for i, ids in zip(own, tokenizer.batch(texts_), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                count += 1
                full = len(ids) // capacity * capacity
                put([[(count, s, capacity)] for s in range(0, full, capacity)], {count: (i, ids)})
                if full < len(ids):
                    held[count] = (i, ids)
                    rest += [(count, s, n) for s, n in _cut(full, len(ids) - full, max(1, capacity // FINE))]
                if len(rest) >= block:
                    put(pack(rest, capacity), held)
                    rest, held = [], {}
                if len(out) > 4096:
                    yield flush()
        put(pack(rest, capacity), held)
        yield flush()

    return texts(docs, id_col, text_col).mapInArrow(lean(run), PIECES)
