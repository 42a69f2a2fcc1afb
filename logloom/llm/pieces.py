"""Texts to pieces and pieces to ids, many at once in numpy arrays: classes of characters, cuts between pieces, hashes of slices, and merges of byte pairs.

Nothing here learns or remembers words: a call's memory is that of the texts it gets.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import regex

from logloom.llm.common import U64, mix, ranges

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The code points of Unicode's White_Space, and the endings that stay with an apostrophe.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, a megabyte."""
    out = np.zeros(0x110000, np.uint8)
    for first, end in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(first, end)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{WHITE}]+")):
            for m in regex.finditer(pattern, every):
                out[first + m.start() : first + m.end()] = kind
    return out


class Points:
    """The code points of texts, joined; where each text begins; their classes, and those of their neighbours within a text (SPACE + 1 beyond it)."""

    def __init__(self, texts: list[str]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum(self.sizes)
        self.firsts = self.ends - self.sizes
        n = len(self.cp)
        self.kind = classes()[self.cp]
        self.begins = np.zeros(n + 1, bool)
        self.begins[self.firsts] = True
        self.begins = self.begins[:n]
        self.before = np.empty(n, np.uint8)
        self.before[1:] = self.kind[:-1]
        self.before[self.begins] = SPACE + 1
        self.after = np.empty(n, np.uint8)
        self.after[:-1] = self.kind[1:]
        self.after[self.ends[self.sizes > 0] - 1] = SPACE + 1

    def byte_sizes(self) -> np.ndarray:
        return (1 + (self.cp > 0x7F) + (self.cp > 0x7FF) + (self.cp > 0xFFFF).astype(np.int8)).astype(np.int8)

    def keep_endings(self, start: np.ndarray) -> None:
        """An apostrophe that begins a piece takes one of ENDINGS from the letters after it."""
        at = np.flatnonzero((self.cp == 0x27) & start & (self.after == LETTER))
        if not len(at):
            return
        n = len(self.cp)
        near = lambda k: np.where(at + k < n, self.cp[np.minimum(at + k, n - 1)], 0)
        length = np.zeros(len(at), np.int64)
        for e in ENDINGS:
            hit = near(1) == ord(e[0])
            if len(e) > 1:
                second = np.minimum(at + 2, n - 1)
                hit &= (near(2) == ord(e[1])) & ~self.begins[second]
            length = np.where((length == 0) & hit, len(e), length)
        at, length = at[length > 0], length[length > 0]
        start[at + 1] = False
        rest = at + 1 + length
        start[rest[rest < n]] = True


def spaced_starts(p: Points) -> np.ndarray:
    """Where pieces begin that take a single space before them along: runs of letters, numbers or other marks, and runs of white space but for what the next piece takes."""
    white = p.kind == SPACE
    start = p.begins | (white & (p.before != SPACE)) | (white & (p.after < SPACE))
    led = np.zeros(len(p.cp), bool)
    led[1:] = p.cp[:-1] == 0x20
    led &= ~p.begins
    start |= ~white & (p.kind != p.before) & ~led
    p.keep_endings(start)
    return start


def portions(texts: list[str], most: int = 1 << 20):
    """The texts by lists of `most` characters together, unless one alone has more."""
    own, size = [], 0
    for t in texts:
        if size + len(t) > most and own:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def starts(texts: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(where pieces begin, number of pieces of each text), in bytes of the joined texts; a last element has their length. The pieces are the matches of the pattern, which must leave nothing out."""
    if pattern == SPACED:
        found, sizes, done = [np.zeros(0, np.int64)], [], 0
        for some in portions(texts):
            points = Points(some)
            if len(points.cp):
                at = np.flatnonzero(spaced_starts(points))
                ends = np.concatenate(([0], np.cumsum(points.byte_sizes(), dtype=np.int64)))
                found.append(ends[at] + done)
                done += int(ends[-1])
                sizes.append(np.bincount(np.searchsorted(points.ends, at, side="right"), minlength=len(some)))
            else:
                sizes.append(np.zeros(len(some), np.int64))
        return np.append(np.concatenate(found), done), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    white = pattern.replace("[^\\s", "[^" + WHITE).replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")
    found = [regex.findall(white, t) for t in texts]
    if any(len("".join(f)) != len(t) for f, t in zip(found, texts, strict=True)):
        raise ValueError("the pattern leaves characters out")
    return np.cumsum([0, *(len(x.encode()) for f in found for x in f)]), np.array([len(f) for f in found], np.int64)


def bare_starts(p: Points) -> np.ndarray:
    """Where pieces begin that have no white space: runs of letters, single numbers, runs of other marks; white space is a piece to be dropped."""
    start = p.begins | (p.kind != p.before) | (p.kind == NUMBER)
    p.keep_endings(start)
    return start


# ---------------------------------------------------------------- hashes of slices

_ODD = 0xD1342543DE82EF95


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.concatenate((np.ones(1, U64), np.full(size - 1, base, U64))))
    return _POWERS[0][:n], _POWERS[1][:n]


def slice_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice of 64-bit values: a polynomial in an odd number, mixed with the length."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(mix(values + U64(seed)) * up[:-1], out=total[1:])
    return mix(mix((total[end] - total[start]) * down[start]) + (end - start).astype(U64))


def string_hashes(data: np.ndarray, bounds: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """A hash of each of adjacent strings of bytes; at most so many bytes at once, unless one string has more."""
    out, x = [np.zeros(0, U64)], 0
    while x < len(bounds) - 1:
        y = max(x + 1, int(np.searchsorted(bounds, bounds[x] + most, side="right")) - 1)
        own = bounds[x : y + 1] - bounds[x]
        out.append(slice_hashes(data[bounds[x] : bounds[y]].astype(U64), own[:-1], own[1:]))
        x = y
    return np.concatenate(out)


# ---------------------------------------------------------------- merges of byte pairs


class PairTable:
    """(left id, right id) -> rank, for arrays of pairs: open tables one after the other, each for what the ones before had no room for."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        key, self.levels = (left.astype(U64) << U64(32)) | right.astype(U64), []
        rank, odd = rank.astype(np.int32), 0x9E3779B97F4A7C15
        while len(key):
            bits = max(4, int(2 * len(key)).bit_length())
            at = (key * U64(odd) >> U64(64 - bits)).astype(np.int64)
            keys, ranks = np.full(1 << bits, (1 << 64) - 1, U64), np.zeros(1 << bits, np.int32)
            keys[at], ranks[at] = key, rank
            self.levels.append((U64(odd), U64(64 - bits), keys, ranks))
            out = keys[at] != key
            key, rank = key[out], rank[out]
            odd = odd * 0xBF58476D1CE4E5B9 + 2 & (1 << 64) - 1 | 1

    def get(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        key = (left.astype(U64) << U64(32)) | right.astype(U64)
        out = np.full(len(key), none, np.int32)
        for odd, shift, keys, ranks in self.levels:
            at = (key * odd >> shift).astype(np.int64)
            hit = keys[at] == key
            out[hit] = ranks[at[hit]]
        return out


NONE = 0x7FFFFFFF


def merged(symbols: np.ndarray, sizes: np.ndarray, pairs: PairTable, results: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of many pieces: again and again each piece's leftmost pair of least rank becomes results[rank]. symbols: their first ids, joined; sizes: at least 1 each."""
    n = len(sizes)
    piece = np.repeat(np.arange(n), sizes)
    sym = symbols.astype(np.int32)
    out_ids, out_piece = [], []

    def ranked(left_at):
        """Ranks of the pairs that begin at these places; none where the next symbol is of another piece."""
        r = np.full(len(left_at), NONE, np.int32)
        ok = left_at + 1 < len(sym)
        ok[ok] = piece[left_at[ok]] == piece[left_at[ok] + 1]
        at = left_at[ok]
        r[ok] = pairs.get(sym[at], sym[at + 1], NONE)
        return r

    rank = ranked(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        least = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(sym)))
        done = least == NONE
        if done.any():
            gone = np.repeat(done, size)
            out_ids.append(sym[gone])
            out_piece.append(piece[gone])
            sym, piece, rank = sym[~gone], piece[~gone], rank[~gone]
            least, size = least[~done], size[~done]
            if not len(sym):
                break
            first = np.cumsum(size) - size
        # the leftmost place of the least rank, one in each piece
        hit = np.flatnonzero(rank == np.repeat(least, size))
        owner = piece[hit]
        at = hit[np.concatenate(([True], owner[1:] != owner[:-1]))]
        sym[at] = results[rank[at]]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        at = at - np.arange(len(at))  # one symbol of each piece before is gone
        sym, piece, rank = sym[stay], piece[stay], rank[stay]
        before = at[at > 0] - 1
        for x in (at, before):
            rank[x] = ranked(x)
    ids, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_ids, out_piece))
    order = np.argsort(of, kind="stable")
    return ids[order], np.bincount(of, minlength=n)


class WordEndBpe:
    """The merges of a tokenizers file whose words end with a suffix and whose alphabet stands for bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.added = [t["content"] for t in whole["added_tokens"]]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        del model, whole
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs = PairTable(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]), np.arange(len(pairs)))
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of slices of bytes, none empty."""
        sizes = end - start
        at = ranges(start, sizes)
        symbols = self.inner[data[at]]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[end - 1]]
        return merged(symbols, sizes, self.pairs, self.results)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it has a shape, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def sliced(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Adjacent slices of bytes as a binary array over the same memory."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
