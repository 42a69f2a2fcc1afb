"""N-gram Jaccard self-join by grouped prefixes.

1. A document's set: hashes of its distinct five-word shingles. Documents with the same set are one class from then on.
2. Sets are ordered by one order of all shingles: the rare ones by hash, then the frequent ones by count. Which are frequent is counted over all documents' hash-ordered prefixes; any order gives the same result, only the work differs, so at most FREQUENT shingles need to be told apart.
3. Two linked sets share a shingle of their prefixes. Classes with the same size and prefix are one group; the groups that share a shingle form a list, and equal lists are one.
4. A list's groups are expanded to their classes. Pairs are filtered by size and by the distance of their parity bitmaps, which bounds the symmetric difference from below. A first round verifies a spanning forest of each list's remaining pairs; a second one the remaining pairs between classes that no verified link has joined yet. So no link between classes that are still apart is lost, and the pairs of a large group of copies are never all made. A list of many classes is dealt out as pairs of blocks.
5. Verification counts the shingles two texts share. Links become components by label propagation.
6. All links, where they are asked for: they lie within components, so a component's classes are dealt out as pairs of blocks, and each pair of classes that passes the filters of 4 is verified in the one pair of blocks that has it. Numbers of links are summed there, without a row for each link.

The postings travel as packed blobs, a row for each task and bucket of shingles. Sets are of 64-bit hashes of the words' bytes.

A null text counts as empty: no set, no links, a component of its own. With fewer than five words the whole sequence is the one shingle. Rows that repeat an id count as one document with each of their texts; a null id takes no part in links and keeps a null component. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, WordHash, boundaries, by_ids, components, lean, mix, ranges, texts, written

WORDS = 5
#: A shingle in this many prefixes is frequent; at most so many frequent ones are put last, those of the highest counts (16 bytes each).
OFTEN = 16
FREQUENT = 1 << 20
#: Bits of the smallest bitmap; a set of n has at least 2n.
BITMAP = 1024
#: A list of more classes is dealt out as pairs of blocks of half as many.
LIST = 4096
#: All links of a component are verified by pairs of blocks of about this many classes; their sets are held at once.
PART = 256

_ODD = 0x9E3779B97F4A7C15


def shingle_sets(words: WordHash, docs: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (bytes)."""
    split = [d.lower().split() for d in docs]
    sizes = [len(w) for w in split]
    h = words.of([x for w in split for x in w])
    out, at = [], 0
    # all windows of k words at once; those that cross documents are not looked at
    n = max(len(h) - k + 1, 0)
    whole = np.zeros(n, U64)
    for j in range(k):
        whole += h[j : j + n] * U64(pow(_ODD, j + 1, 1 << 64))
    whole = mix(whole)
    for size in sizes:
        if size >= k:
            out.append(np.unique(whole[at : at + size - k + 1]))
        elif size:
            one = np.zeros(1, U64) + U64(size)
            for j in range(size):
                one = mix(one + h[at + j : at + j + 1] + U64(j + 1))
            out.append(one)
        else:
            out.append(np.zeros(0, U64))
        at += size
    return out


def least_overlap(n, m, percent: int = 75):
    """100 * overlap >= percent * union, for sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = 75) -> int:
    return n - -(-percent * n // 100) + 1


class Order:
    """The order of shingles: those that aren't frequent by hash, then the frequent ones by (count, hash)."""

    def __init__(self, frequent: np.ndarray, rank: np.ndarray):
        self.frequent, self.rank = frequent, rank

    def prefix(self, s: np.ndarray, percent: int = 75) -> np.ndarray:
        p = prefix_length(len(s), percent)
        if not len(self.frequent):
            return s[:p]
        at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
        often = self.frequent[at] == s
        if not often.any():
            return s[:p]
        rare = s[~often]
        if len(rare) >= p:
            return rare[:p]
        rest = s[often]
        return np.concatenate((rare, rest[np.argsort(self.rank[at[often]], kind="stable")][: p - len(rare)]))


def bitmap(s: np.ndarray) -> bytes:
    """A parity bit for each class of shingles; folding one of twice the size gives the next smaller one."""
    size = max(BITMAP, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s >> U64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(batches, k):
    """(ids, texts' shingle sets) for slices of Arrow batches (doc_id, text)."""
    words = WordHash()
    for batch in batches:
        for x in range(0, batch.num_rows, 200):
            b = batch.slice(x, 200)
            yield b.column(0), shingle_sets(words, b.column(1).cast(pa.binary()).to_pylist(), k)


def _by_bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes are dealt by their high bits."""
    return ((tokens >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def frequent(rows: DataFrame, buckets: int, k: int = WORDS, percent: int = 75, often: int = OFTEN, most: int = FREQUENT) -> Order:
    """Counts over all documents' hash-ordered prefixes: summed in each task, then by bucket."""

    def counted(batches):
        parts = []

        def put():
            u, n = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return u, np.bincount(n, np.concatenate([p[1] for p in parts]), len(u)).astype(np.int64)

        held = 0
        for _, sets in _sets(batches, k):
            p = [s[: prefix_length(len(s), percent)] for s in sets if len(s)]
            if p:
                t = np.concatenate(p)
                parts.append((t, np.ones(len(t), np.int64)))
                held += len(t)
            if held > 2_000_000 and len(parts) > 1:
                parts = [put()]
                held = 0
        if parts:
            u, n = put()
            b = _by_bucket(u, buckets)
            cut = np.searchsorted(b, np.arange(buckets + 1))
            cols = [(i, u[x:y].tobytes(), n[x:y].astype(np.uint32).tobytes()) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cols], pa.int32()), pa.array([c[1] for c in cols], pa.binary()), pa.array([c[2] for c in cols], pa.binary())], names=["bucket", "tokens", "counts"])

    def summed(key, t):
        u = np.frombuffer(b"".join(t.column("tokens").to_pylist()), U64)
        n = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint32)
        v, at = np.unique(u, return_inverse=True)
        n = np.bincount(at, n, len(v)).astype(np.int64)
        keep = n >= often
        return pa.table({"token": pa.array(v[keep].view(np.int64)), "n": pa.array(n[keep])})

    got = rows.mapInArrow(lean(counted), "bucket int, tokens binary, counts binary").groupBy("bucket").applyInArrow(summed, "token long, n long")
    top = got.orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = top.column("token").to_numpy().view(U64), top.column("n").to_numpy()
    by_hash = np.argsort(token)
    token, n = token[by_hash], n[by_hash]
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(n))
    return Order(token, rank)


def signatures(rows: DataFrame, order, k: int = WORDS, percent: int = 75) -> DataFrame:
    """(doc_id, n, sig, gkey, bits, prefix): the class, the group, the bitmap and the prefix of each document's set."""

    def made(batches):
        o = Order(*order.value)
        for ids, sets in _sets(batches, k):
            n = [len(s) for s in sets]
            sig = [xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63) for s in sets]
            prefix = [o.prefix(s, percent).tobytes() if len(s) else b"" for s in sets]
            group = [xxhash.xxh3_64_intdigest(p, len(s)) - (1 << 63) for p, s in zip(prefix, sets, strict=True)]
            blobs = [pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()), pa.array(prefix, pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(group, pa.int64()), *blobs], names=["doc_id", "n", "sig", "gkey", "bits", "prefix"])

    return rows.mapInArrow(lean(made), "doc_id long, n long, sig long, gkey long, bits binary, prefix binary")


def lists(signed: DataFrame, buckets: int, percent: int = 75) -> DataFrame:
    """(lid, gkey): the groups that share a prefix shingle, two or more of near enough sizes; lists with the same groups are one."""

    def posted(batches):
        tokens, groups, sizes = [], [], []
        for b in batches:
            groups.append(b.column("gkey").to_numpy())
            sizes.append(b.column("n").to_numpy())
            tokens += [np.frombuffer(p, U64) for p in b.column("prefix").to_pylist()]
        if not tokens:
            return
        t = np.concatenate(tokens)
        own = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(x) for x in tokens])
        groups, sizes = np.concatenate(groups), np.concatenate(sizes).astype(np.uint32)
        by = np.argsort(t, kind="stable")
        t, own = t[by], own[by]
        cut = np.searchsorted(_by_bucket(t, buckets), np.arange(buckets + 1))
        pack = zstandard.ZstdCompressor(level=1).compress
        for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            if y > x:
                # within a bucket 32 bits tell shingles apart well enough: a mix-up only makes a candidate
                blob = [(t[x:y] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), groups[own[x:y]].tobytes(), pack(sizes[own[x:y]].tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([c], pa.binary()) for c in blob)], names=["bucket", "tokens", "groups", "sizes"])

    def listed(key, t):
        unpack = zstandard.ZstdDecompressor().decompress
        tok = np.frombuffer(b"".join(t.column("tokens").to_pylist()), np.uint32)
        grp = np.frombuffer(b"".join(t.column("groups").to_pylist()), np.int64)
        size = np.frombuffer(b"".join(map(unpack, t.column("sizes").to_pylist())), np.uint32).astype(np.int64)
        by = np.argsort(tok, kind="stable")
        run = boundaries(tok[by])
        many = np.diff(np.append(run, len(tok))) > 1
        by = by[ranges(run[many], np.diff(np.append(run, len(tok)))[many])]  # shingles that no other row has are gone
        by = by[np.lexsort((grp[by], size[by], tok[by]))]
        tok, grp, size = tok[by], grp[by], size[by]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (grp[1:] != grp[:-1])
        tok, grp, size = tok[new], grp[new], size[new]
        # a list ends where the next group is too large to be linked with the one before
        start = boundaries(tok)
        far = np.ones(len(tok), bool)
        far[1:] = (tok[1:] != tok[:-1]) | (100 * size[:-1] < percent * size[1:])
        start = np.flatnonzero(far)
        length = np.diff(np.append(start, len(tok)))
        seen: dict[int, tuple[int, int]] = {}
        for x, n in zip(start[length > 1].tolist(), length[length > 1].tolist(), strict=True):
            seen.setdefault(xxhash.xxh3_64_intdigest(grp[x : x + n].tobytes()), (x, n))
        lid = np.repeat(np.array(list(seen), U64), [n for _, n in seen.values()]).view(np.int64)
        at = ranges(np.array([x for x, _ in seen.values()], np.int64), np.array([n for _, n in seen.values()], np.int64))
        return pa.table({"lid": pa.array(lid, pa.int64()), "gkey": pa.array(grp[at], pa.int64())})

    found = signed.where("n > 0").select("gkey", "n", "prefix").mapInArrow(lean(posted), "bucket int, tokens binary, groups binary, sizes binary").groupBy("bucket").applyInArrow(listed, "lid long, gkey long")
    return found.distinct()


class _List:
    """The classes of a list, by id."""

    def __init__(self, t: pa.Table, percent: int):
        by = np.argsort(t.column("rep").to_numpy())
        self.rep, self.n, self.percent = t.column("rep").to_numpy()[by], t.column("n").to_numpy()[by], percent
        blobs = t.column("bits").to_pylist()
        maps = [np.frombuffer(blobs[i], U64) for i in by.tolist()]
        self.words = np.array([len(m) for m in maps])
        self.place = np.zeros(len(maps), np.int64)
        self.own, self.half = {}, {}  # by their sizes: the bitmaps, and those folded once
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words == w)
            self.place[at] = np.arange(len(at))
            self.own[w] = np.stack([maps[i] for i in at.tolist()])
            self.half[w] = self.own[w][:, : w // 2] ^ self.own[w][:, w // 2 :]

    def passing(self, i: int) -> np.ndarray:
        """Whether class i may be linked with each class."""
        n, words, at = self.n, int(self.words[i]), int(self.place[i])
        near = np.flatnonzero(100 * np.minimum(n, n[i]) >= self.percent * np.maximum(n, n[i]))
        ok = np.zeros(len(n), bool)
        for other in np.unique(self.words[near]).tolist():
            j = near[self.words[near] == other]
            if other == words:
                apart = self.own[other][self.place[j]] ^ self.own[words][at]
            elif other == 2 * words:
                apart = self.half[other][self.place[j]] ^ self.own[words][at]
            elif words == 2 * other:
                apart = self.own[other][self.place[j]] ^ self.half[words][at]
            else:  # sizes this far apart with other thresholds: no bound
                ok[j] = True
                continue
            ok[j] = np.bitwise_count(apart).sum(axis=1) <= n[j] + n[i] - 2 * least_overlap(n[j], n[i], self.percent)
        return ok


def _candidates(across: bool, percent: int):
    """A list's classes to pairs (a, b): a spanning forest of the pairs that pass, or all those between different components."""

    def pairs(key, t):
        classes = _List(t, percent)
        rep, a, b = classes.rep, [], []
        if across:
            comp = t.column("component").to_numpy()[np.argsort(t.column("rep").to_numpy())]
            if (comp != comp[0]).any():
                for i in range(len(rep) - 1):
                    j = np.flatnonzero(classes.passing(i) & (comp != comp[i]))
                    j = j[j > i]
                    a.append(np.full(len(j), rep[i]))
                    b.append(rep[j])
        else:
            free = np.ones(len(rep), bool)
            while free.any():  # each class joins the first star that it passes for
                i = int(free.argmax())
                free[i] = False
                j = np.flatnonzero(classes.passing(i) & free)
                free[j] = False
                a.append(np.full(len(j), rep[i]))
                b.append(rep[j])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": cat(a), "b": cat(b)})

    return pairs


def verified(docs: DataFrame, pairs: DataFrame, k: int = WORDS, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of ids whose texts' sets are linked, with the number of shingles they share. docs: (doc_id, text)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def packed(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            blobs = [press(x) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "z"])

    def shared(batches):
        words, unpack = WordHash(), zstandard.ZstdDecompressor().decompress
        for b in batches:
            known: dict[int, np.ndarray] = {}
            for side in "ab":
                new = {i: z for i, z in zip(b.column(side).to_pylist(), b.column("z" + side).to_pylist(), strict=True) if i not in known}
                known |= dict(zip(new, shingle_sets(words, list(map(unpack, new.values())), k), strict=True))
            x, y = b.column("a").to_pylist(), b.column("b").to_pylist()
            both = np.array([len(np.intersect1d(known[i], known[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)
            union = np.array([len(known[i]) + len(known[j]) for i, j in zip(x, y, strict=True)], np.int64) - both
            ok = 100 * both >= percent * union
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok)), pa.array(both[ok], pa.int64())], names=["a", "b", "shared"])

    blobs = by_ids(docs, "doc_id", wanted, "left_semi").mapInArrow(lean(packed), "doc_id long, z binary").groupBy("doc_id").agg(F.min("z").alias("z"))
    left, right = blobs.select(F.col("doc_id").alias("a"), F.col("z").alias("za")), blobs.select(F.col("doc_id").alias("b"), F.col("z").alias("zb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "za", "zb").mapInArrow(lean(shared), "a long, b long, shared long")


def _linked(percent: int, k: int, counted: bool):
    """The classes of a pair of blocks, with their texts, to their links (a, b, shared); or counted: the number of documents that each class is linked with here."""

    def links(key, t):
        t = t.take(pa.array(np.argsort(t.column("rep").to_numpy())))
        classes, own, unpack = _List(t, percent), t.column("own").to_numpy(), zstandard.ZstdDecompressor().decompress
        rep, n, weight = classes.rep, classes.n, t.column("docs").to_numpy()
        sets = shingle_sets(WordHash(), list(map(unpack, t.column("z").to_pylist())), k)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        start = np.cumsum(size) - size
        here = np.zeros(len(token), np.int32)
        a, b, shared, total = [], [], [], np.zeros(len(rep), np.int64)
        one = int(key[1].as_py()) == int(key[2].as_py())
        for i in range(len(rep)):
            ok = classes.passing(i) if one else classes.passing(i) & (own != own[i])
            found = np.flatnonzero(ok[i + 1 :]) + i + 1
            mine = token[start[i] : start[i] + size[i]]
            here[mine] = 1
            for j in (found[x : x + 64] for x in range(0, len(found), 64)):
                both = np.add.reduceat(here[token[ranges(start[j], size[j])]], np.cumsum(size[j]) - size[j])
                good = 100 * both >= percent * (size[i] + size[j] - both)
                j, both = j[good], both[good]
                if counted:
                    total[i] += weight[j].sum()
                    total[j] += weight[i]
                else:
                    a.append(np.full(len(j), rep[i]))
                    b.append(rep[j])
                    shared.append(both)
            here[mine] = 0
        if counted:
            return pa.table({"rep": pa.array(rep, pa.int64()), "links": pa.array(total)})
        cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.table({"a": cat(a), "b": cat(b), "shared": cat(shared)})

    return links


class _Joined:
    """What a join has found: the rows (doc_id, text), the signatures, the classes and their components."""

    def __init__(self, rows: DataFrame, signed: DataFrame, classes: DataFrame, label: DataFrame, k: int, percent: int):
        self.rows, self.signed, self.classes, self.label, self.k, self.percent = rows, signed, classes, label, k, percent

    def members(self) -> DataFrame:
        label, signed = self.label, self.signed
        named = self.classes.join(label, self.classes.rep == label.node, "left").select("sig", F.col("n").alias("n_"), "rep", F.coalesce("component", "rep").alias("component"))
        out = signed.select("doc_id", "n", "sig").join(named, (signed.sig == named.sig) & (signed.n == named.n_), "left")
        own_id = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own_id, F.when(F.col("doc_id").isNotNull(), F.col("rep"))).alias("class_id"), F.coalesce(own_id, F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id"))

    def _blocks(self, part: int) -> DataFrame:
        """(component, x, y, own, rep, n, bits, docs, z): the classes of each pair of blocks, with the text of each."""
        placed = self.classes.join(self.label.withColumnRenamed("node", "rep"), "rep")
        docs = self.signed.where("n > 0 and doc_id is not null").groupBy("sig", "n").agg(F.count_distinct("doc_id").alias("docs"))
        placed = written(placed.join(docs, ["sig", "n"]).select("component", "rep", "n", "sig", "bits", "docs"), "jaccard-placed")
        k = self.k

        def packed(batches):
            press = zstandard.ZstdCompressor(level=3).compress
            for batch in batches:
                for x in range(0, batch.num_rows, 500):
                    b = batch.slice(x, 500)
                    texts_ = b.column("text").cast(pa.binary()).to_pylist()
                    sig = [xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63) for s in shingle_sets(WordHash(), texts_, k)]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig, pa.int64()), pa.array(map(press, texts_), pa.binary())], names=["rep", "sig", "z"])

        # an id that repeats has a row for each of its texts: the signature tells them apart
        blobs = by_ids(self.rows, "doc_id", placed.select(F.col("rep").alias("doc_id")).distinct(), "left_semi").mapInArrow(lean(packed), "rep long, sig long, z binary").groupBy("rep", "sig").agg(F.min("z").alias("z"))
        sizes = written(placed.groupBy("component").agg(F.ceil(F.count("*") / part).cast("int").alias("blocks")), "jaccard-parts")
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        dealt = placed.join(blobs, ["rep", "sig"]).join(sizes, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return dealt.select("component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "n", "bits", "docs", "z")

    def links(self, part: int = PART) -> DataFrame:
        """All pairs (a, b), a < b, of class ids that are linked, with the number of shingles they share."""
        return self._blocks(part).groupBy("component", "x", "y").applyInArrow(_linked(self.percent, self.k, False), "a long, b long, shared long")

    def counted(self, part: int = PART) -> DataFrame:
        """The members with n_links: how many other documents have the same set or one that is linked. An id that repeats with different texts counts with each of them."""
        near = self._blocks(part).groupBy("component", "x", "y").applyInArrow(_linked(self.percent, self.k, True), "rep long, links long").groupBy(F.col("rep").alias("class_id")).agg(F.sum("links").alias("links"))
        members = self.members()
        same = members.where("n_shingles > 0 and doc_id is not null").groupBy("class_id").agg((F.count_distinct("doc_id") - 1).alias("same"))
        # a table of its own, so that the join of a class of many documents can be split
        links = written(same.join(near, "class_id", "left").select("class_id", (F.col("same") + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-counts")
        own = F.when(F.col("n_shingles") > 0, F.col("n_links"))
        return members.join(links, "class_id", "left").select("doc_id", "n_shingles", "component_id", "class_id", F.coalesce(own, F.lit(0)).alias("n_links"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = 75, often: int = OFTEN, buckets: int | None = None, block: int = LIST, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc_id, n_shingles, class_id (the least id with the same set) and component_id for every row; links all linked pairs of class ids, with the number of shingles they share."""
    found = joined(docs, id_col, text_col, k, percent, often, buckets, block)
    return found.members(), found.links(part)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = 75, often: int = OFTEN, buckets: int | None = None, block: int = LIST) -> _Joined:
    """The search for components, which verifies only the links that they need."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = frequent(rows, buckets, k, percent, often)
    order = spark.sparkContext.broadcast((order.frequent, order.rank))
    signed = written(signatures(rows, order, k, percent), "jaccard-signatures")
    classes = written(signed.where("n > 0 and doc_id is not null").groupBy("sig", "n", "gkey").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")), "jaccard-classes")

    groups = classes.groupBy("gkey").agg(F.count("*").alias("classes"))
    within = groups.where("classes > 1").select(F.col("gkey").alias("lid"), "gkey")
    found = written(lists(signed, buckets, percent).union(within), "jaccard-lists")
    # a table of its own, so that the join of a list of many groups can be split
    sizes = written(found.join(groups, "gkey").groupBy("lid").agg(F.sum("classes").alias("total")).where("total > 1"), "jaccard-sizes")
    blocks = F.ceil(F.col("total") / (block // 2)).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = found.join(sizes, "lid").join(classes.select("gkey", "rep", "n", "bits"), "gkey").withColumn("blocks", F.when(F.col("total") > block, blocks).otherwise(1)).withColumn("own", own)
    members = written(dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lid", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "n", "bits"), "jaccard-members")

    forest = members.groupBy("lid", "x", "y").applyInArrow(_candidates(False, percent), "a long, b long").distinct()
    first = written(verified(rows, written(forest, "jaccard-pairs"), k, percent), "jaccard-links")
    label = components(first)
    labelled = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parted = labelled.groupBy("lid", "x", "y").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("lid", "x", "y")
    across = labelled.join(parted, ["lid", "x", "y"], "left_semi").groupBy("lid", "x", "y").applyInArrow(_candidates(True, percent), "a long, b long").distinct()
    second = written(verified(rows, written(across.join(first, ["a", "b"], "left_anti"), "jaccard-pairs"), k, percent), "jaccard-links")
    links = first.union(second)
    label = components(links) if second.limit(1).count() else label

    return _Joined(rows, signed, classes, label, k, percent)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, of each component the document of the least id."""
    members = joined(docs, id_col, text_col).members()
    gone = members.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return by_ids(docs, id_col, gone, "left_anti").select(docs.columns)
