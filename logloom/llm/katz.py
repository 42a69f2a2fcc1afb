"""Language-model scoring by a Katz back-off model of word pairs.

A pair that training texts have gets its Good-Turing discounted relative frequency; any other gets the word's own probability times its context's back-off weight, which makes the context's probabilities sum to one exactly. The word's own probability is the additive one, (c + 0.5) / (N + 0.5 (V + 1)), where all unknown words share the one extra place.

Tokens travel as packed blobs: a run of documents is a row (its tokens as numbers of its own sorted vocabulary), a vocabulary goes to buckets of words and comes back with counts and numbers that hold for the whole corpus, and the pairs go to buckets of contexts, the model's partitions. These are read twice, first for the counts of counts, then to score: each bucket has all counts of its contexts, and gives back sums for documents. A context with a large share of all tokens is spread over buckets by its next word, with its totals kept apart; there are at most as many such contexts as the share allows.

A null text counts as empty: its only token is the end. A null id stays null; a null training flag counts as false. Long texts are read whole, in a run that ends after them. Rows that repeat an id are scored one by one, and each counts if it is a training row. Extra columns are ignored; an empty table gives no rows. Without any training row all words are unknown and share the one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, WordHash, boundaries, packed, quoted, unpacked, written

#: A run of documents ends after so many tokens.
RUN_TOKENS = 3_000_000
#: Good-Turing discounts hold for counts up to this.
K = 5
END = b""


def _row(names, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names=names)


# ---------------------------------------------------------------- runs of documents and their vocabularies

_RUN = ["run", "ids", "held", "sizes", "tokens", "words", "trained"]
_RUN_TYPES = "run long, ids binary, held binary, sizes binary, tokens binary, words binary, trained long"


def _with_nulls(ids: list[int | None]) -> bytes:
    """Ids, then a byte for each that says whether it is null."""
    return np.array([i or 0 for i in ids], np.int64).tobytes() + np.array([i is None for i in ids], bool).tobytes()


def _ids(blob: bytes) -> pa.Array:
    n = len(blob) // 9
    return pa.array(np.frombuffer(blob[: 8 * n], np.int64), mask=np.frombuffer(blob[8 * n :], bool))


def _runs(batches):
    """(doc_id, text, train) to runs: the sorted hashes of a run's words, and its tokens as places in that order."""
    part, number = TaskContext.get().partitionId(), 0

    def put(ids, held, sizes, hashes):
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        return _row(_RUN, part << 32 | number, _with_nulls(ids), np.array(held, np.uint8).tobytes(), packed(np.array(sizes)), packed(tokens), words.tobytes(), len(held) - sum(held))

    words = WordHash()
    end = words[END]
    ids, held, sizes, hashes, total = [], [], [], [], 0
    for batch in batches:
        for x in range(0, batch.num_rows, 500):
            b = batch.slice(x, 500)
            split = [t.lower().split() for t in b.column("text").cast(pa.binary()).to_pylist()]
            for w in split:
                w.append(END)
            got = words.of([x for w in split for x in w])
            ids += b.column("doc_id").to_pylist()
            held += [0 if t else 1 for t in b.column("train").to_pylist()]
            sizes += map(len, split)
            hashes.append(got)
            total += len(got)
            if total >= RUN_TOKENS:
                yield put(ids, held, sizes, hashes)
                number += 1
                ids, held, sizes, hashes, total = [], [], [], [], 0
    del end
    if ids:
        yield put(ids, held, sizes, hashes)


def _vocabularies(buckets: int):
    def deal(batches):
        for b in batches:
            for r in b.to_pylist():
                words, tokens = np.frombuffer(r["words"], U64), unpacked(r["tokens"])
                trained = np.repeat(np.frombuffer(r["held"], np.uint8) == 0, unpacked(r["sizes"]))
                counts = np.bincount(tokens[trained], minlength=len(words))
                cut = np.searchsorted(words >> U64(32), [-(-(i << 32) // buckets) for i in range(buckets + 1)])
                for i, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if y > x:
                        yield _row(["bucket", "run", "words", "counts"], i, r["run"], words[x:y].tobytes(), packed(counts[x:y]))

    return deal


def _counted(buckets: int):
    """All runs' words of a bucket to each run's counts and numbers, in the order of the run's words. Frequent words get low numbers."""

    def count(key, t):
        rows = t.to_pylist()
        words = [np.frombuffer(r["words"], U64) for r in rows]
        all_words, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpacked(r["counts"]) for r in rows]), len(all_words)).astype(np.int64)
        number = np.empty(len(total), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(total))
        number = number * buckets + rows[0]["bucket"]
        ends = np.cumsum([len(w) for w in words])
        parts = [(packed(number[p]), packed(total[p])) for p in np.split(place, ends[:-1])]
        n = len(rows)
        return pa.table({"run": pa.array([r["run"] for r in rows], pa.int64()), "bucket": pa.array([rows[0]["bucket"]] * n, pa.int64()), "numbers": pa.array([p[0] for p in parts], pa.binary()), "counts": pa.array([p[1] for p in parts], pa.binary()), "tokens": pa.array([int(total.sum())] * n, pa.int64()), "types": pa.array([int((total > 0).sum())] * n, pa.int64())})

    return count


# ---------------------------------------------------------------- pairs

_PAIRS = ["bucket", "run", "contexts", "nexts", "counts", "docs"]
_PAIRS_TYPES = "bucket long, run long, contexts binary, nexts binary, counts binary, docs binary"


def _dealt(buckets: int, hot: float, n: int, v: int, n_docs: int):
    """A run and its counts to its documents' base scores (bucket -1) and its pairs by bucket of contexts.

    A context is 2 * (number + 1), or 2 for a text's start, plus 1 if it is spread; a document 2 * place, plus 1 if it is held out.
    """
    room = n + 0.5 * (v + 1)

    def deal(batches):
        for b in batches:
            for r in b.to_pylist():
                answers = sorted(r["answers"], key=lambda a: a["bucket"])
                number = np.concatenate([unpacked(a["numbers"]) for a in answers])
                count = np.concatenate([unpacked(a["counts"]) for a in answers])
                sizes, tokens, held = unpacked(r["sizes"]), unpacked(r["tokens"]), np.frombuffer(r["held"], np.uint8)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                c = count[tokens]
                base = np.bincount(doc, np.log10((c + 0.5) / room), len(sizes))
                known = np.bincount(doc, c > 0, len(sizes)).astype(np.int64)
                yield _row(_PAIRS, -1, r["run"], r["ids"], r["held"] + known.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), base.tobytes())
                following = number[tokens]
                before = np.concatenate(([0], following[:-1] + 1))
                often = np.concatenate(([0], c[:-1])) > hot
                first = np.cumsum(sizes) - sizes
                before[first], often[first] = 1, n_docs > hot
                before = np.where(np.isin(np.arange(len(doc)), first), 0, before) * 2 + 2 + often
                at = (np.where(often, before + following * 31, before) >> 1) % buckets
                order = np.lexsort((following, before, at))
                at, before, following, c, d = at[order], before[order], following[order], c[order], (doc * 2 + held[doc])[order]
                cut = np.searchsorted(at, np.arange(buckets + 1)).tolist()
                for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if y > x:
                        yield _row(_PAIRS, i, r["run"], packed(np.diff(before[x:y], prepend=0)), packed(following[x:y]), packed(c[x:y]), packed(d[x:y]))

    return deal


class _Bucket:
    """All pairs of a bucket: distinct ones with their training counts, and where each occurs."""

    def __init__(self, rows, room: float):
        self.runs = [r["run"] for r in rows]
        cols = [(np.cumsum(unpacked(r["contexts"])), unpacked(r["nexts"]), unpacked(r["counts"]), unpacked(r["docs"])) for r in rows]
        h, w, c, d = (np.concatenate(x) for x in zip(*cols, strict=True))
        run = np.repeat(np.arange(len(rows)), [len(x[0]) for x in cols])
        order = np.lexsort((w, h))
        h, w, c = h[order], w[order], c[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        start = np.flatnonzero(new)
        self.pair = np.empty(len(h), np.int64)
        self.pair[order] = np.cumsum(new) - 1  # of each occurrence as it came
        self.run, self.doc, held = run, d >> 1, d & 1
        self.count = np.bincount(self.pair, 1 - held, len(start)).astype(np.int64)
        self.own = (c[start] + 0.5) / room  # the next word's own probability
        self.context_of = h[start]
        self.first = boundaries(self.context_of)
        self.context = self.context_of[self.first]

    def totals(self) -> np.ndarray:
        """For each context: training pairs, those with count 1 to K, and the own probabilities of the words seen."""
        if not len(self.first):
            return np.zeros((0, K + 2))
        add = lambda x: np.add.reduceat(x.astype(np.float64), self.first)
        return np.stack([add(self.count), *(add(self.count == r) for r in range(1, K + 1)), add(np.where(self.count > 0, self.own, 0))], 1)


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d[r] for r up to K, from n_1 to n_(K+1); where Good-Turing gives nothing between 0 and 1, (r - 0.5) / r."""
    n = np.concatenate(([0.0], counts_of_counts.astype(float)))
    d = np.ones(K + 1)
    for r in range(1, K + 1):
        d[r] = (r - 0.5) / r
        if n[1] > 0 and n[r] > 0:
            last = (K + 1) * n[K + 1] / n[1]
            if last != 1:
                good = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last)
                if 0 < good < 1:
                    d[r] = good
    return d


def backoff(totals: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale, weight) of contexts: a seen pair has scale * d[count] * count / all, another word weight times its own probability.

    A context whose pairs are all too frequent to be discounted gives up one part in all + 1.
    """
    all_, seen = totals[:, 0], totals[:, -1]
    left = (totals[:, 1 : K + 1] * (1 - d[1:]) * np.arange(1, K + 1)).sum(1) / np.maximum(all_, 1)
    rigid = left < 1e-12
    scale = np.where(rigid, all_ / (all_ + 1), 1.0)
    left = np.where(rigid, 1 / (all_ + 1), left)
    return scale, np.where(all_ > 0, left / np.maximum(1 - seen, 1e-300), 1.0)


def _by_bucket(rows):
    """Rows of a partition, those of a bucket together."""
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["bucket"], []).append(r)
    return sorted(found.items())


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, hot_share: float | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; train: the rows to learn from."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 2 * parts
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    runs = written(rows.mapInArrow(_runs, _RUN_TYPES), "katz-runs")
    dealt = runs.mapInArrow(_vocabularies(buckets), "bucket long, run long, words binary, counts binary").groupBy("bucket")
    answers = written(dealt.applyInArrow(_counted(buckets), "run long, bucket long, numbers binary, counts binary, tokens long, types long"), "katz-words")
    sums = answers.groupBy("bucket").agg(F.first("tokens").alias("n"), F.first("types").alias("v")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    n_docs = runs.agg(F.sum("trained")).first()[0] or 0
    room = n + 0.5 * (v + 1)
    hot = n * (hot_share if hot_share is not None else 1 / (4 * buckets))

    by_run = answers.groupBy("run").agg(F.collect_list(F.struct("bucket", "numbers", "counts")).alias("answers"))
    pairs = runs.drop("words", "trained").join(by_run, "run").mapInArrow(_dealt(buckets, hot, n, v, n_docs), _PAIRS_TYPES)
    # an RDD, so that both jobs read one shuffle
    model = pairs.repartition(parts, "bucket").rdd

    def counts(rows_):
        of_counts, spread = np.zeros(K + 1), {}
        for bucket, own in _by_bucket(rows_):
            if bucket >= 0:
                b = _Bucket(own, room)
                of_counts += np.bincount(b.count[(b.count > 0) & (b.count <= K + 1)], minlength=K + 2)[1:]
                for h, t in zip(b.context.tolist(), b.totals(), strict=True):
                    if h & 1:
                        spread[h] = spread.get(h, 0) + t
        yield of_counts.tolist(), [(h, t.tolist()) for h, t in spread.items()]

    of_counts, spread = np.zeros(K + 1), {}
    for c, s in model.mapPartitions(counts).toLocalIterator():
        of_counts += c
        for h, t in s:
            spread[h] = spread.get(h, 0) + np.array(t)
    d = discounts(of_counts)

    def scores(rows_):
        sums_: dict[int, list] = {}
        for bucket, own in _by_bucket(rows_):
            if bucket < 0:
                for r in own:
                    yield r["run"], r["contexts"], r["nexts"], r["counts"], r["docs"], None
                continue
            b = _Bucket(own, room)
            totals = b.totals()
            for i in np.flatnonzero(b.context & 1).tolist():
                totals[i] = spread[int(b.context[i])]
            scale, weight = backoff(totals, d)
            size = np.diff(np.append(b.first, len(b.count)))
            all_, scale, weight = (np.repeat(x, size) for x in (totals[:, 0], scale, weight))
            cut = np.where(b.count <= K, d[np.minimum(b.count, K)], 1.0)
            p = np.where(b.count > 0, scale * cut * b.count / np.maximum(all_, 1), weight * b.own)
            logs = np.log10(p)[b.pair]
            for i, run in enumerate(b.runs):
                of = b.run == i if len(b.runs) < 4 else slice(*np.searchsorted(b.run, [i, i + 1]).tolist())
                sums_.setdefault(run, []).append((b.doc[of], logs[of]))
            if sum(len(x[0]) for s in sums_.values() for x in s) > 4_000_000:
                sums_ = {run: [_summed(s)] for run, s in sums_.items()}
        for run, s in sums_.items():
            doc, log = _summed(s)
            yield run, None, None, None, packed(doc), log.tobytes()

    sent = spark.createDataFrame(model.mapPartitions(scores), "run long, ids binary, known binary, sizes binary, docs binary, logs binary")

    def joined(key, t):
        rows_ = t.to_pylist()
        top = next(r for r in rows_ if r["ids"] is not None)
        ids, sizes, base = _ids(top["ids"]), np.frombuffer(top["sizes"], "<i8"), np.frombuffer(top["docs"], np.float64)
        held, known = np.frombuffer(top["known"][: len(ids)], np.uint8), np.frombuffer(top["known"][len(ids) :], "<i8")
        total = np.zeros(len(ids))
        for r in rows_:
            if r["ids"] is None:
                total[unpacked(r["docs"])] += np.frombuffer(r["logs"], np.float64)
        return pa.table({"doc_id": ids, "held_out": pa.array(held == 1), "n_tokens": pa.array(sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ids), n, np.int64)), "base_score": pa.array(base), "score": pa.array(total)})

    return sent.groupBy("run").applyInArrow(joined, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _summed(parts) -> tuple[np.ndarray, np.ndarray]:
    """Sums by document."""
    doc, log = (np.concatenate(x) for x in zip(*parts, strict=True))
    own = np.bincount(doc, minlength=0) > 0 if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(own)
    return at, np.bincount(doc, log)[at] if len(doc) else np.zeros(0)
