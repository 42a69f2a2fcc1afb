"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of the labelled rows is fitted by one task, with a learning rate for each coordinate and an L1 penalty that leaves few weights; the weights are sent to all tasks, which score every whole text in one pass without a shuffle.

Null and empty texts have no words and get the model's bias as their score. Repeated rows are scored one by one; only rows of the sample are fitted. Rows without a label, and labels without a row, take no part. Without any labelled row the bias is 0 and every score 0.5. A null id gets a score, but no label. Long texts are scored whole; beyond SAMPLE_CHARS they aren't fitted. An empty table gives no rows. Columns other than the id and the text are never read for a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, WordHash, lean, mix, quoted, texts

#: Features are hashed to so many slots; a dense array of weights takes 4 bytes a slot.
SLOTS = 1 << 20
#: At most so many labelled rows of each class are fitted, those whose ids' hashes are least, and none whose text has more characters.
SAMPLE = 8000
SAMPLE_CHARS = 1 << 15
STEMS = (5, 7)
#: Words and stems whose hashes a worker remembers.
KNOWN = 1 << 16

_WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    bias: float
    slots: np.ndarray  # int64, sorted
    weights: np.ndarray  # float32
    learnt: bool = True  # whether there was a labelled row


def features(words: WordHash, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every word, of its stems, of each pair of neighbours, and of pairs with one or two words between.

    A stem is a word's first STEMS letters, so that inflected forms share a slot.
    """
    tokens = [_WORD.findall(t.lower()) for t in docs]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = [w for t in tokens for w in t]
    h = words.of(flat)
    doc = np.repeat(np.arange(len(docs)), sizes)
    at, slot = [doc], [h]
    for n in STEMS:
        at.append(doc)
        slot.append(mix(words.of([w[:n] for w in flat]) + U64(100 + n)))
    for gap in (1, 2, 3):
        same = doc[gap:] == doc[:-gap]
        at.append(doc[gap:][same])
        slot.append(mix(h[:-gap][same] * U64(0x9E3779B97F4A7C15) + mix(h[gap:][same] + U64(gap))))
    return np.concatenate(at), (mix(np.concatenate(slot)) & U64(SLOTS - 1)).astype(np.int64)


class Ftrl:
    """FTRL-proximal, one example at a time."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)  # the last slot is the bias, which isn't penalised

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == SLOTS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        at = np.flatnonzero(np.abs(self.z[:SLOTS]) > self.l1)
        return Model(float(self.weights(np.array([SLOTS]))[0]), at, self.weights(at).astype(np.float32))


def crc_rest(id_col: Column, m: int) -> Column:
    """crc32 of an id's decimal text, modulo m."""
    return F.crc32(id_col.cast("string").cast("binary")) % m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, epochs: int = 3) -> Model:
    """The model of at most `sample` labelled rows of each class. labels: (id_col, label_col), the rows to learn from."""
    marks = labels.select(quoted(id_col).cast("long").alias("doc_id"), quoted(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    own = texts(docs, id_col, text_col).where(F.length("text") <= SAMPLE_CHARS)
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = [marks.where(F.col("y") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    rows = own.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "y", "text")  # of bounded size

    def featured(batches):
        words = WordHash(KNOWN)
        for b in batches:
            doc, slot = features(words, b.column("text").to_pylist())
            key = np.unique(doc * np.int64(SLOTS) + slot)
            doc, slot = key // SLOTS, (key % SLOTS).astype(np.int32)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            blobs = [slot[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(blobs, pa.binary())], names=["doc_id", "y", "slots"])

    def trained(batches):
        rows_ = sorted({(d, y, s) for b in batches for d, y, s in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "slots")), strict=True)})
        if not rows_:
            return
        data = [(np.append(np.frombuffer(s, np.int32).astype(np.int64), SLOTS), y) for _, y, s in rows_]
        learner = Ftrl()
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(data)).tolist():
                learner.learn(*data[i])
        m = learner.model()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.slots, SLOTS)), pa.array(np.append(m.weights.astype(float), m.bias))], names=["slot", "weight"])

    got = rows.mapInArrow(lean(featured), "doc_id long, y int, slots binary").repartition(1).mapInArrow(lean(trained), "slot long, weight double").collect()
    weights = sorted((r["slot"], r["weight"]) for r in got)
    if not weights:
        return Model(0.0, np.zeros(0, np.int64), np.zeros(0, np.float32), False)
    return Model(weights[-1][1], np.array([s for s, _ in weights[:-1]], np.int64), np.array([w for _, w in weights[:-1]], np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1."""
    return _scored(docs, model, id_col, text_col, ()).select(F.col("_id").alias("doc_id"), F.col("_score").alias("score"))


def below(docs: DataFrame, model: Model, limit: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose score is under a limit, with all their columns, whatever these are called."""
    kept = _scored(docs, model, id_col, text_col, tuple(docs.columns)).where(F.col("_score") < limit)
    return kept.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)))


def _scored(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """_id, _score, and the columns named in keep as _k0, _k1, ..."""
    bias = model.bias
    sent = docs.sparkSession.sparkContext.broadcast((model.slots, model.weights))

    def scored(batches):
        words, w = WordHash(KNOWN), np.zeros(SLOTS, np.float32)
        w[sent.value[0]] = sent.value[1]
        for batch in batches:
            for x in range(0, batch.num_rows, 200):
                b = batch.slice(x, 200)
                doc, slot = features(words, b.column("_text").to_pylist())
                hit = w[slot] != 0
                key = np.unique(doc[hit] * np.int64(SLOTS) + slot[hit])
                total = np.full(b.num_rows, bias)
                np.add.at(total, key // SLOTS, w[key % SLOTS])
                out = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", *kept)), out], names=["_id", *kept, "_score"])

    kept = [f"_k{i}" for i in range(len(keep))]
    given = docs.select(quoted(id_col).cast("long").alias("_id"), F.coalesce(quoted(text_col), F.lit("")).alias("_text"), *(quoted(c).alias(k) for c, k in zip(keep, kept, strict=True)))
    schema = given.drop("_text").schema.add("_score", "double")
    return given.mapInArrow(lean(scored), schema)
