"""The merged timeline: global order, histograms, chapters, and neighbours in time.

Whatever needs a global order is dealt by ranges of (time, order), see order.py: no slice of time is a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.order import SLICE, neighbours, ordered, placed, sliced
from logloom.sources.scratch import written

#: Buckets of the overview, gaps in milliseconds, what makes a storm of errors, the largest timeline, and what a service says when it starts.
BUCKETS, RESTART_GAP, CHAPTER_GAP, CHAPTERS, PEAKS, STORM_FACTOR, STORM_LEAST, SIGNIFICANT, MOST_EVENTS = 240, 30_000, 1000, 10, 4, 4, 20, 300, 500_000
RESTART = r"(?iu)Abort handler is set up|This is AppHost|New run at|Server started"


def events(recs: DataFrame, order: list[str]) -> DataFrame:
    """Records with a valid time as timeline events; order: columns that order records of equal time."""
    ts = T.epoch_ms(F.col("ts"))
    return recs.select(*order, ts.alias("ts_ms"), T.time_text(F.col("ts")).alias("ts_text"), T.service(F.col("file")).alias("service"), "thread", F.coalesce("level", F.lit("INFO")).alias("level"), "component", T.timeline_message(F.col("message")).alias("message")).where("ts_ms is not null")


#: Rows up to which the first of an order are kept by each task and meet in one.
TOP = 10_000


def capped(df: DataFrame, order: list[str], most: int = MOST_EVENTS) -> tuple[DataFrame, bool]:
    """The first events in the order of files and lines, and whether there are as many as the cap. Without this step a timeline has all events."""
    if most <= TOP:  # each task keeps its first ones; nothing else is sorted or moved
        own = written(df.orderBy(*order).limit(most), "capped")
        return own, own.count() >= most
    own = placed(written(df, "uncapped"), order, "capped", "_at").where(F.col("_at") < most)
    return own.drop("_at"), own.limit(most).count() >= most


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with seq, the place in the global order (ts_ms, *order)."""
    return placed(df, ["ts_ms", *order], "timeline", "seq")


def with_previous(df: DataFrame, order: list[str], values: list[str], ahead: bool = False) -> DataFrame:
    """df with prev_<value> of the row before in the global order (or next_<value> of the one after)."""
    near = neighbours(ordered(df, ["ts_ms", *order], "neighbours"), F.struct(*values), ahead)
    name = "next" if ahead else "prev"
    return near.select(*df.columns, *(F.col(f"_near.{v}").alias(f"{name}_{v}") for v in values))


def bounds(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")).first()
    return (r["lo"] or 0), (r["hi"] or 0)


def bucket(ts: Column, start: int, end: int, buckets: int = BUCKETS) -> Column:
    return F.least(F.lit(buckets - 1), F.floor((ts - start) / max(1, end - start) * buckets)).cast("int")


def histogram(df: DataFrame, start: int, end: int, buckets: int = BUCKETS) -> DataFrame:
    """Errors, warnings and others by bucket of [start, end] and service; empty buckets have no row."""
    c = T.level_class(F.col("level"))
    own = df.where(F.col("ts_ms").between(start, end)).groupBy(bucket(F.col("ts_ms"), start, end, buckets).alias("bucket"), "service")
    return own.agg(*(F.count_if(c == i).alias(n) for i, n in enumerate(("err", "warn", "other"))))


def zoom_buckets(asked: int) -> int:
    return min(480, max(40, asked))


def lanes(df: DataFrame) -> DataFrame:
    """Services by activity, ties by their first event."""
    n = df.groupBy("service").agg(F.count("*").alias("events"), F.min("seq").alias("first"))
    return n.select("service", "events", (F.row_number().over(Window.orderBy(F.desc("events"), "first")) - 1).cast("long").alias("lane"))


def _runs(batches, *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of one slice each, with the values that name the slice; a slice can come in several pieces."""
    for b in batches:
        if b.num_rows:
            of = np.stack([b.column(n).to_numpy() for n in names])
            at = np.flatnonzero(np.concatenate(([True], (of[:, 1:] != of[:, :-1]).any(0), [True]))).tolist()
            for x, y in zip(at[:-1], at[1:], strict=True):
                yield tuple(of[:, x].tolist()), b.slice(x, y - x)


SAME = np.iinfo(np.int64).min


def _phases(ts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """A slice's transfer function as steps: (from, exit). Whoever was kept at e before the slice, the last one kept after it is the exit of the last step with from <= e + gap; before the first step nothing of the slice is in reach of e, and it is as if none was kept before. An exit of SAME is e itself: the whole slice lies within its gap.

    Only rows within a gap of the slice's first can be the first one kept, so there are at most gap + 2 steps however long the slice is.
    """
    n = len(ts)
    after = np.searchsorted(ts, ts + gap, "right")
    last = np.where(after < n, after, np.arange(n))  # the next one kept, by doubling the last
    while (last[last] != last).any():
        last = last[last]
    first = np.arange(min(n, int(np.searchsorted(ts, ts[0] + gap, "right")) + 1))
    froms = np.where(first > 0, ts[np.maximum(first - 1, 0)], SAME)
    exits = ts[last[first]]
    if len(first) == n:  # all of the slice can lie within the gap
        froms, exits = np.append(froms, ts[-1]), np.append(exits, SAME)
    own = np.append(froms[1:] != froms[:-1], True)  # of equal times the last decides
    froms, exits = froms[own], exits[own]
    new = np.concatenate(([True], exits[1:] != exits[:-1]))
    return froms[new], exits[new]


_STEPS = "_part int, _slice long, froms array<long>, exits array<long>"


def _transfers(gap: int):
    def run(batches):
        of, held = None, []

        def put():
            froms, exits = _phases(np.concatenate(held), gap)
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([of[0]], pa.int32()), pa.array([of[1]], pa.int64()), pa.array([froms], longs), pa.array([exits], longs)], names=["_part", "_slice", "froms", "exits"])

        for key, own in _runs(batches, "_part", "_slice"):
            if held and key != of:
                yield put()
                held = []
            of = key
            held.append(own.column("ts_ms").to_numpy())
        if held:
            yield put()

    return run


def _entries(gap: int):
    """Slices' functions in order to the last time kept before each slice, null before the first."""

    def run(batches):
        last = None
        for b in batches:
            entries = []
            for froms, exits in zip(b.column("froms"), b.column("exits"), strict=True):
                entries.append(last)
                froms, exits = froms.values.to_numpy(), exits.values.to_numpy()
                exit_ = int(exits[0 if last is None else max(0, int(np.searchsorted(froms, last + gap, "right")) - 1)])
                last = last if exit_ == SAME else exit_
            yield pa.RecordBatch.from_arrays([b.column("_part"), b.column("_slice"), pa.array(entries, pa.int64())], names=["_part", "_slice", "entry"])

    return run


def _keeping(entries: dict[tuple[int, int], int | None], gap: int, names: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        of, last = None, None
        for key, own in _runs(batches, "_part", "_slice"):
            if key != of:
                of, last = key, entries[key]
            ts, kept = own.column("ts_ms").to_numpy(), []
            i = 0 if last is None else int(np.searchsorted(ts, last + gap, "right"))
            while i < len(ts):
                kept.append(i)
                last = int(ts[i])
                i = int(np.searchsorted(ts, last + gap, "right"))
            if kept:
                yield own.take(pa.array(kept)).select(names)

    return run


def debounced(df: DataFrame, gap: int = RESTART_GAP, order: tuple[str, ...] = ("seq",), rows: int = SLICE) -> DataFrame:
    """Rows more than gap after the last row kept.

    What a slice of the order keeps depends on the last row kept before it, and on nothing else; so each slice is reduced to a function from that time to the last time that it keeps. One scan makes the functions, they are applied one after the other (a row a slice, of at most gap + 2 steps), and one more scan keeps the rows: two scans however the events lie. The driver sees one number a slice.
    """
    own = sliced(df.where("ts_ms is not null"), ["ts_ms", *order], "debounce", rows)
    steps = own.select("_part", "_slice", "ts_ms").mapInArrow(_transfers(gap), _STEPS)
    entered = steps.repartition(1).sortWithinPartitions("_part", "_slice").mapInArrow(_entries(gap), "_part int, _slice long, entry long")
    entries = {(r["_part"], r["_slice"]): r["entry"] for r in entered.collect()}
    return own.mapInArrow(_keeping(entries, gap, df.columns), df.schema)


def storm_chapters(hist: DataFrame, start: int, end: int, buckets: int = BUCKETS) -> DataFrame:
    """Buckets whose errors reach the threshold, the few largest: bucket, errors, ts_ms of the middle. Empty buckets count for the mean."""
    by_bucket = hist.groupBy("bucket").agg(F.sum("err").alias("errors"))
    total = hist.agg(F.coalesce(F.sum("err"), F.lit(0)).alias("t")).first()["t"]
    threshold = max(total / max(1, buckets) * STORM_FACTOR, STORM_LEAST)
    middle = start + T.rounded((F.col("bucket") + 0.5) / buckets * max(1, end - start))
    return by_bucket.where(F.col("errors") >= threshold).orderBy(F.desc("errors"), "bucket").limit(PEAKS).withColumn("ts_ms", middle)


def restarts(df: DataFrame, banner: str = RESTART, gap: int = RESTART_GAP) -> DataFrame:
    """Events whose message announces a start, one in a while."""
    return debounced(df.where(F.col("message").rlike(banner)), gap)


def thinned(chapters: DataFrame, order: list[str], gap: int = CHAPTER_GAP, most: int = CHAPTERS) -> DataFrame:
    """Chapters more than gap after the one before in the whole list, the first few."""
    near = with_previous(chapters, order, ["ts_ms"])
    return near.where(F.col("prev_ts_ms").isNull() | (F.col("ts_ms") - F.col("prev_ts_ms") > gap)).drop("prev_ts_ms").orderBy("ts_ms", *order).limit(most)


def chapters(df: DataFrame, hist: DataFrame, start: int, end: int, banner: str = RESTART, buckets: int = BUCKETS) -> DataFrame:
    """(ts_ms, kind, service): restarts, then storms of errors, in order of time and thinned. df: numbered events."""
    found = restarts(df, banner).select("ts_ms", F.lit("restart").alias("kind"), "service", F.lit(0).alias("_kind"), F.col("seq").alias("_ord"))
    peaks = storm_chapters(hist, start, end, buckets).select("ts_ms", F.lit("storm"), F.lit(None).cast("string"), F.lit(1), F.col("bucket").cast("long") - F.col("errors") * buckets)
    return thinned(found.union(peaks), ["_kind", "_ord"]).select("ts_ms", "kind", "service")


def significant(df: DataFrame, most: int = SIGNIFICANT) -> DataFrame:
    """The first error or warning of each service and coarse signature, the earliest few."""
    own = df.where(T.level_class(F.col("level")) < 2).withColumn("coarse", T.coarse_signature(F.col("message")))
    first = own.groupBy("service", "coarse").agg(F.min_by(F.struct("ts_ms", "seq", "level", "message"), "seq").alias("e"))
    return first.select("service", "coarse", "e.*").orderBy("seq").limit(most)
