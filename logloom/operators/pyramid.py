"""Histograms of any range from a pyramid of counts: what a zoom reads depends on its buckets, not on the events in it.

Level 0 has the events of each millisecond and service, level k those of 8^k milliseconds, each level made from the one below. A bucket of a histogram is a range of whole milliseconds, and every range is a few aligned slots of each level, so the sums are exact at both ends and no event is read. The levels are sorted by slot, and a read names the ranges of slots that it needs, so their files prune.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.timeline import BUCKETS

#: Bits of a level, and ranges of slots that one level's read names at most.
STEP, RANGES = 3, 32
_CLASSES = ("err", "warn", "other")


def build(df: DataFrame, path: str) -> str:
    """Writes the pyramid of events (ts_ms, service, level). Levels go on until one slot, or two beside zero, has everything."""
    spark, c = df.sparkSession, T.level_class(F.col("level"))
    counts = df.where("ts_ms is not null").groupBy(F.col("ts_ms").alias("slot"), "service").agg(*(F.count_if(c == i).alias(n) for i, n in enumerate(_CLASSES)))
    level = 0
    while True:
        to = f"{path}/level={level}"
        counts.repartitionByRange("slot").sortWithinPartitions("slot", "service").write.mode("overwrite").parquet(to)
        below = spark.read.schema(counts.schema).parquet(to)
        ends = below.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first()
        if ends["lo"] is None or ends["hi"] - ends["lo"] <= 1:
            return path
        level += 1
        counts = below.groupBy(F.shiftright("slot", STEP).alias("slot"), "service").agg(*(F.sum(n).alias(n) for n in _CLASSES))


def edges(start: int, end: int, buckets: int) -> list[int]:
    """The first millisecond of each bucket as timeline.bucket deals them, and the one after the end."""
    span = max(1, end - start)
    of = lambda t: math.floor((t - start) / span * buckets)  # noqa: E731  the same operations on doubles
    out = [start]
    for b in range(1, buckets):
        t = start + b * span // buckets
        while of(t) >= b:
            t -= 1
        while of(t) < b:
            t += 1
        out.append(min(t, end + 1))
    return [*out, end + 1]


def slots(lo: int, hi: int, top: int) -> list[tuple[int, int]]:
    """(level, slot) of the aligned slots that make up [lo, hi), the coarsest up to level top."""
    out, level = [], 0
    while lo < hi:
        if level == top or lo >> STEP == (hi - 1) >> STEP and (lo & (1 << STEP) - 1 or hi & (1 << STEP) - 1):
            return out + [(level, s) for s in range(lo, hi)]
        up, down = -(-lo >> STEP) << STEP, hi >> STEP << STEP
        if up > down:
            return out + [(level, s) for s in range(lo, hi)]
        out += [(level, s) for s in [*range(lo, up), *range(down, hi)]]
        lo, hi, level = up >> STEP, down >> STEP, level + 1
    return out


def _ranges(own: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Slots as ranges, at most so many: the widest gaps part them."""
    own = sorted(own)
    gaps = sorted(range(1, len(own)), key=lambda i: own[i - 1] - own[i])[: most - 1]
    cut = [0, *sorted(i for i in gaps if own[i] - own[i - 1] > 1), len(own)]
    return [(own[x], own[y - 1]) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def needed(spark: SparkSession, path: str, start: int, end: int, buckets: int = BUCKETS) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The rows of the pyramid that a histogram sums, each with its bucket; and (level, slot, bucket) of the slots asked for, some tens for each bucket."""
    # the levels below the top one are never empty, so the top is the last folder there is
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    top = max(int(f.getPath().getName().split("=")[1]) for f in at.getFileSystem(conf).listStatus(at) if f.getPath().getName().startswith("level="))
    first = edges(start, end, buckets)
    lo, hi = _bounds(spark, path, top)
    asked = [(k, s, b) for b, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True)) for k, s in slots(max(x, lo), min(y, hi), top)]
    by_level: dict[int, list[int]] = {}
    for k, s, _ in asked:
        by_level.setdefault(k, []).append(s)
    rows = spark.read.parquet(path)
    if not asked:
        return rows.withColumn("bucket", F.lit(0)).where(F.lit(False)), []
    wanted = reduce(lambda p, q: p | q, ((F.col("level") == k) & reduce(lambda p, q: p | q, (F.col("slot").between(x, y) for x, y in _ranges(own))) for k, own in by_level.items()))
    of = spark.createDataFrame(asked, "level int, slot long, bucket int")
    return rows.where(wanted).join(F.broadcast(of), ["level", "slot"]), asked


def _bounds(spark: SparkSession, path: str, top: int) -> tuple[int, int]:
    """Milliseconds that the top level covers; beyond them there is nothing to ask for."""
    ends = spark.read.parquet(f"{path}/level={top}").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first()
    return (0, 0) if ends["lo"] is None else (ends["lo"] << STEP * top, (ends["hi"] + 1) << STEP * top)


def histogram(spark: SparkSession, path: str, start: int, end: int, buckets: int = BUCKETS) -> DataFrame:
    """What timeline.histogram gives for the events of the pyramid."""
    rows, _ = needed(spark, path, start, end, buckets)
    return rows.groupBy("bucket", "service").agg(*(F.sum(n).alias(n) for n in _CLASSES))
