"""Storms of signatures in a stream of records: counts by signature and minute, with a watermark for late lines, and the running peak of each signature."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logloom.functions import text as T

MINUTE = 60_000


def _signed(recs: DataFrame) -> DataFrame:
    at = F.try_to_timestamp(F.col("ts"))
    return recs.where(T.level_class(F.col("level")) < 2).select(at.alias("at"), T.signature(F.col("level"), F.col("component"), F.col("message")).alias("signature")).where("at is not null")


def storm_stream(recs: DataFrame, storm: int = 30, minutes: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """recs: a stream of (ts, level, component, message). Windows of a signature with at least `storm` lines, emitted when the watermark passes."""
    counted = _signed(recs).withWatermark("at", late).groupBy(F.window("at", minutes).alias("w"), "signature").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= storm).select("signature", F.col("w.start").alias("start"), "n")


class _Peak(StatefulProcessor):
    """A signature's state: the count of each slice that can still grow, and the highest count so far. A slice's timer ends it when the watermark has passed it, so the state is as large as the time that lines may be late."""

    def __init__(self, storm: int, slice_ms: int):
        self.storm, self.slice_ms = storm, slice_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "slice long", "n long")
        self.peak = handle.getValueState("peak", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.peak.get()[0] if self.peak.exists() else 0
        most = before
        for own in rows:
            for at, n in zip(own["slice"].tolist(), own["n"].tolist(), strict=True):
                if self.open.containsKey((at,)):
                    n += self.open.getValue((at,))[0]
                else:
                    self.handle.registerTimer((at + 1) * self.slice_ms)
                self.open.updateValue((at,), (n,))
                most = max(most, n)
        if most > before:
            self.peak.update((most,))
            yield pd.DataFrame({"signature": [key[0]], "peak": [most], "storm": [most >= self.storm]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() // self.slice_ms - 1
        if self.open.containsKey((at,)):
            self.open.removeKey((at,))
        yield pd.DataFrame({"signature": pd.Series(dtype="object"), "peak": pd.Series(dtype="int64"), "storm": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.groupby(["signature", "slice"], sort=False).agg(at=("at", "max"), n=("at", "size")).reset_index()


def peak_stream(recs: DataFrame, storm: int = 30, slice_ms: int = MINUTE, late: str = "10 minutes") -> DataFrame:
    """recs: a stream of (ts, level, component, message). (signature, peak, storm) whenever a signature's most lines in one slice of time grow; the last row of a signature is what records.peaks gives for the same lines, but for those later than the watermark allows.

    Lines are counted by signature and slice within each Arrow batch before they meet, so a frequent signature sends few rows; lines that are counted together are as late as the latest of them. The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    rows = _signed(recs).select("signature", "at", F.floor(F.unix_millis("at") / slice_ms).alias("slice"))
    counted = rows.mapInPandas(_counted, "signature string, slice long, at timestamp, n long").withWatermark("at", late)
    return counted.groupBy("signature").transformWithStateInPandas(_Peak(storm, slice_ms), "signature string, peak long, storm boolean", "Update", "EventTime")
