"""What a viewer of a report or a timeline derives: windows around a playhead, ticks, lanes, previews, percentages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import text as T

#: Half a window and its step, shown lanes, trees, noise items and files, ticks of the axis, levels shown at first.
HALF_WINDOW, WINDOW_STEP = 300_000, 60_000
LANES, TREES, NOISE, FILES = 8, 5, 4, 8
TICKS = (0.0, 0.25, 0.5, 0.75, 1.0)
LEVELS = ("ERROR", "WARN")


# ---------------------------------------------------------------- the range that is looked at


def fetch_window(playhead: int, half: int = HALF_WINDOW, step: int = WINDOW_STEP) -> tuple[int, int, int]:
    """(start, end, center) of the events to fetch: the center moves in steps, so that a moving playhead seldom fetches anew."""
    center = math.floor(playhead / step + 0.5) * step
    return center - half, center + half, center


def axis_ticks(start: Column, end: Column) -> Column:
    """Times at even shares of a range."""
    return F.array(*(start + F.lit(f) * (end - start) for f in TICKS))


def ticks(marks: DataFrame, start: int, end: int, ts: str = "ts_ms") -> DataFrame:
    """Marks inside a view, both ends included, with their place in percent."""
    return marks.where(F.col(ts).between(start, end)).withColumn("left_pct", (F.col(ts) - start) / float(max(1, end - start)) * 100)


def advanced(playheads: DataFrame, silence: int, end: int) -> DataFrame:
    """playheads (at, moved, next_ms): where playback goes on: at the next event if that is more than `silence` after the moved playhead, no further than the end."""
    jump = F.when(F.col("next_ms") - F.col("moved") > silence, F.col("next_ms")).otherwise(F.col("moved"))
    return playheads.withColumn("to_ms", F.least(F.coalesce(jump, F.col("moved")), F.lit(end)))


# ---------------------------------------------------------------- lanes and levels


def visible_lanes(services: list[str], muted=(), solo=()) -> list[str]:
    """Solo lanes alone if there are any, else those that aren't muted."""
    return [s for s in services if s in set(solo)] if solo else [s for s in services if s not in set(muted)]


def default_levels(df: DataFrame) -> DataFrame:
    """Events of the levels that are shown before anyone chooses."""
    return df.where(T.level_name(F.col("level")).isin(*LEVELS))


def shown_lanes(lanes: DataFrame, most: int = LANES, every: bool = False) -> DataFrame:
    """The busiest lanes."""
    return lanes if every else lanes.where(F.col("lane") < most)


# ---------------------------------------------------------------- parts of a report


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, half up; nothing of nothing is 0."""
    return F.coalesce(T.rounded(part / F.nullif(whole, F.lit(0).cast("double")) * 100), F.lit(0)).cast("long")


def first_ticket(sources: Column) -> Column:
    """The first source of a ticket system that has an address."""
    return F.get(F.filter(sources, lambda s: (s["kind"] == "jira") & (F.coalesce(s["url"], F.lit("")) != "")), F.lit(0))


def class_list(objects: DataFrame) -> DataFrame:
    """Classes by count, equal counts in the order of the language."""
    counted = objects.groupBy("cls").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), F.collate("cls", "UNICODE"), "cls")


def trees(components: DataFrame, most: int | None = TREES) -> DataFrame:
    """Components (component_id, hub, size) of several members, the largest first, at most a few."""
    found = components.where("size > 1").orderBy(F.desc("size"), "component_id")
    return found.limit(most) if most else found


def tree_members(tops: DataFrame, members: DataFrame, objects: DataFrame) -> DataFrame:
    """(component_id, hub, key, cls, name) of the members below their hub; a member without an object shows its key."""
    below = tops.select("component_id", "hub").join(members.select("component_id", "key", "ord"), "component_id").where("key <> hub")
    named = objects.select("key", "cls", "name")
    return below.join(named, "key", "left").select("component_id", "hub", "key", "ord", F.coalesce("cls", "key").alias("cls"), "name")


def component_label(cls: Column, name: Column, key: Column, members: Column) -> Column:
    """A component by its hub's class and name, with the number of other members."""
    own = F.when(F.coalesce(name, F.lit("")) != "", F.concat(cls, F.lit(" «"), name, F.lit("»"))).otherwise(key)
    return F.when(members > 1, F.concat(own, F.lit(" +"), (members - 1).cast("string"))).otherwise(own)


def preview(items: Column, most: int) -> Column:
    """The first few of a list, and how many more there are."""
    return F.struct(F.slice(items, 1, most).alias("shown"), F.greatest(F.size(items) - most, F.lit(0)).cast("long").alias("more"))
