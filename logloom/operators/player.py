"""Reads of a timeline: windows, search, summaries, focus, neighbours of a playhead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.order import ordered, placed

#: Limits of the reads, and the shares and gaps of the player.
WINDOW, SEARCH, SEMANTIC, LEAST_SCORE = 6000, 500, 60, 0.2
COVERAGE, PAD, LEAST_FOCUS = 0.9, 0.15, 5000
CLUSTER_GAP, CLUSTER_ORDER = 2.5, {"storm": 0, "restart": 1, "entity": 2, "ai": 3}
SILENCE, DEAD_ZONE = 1500, 1


def window(df: DataFrame, start: int, end: int, services=(), levels=()) -> DataFrame:
    """Events of [start, end]; empty lists don't filter. A level stands for its class."""
    own = df.where(F.col("ts_ms").between(start, end))
    if services:
        own = own.where(F.col("service").isin(*services))
    if levels:
        own = own.where(T.level_name(F.col("level")).isin(*levels))
    return own


def centered(df: DataFrame, center: int | None = None, most: int = WINDOW) -> DataFrame:
    """At most `most` events in order of time, around center if there are more. df has seq, dense in its own order."""
    total = df.count()
    if total <= most:
        return df
    skip = 0
    if center is not None:
        at = df.where(F.col("ts_ms") < center).count()
        skip = max(0, min(at - most // 2, total - most))
    return placed(df, ["ts_ms", "seq"], "centered", "_at").where(F.col("_at").between(skip, skip + most - 1)).drop("_at")


def search(df: DataFrame, query: str, mode: str = "keyword", most: int = SEARCH) -> DataFrame:
    """Keyword: message or service contains it, case ignored; regex: the message matches; the first few in stream order."""
    if mode == "regex":
        hit = F.col("message").rlike("(?iu)" + query)
    else:
        hit = F.contains(F.lower("message"), F.lit(query.lower())) | F.contains(F.lower("service"), F.lit(query.lower()))
    return df.where(hit).orderBy("seq").limit(most)


def cosine(a, b):
    """Of two arrays of doubles over the shorter length; 0 if a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def semantic(vectors: DataFrame, query: list[float], vector: str, key: str, most: int = SEMANTIC, least: float = LEAST_SCORE) -> DataFrame:
    """The nearest few by cosine, then those above the least score."""
    score = cosine(F.col(vector).cast("array<double>"), F.array(*(F.lit(float(x)) for x in query)))
    return vectors.withColumn("score", score).orderBy(F.desc("score"), key).limit(most).where(F.col("score") > least).withColumn("score", T.rounded(F.col("score") * 100) / 100)


def stats(df: DataFrame) -> DataFrame:
    c = T.level_class(F.col("level"))
    return df.agg(F.count("*").alias("total"), F.count_if(c == 0).alias("errors"), F.count_if(c == 1).alias("warns"))


def busiest(df: DataFrame, most: int = 5) -> DataFrame:
    c = T.level_class(F.col("level"))
    return df.groupBy("service").agg(F.count_if(c == 0).alias("errors"), F.count("*").alias("total"), F.min("seq").alias("_first")).orderBy(F.desc("errors"), F.desc("total"), "_first").limit(most).drop("_first")


def top_errors(df: DataFrame, most: int = 4, first: bool = False) -> DataFrame:
    own = df.where(T.level_class(F.col("level")) == 0)
    return own.groupBy(T.error_key(F.col("message")).alias("text")).agg(F.count("*").alias("count"), F.min("seq").alias("_first")).orderBy(F.desc("count"), "_first").limit(most).drop(*([] if first else ["_first"]))


def explained(df: DataFrame) -> DataFrame:
    """A window in one row: total, errors, warns, the busiest service with its errors, frequent errors with their counts, and all that as a text."""
    busy = busiest(df, 1).select(F.lit(1).alias("_one"), F.col("service").alias("busiest"), F.col("errors").alias("busiest_errors"))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "_first", "text")))
    often = top_errors(df, first=True).agg(F.transform(in_order, lambda x: F.concat(x["text"], F.lit(": "), (-x["n"]).cast("string"))).alias("frequent")).withColumn("_one", F.lit(1))
    row = stats(df).withColumn("_one", F.lit(1)).join(busy, "_one", "left").join(often, "_one", "left").drop("_one")  # one row each
    told = F.concat_ws(" | ", F.concat_ws(" ", F.lit("events"), F.col("total").cast("string"), F.lit("errors"), F.col("errors").cast("string"), F.lit("warnings"), F.col("warns").cast("string")), F.concat(F.lit("busiest "), F.col("busiest")), F.when(F.size("frequent") > 0, F.concat(F.lit("often "), F.array_join("frequent", "; "))))
    return row.withColumn("text", F.when(F.col("total") == 0, "no events").otherwise(told))


def focus(hist: DataFrame, start: int, end: int, buckets: int = 240) -> DataFrame:
    """One row: the shortest run of buckets with the coverage share of all events, earliest on ties, padded, no shorter than a least span."""
    sums = hist.groupBy("bucket").agg(F.sum(F.col("err") + F.col("warn") + F.col("other")).alias("n"))
    grid = hist.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(sums, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    run = grid.withColumn("upto", F.sum("n").over(Window.orderBy("bucket"))).select("bucket", "n", "upto")  # as many rows as buckets
    all_ = run.select(F.array_sort(F.collect_list(F.struct("bucket", "n", "upto")).over(Window.partitionBy(F.lit(1)))).alias("b")).limit(1)
    total = F.col("b")[buckets - 1]["upto"]
    ends = F.transform("b", lambda j: F.struct((j["bucket"] - F.array_max(F.transform(F.filter("b", lambda i: (i["bucket"] <= j["bucket"]) & (j["upto"] - i["upto"] + i["n"] >= total * COVERAGE)), lambda i: i["bucket"]))).alias("length"), j["bucket"].alias("last")))
    best = F.array_min(F.filter(ends, lambda e: e["length"].isNotNull()))
    span = float(max(1, end - start))
    first, last = F.col("best.last") - F.col("best.length"), F.col("best.last")
    pad = (F.col("best.length") + 1) * ((end - start) / buckets) * PAD
    lo = F.greatest(F.lit(float(start)), start + first / buckets * span - pad)
    hi = F.least(F.lit(float(end)), start + (last + 1) / buckets * span + pad)
    wide = all_.select(best.alias("best")).select(first.alias("first_bucket"), last.alias("last_bucket"), lo.alias("lo"), hi.alias("hi"))
    mid, short = (F.col("lo") + F.col("hi")) / 2, F.col("hi") - F.col("lo") < LEAST_FOCUS
    return wide.select("first_bucket", "last_bucket", F.when(short, F.greatest(F.lit(float(start)), mid - LEAST_FOCUS / 2)).otherwise(F.col("lo")).alias("start_ms"), F.when(short, F.least(F.lit(float(end)), mid + LEAST_FOCUS / 2)).otherwise(F.col("hi")).alias("end_ms"))


def clusters(chapters: DataFrame, start: int, end: int) -> DataFrame:
    """Markers nearer than the gap, in percent, to the first of their cluster become one: pct, count, kind. chapters: (ts_ms, kind, ord).

    The first markers are found from the ends of slices of the span, at most a few hundred rows; there are at most 42, and each marker belongs to the last one before it.
    """
    pct = (F.col("ts_ms") - start) / float(max(1, end - start)) * 100
    own = chapters.select(pct.alias("pct"), "ord", "kind").where(F.col("pct").between(-2, 102)).withColumn("_slice", F.floor(F.col("pct") * 16 / CLUSTER_GAP))
    ends = sorted(own.groupBy("_slice").agg(F.min("pct").alias("lo"), F.max("pct").alias("hi")).collect(), key=lambda r: r["_slice"])
    anchors: list[float] = []
    for r in ends:
        if not anchors or r["lo"] - anchors[-1] >= CLUSTER_GAP:
            anchors.append(r["lo"])
        elif r["hi"] - anchors[-1] >= CLUSTER_GAP:  # the cluster ends within the slice
            anchors.append(own.where((F.col("_slice") == r["_slice"]) & (F.col("pct") - anchors[-1] >= CLUSTER_GAP)).agg(F.min("pct")).first()[0])
    rank = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in CLUSTER_ORDER.items()), F.lit(9))
    anchor = F.array_max(F.filter(F.array(*map(F.lit, anchors)).cast("array<double>"), lambda a: a <= F.col("pct")))
    found = own.groupBy(anchor.alias("_anchor")).agg(F.count("*").alias("count"), F.min_by("kind", F.struct(rank, "pct", "ord", "kind")).alias("kind"))
    return found.select(F.col("_anchor").alias("pct"), "count", "kind")


def as_of(playheads: DataFrame, df: DataFrame, values: list[str], ahead: bool = False, dead_zone: int = 0, order: str = "seq") -> DataFrame:
    """playheads (id, at) with the values of the last event with ts_ms <= at - dead_zone, or ahead the first with ts_ms > at + dead_zone.

    Both sides are dealt by ranges of time; a range begins with what the ranges before it ended with. Looking ahead is looking back in the reverse order.
    """
    value = F.struct(*values)
    at = F.col("at") + dead_zone if ahead else F.col("at") - dead_zone
    e = df.select(F.col("ts_ms"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("id"), F.col(order).cast("long").alias("_o"), value.alias("_v"))
    p = playheads.select(at.alias("ts_ms"), F.lit(1).alias("_side"), F.col("id").cast("long").alias("id"), F.lit(0).cast("long").alias("_o"), F.lit(None).cast(e.schema["_v"].dataType).alias("_v"))
    # an event at the very time stands before a playhead: behind it counts, ahead it doesn't
    own = ordered(e.union(p), ["ts_ms", "_side", "_o"], "as-of")
    back = F.desc if ahead else F.asc
    w = Window.partitionBy("_part").orderBy(back("_place")).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.orderBy(back("_part")).rowsBetween(Window.unboundedPreceding, -1)
    edge = own.groupBy("_part").agg((F.min_by if ahead else F.max_by)(F.col("_v"), F.when(F.col("_side") == 0, F.col("_place"))).alias("_e"))
    edges = edge.select("_part", F.last("_e", ignorenulls=True).over(over).alias("_edge"))
    near = own.withColumn("_near", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").join(F.broadcast(edges), "_part").withColumn("_near", F.coalesce("_near", "_edge"))
    return near.select("id", *(F.col(f"_near.{v}").alias(v) for v in values))


def focus_line(playheads: DataFrame, df: DataFrame) -> DataFrame:
    """The line that a playhead stands on."""
    return as_of(playheads, df, ["seq", "ts_ms"])


def history(jobs: DataFrame, statuses=(), term: str = "", page: int = 1, size: int = 10, columns=("product", "filename", "host", "version")) -> DataFrame:
    """Jobs of a status bucket (processing includes queued) whose columns contain the term, the newest first, one page."""
    own = jobs
    if statuses:
        own = own.where(F.col("status").isin(*statuses, *(["queued"] if "processing" in statuses else [])))
    if term:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower()))
        own = own.where(hit)
    return own.orderBy(F.desc("created_at"), "id").offset((page - 1) * size).limit(size)
