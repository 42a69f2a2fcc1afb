"""Masking of sensitive values by tokens that are numbered in order of first encounter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.order import placed
from logloom.sources.scratch import written

#: Kinds in their order, with their patterns.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
PATTERNS = {
    "ip": rf"{_L}\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{_R}",
    "email": rf"{_L}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}{_R}",
    "userpath": r"[Cc]:\\Users\\[^\\\s\"]+",
    "secret": r"(?i)(?:password|passwd|pwd|token|secret)\s*[=:]\s*\S+",
}


def redacted(rows: DataFrame, key: str, column: str, kinds=tuple(PATTERNS)) -> tuple[DataFrame, DataFrame]:
    """(rows with masked text, mapping (kind, value, token)). Values of a kind are numbered over all rows by (key, place); a kind sees the tokens of the ones before.

    One pass finds the values of a kind and stores where they are; their first places give the numbers, and only rows that have a match are joined with their own values' tokens.
    """
    mapping = None
    for kind in kinds:
        pattern = PATTERNS[kind]
        found = rows.select(key, F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)).alias("_m")).where(F.size("_m") > 0)
        places = written(found.select(F.col(key).alias("_k"), F.posexplode("_m").alias("_i", "_v")), "redact-places")
        first = places.groupBy("_v").agg(F.min(F.struct("_k", "_i")).alias("_at")).select("_v", F.col("_at._k").alias("_k"), F.col("_at._i").alias("_i"))
        numbered = placed(first, ["_k", "_i"], "redact-values", "_n").select("_v", F.concat(F.lit(f"<{kind}-"), (F.col("_n") + 1).cast("string"), F.lit(">")).alias("_t"))
        tokens = places.join(numbered, "_v").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_tokens"))
        gaps = F.split(F.col(column), pattern, -1)
        joined = F.array_join(F.zip_with(gaps, F.transform("_tokens", lambda x: x["_t"]), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
        rows = rows.join(tokens.withColumnRenamed("_k", key), key, "left").withColumn(column, F.when(F.col("_tokens").isNotNull(), joined).otherwise(F.col(column))).drop("_tokens")
        own = numbered.select(F.lit(kind).alias("kind"), F.col("_v").alias("value"), F.col("_t").alias("token"))
        mapping = own if mapping is None else mapping.union(own)
    return rows, mapping


def masked_events(events: DataFrame, kinds=tuple(PATTERNS)) -> DataFrame:
    """Events of one request with masked messages and components: one numbering in the order of events, a message before its component."""
    texts = events.select("seq", F.posexplode(F.array("message", "component")).alias("_i", "_text")).withColumn("_key", F.col("seq") * 2 + F.col("_i"))
    clean, _ = redacted(texts.select("_key", "_text"), "_key", "_text", kinds)
    own = clean.select((F.col("_key") / 2).cast("long").alias("seq"), (F.col("_key") % 2).alias("_i"), "_text")
    pair = own.groupBy("seq").agg(F.max(F.when(F.col("_i") == 0, F.col("_text"))).alias("message"), F.max(F.when(F.col("_i") == 1, F.col("_text"))).alias("component"))
    return events.drop("message", "component").join(pair, "seq").select(events.columns)
