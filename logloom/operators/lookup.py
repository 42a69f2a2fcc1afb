"""Search in a stored timeline by an index of trigrams: files that cannot hold a hit aren't read.

For every file of the timeline the index has the distinct trigrams of its messages and services, in lower case. A hit of a keyword has all the keyword's trigrams, and a hit of a pattern those of the literal runs that every match must have; only files with all of them are read, and what they hold is tested as without an index. A search text with no run of three characters, and a pattern whose literals aren't certain, read every file. The index is a table of its own, in order of the trigrams, so that a search reads few of its row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import player
from logloom.sources.scratch import written

SIZE = 3


def index(spark: SparkSession, path: str) -> str:
    """Writes the index of the timeline at path beside it: (gram, file)."""
    events = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "message", "service")
    # a file has few services, each of many events
    texts = events.select("file", F.lower("message").alias("x")).unionByName(events.select("file", F.lower("service").alias("x")).distinct())
    each = texts.where(F.length("x") >= SIZE).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("x") - (SIZE - 1))))
    # a gram that every event of a file has is one row for each task that reads the file; stored, as dealing by ranges reads them twice
    rows = written(each.select("file", F.substring(F.col("x"), F.col("i"), F.lit(SIZE)).alias("gram")).distinct(), "grams")
    to = f"{path.rstrip('/')}-grams"
    rows.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.mode("overwrite").parquet(to)
    return to


def literals(pattern: str) -> list[str]:
    """Runs of plain characters that every match of a pattern has, whatever the case. Only what is certain: groups, sets and optional characters break runs, alternatives and flags leave none. So do `i`, `k` and `s`, which have relatives outside ASCII that only patterns without regard to case match."""
    if "|" in pattern or "(?" in pattern or "\\Q" in pattern or "\\E" in pattern:
        return []
    runs, run, i, depth = [], "", 0, 0

    def ended():
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            following = pattern[i + 1 : i + 2]
            if following.isalnum():  # a class, a boundary, a reference or a code: what belongs to it is skipped
                ended()
                i += 2
                while i < len(pattern) and (pattern[i].isalnum() or pattern[i] in "{}"):
                    i += 1
                continue
            c, i = following, i + 1
            plain = True
        else:
            plain = c not in ".^$*+?{}[]()"
        if not plain:
            if c in "*?{":
                run = run[:-1]  # what stands before it may be missing
            ended()
            if c == "[":
                i += 2 if pattern[i + 1 : i + 2] != "^" else 3
                while i < len(pattern) and pattern[i] != "]":
                    if pattern[i] == "[":  # a set within a set
                        return []
                    i += 2 if pattern[i] == "\\" else 1
            elif c == "{":
                while i < len(pattern) and pattern[i] != "}":
                    i += 1
            depth += (c == "(") - (c == ")")
        elif depth or not c.isascii() or c in "iIkKsS":
            ended()
        else:
            run += c.lower()
        i += 1
    ended()
    return [r for r in runs if len(r) >= SIZE]


def _grams_of(texts: list[str]) -> list[str]:
    return sorted({t[i : i + SIZE] for t in texts for i in range(len(t) - SIZE + 1)})


def files(spark: SparkSession, path: str, query: str, mode: str = "keyword") -> list[str] | None:
    """Names of the files that can hold a hit; None if the index can't tell."""
    grams = _grams_of(literals(query) if mode == "regex" else [query.lower()])
    if not grams:
        return None
    found = spark.read.parquet(f"{path.rstrip('/')}-grams").where(F.col("gram").isin(grams)).groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return sorted(r["file"] for r in found.select("file").collect())  # names of files, which a reader has anyway


def search(spark: SparkSession, path: str, query: str, mode: str = "keyword", most: int = player.SEARCH) -> tuple[DataFrame, int | None]:
    """The hits that player.search finds in the whole timeline, and how many files are read for them (None: all)."""
    names = files(spark, path, query, mode)
    events = spark.read.parquet(path)
    if names is not None:
        events = spark.read.schema(events.schema).parquet(*(f"{path.rstrip('/')}/{n}" for n in names)) if names else events.where(F.lit(False))
    return player.search(events, query, mode, most), None if names is None else len(names)
