"""Global orders without a single task: rows are dealt by ranges of the sort keys, sorted within them, and written; what crosses ranges comes from one small row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.sources.scratch import shared_dir, unique, written

_ROW = (1 << 33) - 1


def ordered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df as a table with `_part`, a range of the keys, and `_place`, a row's place within it. Equal first keys can lie in several ranges, so a storm in one instant is spread too."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))}), name)


#: Rows of a file of a sliced table.
SLICE = 65_536


def sliced(df: DataFrame, keys: list[str], name: str, rows: int = SLICE) -> DataFrame:
    """ordered() with `_slice`: every file holds one slice of a part, as one row group, so whoever reads the table gets each slice whole and in order, without another shuffle."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
    own = dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}).withColumn("_slice", F.floor(F.col("_place") / rows))
    path = f"{shared_dir(df.sparkSession)}/{unique(name)}"
    own.write.option("maxRecordsPerFile", rows).option("parquet.block.size", 2**31 - 1).parquet(path)
    return df.sparkSession.read.schema(own.schema).parquet(path)


def before(own: DataFrame, count) -> DataFrame:
    """(_part, _before): the sum of `count` over the parts before; as many rows as there are parts."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return own.groupBy("_part").agg(count.alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def placed(df: DataFrame, keys: list[str], name: str, place: str = "place") -> DataFrame:
    """df with its place in the global order of the keys, from 0."""
    own = ordered(df, keys, name)
    return own.join(F.broadcast(before(own, F.count("*"))), "_part").withColumn(place, F.col("_before") + F.col("_place")).select(*df.columns, place)


def neighbours(own: DataFrame, value, ahead: bool = False, name: str = "_near") -> DataFrame:
    """An ordered table with the value of the row before, or after, across parts."""
    w, over = Window.partitionBy("_part").orderBy("_place"), Window.orderBy("_part")
    step, edge = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    edges = own.groupBy("_part").agg(edge(value, "_place").alias("_e")).select("_part", step("_e").over(over).alias("_edge"))
    return own.withColumn(name, step(value).over(w)).join(F.broadcast(edges), "_part").withColumn(name, F.coalesce(name, "_edge")).drop("_edge")


def running_count(own: DataFrame, keys: list[str], flag: Column, name: str) -> DataFrame:
    """An ordered table (its first sort keys are `keys`) with the number of flagged rows of the row's keys up to it.

    Within a part rows are counted. A part's first key goes on from the parts before, where it is the last key, so these hand on how many flagged rows of it they have: a row for each part.
    """
    key = F.struct(*keys)
    counted = own.withColumn("_flag", flag).withColumn("_n", F.sum(F.col("_flag").cast("long")).over(Window.partitionBy("_part", *keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)))
    edges = own.groupBy("_part").agg(F.min_by(key, "_place").alias("_first"), F.max_by(key, "_place").alias("_last"))
    tails = own.withColumn("_flag", flag).join(F.broadcast(edges.select("_part", "_last")), "_part").groupBy("_part").agg(F.first("_last").alias("_key"), F.count_if(F.col("_flag") & key.eqNullSafe(F.col("_last"))).alias("_h"))
    asked = edges.select("_part", F.col("_first").alias("_key"), F.lit(0).cast("long").alias("_h"), F.lit(0).alias("_side"))
    earlier = Window.partitionBy("_key").orderBy("_part", "_side").rowsBetween(Window.unboundedPreceding, -1)
    handed = asked.union(tails.select("_part", "_key", "_h", F.lit(1))).withColumn("_before", F.coalesce(F.sum("_h").over(earlier), F.lit(0))).where("_side = 0").select(F.col("_part").alias("_of"), "_key", "_before")
    joined = counted.join(F.broadcast(handed), (F.col("_part") == F.col("_of")) & key.eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(name, F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_flag", "_n", "_of", "_key", "_before")
