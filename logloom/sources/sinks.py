"""Writing results: stage outputs, the timeline with its manifest, metadata tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.order import placed
from logloom.sources.store import Store


def stage(df: DataFrame, root: str, run: str, name: str) -> DataFrame:
    """A stage's output as its checkpoint; the next stage reads it back."""
    path = f"{root}/checkpoints/{run}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, root: str, run: str, name: str) -> DataFrame:
    """A stage's checkpoint, for a run that begins after it."""
    return spark.read.parquet(f"{root}/checkpoints/{run}/{name}")


def timeline(df: DataFrame, root: str, run: str, shard_rows: int = 4000) -> str:
    """Events in shards of shard_rows each by seq (dense, in order of time), so that files and row groups prune by their statistics. Tasks get whole shards, as many as there are tasks for."""
    path = f"{root}/timeline/{run}/events"
    dealt = df.withColumn("_shard", F.floor(F.col("seq") / shard_rows)).repartitionByRange("_shard").sortWithinPartitions("_shard", "ts_ms", "seq")
    dealt.drop("_shard").write.mode("overwrite").option("maxRecordsPerFile", shard_rows).parquet(path)
    return path


#: Bits of each side of the key that clusters a timeline by time and service.
CURVE_BITS = 15


def _spread(x: Column) -> Column:
    """The bits of a number with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x.bitwiseOR(F.shiftleft(x, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return x


def timeline_by_service(df: DataFrame, root: str, run: str, shard_rows: int = 4000) -> str:
    """Events in shards clustered by time and service together: along a curve whose key interleaves the bits of the time's place in the whole range and of the service's place in the list of services. A shard holds a stretch of time of neighbouring services, so a range of one service reads few shards; their statistics prune, as in a timeline by time.

    The list of services is joined, never collected. Equal keys lie in the order of time.
    """
    path = f"{root}/timeline/{run}/events-by-service"
    ends = df.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")).first()
    lo, span = ends["lo"] or 0, max(1, (ends["hi"] or 0) - (ends["lo"] or 0))
    services = placed(df.select("service").distinct(), ["service"], "services", "_lane")
    n = max(1, services.count() - 1)
    side = lambda x, whole: F.floor(x * ((1 << CURVE_BITS) - 1) / whole).cast("long")
    key = F.shiftleft(_spread(side(F.col("_lane"), n)), 1).bitwiseOR(_spread(side(F.col("ts_ms") - lo, span)))
    dealt = df.join(services, "service").withColumn("_key", key).repartitionByRange("_key", "ts_ms", "seq").sortWithinPartitions("_key", "ts_ms", "seq")
    dealt.select(*df.columns).write.mode("overwrite").option("maxRecordsPerFile", shard_rows).parquet(path)
    return path


def service_zones(spark: SparkSession, path: str) -> DataFrame:
    """zone_map with the least and greatest service of each shard and its size in bytes."""
    meta = F.col("_metadata")
    return spark.read.parquet(path).groupBy(meta["file_name"].alias("shard"), meta["file_size"].alias("bytes")).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.min("service").alias("first_service"), F.max("service").alias("last_service"), F.count("*").alias("events"))


def overlapping_service(zones: DataFrame, start: int, end: int, service: str) -> DataFrame:
    """The shards that can hold events of a service in [start, end]."""
    return overlapping(zones, start, end).where(F.lit(service).between(F.col("first_service"), F.col("last_service")))


def zone_map(spark: SparkSession, path: str) -> DataFrame:
    """Least and greatest time and number of events of each shard."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("shard")).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("events"))


def overlapping(zones: DataFrame, start: int, end: int) -> DataFrame:
    """The shards that can hold events of [start, end]."""
    return zones.where((F.col("end_ms") >= start) & (F.col("start_ms") <= end))


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Events of [start, end]; the files' statistics do what the zone map does, so nothing is joined."""
    return spark.read.parquet(path).where(F.col("ts_ms").between(start, end))


def manifest(store: Store, run: str, zones: DataFrame, lanes: DataFrame, histogram: DataFrame, chapters: DataFrame, buckets: int, truncated: bool = False, has_embeddings: bool = False) -> dict:
    """What a player needs to open a timeline: tables of lanes, activity, chapters and shards beside the events, and a small object with totals, lane order and chapters."""
    for name, df in (("lanes", lanes), ("activity", histogram), ("chapters", chapters), ("shards", zones)):
        df.write.mode("overwrite").parquet(store.at(f"timeline/{run}/{name}"))
    read = lambda name: store.spark.read.parquet(store.at(f"timeline/{run}/{name}"))
    total = read("shards").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"), F.coalesce(F.sum("events"), F.lit(0)).alias("n"), F.count("*").alias("shards")).first()
    found = {
        "start_ms": total["lo"],
        "end_ms": total["hi"],
        "events": total["n"],
        "shards": total["shards"],
        "truncated": truncated,
        "buckets": buckets,
        "has_embeddings": has_embeddings,
        "services": [r["service"] for r in read("lanes").orderBy("lane").select("service").collect()],
        "chapters": [r.asDict() for r in read("chapters").orderBy("ts_ms").collect()],
    }
    store.put_json(f"timeline/{run}/manifest.json", found)
    return found


class Table:
    """A metadata table of Parquet files. Each version has a folder of its own, and the last one that was finished is current, for every session; older ones stay for readers until `keep` newer ones are there.

    A version is written under a name of its own and gets its number when it is whole, so a write that crashes leaves nothing that stands in the way. Two writers of one version can't both finish: the second one finds the number taken, and fails.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, key: str = "id", keep: int = 2):
        self.spark, self.name, self.schema, self.key, self.keep = spark, name, schema, key, keep
        self.store = Store(spark, root)
        self.columns = spark.createDataFrame([], schema).columns

    def _versions(self) -> list[str]:
        return [v for v in self.store.names(self.name) if v.startswith("v-") and self.store.exists(f"{self.name}/{v}/_SUCCESS")]

    def read(self) -> DataFrame:
        there = self._versions()
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.store.at(f"{self.name}/{there[-1]}"))

    def _put(self, df: DataFrame) -> None:
        there = self._versions()
        number = max((int(v[2:]) + 1 for v in self.store.names(self.name) if v.startswith("v-")), default=0)  # also after a folder that nobody finished
        draft, final = f"new-{uuid.uuid4().hex}", f"{self.name}/v-{number:012d}"
        df.select(self.columns).write.parquet(self.store.at(f"{self.name}/{draft}"))
        if not self.store.move(f"{self.name}/{draft}", final):
            self.store.delete_prefix(f"{self.name}/{draft}")
            raise FileExistsError(f"another writer has made version {number} of {self.name}")
        for old in there[: -self.keep]:
            self.store.delete_prefix(f"{self.name}/{old}")

    def get(self, key) -> dict | None:
        """The row of a key."""
        rows = self.read().where(F.col(self.key) == F.lit(key)).limit(1).collect()
        return rows[0].asDict(True) if rows else None

    def insert(self, row: dict) -> dict:
        whole = {c: row.get(c) for c in self.columns}
        self.upsert(self.spark.createDataFrame([tuple(whole.values())], self.schema))
        return whole

    def upsert(self, rows: DataFrame) -> None:
        self._put(self.read().join(rows.select(self.key), self.key, "left_anti").unionByName(rows))

    def update(self, condition, **values) -> None:
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        self._put(self.read().withColumns({c: F.when(condition, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, condition) -> None:
        self._put(self.read().where(~condition))
