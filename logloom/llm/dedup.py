"""Exact dedup as a stateful stream with disk-backed state.

The documents land, normalised and with their digests, as files of a state's folder, which a stream reads in micro-batches. The stream's state, in RocksDB with its checkpoint in the same folder, keeps for each digest, for ever, the least id, a locator of that document's content (file and row) and how many rows had the digest; partial sums are made before the shuffle, so a text that a third of all rows share is no hot key. A later call goes on with the state. Each hit is then checked: the bytes at its locator and at the one that stays are compared, and texts that only share a digest are told apart.

Results for odd rows: a null text counts as empty, and all empty texts are equal. Of equal texts the row of the least id stays; a null id comes last. Rows that repeat an id count one by one, and all rows with the id that stays are kept; rows with a null id are checked by their bytes as well; nothing else is read, so extra columns can have any name. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import by_ids, new_path, texts, written

_STORE = "spark.sql.streaming.stateStore"
#: State on disk, in files that aren't allocated ahead: a state of many partitions would take megabytes for each otherwise.
_SETTINGS = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


_ROWS = "doc_id long, digest binary, sha binary, text string"
_STATE = "digest binary, keep_id long, file string, row long, n long"
#: Where a landed text lies: its file and the row in it.
_LOCATOR = ("_metadata.file_path AS file", "_metadata.row_index AS row")


def landed(spark: SparkSession, root: str, call: str | None = None) -> DataFrame:
    """The landed rows of a state, or of one call, with their locators."""
    reader = spark.read.schema(_ROWS).option("recursiveFileLookup", True)
    return reader.parquet(f"{root}/rows/{call}" if call else f"{root}/rows").selectExpr("doc_id", "digest", "sha", "text", *_LOCATOR)


def keyed_state(spark: SparkSession, root: str, batch_bytes: int = 2 << 30) -> DataFrame:
    """(digest, keep_id, file, row, n) of all rows that have landed in a state's folder. A stream takes the files that it hasn't seen; its checkpoint lies in the folder, so a later call, or one after a failure, goes on where the last one stopped."""
    out = f"{root}/changes"
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(_ROWS).option("maxBytesPerTrigger", batch_bytes).option("recursiveFileLookup", True).parquet(f"{root}/rows").selectExpr("doc_id", "digest", *_LOCATOR)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row"))
        state = stream.groupBy("digest").agg(least.alias("least"), F.count("*").alias("n"))

        def put(batch: DataFrame, number: int) -> None:
            batch.select("digest", F.col("least.doc_id").alias("keep_id"), "least.file", "least.row", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(f"{_STATE}, batch long").parquet(out)
    last = F.max_by(F.struct("keep_id", "file", "row", "n"), F.col("batch")).alias("last")  # a later state of a digest replaces an earlier one
    return changes.groupBy("digest").agg(last).select("digest", "last.*")


def exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 64, batch_bytes: int = 2 << 30, state: str | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    state: a folder that all executors share. Documents of later calls with the same folder are compared with those of all earlier ones; the rows are those of this call's documents, with keep_id and group_size over all calls so far. Without one the state is of this call alone.
    digest_chars: hexadecimal digits of the state's keys; fewer make false hits, which the check of the bytes finds.
    """
    spark = docs.sparkSession
    root, call = state or new_path(spark, "dedup"), f"call-{uuid.uuid4().hex}"
    rows = texts(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
    hexed = F.sha2("text", 256)
    digest = F.unhex(hexed if digest_chars == 64 else F.substring(hexed, 1, digest_chars))
    rows.select("doc_id", digest.alias("digest"), F.unhex(hexed).alias("sha"), "text").write.option("compression", "zstd").parquet(f"{root}/rows/{call}")
    own = landed(spark, root, call)
    # only digests of several rows are joined; as a table of their own, so that a skewed join can be split
    several = written(keyed_state(spark, root, batch_bytes).where("n > 1").withColumnsRenamed({"file": "keep_file", "row": "keep_row"}), "dedup-several")
    found = written(own.drop("text").join(several, "digest", "left"), "dedup-found")

    # a hit's text and the one that stays are fetched by their locators; equal bytes collapse before the shuffle, however many rows have them
    hits = found.where("n > 1 and not (file = keep_file and row = keep_row)").select("file", "row", "keep_file", "keep_row")
    wanted = hits.select("file", "row").union(hits.select("keep_file", "keep_row").distinct()).distinct()
    bytes_of = landed(spark, root).join(wanted, ["file", "row"], "left_semi").select("digest", "text").distinct()
    false_hits = written(bytes_of.groupBy("digest").count().where("count > 1").select("digest"), "dedup-false")
    if false_hits.limit(1).count():
        every = landed(spark, root).join(false_hits, "digest")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
        groups = every.groupBy("digest", "text").agg(least.alias("least"), F.count("*").alias("n")).select("digest", F.unhex(F.sha2("text", 256)).alias("sha"), F.col("least.doc_id").alias("keep_id"), "n")
        apart = found.drop("keep_id", "n").join(false_hits, "digest", "left_semi").join(groups, ["digest", "sha"])
        found = found.join(false_hits, "digest", "left_anti").unionByName(apart)
    alone = F.col("n").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, without the rows whose text an earlier id has."""
    gone = exact(docs, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return by_ids(docs, id_col, gone, "left_anti").select(docs.columns)
