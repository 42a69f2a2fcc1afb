"""What the corpus operators share: inputs, scratch tables, word hashes, a Bloom filter of fixed size and components."""

from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.scratch import shared_dir

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), whatever else the input has; a null text counts as empty.

    Texts are long rows: the session's Arrow batches are made smaller, so that a worker holds few megabytes at once.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))


def lean(task):
    """task, a function of Arrow batches, that gives back the memory it freed when it ends: idle Python workers stay beside those of later stages."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        released()

    return run


def lean_group(task):
    """The same for a function of a key and its rows as an Arrow table."""

    def run(key, t):
        out = task(key, t)
        released()
        return out

    return run


def released() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # the C library isn't glibc
        pass


# ---------------------------------------------------------------- scratch tables


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/logloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table in the shared folder whose files are dealt by key as a shuffle would deal it: joins on the key move the other side only."""
    spark = df.sparkSession
    table_name = f"logloom_{name}_{uuid.uuid4().hex}".replace("-", "_")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", new_path(spark, name)).option("compression", "zstd").bucketBy(parts, key).saveAsTable(table_name)
    return spark.table(table_name)


def dropped(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/logloom-" in at:
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(conf).delete(p, True)


# ---------------------------------------------------------------- hashes of words


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered while there are few enough words."""

    MOST = 1 << 18

    def __init__(self, most: int = MOST):
        super().__init__()
        self.MOST = most

    def __missing__(self, word):
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each pair, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return first + np.arange(total)


def boundaries(x: np.ndarray) -> np.ndarray:
    """Indexes at which a run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


# ---------------------------------------------------------------- packed integers


def packed(x: np.ndarray) -> bytes:
    """Integers, least bytes first in planes, compressed."""
    x = np.ascontiguousarray(x).astype(np.uint64)
    w = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    planes = x.astype(f"<u{w}").view(np.uint8).reshape(-1, w).T.tobytes()
    return bytes([w]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").reshape(-1).astype(np.int64)


# ---------------------------------------------------------------- Bloom filter


class Bloom:
    """A broadcast set of longs: it lets pass all of them and few others. It only thins the rows that a shuffled join gets; the join decides.

    It has 8 to 16 bits for each long, up to `most` bits (16 MB); a set of more than a sixth as many longs isn't sent at all, and every row passes.
    """

    def __init__(self, ids: DataFrame, col: str, most: int = 1 << 27):
        spark = ids.sparkSession
        n = ids.count()
        self.empty, self.open = n == 0, 6 * n > most
        if self.open:
            return
        self.bits = bits = max(1 << 18, 1 << (8 * n).bit_length())
        marks = ids.select(F.explode(F.array(*self._marks(F.col(col)))).alias("bit"))
        blocks = marks.groupBy(F.floor(F.col("bit") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("m")).collect()
        got = np.zeros(bits // 8, np.uint8)
        for r in blocks:
            got[r["k"] * 4096 : r["k"] * 4096 + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
        self._bits = spark.sparkContext.broadcast(got)

    def _marks(self, x: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(x.cast("long"), F.lit(seed)), F.lit(self.bits)) for seed in (1, 2)]

    def may_have(self, df: DataFrame, col: str) -> DataFrame:
        """The rows of df whose `col` may be in the set."""
        return df if self.open else self._split(df, col, True)

    def cannot_have(self, df: DataFrame, col: str) -> DataFrame:
        """The other rows: their `col` isn't in the set."""
        return df.where(F.lit(False)) if self.open else self._split(df, col, False)

    def _split(self, df: DataFrame, col: str, having: bool) -> DataFrame:
        names, bits = df.columns, self._bits

        def keep(batches):
            have = bits.value
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                for c in ("_b0", "_b1"):
                    at = b.column(c).to_numpy()
                    ok &= (have[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                ok = ok if having else ~ok
                if ok.any():
                    yield b.filter(pa.array(ok)).select(names)

        marked = df.withColumns(dict(zip(("_b0", "_b1"), self._marks(F.col(col)), strict=True)))
        return marked.mapInArrow(lean(keep), df.schema)


# ---------------------------------------------------------------- components


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for each node of links (a, b longs): component is the least node that it reaches.

    Each round every node takes the least label next to it, then its label's label; tables in the shared folder cut the lineage. Rounds: about the logarithm of the longest path.
    """
    edges = written(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b").distinct(), f"{name}-edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), f"{name}-0")
    n = 0
    while True:
        n += 1
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        new = written(step.join(jump, "low", "left").select("node", "old", F.least(F.col("low"), F.coalesce("next", "low")).alias("component")), f"{name}-{n}")
        moved = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


# ---------------------------------------------------------------- rows by id

#: Lists of ids are broadcast up to this many (16 MB); longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, col: str, ids: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with ids (its column has the same name); how: left_semi or left_anti."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, col, how)
