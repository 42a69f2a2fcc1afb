"""Media columns with content-defined chunks.

A text becomes a payload, the payload a WAV file of 8-bit samples. Payloads are cut where a rolling gear hash of the last 32 bytes has enough zero bits, so equal passages give equal chunks wherever they stand. Spark joins the chunks' digests: a chunk that occurs in several payloads is stored once, in a table of shared chunks; one that a single payload has is stored once with that payload, in a table that has each payload's ordered list of digests. Reading has only these two tables: the lists are joined with the shared chunks by digest, every chunk's digest is verified, the pieces are put together in order, and the result must have the payload's hash.

A null text counts as empty; its payload is 64 zero bytes. Payloads are known by a hash of their bytes, so repeated rows and ids share one, and no id is read; extra columns are ignored. An empty table gives no rows. A chunk that is missing or whose bytes don't have its digest is an error, and so is a payload that isn't rebuilt as it was.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Bloom, mix, texts, written

LEAST, MASK, MOST = 1024, (1 << 12) - 1, 16384
UNIT = 64
RATE = 8000

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long, n_shared long, media binary"
#: A stored payload: its digests in order, with the bytes of those that no other payload has where they first stand.
STORED = "pid long, n_shared long, chunks array<struct<digest: binary, bytes: binary>>"


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for unit in (1, 2, 4, 8, 16):
        g = h.copy()
        g[unit:] += h[:-unit] << np.uint32(unit)
        h = g
    ends, last = [], 0
    for c in (np.flatnonzero((h >> np.uint32(12) & np.uint32(MASK)) == 0) + 1).tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def pid(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def stored(data: bytes) -> bytes:
    """A mono WAV file whose 8-bit samples are the bytes."""
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return f.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def feature(samples: bytes) -> str:
    """Length, mean, root mean square around the middle, and how often the signal crosses the middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"samples={len(x)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _payloads(batches):
    for batch in batches:
        for x in range(0, batch.num_rows, 500):
            b = batch.slice(x, 500)
            yield b, [payload(t) for t in b.column("text").cast(pa.binary()).to_pylist()]


def _refs(batches):
    for _, data in _payloads(batches):
        rows = [(pid(d), digest(c)) for d in data for c in chunks(d)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["pid", "digest"])


def _rows(batches):
    for b, data in _payloads(batches):
        n = [len(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(map(pid, data), pa.int64())], names=["doc_id", "n_bytes", "pid"])


def _with_pid(batches):
    for b, data in _payloads(batches):
        yield pa.RecordBatch.from_arrays([b.column("text"), pa.array(map(pid, data), pa.int64())], names=["text", "pid"])


def _stored(batches):
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
    for b, data in _payloads(batches):
        out = []
        for own, shared in zip(data, b.column("digests").to_pylist(), strict=True):
            listed, there = [(digest(c), c) for c in chunks(own)], set(shared or ())
            n = sum(h in there for h, _ in listed)
            kept = []
            for h, c in listed:
                kept.append({"digest": h, "bytes": None if h in there else c})
                there.add(h)
            out.append((n, kept))
        yield pa.RecordBatch.from_arrays([b.column("pid"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind)], names=["pid", "n_shared", "chunks"])


def _shared_bytes(batches):
    for b, data in _payloads(batches):
        rows = [(h, c) for d, wanted in zip(data, b.column("digests").to_pylist(), strict=True) for want in [set(wanted)] for c in chunks(d) for h in [digest(c)] if h in want]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["digest", "bytes"])


def rebuilt(want: int, listed: list[dict], shared: list[dict]) -> bytes:
    """The payload of a stored list and the shared chunks that were joined with it."""
    store = {c["digest"]: c["bytes"] for c in (*shared, *listed) if c["bytes"] is not None}
    parts = [store.get(c["digest"]) for c in listed]
    if any(p is None for p in parts):
        raise ValueError("a chunk is missing")
    if any(digest(c) != h for h, c in store.items()):
        raise ValueError("a stored chunk doesn't have its digest")
    data = b"".join(parts)
    if pid(data) != want:
        raise ValueError("a payload wasn't rebuilt as it was")
    return data


def _media(names: list[str]):
    def make(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 500):
                b, rows = batch.slice(x, 500), []
                for want, n, listed, shared in zip(*(b.column(c).to_pylist() for c in ("pid", "n_shared", "chunks", "shared")), strict=True):
                    own = rebuilt(want, listed, shared or [])
                    whole = stored(own)
                    back = read_back(whole)
                    if back != own:
                        raise ValueError("a payload wasn't read back as it was")
                    got = (want, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(whole), hashlib.sha256(whole).hexdigest(), feature(back), len(listed), n, whole)
                    rows.append(got[: len(names)])
                kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return make


def store(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the rows (doc_id, n_bytes, pid), the payloads (STORED) and the shared chunks (digest, bytes); rows: (doc_id, text)."""
    refs = rows.mapInArrow(_refs, "pid long, digest binary")
    owners = refs.groupBy("digest").agg(F.min("pid").alias("pid"), F.max("pid").alias("last")).where("pid <> last")
    owners = written(owners.select("digest", "pid"), "media-owners")
    held = rows.mapInArrow(_with_pid, "text string, pid long")
    wanted = owners.groupBy("pid").agg(F.collect_list("digest").alias("digests"))
    holders = Bloom(owners, "pid").may_have(held, "pid").join(wanted, "pid").select("text", "digests")
    shared = written(holders.mapInArrow(_shared_bytes, "digest binary, bytes binary").groupBy("digest").agg(F.max("bytes").alias("bytes")), "media-chunks")

    known = written(rows.mapInArrow(_rows, "doc_id long, n_bytes long, pid long"), "media-rows")
    uses = written(refs.distinct().join(owners.select("digest"), "digest", "left_semi").groupBy("pid").agg(F.collect_list("digest").alias("digests")), "media-uses")
    # payloads that share a chunk, or that several rows have, meet by pid; the others stay where they are
    again = known.groupBy("pid").agg(F.count("*").alias("n")).where("n > 1").select("pid")
    some = Bloom(uses.select("pid").union(again), "pid")
    once = some.may_have(held, "pid").groupBy("pid").agg(F.first("text").alias("text"))
    met = once.join(uses, "pid", "left").select("pid", "text", "digests")
    none = F.lit(None).cast(uses.schema["digests"].dataType)
    alone = some.cannot_have(held, "pid").select("pid", "text", none.alias("digests"))
    return known, written(met.union(alone).mapInArrow(_stored, STORED), "media-payloads"), shared


def read(payloads: DataFrame, shared: DataFrame, contents: bool = True) -> DataFrame:
    """What RESULT says of each payload, with its pid, from the stored tables alone."""
    listed = payloads.where("n_shared > 0").select("pid", F.explode(F.array_distinct(F.transform(F.filter("chunks", lambda c: c["bytes"].isNull()), lambda c: c["digest"]))).alias("digest"))
    found = written(listed.join(shared, "digest").groupBy("pid").agg(F.collect_list(F.struct("digest", "bytes")).alias("shared")), "media-lists")
    joined = payloads.where("n_shared > 0").join(found, "pid", "left").select("pid", "n_shared", "chunks", "shared")
    none = F.lit(None).cast(found.schema["shared"].dataType)
    alone = payloads.where("n_shared = 0").select("pid", "n_shared", "chunks", none.alias("shared"))
    names = [x for x in RESULT.split(", ") if x.split()[0] not in ("doc_id", "n_bytes")]
    schema = ["pid long", *(names if contents else names[:-1])]
    return joined.union(alone).mapInArrow(_media([x.split()[0] for x in schema]), ", ".join(schema))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contents: bool = True) -> DataFrame:
    """RESULT for each row: the payload as it is rebuilt from the stored chunks, how many chunks it has and how many of them are stored in common; with contents, the file itself."""
    known, payloads, shared = store(texts(docs, id_col, text_col))
    schema = [x.split()[0] for x in RESULT.split(", ")]
    return known.join(read(payloads, shared, contents), "pid").select(schema if contents else schema[:-1])
