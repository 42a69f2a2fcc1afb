"""The life of an analysis in metadata tables: upload, progress, cancel, restart, report, delete; rules, brands and settings that users edit."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.report import markdown, restart_allowed
from logloom.sources.sinks import Table
from logloom.sources.store import Store

#: The stages with the progress each begins at, where the shown steps end, states, and the sizes of lists.
STAGES = {"extract": 2, "parse": 18, "timeline": 40, "rules": 57, "retrieval": 69, "llm": 80}
STEP_ENDS = (18, 57, 69, 80, 100)
RUNNING, ENDED = ("processing", "queued"), ("done", "error", "cancelled")
HISTORY, PAGE, RECENT = 100, 10, 5
SEVERITIES = ("critical", "warning", "info", "noise")
SUBSYSTEMS = ("license", "cameras", "archive", "detectors", "network", "hardware", "other")
PART_BYTES, MOST_BYTES = 64 << 20, 8 << 30

ANALYSES = "id string, filename string, size long, storage_key string, status string, progress int, stage string, cancel_requested int, available_stages array<string>, product string, version string, host string, health_score int, problem_count int, report string, error string, created_at timestamp, updated_at timestamp"
RULES = "id string, key string, severity string, subsystem string, title string, component string, any_of array<string>, all_of array<string>, min_per_minute int, cause string, solution array<string>, applies_to array<string>, retrieval_query string, enabled boolean, source string, created_at timestamp, updated_at timestamp"
BRANDS = "id string, product string, brand_key string, head_log string, version_prefix string, family string, active boolean, created_at timestamp, updated_at timestamp"
SETTINGS = "id int, data string, updated_at timestamp"


class NotFound(LookupError):
    pass


class Conflict(RuntimeError):
    pass


class Cancelled(RuntimeError):
    pass


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


# ---------------------------------------------------------------- analyses


class Analyses:
    """Analyses by id, with their objects in the same store: `checkpoints/<id>/`, `timeline/<id>/` and the uploaded bundle."""

    def __init__(self, spark: SparkSession, root: str):
        self.table, self.store = Table(spark, root, "analyses", ANALYSES), Store(spark, root)

    def _set(self, id_: str, **values) -> None:
        self.table.update(F.col("id") == id_, updated_at=_now(), **values)

    def insert(self, filename: str, size: int, storage_key: str | None) -> str:
        """A queued analysis; its id."""
        id_, now = str(uuid.uuid4()), _now()
        self.table.insert({"id": id_, "filename": filename, "size": size, "storage_key": storage_key, "status": "queued", "progress": 0, "stage": "queued", "cancel_requested": 0, "available_stages": [], "created_at": now, "updated_at": now})
        return id_

    def get(self, id_: str) -> dict:
        row = self.table.get(id_)
        if row is None:
            raise NotFound(id_)
        return row

    def by_storage_key(self, key: str) -> dict | None:
        rows = self.table.read().where(F.col("storage_key") == key).limit(1).collect()
        return rows[0].asDict(True) if rows else None

    def history(self, most: int = HISTORY) -> DataFrame:
        """The newest few, without reports."""
        return self.table.read().drop("report").orderBy(F.desc("created_at"), "id").limit(most)

    def status(self, id_: str) -> dict:
        row = self.table.get(id_)
        return {c: row[c] for c in ("status", "progress", "stage", "error")} if row else {"status": "error", "error": "not found"}

    def polled(self, id_: str, every: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
        """The status again and again until the analysis has ended."""
        while True:
            now = self.status(id_)
            yield now
            if now["status"] in ENDED:
                return
            sleep(every)

    def progress(self, id_: str, stage: str, progress: int) -> None:
        self._set(id_, status="processing", stage=stage, progress=progress)

    def available(self, id_: str, stage: str) -> None:
        """A stage's output is stored; sets of stages keep their order."""
        self._set(id_, available_stages=F.array_union("available_stages", F.array(F.lit(stage))))

    def cancel(self, id_: str) -> bool:
        """Asks a running analysis to stop; whether it runs."""
        if self.get(id_)["status"] not in RUNNING:
            return False
        self._set(id_, cancel_requested=1)
        return True

    def guard(self, id_: str) -> None:
        if self.get(id_)["cancel_requested"]:
            raise Cancelled(id_)

    def rerun(self, id_: str, stage: str = "extract") -> dict:
        """Queues an analysis again from a stage; what a worker needs to know."""
        if stage not in STAGES:
            raise ValueError(f"no such stage: {stage}")
        row = self.get(id_)
        if not row["storage_key"]:
            raise Conflict("the archive is gone")
        if row["status"] in RUNNING:
            raise Conflict("already running")
        if not restart_allowed(stage, set(row["available_stages"] or ())):
            raise Conflict("a stage before has no stored output")
        self._set(id_, status="queued", stage="queued", progress=STAGES[stage], error=None, cancel_requested=0)
        return {"id": id_, "storage_key": row["storage_key"], "filename": row["filename"], "from_stage": stage}

    def finish(self, id_: str, report: dict) -> None:
        """The report, and beside it what lists of analyses show."""
        p = report["profile"]
        self._set(id_, status="done", progress=100, stage="done", report=json.dumps(report, ensure_ascii=False, default=str), product=p.get("product"), version=p.get("version"), host=p.get("host"), health_score=report["health"], problem_count=len(report["problems"]), error=None)

    def stopped(self, id_: str) -> None:
        self._set(id_, status="cancelled", stage="cancelled", cancel_requested=0)

    def failed(self, id_: str, error: str) -> None:
        self._set(id_, status="error", error=error)

    def run(self, id_: str, steps: list[tuple[str, Callable[[], object]]], from_stage: str = "extract") -> bool:
        """Runs the steps (stage, function) from a stage on; the last one returns the report. Each asks for a cancel first, and its output is available then. Whether it ended well."""
        self._set(id_, status="processing", error=None, cancel_requested=0)
        order = list(STAGES)
        result = None
        try:
            for stage, step in steps:
                if order.index(stage) < order.index(from_stage):
                    continue
                self.guard(id_)
                self.progress(id_, stage, STAGES[stage])
                result = step()
                self.available(id_, stage)
            self.finish(id_, result)
        except Cancelled:
            self.stopped(id_)
            return False
        except Exception as e:
            self.failed(id_, str(e))
            raise
        return True

    def exported(self, id_: str, kind: str = "md") -> str:
        """The stored report as JSON or Markdown."""
        row = self.table.get(id_)
        if not row or not row["report"]:
            raise NotFound("no report yet")
        report = json.loads(row["report"])
        return json.dumps(report, ensure_ascii=False, indent=2) if kind == "json" else markdown(row["filename"], report)

    def delete(self, id_: str) -> None:
        """The row and all its objects; objects that are missing already don't stop it."""
        row = self.get(id_)
        for key in (row["storage_key"], f"{row['storage_key']}.info"):
            if row["storage_key"]:
                self.store.delete(key)
        for folder in ("checkpoints", "timeline"):
            self.store.delete_prefix(f"{folder}/{id_}")
        self.table.delete(F.col("id") == id_)


def playable(stages: Column) -> Column:
    """Whether a timeline is there."""
    return F.coalesce(F.array_contains(stages, "timeline"), F.lit(False))


def default_bundle(history: DataFrame) -> DataFrame:
    """One row: the newest analysis with a timeline, without one the newest."""
    return history.orderBy(F.desc(playable(F.col("available_stages"))), F.desc("created_at"), "id").limit(1)


def current_step(progress: int, status: str = "processing") -> int:
    """The first shown step that isn't over; all of them when the analysis is done."""
    return len(STEP_ENDS) if status == "done" else next((i for i, end in enumerate(STEP_ENDS) if progress < end), -1)


def page_count(rows: int, size: int = PAGE) -> int:
    return max(1, -(-rows // size))


class Uploads:
    """Uploads in parts that can be resumed: a part is taken only where the last one ended. When all bytes are there, the bundle is one object and an analysis is queued."""

    def __init__(self, analyses: Analyses, most: int = MOST_BYTES):
        self.analyses, self.store, self.most = analyses, analyses.store, most

    def begin(self, filename: str, size: int) -> str:
        if size > self.most:
            raise ValueError(f"more than {self.most} bytes")
        id_ = uuid.uuid4().hex
        self.store.put_json(f"uploads/{id_}.info", {"filename": filename or f"{id_}.7z", "size": size})
        return id_

    def offset(self, id_: str) -> int:
        return sum(self.store.size(f"uploads/{id_}.parts/{n}") for n in self.store.names(f"uploads/{id_}.parts"))

    def append(self, id_: str, offset: int, data: bytes) -> str | None:
        """The analysis's id when this was the last part."""
        info, at = self.store.get_json(f"uploads/{id_}.info"), self.offset(id_)
        if offset != at:
            raise Conflict(f"the next byte is {at}")
        if at + len(data) > info["size"]:
            raise ValueError("more bytes than announced")
        self.store.put(f"uploads/{id_}.parts/{at:020d}", data)
        if at + len(data) < info["size"]:
            return None
        jvm, fs, path = self.store.spark._jvm, self.store._fs, self.store._path
        out = fs.create(path(self.store.at(f"uploads/{id_}")), True)
        try:
            for n in self.store.names(f"uploads/{id_}.parts"):
                part = fs.open(path(self.store.at(f"uploads/{id_}.parts/{n}")))
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(part, out)
                finally:
                    part.close()
        finally:
            out.close()
        self.store.delete_prefix(f"uploads/{id_}.parts")
        return self.analyses.insert(info["filename"], info["size"], f"uploads/{id_}")


# ---------------------------------------------------------------- rules, brands, settings


def text_list(x) -> list[str]:
    """A list, or the lines of a text, trimmed and without empty ones."""
    items = x if isinstance(x, list | tuple) else x.split("\n") if isinstance(x, str) else []
    return [s for s in (str(i).strip() for i in items) if s]


def _clean(x) -> str | None:
    return (str(x).strip() or None) if x is not None else None


def _positive(x) -> int | None:
    try:
        n = float(x)
    except (TypeError, ValueError):
        return None
    return int(n + 0.5) if 0 < n < float("inf") else None


class RuleBook:
    """Rules that users write or capture from findings."""

    _KINDS = {"title": lambda v: str(v).strip(), "key": lambda v: str(v).strip(), "severity": str, "subsystem": str, "component": _clean, "any_of": text_list, "all_of": text_list, "min_per_minute": _positive, "cause": _clean, "solution": text_list, "applies_to": text_list, "retrieval_query": _clean, "enabled": bool}

    def __init__(self, spark: SparkSession, root: str):
        self.table = Table(spark, root, "rules", RULES)

    def listed(self) -> DataFrame:
        return self.table.read().orderBy(F.desc("created_at"), "id")

    def insert(self, body: dict) -> dict:
        if not body.get("title"):
            raise ValueError("a rule needs a title")
        row = {c: kind(body[c]) if c in body else kind(None) if kind in (_clean, text_list, _positive) else None for c, kind in self._KINDS.items()}
        if not (row["component"] or row["any_of"] or row["all_of"]):
            raise ValueError("a rule needs a component or a phrase")
        stem = re.sub(r"\A-+|-+\Z", "", re.sub(r"[^a-z0-9а-я]+", "-", row["title"].lower()))[:40]
        row |= {"id": str(uuid.uuid4()), "key": row["key"] or f"{stem or 'rule'}-{uuid.uuid4().hex[:5]}", "severity": row["severity"] if row["severity"] in SEVERITIES else "warning", "subsystem": row["subsystem"] if row["subsystem"] in SUBSYSTEMS else "other", "enabled": body.get("enabled") is not False, "source": "captured" if body.get("source") == "captured" else "manual", "created_at": _now(), "updated_at": _now()}
        return self.table.insert(row)

    def update(self, id_: str, body: dict) -> dict:
        if self.table.get(id_) is None:
            raise NotFound(id_)
        values = {c: kind(body[c]) for c, kind in self._KINDS.items() if c in body}
        self.table.update(F.col("id") == id_, updated_at=_now(), **values)
        return self.table.get(id_)

    def delete(self, id_: str) -> None:
        self.table.delete(F.col("id") == id_)

    def enabled(self) -> list[dict]:
        """The rules in force, as the rule base takes them; empty lists are no condition."""
        rows = self.table.read().where("enabled").orderBy("created_at", "id").collect()
        names = ("severity", "subsystem", "title", "component", "any_of", "all_of", "min_per_minute", "applies_to", "cause", "solution", "retrieval_query")
        return [{"id": r["key"], **{c: r[c] or None for c in names}} for r in rows]


class Brands:
    """Brands that users add to the built-in ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = Table(spark, root, "brands", BRANDS)

    def listed(self) -> DataFrame:
        return self.table.read().orderBy(F.desc("created_at"), "id")

    def insert(self, body: dict) -> dict:
        if not _clean(body.get("product")):
            raise ValueError("a brand needs a product")
        names = ("product", "brand_key", "head_log", "version_prefix", "family")
        return self.table.insert({"id": str(uuid.uuid4()), **{c: _clean(body.get(c)) for c in names}, "active": body.get("active") is not False, "created_at": _now(), "updated_at": _now()})

    def update(self, id_: str, body: dict) -> dict:
        if self.table.get(id_) is None:
            raise NotFound(id_)
        values = {c: _clean(body[c]) for c in ("product", "brand_key", "head_log", "version_prefix", "family") if c in body}
        self.table.update(F.col("id") == id_, updated_at=_now(), **values, **({"active": bool(body["active"])} if "active" in body else {}))
        return self.table.get(id_)

    def delete(self, id_: str) -> None:
        self.table.delete(F.col("id") == id_)

    def active(self) -> DataFrame:
        """Active brands with their order, as the registry takes them."""
        rows = self.table.read().where("active").orderBy("created_at", "id").collect()
        names = ("product", "brand_key", "head_log", "version_prefix", "family")
        return self.table.spark.createDataFrame([(i, *(r[c] for c in names)) for i, r in enumerate(rows)], "entry_ord int, product string, brand_key string, head_log string, version_prefix string, family string")


class Settings:
    """One document of settings over defaults. Empty values don't replace defaults, and an empty secret leaves the stored one."""

    def __init__(self, spark: SparkSession, root: str, defaults: dict, secrets: tuple[str, ...] = ()):
        self.table, self.defaults, self.secrets = Table(spark, root, "settings", SETTINGS), defaults, secrets

    def _stored(self) -> dict:
        row = self.table.get(1)
        return json.loads(row["data"]) if row else {}

    def load(self) -> dict:
        return overlaid(self.defaults, self._stored())

    def save(self, patch: dict) -> dict:
        clean = {k: v for k, v in patch.items() if not (k in self.secrets and v in ("", None))}
        new = self._stored() | clean
        self.table.insert({"id": 1, "data": json.dumps(new), "updated_at": _now()})
        return overlaid(self.defaults, new)

    def shown(self) -> dict:
        return masked(self.load(), self.secrets)


def overlaid(defaults: dict, stored: dict) -> dict:
    return defaults | {k: v for k, v in stored.items() if v is not None and v != ""}


def masked(settings: dict, secrets: tuple[str, ...]) -> dict:
    """Secrets as whether they are set."""
    return {k: v for k, v in settings.items() if k not in secrets} | {f"{k}_set": bool(settings.get(k)) for k in secrets}


def overlaid_columns(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """The same for a table with a column for each setting."""
    return rows.withColumns({c: F.coalesce(F.nullif(T.trim(F.col(c)), F.lit("")), F.lit(v)) for c, v in defaults.items()})


def masked_columns(rows: DataFrame, secrets: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({f"{c}_set": F.col(c).isNotNull() & (F.col(c) != "") for c in secrets}).drop(*secrets)
