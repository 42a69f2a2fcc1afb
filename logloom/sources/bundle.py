"""Reading an extracted bundle: where its report is, its logs, small files, configuration objects and rules."""

from __future__ import annotations

import json
import os
import tarfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where things lie in a bundle.
LOGS, MARKER, REPORT, DEPTH = "Logs", "product_version.txt", "Report", 4
CONFIGS = ("Config.local/config_repo", "Config.local/clone_config_repo")


def extract(archive: str, to: str) -> str:
    """Unpack .zip, .tar, .tgz or .tar.gz on the driver; names that leave the folder are refused. Other formats need their own tool."""
    root = Path(to).resolve()
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            if any(not (root / n).resolve().is_relative_to(root) for n in z.namelist()):
                raise ValueError("a name in the archive leads out of the folder")
            z.extractall(root)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            t.extractall(root, filter="data")
    else:
        raise ValueError(f"unknown kind of archive: {archive}")
    return str(root)


def locate(root: str, depth: int = DEPTH) -> str | None:
    """The first folder, breadth first, that has logs or the version file; else a child named for the report."""
    level = [Path(root)]
    for _ in range(depth + 1):
        below: list[Path] = []
        for d in level:
            if (d / LOGS).is_dir() or (d / MARKER).is_file():
                return str(d)
            children = sorted(x for x in d.iterdir() if x.is_dir())
            if (d / REPORT) in children:
                return str(d / REPORT)
            below += children
        level = below
    return None


def log_lines(spark: SparkSession, report: str) -> DataFrame:
    """(file, pos, line) of the logs; pos orders the lines of a file."""
    text = spark.read.text(f"{report}/{LOGS}/*.log")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return text.select(F.col("_metadata.file_name").alias("file"), at.alias("pos"), F.col("value").alias("line"))


def text_lines(blobs: DataFrame, key: str, text: str) -> DataFrame:
    """(file, pos, line) of texts in a column."""
    return blobs.select(F.col(key).alias("file"), F.posexplode(F.split(F.col(text), r"\r?\n", -1)).alias("pos", "line"))


def small_file(report: str, name: str) -> str | None:
    path = os.path.join(report, name)
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def configs(spark: SparkSession, report: str) -> DataFrame | None:
    """(key, main, meta, offers) of the configuration objects in the first repository that exists."""
    repo = next((f"{report}/{c}" for c in CONFIGS if os.path.isdir(f"{report}/{c}")), None)
    if repo is None:
        return None
    whole = spark.read.option("wholetext", True).text(f"{repo}/*/*.conf").select(F.col("_metadata.file_path").alias("path"), "value")
    named = whole.select(F.element_at(F.split("path", "/"), -2).alias("key"), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.conf\z", "").alias("file"), "value")
    return named.where(~F.startswith("key", F.lit("."))).groupBy("key").pivot("file", ["main", "meta", "offers"]).agg(F.first("value"))


def rules(folder: str) -> list[dict]:
    """Rules of all .json files of a folder, and of .yaml files where a YAML library is installed."""
    found: list[dict] = []
    for path in sorted(Path(folder).iterdir()):
        if path.suffix == ".json":
            found += json.loads(path.read_text()).get("rules", [])
        elif path.suffix in (".yaml", ".yml"):
            try:
                import yaml
            except ModuleNotFoundError as e:
                raise RuntimeError(f"{path} needs a YAML library") from e
            found += (yaml.safe_load(path.read_text()) or {}).get("rules", [])
    return [_flat(r) for r in found]


def _flat(r: dict) -> dict:
    m = r.get("match", {})
    return {"id": r["id"], "severity": r["severity"], "subsystem": r["subsystem"], "title": r["title"], "component": m.get("component"), "any_of": m.get("anyOf"), "all_of": m.get("allOf"), "min_per_minute": (r.get("frequency") or {}).get("minPerMinute"), "applies_to": r.get("appliesTo"), "cause": r.get("cause"), "solution": r.get("solution"), "retrieval_query": r.get("retrievalQuery")}
