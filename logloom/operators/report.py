"""Facts and profiles of a bundle's text files, product resolution, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.redact import redacted
from logloom.operators.rules import severity_rank

#: What the fact files look like, and limits of the report.
DISK_SHARE, SAMPLES, SAMPLE_CHARS, SOURCES = 0.05, 2, 400, 6
RULE_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.8, 0.4


def _number(x: Column) -> Column:
    plain = F.regexp_replace(F.replace(x, F.lit(","), F.lit(".")), r"\A([^.]*\.[^.]*)\..*\z", "$1")
    return F.coalesce(F.regexp_extract(plain, r"\A(\d*\.?\d+|\d+\.?)", 1).try_cast("double"), F.lit(0.0))


def disks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks after `Name -`: name, total and free megabytes, and whether little is free."""
    blocks = F.slice(F.split(F.col(text), "Name -", -1), F.lit(2), F.greatest(F.size(F.split(F.col(text), "Name -", -1)) - 1, F.lit(0)))
    own = texts.select(key, F.posexplode(blocks).alias("disk_ord", "b"))
    total, free = (_number(F.regexp_extract("b", rf"(?i){w} -\s*([\d.,]+)\s*Mb", 1)) for w in ("Total size", "Total free space"))
    out = own.select(key, F.col("disk_ord").cast("long"), T.trim(T.first_line(F.col("b"))).alias("name"), total.alias("total_mb"), free.alias("free_mb"))
    return out.withColumn("low", (F.col("total_mb") > 0) & (F.col("free_mb") / F.nullif("total_mb", F.lit(0.0)) < DISK_SHARE))


def facts(files: DataFrame) -> DataFrame:
    """files: (guardants, modules, ports), texts or null: the dongle, the number of modules and of open ports."""
    g = F.coalesce("guardants", F.lit(""))
    dongle = (F.length(g) > 0) & ~g.rlike("(?iu)not found|не найден")
    modules = F.when(F.length("modules") > 0, F.size(F.filter(F.split("modules", r"\r?\n"), lambda x: T.trim(x) != "")) - 1)
    ports = T.group(F.col("ports"), r"(\d+)\s+active ports found", 1).cast("int")
    return files.select(*[c for c in files.columns if c not in ("guardants", "modules", "ports")], dongle.alias("dongle_found"), modules.alias("modules"), ports.alias("open_ports"))


def profile(files: DataFrame) -> DataFrame:
    """files: (version, prometheus, ports, guardants): version, host and locale."""
    host = F.coalesce(T.group(F.col("prometheus"), r"replacement:\s*(\S+)", 1), T.group(F.col("ports"), r"Local computer name:\s*\n\s*\n\s*(\S+)", 1))
    locale = F.when(F.coalesce("guardants", F.lit("")).rlike("[А-Яа-я]"), "ru").otherwise("en")
    return files.select(*[c for c in files.columns if c not in ("version", "prometheus", "ports", "guardants")], F.nullif(T.trim(F.col("version")), F.lit("")).alias("version"), host.alias("host"), locale.alias("locale"))


def registry(defaults: DataFrame, active: DataFrame) -> DataFrame:
    """Brands (product, brand_key, head_log, version_prefix, family): active rows replace defaults of the same key and keep their place."""
    both = defaults.withColumn("_set", F.lit(0)).unionByName(active.withColumn("_set", F.lit(1)))
    key = F.lower(F.coalesce(F.nullif("brand_key", F.lit("")), F.nullif("head_log", F.lit("")), "product"))
    place = F.struct("_set", "entry_ord")
    merged = both.groupBy(key.alias("_key")).agg(F.max_by(F.struct("product", "brand_key", "head_log", "version_prefix", "family"), place).alias("e"), F.min(place).alias("_at"))
    return merged.select("e.*", F.row_number().over(Window.orderBy("_at")).alias("entry_ord"))


def product(bundles: DataFrame, entries: DataFrame) -> DataFrame:
    """bundles (id, version, head_logs): product and family by head log, else version prefix, else the shortest head log's name.

    entries is a registry of brands, at most a few hundred rows, kept as one array.
    """
    every = entries.agg(F.array_sort(F.collect_list(F.struct("entry_ord", "product", "head_log", "version_prefix", "family"))).alias("_e"))
    logs = F.transform("head_logs", F.lower)
    by_log = F.get(F.filter("_e", lambda e: e["head_log"].isNotNull() & F.array_contains(logs, F.lower(e["head_log"]))), F.lit(0))
    by_version = F.get(F.filter("_e", lambda e: F.col("version").isNotNull() & e["version_prefix"].isNotNull() & F.startswith("version", e["version_prefix"])), F.lit(0))
    shortest = F.array_min(F.transform("head_logs", lambda h, i: F.struct(F.length(h).alias("n"), i.alias("i"), h.alias("h"))))["h"]
    own = bundles.join(F.broadcast(every)).withColumn("_hit", F.coalesce(by_log, by_version))
    name = F.coalesce(F.col("_hit.product"), F.regexp_replace(shortest, r"(?i)\.log\z", ""), F.lit("Unknown product"))
    return own.select("id", name.alias("product"), F.coalesce(F.col("_hit.family"), T.family(F.coalesce("version", F.lit("")))).alias("family"), F.col("_hit").isNull().alias("auto_detected"))


def sources(found: DataFrame, group: str, order: str, most: int = SOURCES) -> DataFrame:
    """The first source of each url, or title without one, at most a few a group."""
    key = F.coalesce(F.nullif("url", F.lit("")), "title")
    first = found.groupBy(group, key.alias("_k")).agg(F.min_by(F.struct("title", "url", order), order).alias("s"))
    w = Window.partitionBy(group).orderBy(f"s.{order}")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(group, "s.title", "s.url", F.col("place").cast("long"))


def findings(problems: DataFrame, masked: bool = True, noise: bool = False) -> DataFrame:
    """Problems of the rules' path as report rows: time range, component, entities and files of the evidence, cause and solution, confidence, masked samples."""
    own = problems if noise else problems.where("severity <> 'noise'")
    e = F.col("evidence")
    flat = lambda f: F.array_distinct(F.flatten(F.transform(e, lambda x: x[f])))
    first_comp = F.get(F.filter(F.transform(e, lambda x: x["component"]), lambda c: F.coalesce(c, F.lit("")) != ""), F.lit(0))
    out = own.select("problem_ord", "rule_id", "severity", "subsystem", "title", "count", "storm", F.when(F.col("rule_id").isNotNull(), RULE_CONFIDENCE).otherwise(UNKNOWN_CONFIDENCE).alias("confidence"), first_comp.alias("component"), F.array_min(F.transform(e, lambda x: x["first_ts"])).alias("first_ts"), F.array_max(F.transform(e, lambda x: x["last_ts"])).alias("last_ts"), flat("entities").alias("entities"), flat("files").alias("files"), "retrieval_query", F.col("cause").alias("root_cause"), F.lit(None).cast("string").alias("impact"), F.coalesce("solution", F.array().cast("array<string>")).alias("solution"), F.transform(F.slice(e, 1, SAMPLES), lambda x: x["sample"]).alias("samples"))
    if not masked:
        return out
    lines = out.select("problem_ord", F.posexplode("samples").alias("i", "t")).withColumn("k", F.col("problem_ord").cast("long") * SAMPLES + F.col("i"))
    clean, _ = redacted(lines, "k", "t")
    samples = clean.groupBy("problem_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: F.substring(x["t"], 1, SAMPLE_CHARS)).alias("samples"))
    return out.drop("samples").join(samples, "problem_ord", "left")


def dated(findings: DataFrame) -> DataFrame:
    """Findings that have a time, in its order; equal times in the order of the report."""
    rank = severity_rank(F.col("severity"))
    return findings.where("first_ts is not null").orderBy("first_ts", rank, F.desc("count"), "problem_ord").select(F.col("first_ts").alias("ts"), "severity", "subsystem", "title", "count", "storm")


def masked_objects(objs: DataFrame) -> DataFrame:
    """Configuration objects (ord, name, ip, ...) with masked names and addresses, numbered in the order of the objects."""
    texts = objs.select("ord", F.posexplode(F.array("name", "ip")).alias("_i", "_text")).select((F.col("ord") * 2 + F.col("_i")).alias("_key"), "_text")
    clean, _ = redacted(texts, "_key", "_text")
    own = clean.groupBy(F.floor(F.col("_key") / 2).alias("ord")).agg(F.max(F.when(F.col("_key") % 2 == 0, F.col("_text"))).alias("name"), F.max(F.when(F.col("_key") % 2 == 1, F.col("_text"))).alias("ip"))
    return objs.drop("name", "ip").join(own, "ord").select(objs.columns)


def markdown(filename: str, made: dict) -> str:
    """A report, as `assembled` makes it, as text: profile, statistics, problems with cause, impact, solution, sources and a line of the first sample, and the noise."""
    p, s = made["profile"], made["stats"]
    out = [f"# Analysis of {filename}", "", f"- **Product:** {p.get('product')} ({p.get('family')})", f"- **Version:** {p.get('version') or '-'}", f"- **Host:** {p.get('host') or '-'}", f"- **Health:** {made['health']}/100", f"- **Analysed by:** {'model and rules' if made['analysed_by'] == 'model' else 'rules'}", f"- **Date:** {made['created_at']}", "", f"> {made['summary']}", ""]
    out += [f"**Statistics:** {s['signatures']} signatures, {s['errors']} errors, {s['warnings']} warnings, {s['files']} logs.", "", "## Problems"]
    if not made["problems"]:
        out.append("_None found._")
    for i, x in enumerate(made["problems"], 1):
        out += ["", f"### {i}. [{x['severity'].upper()}] {x['title']}", f"- Count: {x['count']}" + (" (storm)" if x["storm"] else ""), f"- Subsystem: {x['subsystem']}"]
        out += [f"- **{name}:** {x[c]}" for name, c in (("Cause", "root_cause"), ("Impact", "impact")) if x.get(c)]
        if x.get("solution"):
            out += ["- **Solution:**", *(f"  - {step}" for step in x["solution"])]
        if x.get("sources"):
            out += ["- **Sources:**", *(f"  - [{r['kind']}] {r['title']}" + (f" ({r['url']})" if r["url"] else "") for r in x["sources"])]
        if x.get("samples"):
            out += ["- Sample:", "  ```", f"  {x['samples'][0].split(chr(10))[0]}", "  ```"]
    if made["noise"]:
        out += ["", "## Suppressed noise", *(f"- {n['title']} x{n['count']}" for n in made["noise"])]
    return "\n".join(out)


def restart_allowed(stage: str, available: set[str]) -> bool:
    """Whether a run may begin at a stage, given the stages whose output is stored."""
    #: The stage whose output each needs.
    needs = {"extract": None, "parse": None, "timeline": None, "rules": "parse", "retrieval": "rules", "llm": "retrieval"}
    return stage in needs and (needs[stage] is None or needs[stage] in available)
