"""A bundle from its folder to a report and a timeline; each stage is stored and can be read back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import correlate, evidence, inventory, records, redact, report, rules, timeline, view
from logloom.sources import bundle, sinks
from logloom.sources.scratch import written
from logloom.sources.store import Store

#: Where the small files of a bundle are.
FILES = {"version": "product_version.txt", "prometheus": "Prometheus/config/prometheus.yaml", "ports": "ports.txt", "guardants": "guardants.txt", "modules": "modules_version.csv", "drives": "drives_defrag_info.txt"}


def system(spark: SparkSession, at: str, brands: DataFrame | None = None) -> tuple[dict, dict]:
    """(profile, facts) of a bundle, from its small files."""
    import os

    texts = {k: bundle.small_file(at, p) for k, p in FILES.items()}
    row = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{k} string" for k in texts))
    profile = report.profile(row.select("version", "prometheus", "ports", "guardants")).first().asDict()
    logs = sorted(f for f in os.listdir(f"{at}/{bundle.LOGS}") if f.endswith(".log")) if os.path.isdir(f"{at}/{bundle.LOGS}") else []
    heads = [f for f in logs if not f.lower().startswith("app_host.")]
    one = spark.createDataFrame([(0, profile["version"], heads)], "id int, version string, head_logs array<string>")
    none = "entry_ord int, product string, brand_key string, head_log string, version_prefix string, family string"
    entries = report.registry(spark.createDataFrame([], none), brands if brands is not None else spark.createDataFrame([], none))
    profile |= report.product(one, entries).drop("id").first().asDict()
    facts = report.facts(row.select("guardants", "modules", "ports")).first().asDict()
    disks = report.disks(row.select(F.lit(0).alias("id"), "drives").where("drives is not null"), "id", "drives").orderBy("disk_ord").collect()
    facts["disks"] = [{"name": d["name"], "total_mb": d["total_mb"], "free_mb": d["free_mb"]} for d in disks]
    facts["notes"] = [f"little room on disk {d['name']}: {d['free_mb']:.0f} MB free" for d in disks if d["low"]] + (["no licence key found"] if texts["guardants"] and not facts["dongle_found"] else [])
    return profile, facts


def equipment(confs: DataFrame) -> dict[str, DataFrame]:
    """Objects, their classes, components with hub and label, members and the aliases that log entities are resolved by."""
    objs = inventory.objects(confs)
    numbered = written(objs.join(inventory.ordinals(objs), "key").withColumn("n_offers", F.size("offers").cast("long")), "objects")
    links = written(inventory.edges(numbered), "edges")
    members = inventory.components(numbered.select("key", "ord"), links)
    hubs = inventory.hubs(members.join(numbered.select("key", "n_offers"), "key"), links)
    named = numbered.select(F.col("key").alias("hub"), "cls", "name")
    hubs = hubs.join(named, "hub").select("component_id", "hub", "size", view.component_label(F.col("cls"), F.col("name"), F.col("hub"), F.lit(1)).alias("label"), view.component_label(F.col("cls"), F.col("name"), F.col("hub"), F.col("size")).alias("chain_label"))
    owners = numbered.select("key", "ord", F.explode("aliases").alias("alias")).join(members.select("key", "component_id"), "key").join(hubs, "component_id")
    aliases = owners.select("alias", F.concat(F.lit("equipment:"), F.col("hub")).alias("owner"), "ord", F.col("chain_label").alias("label"))
    return {"objects": numbered, "classes": view.class_list(numbered), "members": members, "hubs": hubs, "aliases": aliases}


def analyse(
    spark: SparkSession,
    folder: str,
    out: str,
    rule_sets: tuple[list[dict], ...],
    run: str = "run",
    family: str | None = None,
    unknown_count: int = rules.UNKNOWN_COUNT,
    brands: DataFrame | None = None,
    retrieval: evidence.Retrieval | None = None,
    model=None,
    embed=None,
    mask: bool = True,
) -> dict:
    """Tables by name (records, signatures, problems, findings, correlations, health, timeline, ...), the report and the manifest."""
    at = bundle.locate(folder)
    if at is None:
        raise FileNotFoundError(f"no report in {folder}")
    store = Store(spark, out)
    profile, facts = system(spark, at, brands)
    recs = sinks.stage(records.records(bundle.log_lines(spark, at)), out, run, "records")
    sigs = sinks.stage(records.signatures(recs), out, run, "signatures")
    result = {"profile": profile, "facts": facts, "records": recs, "signatures": sigs}
    result |= player_tables(store, recs, run, embed)

    found = sinks.stage(rules.problems(rules.first_match(sigs, rules.rule_base(*rule_sets), family or profile["family"]), unknown_count), out, run, "problems")
    shown = sinks.stage(report.findings(found, mask), out, run, "findings")
    confs = bundle.configs(spark, at)
    gear = equipment(confs) if confs is not None else None
    if gear:
        result |= gear
    resolved = correlate.equipped(shown, gear["aliases"] if gear else None)
    chains = correlate.correlations(correlate.items(resolved), labels=gear["aliases"].select(F.col("owner").alias("entity"), "label") if gear else None)

    lookups = retrieval or evidence.Retrieval(None)
    context = shown.select("problem_ord", F.get("samples", F.lit(0)).alias("context"))
    answers = evidence.retrieved(found.join(context, "problem_ord", "left"), lookups, profile["version"], family or profile["family"], profile["locale"])
    answers = sinks.stage(answers, out, run, "retrieval")
    final = evidence.with_sources(resolved, answers)
    health = rules.health(found)
    told = evidence.summary(found, health.first()["health"]).first()
    by, words, score = "rules", told["summary"], health.first()["health"]
    if model is not None:
        every = evidence.with_sources(correlate.equipped(report.findings(found, True, noise=True), gear["aliases"] if gear else None), answers)
        numbered = chains.withColumn("ord", F.row_number().over(Window.orderBy(rules.severity_rank(F.col("severity")), F.desc("n_steps"), "chain")))  # a few rows
        parts = [evidence.system_lines(spark, profile, facts), evidence.problem_lines(every, answers), evidence.chain_lines(numbered)]
        if gear:
            tops = view.trees(gear["hubs"], evidence.COMPONENTS)
            parts.append(evidence.gear_lines(gear["classes"], tops, view.tree_members(tops, gear["members"], gear["objects"])))
        text = evidence.pack(*parts)
        got = evidence.model_findings(spark, text, model)
        if got:
            own, words, score = got
            by, final = "model", evidence.linked(own, every).withColumnsRenamed({"finding_ord": "problem_ord"})
            chains = correlate.correlations(correlate.items(final), labels=gear["aliases"].select(F.col("owner").alias("entity"), "label") if gear else None)
    result |= {"problems": found, "findings": shown, "final": final, "correlations": chains, "health": health, "retrieval": answers}
    result["report"] = assembled(result, by, words, score, gear, mask)
    store.put_json(f"reports/{run}.json", result["report"])
    return result


def player_tables(store: Store, recs: DataFrame, run: str, embed=None) -> dict:
    """The timeline of the records, stored with its manifest; without a dated event there is none."""
    parsed = sinks.stage(timeline.events(recs, ["file", "rec_ord"]), store.root, run, "events")
    events = timeline.numbered(parsed, ["file", "rec_ord"])
    if not parsed.limit(1).count():
        return {"timeline": events, "manifest": None}
    path = sinks.timeline(events, store.root, run)
    events = store.spark.read.schema(events.schema).parquet(path)
    lo, hi = timeline.bounds(events)
    hist = timeline.histogram(events, lo, hi)
    index = evidence.semantic_index(timeline.significant(events), embed, _masked_texts)
    if index is not None:
        index.write.mode("overwrite").parquet(store.at(f"timeline/{run}/vectors"))
    made = sinks.manifest(store, run, sinks.zone_map(store.spark, path), timeline.lanes(events), hist, timeline.chapters(events, hist, lo, hi), timeline.BUCKETS, has_embeddings=index is not None)
    return {"timeline": events, "manifest": made, "timeline_path": path, "semantic_index": index}


def _masked_texts(rows: DataFrame) -> DataFrame:
    return redact.redacted(rows, "seq", "text")[0]


def assembled(result: dict, by: str, words: str, score: int, gear: dict | None, mask: bool) -> dict:
    """The report as one object. Its lists are bounded: a problem for each rule, and a few more."""
    rank = rules.severity_rank(F.col("severity"))
    final = result["final"].withColumn("id", F.concat(F.lit("p"), F.col("problem_ord").cast("string"))).orderBy(rank, F.desc("count"), "problem_ord")
    counts = records.counters(result["records"]).first()
    noise = result["problems"].where("severity = 'noise'").orderBy("problem_ord").select("title", "count", "rule_id").collect()
    made = {
        "profile": result["profile"],
        "facts": result["facts"],
        "health": score,
        "summary": words,
        "analysed_by": by,
        "problems": [r.asDict(True) for r in final.collect()],
        "noise": [r.asDict() for r in noise],
        "timeline": [r.asDict() for r in report.dated(result["final"]).collect()],
        "correlations": [r.asDict(True) for r in result["correlations"].collect()],
        "stats": {"signatures": result["signatures"].count(), "errors": counts["errors"], "warnings": counts["warnings"], "files": counts["files"], "noise_lines": sum(r["count"] for r in noise)},
        "created_at": datetime.now(timezone.utc).isoformat(),
    }
    if gear:
        objs = gear["objects"].join(gear["members"].select("key", "component_id"), "key").select("ord", "key", "cls", "instance", "name", "offers", "ip", "model", "component_id")
        labels = gear["hubs"].select("component_id", "hub", "label", "size")
        if mask:
            objs, labels = report.masked_objects(objs), redact.redacted(labels, "component_id", "label")[0]
        made["inventory"] = {"classes": [r.asDict() for r in gear["classes"].collect()], "components": [r.asDict() for r in labels.orderBy("component_id").collect()], "objects": [r.asDict(True) for r in objs.orderBy("ord").drop("ord").collect()]}
    return made


def printed(made: dict, show=print) -> None:
    """A report on the console."""
    show(f"{made['profile'].get('product')} {made['profile'].get('version') or ''}, health {made['health']}/100 ({made['analysed_by']})")
    show(made["summary"])
    show(", ".join(f"{k} {v}" for k, v in made["stats"].items()))
    for p in made["problems"]:
        show(f"\n[{p['severity'].upper()}] {p['title']} x{p['count']}" + (" (storm)" if p["storm"] else ""))
        for name, value in (("cause", p.get("root_cause") or p.get("cause")), ("solution", " | ".join(p.get("solution") or [])), ("sample", (p.get("samples") or [""])[0].split("\n")[0])):
            if value:
                show(f"  {name}: {value}")
    for n in made["noise"]:
        show(f"  noise: {n['title']} x{n['count']}")


def main(args: list[str]) -> int:
    """python -m logloom.plans.analysis FOLDER [RULES [OUT]]: analyses an extracted bundle and prints the report."""
    import tempfile

    if not args:
        print(main.__doc__)
        return 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    base = bundle.rules(args[1]) if len(args) > 1 else []
    got = analyse(spark, args[0], args[2] if len(args) > 2 else tempfile.mkdtemp(prefix="logloom-"), (base,))
    printed(got["report"])
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
