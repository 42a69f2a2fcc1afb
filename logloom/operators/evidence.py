"""What goes to outside helpers and comes back: evidence packs, retrieved sources, findings of a language model, embeddings.

The helpers are functions that a caller passes in; without one, or when one fails, its result is none and the rules' path stands. Whatever leaves is masked first.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.report import SOURCES

#: How much of everything is sent.
BATCH, TARGETS, DOCUMENTS, COMPONENTS, PROMPT_CHARS = 96, 6, 6, 20, 24_000
SAMPLE_CHARS, ANSWER_CHARS, SHOWN_SOURCES, EXPLAIN_ROWS, EXPLAIN_CHARS = 300, 400, 3, 120, 12_000

log = logging.getLogger(__name__)


# ---------------------------------------------------------------- embeddings


def embedded(texts: list[str], embed: Callable[[list[str]], list[list[float]]] | None, batch: int = BATCH) -> list[list[float]] | None:
    """Vectors of texts, a batch at a time; none without a helper, without texts, or if a batch fails."""
    if embed is None or not texts:
        return None
    out: list[list[float]] = []
    try:
        for i in range(0, len(texts), batch):
            out += embed(texts[i : i + batch])
    except Exception:
        log.warning("no embeddings", exc_info=True)
        return None
    return out if len(out) == len(texts) else None


def semantic_index(significant: DataFrame, embed: Callable | None, mask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """The significant events (a bounded list) with their vectors; none if they can't be embedded. mask: takes and gives a frame with seq and text."""
    rows = significant.withColumn("text", F.concat_ws(" ", "service", "level", "message"))
    found = (mask(rows) if mask else rows).orderBy("seq").collect()
    vectors = embedded([r["text"] for r in found], embed)
    if vectors is None:
        return None
    own = [(r["ts_ms"], r["seq"], r["service"], r["level"], r["text"], [float(x) for x in v]) for r, v in zip(found, vectors, strict=True)]
    return significant.sparkSession.createDataFrame(own, "ts_ms long, seq long, service string, level string, text string, vector array<double>")


# ---------------------------------------------------------------- retrieval


class Retrieval:
    """Answers of a knowledge base, remembered by (query, version, subsystem). ask: takes the keyword arguments of `one` and gives {answer, confidence, sources: [{title, url, product, similarity}]} or None."""

    def __init__(self, ask: Callable[..., dict | None] | None, product_hints: dict[str, str] | None = None, topic_hints: dict[str, list[str]] | None = None):
        self.ask, self.product_hints, self.topic_hints = ask, product_hints or {}, topic_hints or {}
        self.known: dict[tuple, dict] = {}

    def one(self, query: str, version: str | None = None, subsystem: str | None = None, family: str = "unknown", context: str | None = None, locale: str = "en") -> dict | None:
        key = (query, version, subsystem or "")
        if key in self.known:
            return self.known[key]
        if self.ask is None:
            return None
        try:
            got = self.ask(query=query, version=version, context=context, product_hint=self.product_hints.get(family), topic_hints=self.topic_hints.get(subsystem or "", []), locale=locale)
        except Exception:
            log.warning("nothing retrieved for %r", query, exc_info=True)
            return None
        if not got or not got.get("answer"):
            return None
        sources = [{"kind": source_kind(s.get("product")), "title": s["title"], "url": s.get("url"), "similarity": s.get("similarity")} for s in (got.get("sources") or [])[:DOCUMENTS]]
        self.known[key] = {"query": query, "answer": got["answer"], "confidence": float(got.get("confidence") or 0), "sources": sources}
        return self.known[key]


RETRIEVED = "query string, answer string, confidence double, sources array<struct<kind: string, title: string, url: string, similarity: double>>"


def source_kind(product: str | None) -> str:
    return "jira" if (product or "").lower().startswith("jira") else "doc"


def targets(problems: DataFrame, most: int = TARGETS) -> DataFrame:
    """The first problems to look up, noise aside."""
    return problems.where("severity <> 'noise'").orderBy("problem_ord").limit(most)


def retrieved(problems: DataFrame, retrieval: Retrieval, version: str | None = None, family: str = "unknown", locale: str = "en") -> DataFrame:
    """(query, answer, confidence, sources) of the targets; problems have masked `context`."""
    rows = targets(problems).select("retrieval_query", "subsystem", "context").collect()
    found = {r["retrieval_query"]: got for r in rows if (got := retrieval.one(r["retrieval_query"], version, r["subsystem"], family, r["context"], locale))}
    own = [(g["query"], g["answer"], g["confidence"], [(s["kind"], s["title"], s["url"], s["similarity"]) for s in g["sources"]]) for g in found.values()]
    return problems.sparkSession.createDataFrame(own, RETRIEVED)


def distinct_sources(sources: Column, most: int = SOURCES) -> Column:
    """The first source of each address, or title without one, at most a few."""
    keyed = F.transform(sources, lambda s: F.struct(F.coalesce(F.nullif(s["url"], F.lit("")), s["title"]).alias("k"), s.alias("s")))
    keys = F.transform(keyed, lambda x: x["k"])
    first = F.filter(keyed, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.slice(F.transform(first, lambda x: x["s"]), 1, most)


def with_sources(problems: DataFrame, found: DataFrame, query: str = "retrieval_query") -> DataFrame:
    """problems with the sources that their query has; problems of one query share them."""
    none = F.array().cast(found.schema["sources"].dataType)
    own = found.select(F.col("query").alias(query), distinct_sources(F.col("sources")).alias("sources"))
    return problems.join(own, query, "left").withColumn("sources", F.coalesce("sources", none))


# ---------------------------------------------------------------- findings of a model


def linked(findings: DataFrame, problems: DataFrame) -> DataFrame:
    """findings (finding_ord, severity, subsystem, title, root_cause, impact, solution, confidence, evidence_refs) with what their evidence says. References are places in the whole list of problems, noise included; those beyond it are dropped.

    problems: problem_ord, rule_id, count, storm, component, first_ts, last_ts, entities, files, samples, sources.
    """
    refs = findings.select("finding_ord", F.posexplode("evidence_refs").alias("i", "problem_ord")).join(problems, "problem_ord")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("i")))
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]))
    own = refs.groupBy("finding_ord").agg(
        F.sum("count").alias("count"),
        F.max("storm").alias("storm"),
        F.min_by("rule_id", "i").alias("rule_id"),
        first("component").alias("component"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.array_distinct(in_order("entities")).alias("entities"),
        F.array_distinct(in_order("files")).alias("files"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.slice("samples", 1, 1).alias("s")))), lambda x: F.get(x["s"], F.lit(0))).alias("samples"),
        distinct_sources(in_order("sources")).alias("sources"),
    )
    out = findings.drop("evidence_refs").join(own, "finding_ord", "left")
    none = F.array().cast("array<string>")
    filled = out.withColumns({"count": F.coalesce("count", F.lit(0)), "storm": F.coalesce("storm", F.lit(False)), "entities": F.coalesce("entities", none), "files": F.coalesce("files", none), "samples": F.filter(F.coalesce("samples", none), lambda s: s.isNotNull())})
    return filled.withColumn("sources", F.coalesce("sources", F.array().cast(out.schema["sources"].dataType)))


#: What a model's answer may hold.
_FINDING = "struct<title:string,severity:string,subsystem:string,root_cause:string,impact:string,solution:array<string>,evidence_refs:array<int>,confidence:double>"


def model_findings(spark, pack: str, analyse: Callable[[str], dict | None] | None) -> tuple[DataFrame, str, int] | None:
    """(findings, summary, health) of a model that reads a pack; none without one, on an error, or if its answer breaks the rules."""
    if analyse is None:
        return None
    try:
        got = analyse(pack)
        if not got or not 0 <= got["health"] <= 100:
            return None
        rows = []
        for i, p in enumerate(got["problems"]):
            if p["severity"] not in ("critical", "warning", "info") or not 0 <= p["confidence"] <= 1:
                return None
            rows.append((i, p["severity"], p["subsystem"], p["title"], p.get("root_cause"), p.get("impact"), list(p.get("solution") or []), float(p["confidence"]), [int(x) for x in p.get("evidence_refs") or []]))
    except Exception:
        log.warning("no findings of a model", exc_info=True)
        return None
    schema = "finding_ord int, severity string, subsystem string, title string, root_cause string, impact string, solution array<string>, confidence double, evidence_refs array<int>"
    return spark.createDataFrame(rows, schema), got["summary"], int(got["health"])


# ---------------------------------------------------------------- texts


#: What a pack tells of the system and of its facts, in this order.
SYSTEM, FACTS = ("product", "family", "version", "locale"), ("dongle_found", "modules", "open_ports")


def _told(*parts) -> Column:
    """`a=1 b=x` of the (name, column) that aren't null."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in parts))


def _each(df: DataFrame, part: int, at: list, lines: Column) -> DataFrame:
    """Lines of every row: part, place (of the row, then within it) and line; null lines are left out."""
    return df.select(F.array(*(F.col(a).cast("long") if isinstance(a, str) else a.cast("long") for a in at)).alias("at"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("i", "line")).select(F.lit(part).alias("part"), F.concat("at", F.array(F.col("i").cast("long"))).alias("place"), "line")


def chain_lines(chains: DataFrame, part: int = 4) -> DataFrame:
    """Linked problems: a line for each chain (numbered by `ord`), and one for each of its steps."""
    head = F.concat(F.lit("chain "), F.col("ord").cast("string"), F.lit(": "), _told(("by", F.col("label")), ("severity", F.col("severity"))))
    steps = F.transform("steps", lambda x: F.concat(F.lit("- "), F.coalesce(x["ts"], F.lit("no time")), F.lit(" "), x["id"], F.lit(" "), _told(("subsystem", x["subsystem"])), F.lit(": "), x["title"]))
    return _each(chains, part, ["ord"], F.concat(F.array(head), steps))


def problem_lines(problems: DataFrame, answers: DataFrame | None = None, part: int = 3) -> DataFrame:
    """What is known of each problem (problem_ord, severity, subsystem, title, count, storm, rule_id, component, samples, retrieval_query), with the answer to its query."""
    if answers is None:
        own = problems.withColumns({"answer": F.lit(None).cast("string"), "_sources": F.array().cast("array<string>"), "confidence": F.lit(None).cast("double")})
    else:
        shown = F.transform(F.slice("sources", 1, SHOWN_SOURCES), lambda x: F.concat_ws(" ", x["kind"], x["title"], x["url"]))
        known = answers.select(F.col("query").alias("retrieval_query"), "answer", "confidence", shown.alias("_sources")).dropDuplicates(["retrieval_query"])
        own = problems.drop("answer", "confidence").join(known, "retrieval_query", "left")
    sample = F.get("samples", F.lit(0))
    lines = [
        F.concat(F.lit("problem "), F.col("problem_ord").cast("string"), F.lit(": "), _told(("severity", F.col("severity")), ("subsystem", F.col("subsystem")), ("count", F.col("count")), ("storm", F.when(F.col("storm"), "yes")), ("rule", F.col("rule_id"))), F.lit(" | "), F.col("title")),
        F.concat(F.lit("- component "), F.when(F.size("samples") > 0, F.col("component"))),
        F.concat(F.lit("- says "), F.substring(sample, 1, SAMPLE_CHARS)),
        F.concat(F.lit("- known "), _told(("confidence", F.format_string("%.2f", F.col("confidence")))), F.lit(" | "), F.substring("answer", 1, ANSWER_CHARS)),
    ]
    return _each(own, part, ["problem_ord"], F.concat(F.array(*lines), F.transform(F.coalesce("_sources", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- source "), x))))


def gear_lines(classes: DataFrame, hubs: DataFrame, members: DataFrame, part: int = 2) -> DataFrame:
    """Classes by number, and the largest components with their members. hubs: component_id, hub, label, size; members: component_id, key, ord, cls, name."""
    kinds = _each(classes, part, [F.lit(0), -F.col("count")], F.array(F.concat(F.lit("class "), _told(("name", F.col("cls")), ("count", F.col("count"))))))
    tops = _each(hubs, part, [F.lit(1), -F.col("size"), F.col("component_id"), F.lit(-1)], F.array(F.concat(F.lit("component "), F.col("component_id").cast("string"), F.lit(": "), _told(("hub", F.col("hub"))), F.lit(" | "), F.col("label"))))
    named = F.concat(F.lit("- of "), F.col("component_id").cast("string"), F.lit(": "), _told(("class", F.col("cls")), ("name", F.nullif("name", F.lit(""))), ("key", F.col("key"))))
    below = members.join(hubs.select("component_id", "size"), "component_id")
    return kinds.union(tops).union(_each(below, part, [F.lit(1), -F.col("size"), F.col("component_id"), "ord"], F.array(named)))


def system_lines(spark, profile: dict, facts: dict) -> DataFrame:
    """The system and its facts, which are a few values."""
    rows = [(0, [i, 0], f"{k}={profile[k]}") for i, k in enumerate(SYSTEM) if profile.get(k) is not None]
    rows += [(1, [i, 0], f"{k}={facts[k]}") for i, k in enumerate(FACTS) if facts.get(k) is not None]
    disks = [(d["name"], d["free_mb"], d["total_mb"]) for d in facts.get("disks") or []]
    rows += [(1, [10, i], f"disk={n} free_mb={free:.0f} of_mb={total:.0f}") for i, (n, free, total) in enumerate(disks)]
    rows += [(1, [20, i], f"note={x}") for i, x in enumerate(facts.get("notes") or [])]
    return spark.createDataFrame(rows, "part int, place array<long>, line string")


def pack(*parts: DataFrame, most: int = PROMPT_CHARS) -> str:
    """Lines in order of part and place as one text for a model, cut at `most` characters. As a line has one character at least with its break, so many lines are enough."""
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    text = "\n".join(r["line"] for r in every.orderBy("part", "place", "line").limit(most).collect())
    return text[:most] + "\n[cut]" if len(text) > most else text


def explain_sample(events: DataFrame, most: int = EXPLAIN_ROWS) -> DataFrame:
    """The first errors and warnings of a window; without any, the first events."""
    important = T.level_class(F.col("level")) < 2
    own = events.withColumn("_important", important)
    top = own.orderBy(F.desc("_important"), "ts_ms", "seq").limit(most)
    some = top.agg(F.max("_important").alias("_some"))
    return top.join(F.broadcast(some)).where(F.col("_important") | ~F.col("_some")).drop("_important", "_some")


def explain_text(rows: list[dict], most: int = EXPLAIN_CHARS) -> str:
    """Masked rows (ts_text, service, level, message) as the lines of a prompt."""
    return "\n".join(f"{r['ts_text']} {r['service']} {r['level']} {r['message']}" for r in rows)[:most]


def summary(problems: DataFrame, health: Column | int) -> DataFrame:
    """One row: critical and warning counts, and a sentence."""
    s = F.col("severity")
    own = problems.where("severity <> 'noise'").agg(F.count("*").alias("problems"), F.count_if(s == "critical").alias("critical"), F.count_if(s == "warning").alias("warnings"))
    parts = F.concat_ws(", ", F.when(F.col("critical") > 0, F.concat(F.col("critical").cast("string"), F.lit(" critical"))), F.when(F.col("warnings") > 0, F.concat(F.col("warnings").cast("string"), F.lit(" warnings"))))
    score = health if isinstance(health, Column) else F.lit(health)
    text = F.concat(F.lit("Health "), score.cast("string"), F.lit("/100. Found: "), parts, F.lit("."))
    return own.withColumn("summary", F.when(F.col("problems") == 0, "No serious problems, mostly background noise.").otherwise(text))
