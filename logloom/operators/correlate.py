"""Problems that share an entity, and entities resolved to equipment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.rules import SEVERITIES, severity_rank

#: Kinds from specific to weak, and the largest chains and lists.
KINDS = {"equipment": 0, "camera": 0, "object": 1, "address": 2, "thread": 3}
MOST_LINKED, MOST_GROUPS = 8, 8
NAMES = {"equipment": "Equipment", "camera": "Camera", "object": "Object", "address": "Address", "thread": "Thread"}


def items(findings: DataFrame, key: str = "problem_ord") -> DataFrame:
    """Findings as what is correlated: (id, ord, title, subsystem, severity, first_ts, entities)."""
    return findings.select(F.concat(F.lit("p"), F.col(key).cast("string")).alias("id"), F.col(key).alias("ord"), "title", "subsystem", "severity", "first_ts", "entities")


def correlations(items: DataFrame, most_linked: int = MOST_LINKED, most_groups: int = MOST_GROUPS, labels: DataFrame | None = None) -> DataFrame:
    """items: (id, ord, title, subsystem, severity, first_ts, entities). Chains of 2 to most_linked problems around one entity, with their steps in order of time. labels: (entity, label) of entities that have names.

    The size of an entity's set is counted before any set is gathered, so an entity that links everything costs a count.
    """
    links = items.select("id", "ord", "title", "subsystem", "severity", "first_ts", F.posexplode("entities").alias("i", "entity")).groupBy("entity", "id", "ord", "title", "subsystem", "severity", "first_ts").agg(F.min("i").alias("i"))
    small = links.groupBy("entity").agg(F.count("*").alias("n"), F.min(F.struct("ord", "i")).alias("seen")).where((F.col("n") >= 2) & (F.col("n") <= most_linked))
    step = F.struct(F.coalesce("first_ts", F.lit("")).alias("at"), "ord", "id", F.col("first_ts").alias("ts"), "title", "subsystem", "severity")
    groups = links.join(small, "entity").groupBy("entity", "seen").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.min(severity_rank(F.col("severity"))).alias("rank"), F.countDistinct("subsystem").alias("subsystems"), F.min("first_ts").alias("first_ts"), F.max("first_ts").alias("last_ts"))
    kind = T.entity_kind(F.col("entity"))
    priority = F.coalesce(*(F.when(kind == k, v) for k, v in KINDS.items()), F.lit(9))
    groups = groups.where((kind != "thread") | (F.col("subsystems") >= 2)).withColumns({"kind": kind, "priority": priority, "members": F.array_join(F.array_sort(F.transform("steps", lambda s: s["id"])), "|")})
    best = groups.groupBy("members").agg(F.min_by(F.struct("entity", "kind", "rank", "first_ts", "last_ts", "steps"), F.struct("priority", "seen")).alias("g"), F.min("seen").alias("met"))
    out = best.select("g.*", "members", "met").orderBy("rank", F.desc(F.size("steps")), F.coalesce("first_ts", F.lit("")), "met").limit(most_groups)
    own = T.entity_label(F.col("entity"), NAMES)
    if labels is not None:  # a few chains
        out = out.join(labels.groupBy("entity").agg(F.min("label").alias("_label")), "entity", "left")
        own = F.coalesce("_label", own)
    severity = F.get(F.array(*map(F.lit, SEVERITIES)), F.col("rank").cast("int"))
    return out.select("entity", "kind", own.alias("label"), severity.alias("severity"), "first_ts", "last_ts", F.size("steps").cast("long").alias("n_steps"), F.array_join(F.transform("steps", lambda s: s["id"]), ">").alias("chain"), F.transform("steps", lambda s: s.dropFields("at", "ord")).alias("steps"))


def resolved(entities: DataFrame, aliases: DataFrame, entity: str = "entity") -> DataFrame:
    """entities joined to the first owner of their alias (alias, owner, ord), case ignored; those without one are dropped."""
    first = aliases.groupBy(F.lower("alias").alias("_alias")).agg(F.min_by("owner", "ord").alias("owner"))
    return entities.withColumn("_alias", F.lower(T.entity_value(F.col(entity)))).join(first, "_alias").drop("_alias")


def equipped(findings: DataFrame, aliases: DataFrame | None, key: str = "problem_ord") -> DataFrame:
    """Findings whose entities are the equipment that owns them, the others dropped; without known equipment the entities stay as they are."""
    if aliases is None or not aliases.limit(1).count():
        return findings
    each = findings.select(key, F.posexplode("entities").alias("_i", "entity"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_i", "owner"))), lambda x: x["owner"])
    own = resolved(each, aliases).groupBy(key).agg(F.array_distinct(in_order).alias("_owners"))
    return findings.join(own, key, "left").withColumn("entities", F.coalesce("_owners", F.array().cast("array<string>"))).select(findings.columns)
