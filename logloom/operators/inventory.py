"""The equipment graph: configuration texts to objects, references, components and hubs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators.order import placed
from logloom.sources.scratch import written

#: How configuration texts name things; endpoints that wire everything together aren't equipment.
REFERENCE = r"(?i)<value>([A-Za-z][A-Za-z0-9_]*\.[A-Za-z0-9_]+/[^<\s]+)</value>"
OFFERED = r"(?i)<type>([^<]+)</type>\s*<interface>"
FRIENDLY = r"(?i)<name>friendly_name</name>\s*<value>([^<]*)</value>"
PLUMBING = r"(?i)event(channel|consumer|supplier|database)|asipdatabase"


def _tag(x: Column, name: str) -> Column:
    return F.nullif(T.trim(F.regexp_extract(x, f"(?i)<{name}>([^<]*)</{name}>", 1)), F.lit(""))


def objects(confs: DataFrame) -> DataFrame:
    """confs: (key, main, meta, offers), texts or null. One row for each object: class, instance, name, offers, model, ip, aliases and references."""
    main, meta, offers = (F.coalesce(c, F.lit("")) for c in ("main", "meta", "offers"))
    key = F.col("key")
    last = F.length(key) - F.instr(F.reverse(key), ".") + 1
    dotted = F.instr(key, ".") > 0
    cls = F.when(dotted & (last > 1), F.substring(key, F.lit(1), last - 1)).otherwise(key)
    instance = F.when(dotted & (last > 1), F.substring(key, last + 1, F.length(key))).otherwise("")
    names = F.filter(F.transform(F.regexp_extract_all(offers, F.lit(FRIENDLY)), T.trim), lambda n: n != "")
    name = F.coalesce(F.get(names, F.lit(0)), _tag(meta, "long"), _tag(meta, "short"))
    ip, port = _tag(main, "ipAddress"), _tag(main, "port")
    refs = F.transform(F.concat(F.regexp_extract_all(offers, F.lit(REFERENCE)), F.regexp_extract_all(main, F.lit(REFERENCE))), T.trim)

    def own(v: Column) -> Column:
        return F.lower(F.substring_index(v, "/", 1)) == F.lower(key)

    guids = F.concat(F.regexp_extract_all(main, F.lit(f"({T.GUID})")), F.regexp_extract_all(offers, F.lit(f"({T.GUID})")))
    aliases = F.concat(F.array(key), F.array(ip), F.array(F.concat(ip, F.lit(":"), port)), guids, F.filter(refs, own))
    lowered = F.array_distinct(F.transform(F.filter(aliases, lambda a: a.isNotNull()), F.lower))
    targets = F.transform(F.filter(refs, lambda v: ~own(v) & ~v.rlike(PLUMBING)), lambda v: F.substring_index(v, "/", 1))
    kept = confs.where("coalesce(main, '') <> '' or coalesce(meta, '') <> '' or coalesce(offers, '') <> ''")
    return kept.select("key", cls.alias("cls"), instance.alias("instance"), name.alias("name"), F.array_distinct(F.transform(F.regexp_extract_all(offers, F.lit(OFFERED)), T.trim)).alias("offers"), _tag(main, "model").alias("model"), ip.alias("ip"), lowered.alias("aliases"), F.array_distinct(targets).alias("raw_refs"))


def ordinals(objs: DataFrame) -> DataFrame:
    """(key, ord): objects in the order of their names."""
    return placed(objs.select("key"), ["key"], "objects", "ord")


def edges(objs: DataFrame) -> DataFrame:
    """(src, dst): references to other known objects, once each, case kept."""
    out = objs.select(F.col("key").alias("src"), F.explode("raw_refs").alias("dst")).where("src <> dst").distinct()
    return out.join(objs.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst")


#: Rows of one key that a task may get in a join, and the number of keys with more that are sent to all tasks at most.
HEAVY, MANY = 10_000, 100_000
#: Slots of hashes in which rows are counted before any key is: where no slot has many rows, no key has.
SLOTS = 1 << 16


def heavy_keys(rows: DataFrame, key: str, heavy: int = HEAVY) -> DataFrame | None:
    """The keys of over `heavy` rows, or of so many that there are MANY of them at most; None without any. Keys are counted only in the slots that have as many rows."""
    own = rows.select(key, F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int").alias("_slot"))
    slots = own.groupBy("_slot").agg(F.count("*").alias("_n"))
    n, most = slots.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    least = max(heavy, n // MANY)
    if most <= least:
        return None
    full = F.broadcast(slots.where(F.col("_n") > least).select("_slot"))
    often = written(own.join(full, "_slot", "left_semi").groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(key), "heavy-keys")
    return often if often.limit(1).count() else None


def hashed(table: DataFrame) -> DataFrame:
    """A table about as large as what it is joined with, each key once: tasks hash their part of it, so neither side is sorted."""
    return table.hint("shuffle_hash")


def _joined(rows: DataFrame, key: str, table: DataFrame, often: DataFrame | None, how: str = "inner") -> DataFrame:
    if often is None:
        return rows.join(table, key, how)
    own = F.broadcast(table.join(F.broadcast(often), key, "left_semi"))
    rest = rows.join(F.broadcast(often), key, "left_anti").join(table, key, how)
    return rows.join(F.broadcast(often), key, "left_semi").join(own, key, how).unionByName(rest)


def spread_join(rows: DataFrame, key: str, table: DataFrame, heavy: int = HEAVY, how: str = "inner") -> DataFrame:
    """rows (read twice) joined (inner or left) with a table that has each key once. Heavy keys are sent to all tasks with their part of the table; the rest is shuffled, so no task gets more of one key."""
    return _joined(rows, key, table, heavy_keys(rows, key, heavy), how)


#: Leaves are taken off a graph while there are at least as many as this part of its links.
LEAFY = 4


def _star_round(own: DataFrame, both: DataFrame, known: DataFrame, n: int, heavy: int) -> DataFrame:
    """A large star and a small one: each node tells its greater neighbours, then its lesser ones and itself, the least node that it knows. known: (a, n, m), the number of neighbours and the least one."""

    def often(counted: DataFrame, rows: int) -> DataFrame | None:
        found = counted.where(F.col("n") > max(heavy, rows // MANY)).select("a")
        return found if found.limit(1).count() else None

    least = known.select("a", F.least("m", "a").alias("m"))
    large = _joined(both, "a", least, often(known, 2 * n)).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = written(large, "links-large")
    told = written(large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")), "links-least")
    lesser = _joined(large, "a", told.select("a", "m"), often(told, n)).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return written(lesser.union(told.select("a", "m")).where("a <> b").distinct(), "links")


def _peeled(links: DataFrame, heavy: int) -> tuple[list[tuple[DataFrame, DataFrame, DataFrame | None]], DataFrame, DataFrame]:
    """Takes leaves off links (a, b) until no link is left: the rounds, as (leaves (a, m), the new names (m, e) of their nodes, nodes that may be heavy or None); the roots (a); and all nodes that have links (a).

    Nodes with one neighbour are leaves. Where there are many, they are taken off, and the node m that has them goes on as e, the least number among it and them; else large and small stars in turn (_star_round) bring each node nearer to its root, until there are many leaves again. An e without links that are left is a root. Tables in the shared folder cut the lineage.
    """
    hi, lo = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    own, taken, roots, met, last = links.where("a <> b").select(hi, lo), [], [], None, None
    while True:
        both = own.union(own.select("b", "a"))
        known = written(both.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"), (F.min("b") == F.max("b")).alias("lone")), "links-known")
        met = known.select("a") if met is None else met
        if last is not None:
            roots.append(last.select(F.col("e").alias("a")).join(known.select("a"), "a", "left_anti"))
        n, lone, most = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("lone"), F.col("n"))), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        n //= 2
        if not n:
            break
        if lone * LEAFY < n:
            own, last = _star_round(own, both, known, n, heavy), None
            continue
        # a node has no more leaves than links
        least = max(heavy, n // MANY)
        often = known.where(F.col("n") > least).select("a") if most > least else None
        leaves, inner = known.where("lone").select("a", "m"), known.where("not lone").select("a")
        # of two nodes that have only each other the greater is the leaf
        firsts = leaves.groupBy("m").agg(F.min("a").alias("e")).join(inner.select(F.col("a").alias("m"), F.lit(True).alias("inner")), "m", "left")
        last = written(firsts.where("inner or m < e").select("m", F.least("e", "m").alias("e")), "links-of")
        taken.append((leaves, last, often and often.withColumnRenamed("a", "m")))
        kept = _joined(own, "a", hashed(inner), often, "left_semi")
        kept = _joined(kept, "b", inner.withColumnRenamed("a", "b"), often and often.withColumnRenamed("a", "b"), "left_semi")
        own = written(kept.select("a", "b"), "links-left")
        renamed = last.where("e < m")
        if renamed.limit(1).count():
            for side, other in (("a", "b"), ("b", "a")):
                to = renamed.select(F.col("m").alias(side), "e")
                own = written(spread_join(own, side, to, heavy, "left").select(F.coalesce("e", side).alias(side), other), "links-renamed")
            own = own.select(hi, lo)
    return taken, functools.reduce(DataFrame.union, roots) if roots else met.limit(0), met


def _told(taken: list[tuple[DataFrame, DataFrame, DataFrame | None]], found: DataFrame) -> DataFrame:
    """(a, v) of all nodes that have links, from found, those of the roots: each leaf gets what its node has, the last ones first."""
    for i, (leaves, of, often) in enumerate(reversed(taken)):
        at = written(of.join(found.select(F.col("a").alias("e"), "v"), "e").select("m", "e", "v"), "leaf-values")
        told = _joined(leaves, "m", hashed(at), often).where("a <> e").select("a", "v")
        found = found.union(at.where("e < m").select("m", "v")).union(told)
        if i < len(taken) - 1:
            found = written(found, "values")
    return found


def stars(links: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, root) for every node of links (a, b: longs; a table, since it is read twice) but the roots: root is the least node of a's component. Links can be given more than once. Heavy nodes are split (spread_join)."""
    taken, roots, _ = _peeled(links, heavy)
    return _told(taken, written(roots.select("a", F.col("a").alias("v")), "roots")).where("a <> v").select("a", F.col("v").alias("root"))


def linked(nodes: DataFrame, links: DataFrame, key: str = "key", order: str = "ord", heavy: int = HEAVY, own: str | None = None) -> DataFrame:
    """(src, dst) by the orders of nodes, a table, of links (src, dst) by their keys: those between two known nodes, as often as they are given. own: the column of links that has the order of src, a known node, already: then only dst is looked up. Nodes and links are read twice, so costly ones should be tables."""
    at = lambda side, to: hashed(nodes.select(F.col(key).alias(side), F.col(order).cast("long").alias(to)))
    some = links.where("src <> dst")
    if own:
        half = some.select("dst", F.col(own).cast("long").alias("a"))
    else:
        half = spread_join(some.select("src", "dst"), "src", at("src", "a"), heavy).select("dst", "a")
    return written(spread_join(written(half, "half-links"), "dst", at("dst", "b"), heavy).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")


def labelled(nodes: DataFrame, links: DataFrame, key: str = "key", order: str = "ord", heavy: int = HEAVY, ends: str | None = None) -> DataFrame:
    """(node, own, label): label is the least order in the node's component. ends: the column that links name nodes by, key or order (as linked() makes them)."""
    pairs = links if ends == order else linked(nodes, links, key, order, heavy)
    found = stars(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), heavy)
    known = nodes.select(F.col(key).alias("node"), F.col(order).cast("long").alias("own"))
    return written(known.join(found, F.col("own") == F.col("a"), "left").select("node", "own", F.coalesce("root", "own").alias("label")), "labels")


def grown(labels: DataFrame, nodes: DataFrame, links: DataFrame, key: str = "key", order: str = "ord", heavy: int = HEAVY) -> DataFrame:
    """labels after more nodes and links: only what the new links touch is searched, as a graph of whole components, and only labels that change are joined. Links may lead to old and new nodes; an old node keeps its order."""
    fresh = nodes.select(F.col(key).alias("node"), F.col(order).cast("long").alias("own"), F.col(order).cast("long").alias("label"))
    every = written(labels.select("node", "own", "label").union(fresh.join(labels.select("node"), "node", "left_anti").select("node", "own", "label")), "labels")
    named = written(links.select("src", "dst").where("src <> dst").distinct(), "named-links")
    met = linked(every, named, "node", "label", heavy).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    moved = written(stars(met, heavy), "moved")
    gone = moved.select(F.col("a").alias("label"))
    gone = F.broadcast(gone) if moved.count() <= MANY else gone
    lost = written(every.join(gone, "label", "left_semi").select("node", "own", "label"), "moving")
    now = spread_join(lost, "label", moved.select(F.col("a").alias("label"), "root"), heavy).select("node", "own", F.col("root").alias("label"))
    stay = every.join(gone, "label", "left_anti").select("node", "own", "label")
    return written(stay.unionByName(now), "labels")


def numbered(labels: DataFrame, key: str = "key", order: str = "ord", heavy: int = HEAVY) -> DataFrame:
    """(key, ord, component_id): components by number, in the order of their first members."""
    ids = placed(labels.where("own = label").select("label"), ["label"], "components", "component_id")
    return spread_join(labels, "label", ids, heavy).select(F.col("node").alias(key), F.col("own").alias(order), F.col("component_id").cast("long").alias("component_id"))


def components(nodes: DataFrame, links: DataFrame, key: str = "key", order: str = "ord", heavy: int = HEAVY, ends: str | None = None, own: str | None = None) -> DataFrame:
    """(key, ord, component_id), a table: components of an undirected graph, numbered by their first member. ends: as for labelled(); own: as for linked().

    Roots and nodes without links are numbered first, and the others are told the number of their component, so keys are shuffled once, at the end.
    """
    pairs = links if ends == order else linked(nodes, links, key, order, heavy, own)
    taken, roots, met = _peeled(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), heavy)
    known = nodes.select(F.col(key).alias("node"), F.col(order).cast("long").alias("a"))
    roots = roots.select("a", F.lit(False).alias("alone"))
    if known.count() > met.count():  # nodes without links; all nodes of links are known
        roots = roots.union(known.select("a").join(hashed(met), "a", "left_anti").select("a", F.lit(True)))
    ids = placed(roots, ["a"], "components", "v")
    ids = written(ids.select("a", "alone", F.col("v").cast("long").alias("v")), "component-ids")
    told = _told(taken, ids.where("not alone").select("a", "v")).union(ids.where("alone").select("a", "v"))
    return written(known.join(hashed(told), "a").select(F.col("node").alias(key), F.col("a").alias(order), F.col("v").alias("component_id")), "labels")


def hubs(members: DataFrame, links: DataFrame, key: str = "key", order: str = "ord", ends: str | None = None) -> DataFrame:
    """members: (key, ord, component_id, n_offers). Of each component the most referenced object, then the richest, then the first. links: each once. ends: the column that they name nodes by, key if not given."""
    degree = links.groupBy(F.col("dst").alias(ends or key)).agg(F.count("*").alias("degree"))
    own = members.join(degree, ends or key, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    best = F.min_by(F.struct(key, "degree"), F.struct(-F.col("degree"), -F.col("n_offers"), order))
    return own.groupBy("component_id").agg(best.alias("h"), F.count("*").alias("size")).select("component_id", F.col(f"h.{key}").alias("hub"), F.col("h.degree").alias("degree"), "size")


def classes(objs: DataFrame) -> DataFrame:
    return objs.groupBy("cls").agg(F.count("*").alias("count"))
