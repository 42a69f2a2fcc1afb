"""A small bundle with results derived by hand, and the parts that need files."""

import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import inventory, order, player, records, redact, report, rules, timeline
from logloom.plans import analysis, catalogue, views
from logloom.sources import archive, bundle, scratch, sinks
from logloom.streaming import storms

LOG = """orphan line before any header
~[11]; 2026-01-02; 03:04:05.100; ERROR; [Sink] lost 10.1.2.3:554 on DeviceIpint.5
  at frame one

  at frame two
~#[12]; 2026-01-02; 03:04:05.200; WARN; /Store.1/: retry 7
~[11]; 2026-01-02; 03:04:05.300; INFO; plain text
~[11]; 2026-01-02; 03:05:00.000; ERROR; [Sink] lost 10.1.2.4:554 on DeviceIpint.6
"""


@pytest.fixture
def folder(tmp_path):
    logs = tmp_path / "x" / "Report" / "Logs"
    logs.mkdir(parents=True)
    (logs / "APP_HOST.Alpha.log").write_text(LOG)
    conf = tmp_path / "x" / "Report" / "Config.local" / "config_repo" / "DeviceIpint.5"
    conf.mkdir(parents=True)
    (conf / "main.conf").write_text("<model>M</model><ipAddress>10.1.2.3</ipAddress><port>554</port>")
    return tmp_path / "x"


def test_records(spark, folder):
    at = bundle.locate(str(folder))
    assert at.endswith("Report")
    recs = records.records(bundle.log_lines(spark, at)).orderBy("rec_ord").collect()
    assert [r["component"] for r in recs] == ["Sink", "/Store.1/", None, "Sink"]
    assert [r["address"] for r in recs] == ["10.1.2.3:554", None, None, "10.1.2.4:554"]
    assert recs[0]["message"] == "lost 10.1.2.3:554 on DeviceIpint.5\n  at frame one\n  at frame two"
    sigs = {r["signature"]: r for r in records.signatures(records.records(bundle.log_lines(spark, at))).collect()}
    assert {k: (r["count"], r["peak"]) for k, r in sigs.items()} == {"ERROR|Sink|lost <addr> on DeviceIpint.<n>": (2, 1), "WARN|/Store.1/|retry <n>": (1, 1)}
    assert sigs["ERROR|Sink|lost <addr> on DeviceIpint.<n>"]["entities"] == ["address:10.1.2.3:554", "object:DeviceIpint.5", "thread:11", "address:10.1.2.4:554", "object:DeviceIpint.6"]


def test_analysis_and_restart(spark, folder, tmp_path):
    base = [{"id": "sink", "severity": "critical", "subsystem": "network", "title": "Lost", "any_of": ["LOST"]}]
    got = analysis.analyse(spark, str(folder), str(tmp_path / "out"), (base,), unknown_count=1)
    assert [(r["rule_id"], r["severity"], r["count"]) for r in got["problems"].orderBy("problem_ord").collect()] == [("sink", "critical", 2), (None, "info", 1)]
    assert got["health"].first()["health"] == 73
    assert got["timeline"].count() == 4
    assert got["findings"].where("rule_id = 'sink'").first()["samples"] == ["lost <ip-1>:554 on DeviceIpint.5"]
    assert got["objects"].first()["aliases"] == ["deviceipint.5", "10.1.2.3", "10.1.2.3:554"]
    path = sinks.timeline(got["timeline"], str(tmp_path / "out"), "small", shard_rows=2)
    assert sinks.zone_map(spark, path).agg(F.sum("events")).first()[0] == 4
    assert got["manifest"]["events"] == 4 and got["manifest"]["services"] == ["Alpha"] and got["manifest"]["chapters"] == []
    assert report.restart_allowed("rules", {"parse"}) and not report.restart_allowed("llm", {"parse"})
    made = got["report"]
    assert made["stats"] == {"signatures": 2, "errors": 2, "warnings": 1, "files": 1, "noise_lines": 0}
    assert [p["entities"] for p in made["problems"]] == [["equipment:DeviceIpint.5"], []]
    assert made["timeline"][0]["ts"] == "2026-01-02 03:04:05.100" and made["inventory"]["objects"][0]["ip"] == "<ip-1>"
    assert "### 1. [CRITICAL] Lost" in report.markdown("R", made) and "Statistics:** 2 signatures" in report.markdown("R", made)
    lines = []
    analysis.printed(made, lines.append)
    assert any("[CRITICAL] Lost x2" in x for x in lines)


def test_normalisers(spark):
    odd = spark.createDataFrame([("at 0xAB12 DEADBEEF01 2026-01-02 камера7 12",), ("550E8400-E29B-41D4-A716-446655440000",), ("550e8400-e29b-41d4-a716-44665544000a x",)], "m string")
    none = F.lit(None).cast("string")
    got = [r[0] for r in odd.select(T.signature(F.lit("E"), none, F.col("m"))).collect()]
    assert got[0] == "E||at <ptr> <hex> <date> камера<n> <n>"
    assert got[2] == "E||<guid> x"
    assert "<guid>" not in got[1]


def test_redaction(spark):
    rows = spark.createDataFrame([(1, "b@c.de 1.2.3.4 password=1.2.3.4"), (2, "1.2.3.4 9.9.9.9 C:\\Users\\me\\x")], "k long, t string")
    out, mapping = redact.redacted(rows, "k", "t")
    assert [r["t"] for r in out.orderBy("k").collect()] == ["<email-1> <ip-1> <secret-1>", "<ip-1> <ip-2> <userpath-1>\\x"]
    assert mapping.count() == 5


def test_debounce_and_edges(spark):
    rows = spark.createDataFrame([(0, 0), (10000, 1), (30001, 2), (50000, 3), (60002, 4)], "ts_ms long, seq long")
    assert sorted(r["ts_ms"] for r in timeline.debounced(rows).collect()) == [0, 30001, 60002]
    empty = rows.where("seq < 0")
    assert timeline.debounced(empty).count() == 0
    assert timeline.numbered(empty.drop("seq").withColumn("k", F.lit(1)), ["k"]).count() == 0


def test_graph(spark):
    nodes = spark.createDataFrame([("D.5", 0, 2), ("M.A", 1, 1), ("V.1", 2, 1), ("D.6", 3, 1)], "key string, ord long, n_offers long")
    objs = spark.createDataFrame([("D.5", []), ("M.A", ["D.5"]), ("V.1", ["D.5", "V.1"]), ("D.6", ["Ghost.9"])], "key string, raw_refs array<string>")
    links = inventory.edges(objs)
    got = inventory.components(nodes, links)
    assert {r["key"]: r["component_id"] for r in got.collect()} == {"D.5": 0, "M.A": 0, "V.1": 0, "D.6": 1}
    hub = inventory.hubs(got.join(nodes.select("key", "n_offers"), "key"), links).where("component_id = 0").first()
    assert (hub["hub"], hub["degree"], hub["size"]) == ("D.5", 2, 3)


def test_facts(spark):
    f = spark.createDataFrame([("Key not found", "a\n\nb\nc", "7 active ports found"), (None, None, None)], "guardants string, modules string, ports string")
    assert [tuple(r) for r in report.facts(f).collect()] == [(False, 2, 7), (False, None, None)]
    p = spark.createDataFrame([(" 5.1\n", "x\n  replacement: host1 ", None, "ключ")], "version string, prometheus string, ports string, guardants string")
    assert tuple(report.profile(p).first()) == ("5.1", "host1", "ru")
    d = spark.createDataFrame([(1, "x Name - C\nTotal size - 1 000 Mb\nTotal free space - 1,5 Mb")], "id long, t string")
    assert tuple(report.disks(d, "id", "t").select("name", "total_mb", "free_mb").first()) == ("C", 0.0, 1.5)


def test_cosine(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    assert [tuple(r) for r in player.semantic(rows, [1.0, 0.0], "v", "id").select("id", "score").collect()] == [(1, 1.0), (3, 0.71)]


def test_sources(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Report/product_version.txt", "5.0")
    root = bundle.extract(str(tmp_path / "a.zip"), str(tmp_path / "to"))
    assert bundle.small_file(bundle.locate(root), "product_version.txt") == "5.0"
    assert bundle.small_file(root, "missing") is None
    rule = {"id": "r", "severity": "info", "subsystem": "other", "title": "t", "match": {"anyOf": ["x"]}, "frequency": {"minPerMinute": 3}}
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.json").write_text(json.dumps({"rules": [rule]}))
    assert bundle.rules(str(tmp_path / "rules"))[0]["min_per_minute"] == 3


def test_metadata(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path), "jobs", "id string, status string")
    t.upsert(spark.createDataFrame([("a", "queued"), ("b", "done")], "id string, status string"))
    t.update(F.col("id") == "a", status="cancelled")
    t.delete(F.col("id") == "b")
    assert [tuple(r) for r in t.read().collect()] == [("a", "cancelled")]


def test_stream(spark, tmp_path):
    rows = [(f"2026-01-02 03:04:{i % 60:02d}.000", "ERROR", "S", f"lost {i}") for i in range(40)] + [("2026-01-02 09:00:00.000", "ERROR", "S", "late 1")]
    spark.createDataFrame(rows, "ts string, level string, component string, message string").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("2026-01-02 10:00:00.000", "WARN", "S", "end")], "ts string, level string, component string, message string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, level string, component string, message string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = storms.storm_stream(stream).writeStream.format("memory").queryName("storms").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["signature"], r["n"]) for r in spark.table("storms").collect()] == [("ERROR|S|lost <n>", 40)]


def test_rules(spark):
    sigs = spark.createDataFrame([("s", "ERROR", None, "Lost Link", 5, True, 31)], "signature string, level string, component string, sample string, count long, storm boolean, peak long")
    base = rules.rule_base([{"id": "a", "severity": "info", "subsystem": "x", "title": "t", "component": "lost"}, {"id": "off", "enabled": False, "severity": "info", "subsystem": "x", "title": "t", "any_of": ["lost"]}], [{"id": "b", "severity": "noise", "subsystem": "x", "title": "t", "all_of": ["LOST", "link"], "min_per_minute": 31, "any_of": []}])
    assert rules.first_match(sigs, base).first()["rule"]["id"] == "b"


def joined_lines(lines, is_header):
    out = []
    for x in lines:
        if is_header(x):
            out.append([x])
        elif out and x.strip(" \t\r"):
            out[-1].append(x)
    return [(i + 1, "\n".join(r), len(r)) for i, r in enumerate(out)]


def test_one_file_is_stitched_in_many_parts(spark, tmp_path):
    r = random.Random(4)
    line = lambda i: r.choice([f"~[{i}]; 2024-01-01; 10:00:00.000; ERROR; c: m{i}", f"  at {i}", "", "\t", f"more {i}"])
    files = {"a.log": [line(i) for i in range(6000)], "b.log": ["no header"] * 700 + [line(i) for i in range(30)], "c.log": ["~[1]; 2024-01-01; 10:00:00.000; WARN; x"] + [f" {i}" for i in range(3000)], "d.log": ["never"] * 50}
    (tmp_path / "Logs").mkdir()
    for name, lines in files.items():
        (tmp_path / "Logs" / name).write_text("\n".join(lines))
    want = sorted((name, *x) for name, lines in files.items() for x in joined_lines(lines, lambda t: t.startswith("~[")))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small ranges stay apart
    for split in ("128m", "10k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            lines = bundle.log_lines(spark, str(tmp_path))
            assert lines.select(F.spark_partition_id()).distinct().count() >= 8 or split == "128m"
            got = records.stitched(lines, F.col("line").startswith("~["), ["file"], "pos").select("file", "rec_ord", "text", "n_lines")
            assert sorted(map(tuple, got.collect())) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # no part has more than a few eighths of the lines, though one file has most of them
    dealt = order.ordered(lines, ["file", "pos"], "parts").groupBy("_part", "file").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({x["_part"] for x in dealt if x["file"] == "a.log"}) > 2 and max(x["count"] for x in dealt) < 6000


def test_stitching_with_null_keys(spark):
    lines = spark.createDataFrame([(None, 1, "H a"), (None, 2, "b"), ("x", 1, "c"), ("x", 2, "H d"), ("x", 3, " "), ("x", 4, "e"), ("x", 5, None)], "file string, pos long, line string")
    got = records.stitched(lines, F.col("line").startswith("H"), ["file"], "pos").collect()
    assert sorted((str(x["file"]), x["rec_ord"], x["text"]) for x in got) == [("None", 1, "H a\nb"), ("x", 1, "H d\ne")]
    assert records.stitched(lines.where("pos > 9"), F.col("line").startswith("H"), ["file"], "pos").count() == 0


def test_thousands_of_rules(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    base = []
    for i in range(5000):
        x = {"id": f"r{i}", "severity": "info", "subsystem": "other", "title": f"t{i}"}
        if r.random() < 0.4:
            x["all_of"] = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3))]
        if r.random() < 0.6:
            x["any_of"] = [word().upper() + " " + word() for _ in range(r.randint(1, 3))]
        if r.random() < 0.2:
            x["component"] = word()
        if r.random() < 0.1:
            x["min_per_minute"] = r.randint(1, 5)
        if r.random() < 0.1:
            x["applies_to"] = [r.choice(["current", "legacy"])]
        base.append(x)
    base += [{"id": "two", "severity": "info", "subsystem": "other", "title": "t", "any_of": ["Ж"]}, {"id": "all", "severity": "info", "subsystem": "other", "title": "t", "any_of": [""], "component": "zz"}, {"id": "loose", "severity": "info", "subsystem": "other", "title": "t", "any_of": [""], "min_per_minute": 5}]
    sigs = [(f"s{i}", r.choice([word(), None, "ZZ top"]), " ".join(word() for _ in range(r.randint(0, 40))) + r.choice(["", " ж"]), r.randint(0, 5)) for i in range(300)] + [("none", "zz", None, 5)]
    df = spark.createDataFrame(sigs, "signature string, component string, sample string, peak int")
    want = rules.first_match(df, rules.rule_base(base), "current").select("signature", "rule.rule_ord").collect()
    table = rules.rule_rows(spark, base)
    got = rules.first_match_indexed(df, table, "current")
    assert got.columns == [*df.columns, "rule"]
    assert sorted(map(str, map(tuple, got.select("signature", "rule.rule_ord").collect()))) == sorted(map(str, map(tuple, want)))
    assert sum(x["rule_ord"] is not None for x in want) > 50
    index = rules.RuleIndex(df, table)
    assert index.candidates().count() < len(sigs) * len(base) / 10  # eight letters give few trigrams
    assert "CartesianProduct" not in str(got._jdf.queryExecution().executedPlan()) and "NestedLoop" not in str(got._jdf.queryExecution().executedPlan())
    assert rules.first_match_indexed(df.where("peak > 9"), table).count() == 0
    assert rules.first_match_indexed(df, table.where("rule_ord < 0")).where("rule is not null").count() == 0


def test_rules_that_say_the_same(spark):
    base = [{"id": f"r{i}", "severity": "info", "subsystem": "other", "title": "t", "all_of": [f"Amount {i % 7}", f"device {i % 5}"], "any_of": ["from", f"to {i % 3}"], "component": f"c{i % 2}"} for i in range(2100)]
    df = spark.createDataFrame([(f"s{i}", f"C{i % 2}", f"amount {i % 10} from device {i % 6}", 1) for i in range(60)], "signature string, component string, sample string, peak int")
    table = rules.rule_rows(spark, base)
    once, often = (rules.RuleIndex(df, t).candidates().count() for t in (table.where("rule_ord < 210"), table))
    assert 0 < once == often < 200  # ten times the rules, but the same conditions
    want = rules.first_match(df, rules.rule_base(base)).select("signature", "rule.rule_ord").collect()
    got = rules.first_match_indexed(df, table).select("signature", "rule.rule_ord").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and any(x["rule_ord"] for x in want)


def test_brackets_of_lines(spark):
    rest = ["[a] b", "[]] b", "[] b", "[a b", "[a\nb]\u00a0\u3000 c]", "[a]", "x: y", "[x: y", " : y", "", None, "]a[", "[\U0001f600a] \U0001f600"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rest)], "i int, r string")
    r = F.col("r")
    old = F.when(r.rlike(r"\A\[[^\]]+\]"), F.regexp_replace(r, rf"\A\[[^\]]+\]{T.SPACE}*", ""))
    name = F.when(r.rlike(r"\A\[[^\]]+\]"), F.regexp_extract(r, r"\A\[([^\]]+)\]", 1))
    for x in df.select("i", T.component(r).alias("c"), T.message(r).alias("m"), old.alias("old"), name.alias("name")).collect():
        assert x["old"] is None or (x["m"], x["c"]) == (x["old"], x["name"]), x["i"]
    assert [x["c"] for x in df.orderBy("i").select(T.component(r).alias("c")).collect()][:4] == ["a", None, None, None]


def test_white_space_of_messages(spark):
    texts = ["a b", " a  b ", "a\tb", "a\u00a0b", "\u3000a \u2028b", "a\nb", "", None, "x" * 700, "a" + chr(11) + "b" + chr(12) + "c\rd", "é ü"]
    df = spark.createDataFrame([(x,) for x in texts], "m string")
    m = F.col("m")
    old = F.substring(T.trim(F.regexp_replace(m, f"{T.SPACE}+", " ")), 1, T.MESSAGE_LENGTH)
    assert df.where(~T.timeline_message(m).eqNullSafe(old)).count() == 0
    lines = spark.createDataFrame([(x,) for x in ("0x1f - 0xAB 12", "12 ABCDEF01 1.2.3.4:5", "on 2026-01-02 7", "01234567-89ab-cdef-0123-456789abcdef 9", "x0x 0x", "-5 a", None)], "m string")
    whole = F.substring(T.trim(T.replaced(T.first_line(m), T.SIGNATURE_TOKENS)), 1, T.SIGNATURE_LENGTH)
    got = T.signature(F.lit("E"), F.lit("c"), m)
    assert lines.where(~got.eqNullSafe(F.concat(F.lit("E|c|"), whole))).count() == 0


def test_findings_of_many_values(spark):
    n = 12_000
    at = F.col("id")
    recs = spark.range(n).select(F.lit("a.log").alias("file"), at.alias("rec_ord"), F.lit("2026-01-02 03:04:05.000").alias("ts"), F.lit("ERROR").alias("level"), F.lit("c").alias("component"), F.lit(None).cast("string").alias("address"), F.lit("lost").alias("message"), at.cast("string").alias("thread"))
    base = rules.rule_base([{"id": "r", "severity": "info", "subsystem": "other", "title": "t", "any_of": ["lost"]}])
    got = report.findings(rules.problems(rules.first_match(records.signatures(recs), base)), masked=False).collect()
    assert len(got) == 1 and got[0]["entities"] == [f"thread:{i}" for i in range(n)]


def test_capped_without_a_sort_of_all(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 7).alias("f"), F.col("id").alias("seq"))
    want = sorted((i % 7, i) for i in range(1000))
    few, full = timeline.capped(df, ["f", "seq"], 300)
    assert full and sorted(map(tuple, few.collect())) == want[:300]

    def unasked(*_):
        raise AssertionError("all rows are put in order")

    monkeypatch.setattr(timeline, "placed", unasked)
    assert timeline.capped(df, ["f", "seq"], 300)[0].count() == 300
    monkeypatch.undo()
    monkeypatch.setattr(timeline, "TOP", 100)  # as for large caps
    assert sorted(map(tuple, timeline.capped(df, ["f", "seq"], 300)[0].collect())) == want[:300]


def least_members(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("heavy", [5, 10_000])
def test_components_grow(spark, heavy):
    r = random.Random(9)
    n = 700
    star = [(0, i) for i in range(300, 500)] + [(i, 299) for i in range(260, 299)]
    chain = [(i, i + 1) for i in range(500, 560)]
    some = [(r.randint(100, 250), r.randint(100, 250)) for _ in range(90)] + [(3, 3), (560, 500)]
    links = star + chain + some
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(n)], "key string, ord long")
    as_df = lambda x: spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in x], "src string, dst string")
    want = least_members(range(n), links)
    labels = inventory.labelled(nodes, as_df(links), heavy=heavy)
    assert {x["own"]: x["label"] for x in labels.collect()} == want
    number = {x: i for i, x in enumerate(sorted(set(want.values())))}
    assert {x["ord"]: x["component_id"] for x in inventory.numbered(labels, heavy=heavy).collect()} == {k: number[v] for k, v in want.items()}
    # new nodes and links join what is there without a search from the start
    more = [(450, 530), (100, 701), (702, 703), (699, 698), (250, 450)]
    fresh = spark.createDataFrame([(f"n{i}", i) for i in range(695, 710)], "key string, ord long")
    got = inventory.grown(labels, fresh, as_df(more), heavy=heavy)
    assert {x["own"]: x["label"] for x in got.collect()} == least_members(range(710), links + more)
    none = inventory.grown(labels, nodes.where("ord < 0"), as_df(more).where("src = ''"), heavy=heavy)
    assert {x["own"]: x["label"] for x in none.collect()} == want


def test_a_star_has_no_hot_task(spark):
    nodes = spark.range(60_001).select(F.concat(F.lit("n"), "id").alias("key"), F.col("id").alias("ord"))
    links = spark.range(1, 60_001).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("n0").alias("dst"))
    named = inventory.written(links, "star")
    joined = inventory.spread_join(named, "dst", nodes.select(F.col("key").alias("dst"), "ord"), 1000)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 60_000 and "BroadcastHashJoin" in plan  # the hub goes to the leaves, not they to it
    got = inventory.components(nodes, links, heavy=1000).agg(F.count("*").alias("n"), F.max("component_id").alias("last")).first()
    assert (got["n"], got["last"]) == (60_001, 0)


def test_leaves_leave_a_graph_before_stars_are_made(spark, monkeypatch):
    made = []
    monkeypatch.setattr(inventory, "written", lambda df, name, real=inventory.written: made.append(name) or real(df, name))
    homes = [(i, i - i % 3) for i in range(300) if i % 3] + [(1000 + i, i % 300) for i in range(3000)]
    found = inventory.stars(spark.createDataFrame(homes, "a long, b long"))
    assert {x["a"]: x["root"] for x in found.collect()} == {k: v for k, v in least_members({n for e in homes for n in e}, homes).items() if k != v}
    assert "links-large" not in made  # all are leaves, then leaves of what is left


def test_trees_seek_hubs_of_the_largest_components(spark, monkeypatch):
    asked = []
    spy = lambda members, *x, real=inventory.hubs, **y: asked.append(members.select("component_id").distinct().count()) or real(members, *x, **y)
    monkeypatch.setattr(inventory, "hubs", spy)
    got = catalogue.queries()["equipment_trees"](spark, "/root/testdata/sf0.001")
    assert got.select("component_id").distinct().count() == 5 and asked == [5]


def test_named_links_are_stored_once(spark, monkeypatch):
    stored = []
    spy = lambda df, name, real=scratch.written: stored.append((name, dict(df.dtypes))) or real(df, name)
    for module in (inventory, scratch):
        monkeypatch.setattr(module, "written", spy)
    catalogue.queries()["equipment_components"](spark, "/root/testdata/sf0.001")
    assert [name for name, types in stored if "string" in types.values()] == ["half-links", "labels"]  # all else is numbers


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_links_are_given_more_than_once(spark, heavy):
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(60)], "key string, ord long")
    links = [(i, i - i % 10) for i in range(40)] * 4 + [(i - i % 10, i) for i in range(40)] + [(40, 41), (41, 40), (42, 99), (98, 43)]
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links] + [("n44", None), (None, "n45")], "src string, dst string")
    want = least_members(range(60), [e for e in links if max(e) < 60])
    number = {x: i for i, x in enumerate(sorted(set(want.values())))}
    pairs = inventory.linked(nodes, named, heavy=heavy)
    for got in (inventory.components(nodes, named, heavy=heavy), inventory.components(nodes, pairs, heavy=heavy, ends="ord")):
        assert {x["ord"]: x["component_id"] for x in got.collect()} == {k: number[v] for k, v in want.items()}
        hubs = inventory.hubs(got.withColumn("n_offers", F.lit(0)), pairs.distinct(), ends="ord").where("size > 2")
        assert sorted((x["hub"], x["degree"], x["size"]) for x in hubs.collect()) == [(f"n{i}", 9, 10) for i in (0, 10, 20, 30)]


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_only_unknown_ends_of_links_are_looked_up(spark, monkeypatch, heavy):
    asked = []
    spy = lambda rows, key, *x, real=inventory.spread_join, **y: asked.append(key) or real(rows, key, *x, **y)
    monkeypatch.setattr(inventory, "spread_join", spy)
    catalogue.queries()["equipment_components"](spark, "/root/testdata/sf0.001")
    assert "dst" in asked and not {"src", "label"} & set(asked)  # orders know themselves, members are told their number
    r = random.Random(5)
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(90)], "key string, ord long")  # the last twenty have no links
    links = [(i, i - i % 10) for i in range(40)] * 3 + [(40, 41), (41, 40), (42, 99), (43, 98)] + [(r.randint(44, 69), r.randint(44, 69)) for _ in range(25)]
    named = spark.createDataFrame([(f"n{a}", f"n{b}", a) for a, b in links] + [("n44", None, 44)], "src string, dst string, own long")
    want = least_members(range(90), [e for e in links if max(e) < 90])
    number = {x: i for i, x in enumerate(sorted(set(want.values())))}
    got = inventory.components(nodes, named, heavy=heavy, own="own").collect()
    assert len(got) == 90 and {x["key"]: x["component_id"] for x in got} == {f"n{k}": number[v] for k, v in want.items()}
    assert inventory.linked(nodes, named, heavy=heavy, own="own").exceptAll(inventory.linked(nodes, named, heavy=heavy)).count() == 0


@pytest.mark.parametrize("heavy", [3, 10_000])
def test_components_of_many_shapes(spark, heavy):
    r = random.Random(17)
    pairs = [(2 * i, 2 * i + 1) for i in range(1000, 1020)]
    low_leaves = [(500 + i % 7, i) for i in range(60, 140)] + [(500, 501), (502, 503), (503, 504)]  # leaves before their node
    ring = [(200 + i, 200 + (i + 1) % 40) for i in range(40)] + [(200 + i, 300 + i) for i in range(40)]
    dense = [(r.randint(600, 640), r.randint(600, 640)) for _ in range(300)] + [(600 + r.randint(0, 40), 700 + i) for i in range(30)]
    links = pairs + low_leaves + ring + dense + [(7, 7), (201, 200), (200, 201)]
    nodes = sorted({n for e in links for n in e})
    found = inventory.stars(spark.createDataFrame(links, "a long, b long"), heavy=heavy).collect()
    assert len(found) == len({x["a"] for x in found})
    assert {x["a"]: x["root"] for x in found} == {k: v for k, v in least_members(nodes, links).items() if k != v}


def test_a_filter_on_headers_matches_each_line_once(spark):
    lines = spark.createDataFrame([("~[7]; 2026-01-02; 03:04:05.000; ERROR; [c] lost",), ("~[7]; 2026-01-02; 03:04:05.000; INFO; [c] well",), ("none",), (None,)], "line string")
    own = records.headers(lines)
    assert own.count() == 4
    kept = own.where(T.level_class(F.col("level")) < 2)
    assert [(x["thread"], x["component"], x["message"]) for x in kept.where("level is not null").collect()] == [("7", "c", "lost")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_signatures_without_sets(spark):
    lines = [(f"f{i % 3}.log", i, f"~[{i % 4}]; 2026-01-02; 03:04:0{i % 10}.000; {['ERROR', 'WARN', 'INFO'][i % 3]}; [c{i % 2}] lost 10.0.0.{i % 5}:80 Device.{i % 6}") for i in range(90)]
    recs = records.headers(spark.createDataFrame(lines, "file string, rec_ord long, line string"))
    whole, bare = records.signatures(recs), records.signatures(recs, sets=False)
    assert whole.columns == bare.columns
    lists = ["files", "addresses", "entities", "n_files", "n_addresses", "n_entities"]
    assert sorted(map(str, whole.drop(*lists).collect())) == sorted(map(str, bare.drop(*lists).collect()))
    assert whole.count() == 4 and bare.where(" or ".join(f"{c} is not null" for c in lists)).count() == 0


def test_lines_are_made_by_many_tasks(spark):
    own = views.log_lines(spark, "/root/testdata/sf0.001")
    assert own.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_events_are_stored_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(views, "written", lambda df, name, real=views.written: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    assert views.unnumbered(spark, "/root/testdata/sf0.001").count() > 0
    assert [name for name, _ in made] == ["events"] and made[0][1].count(r"regexp_replace(concat(~[") <= 1


def test_running_peaks(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # what Spark's own client of the state uses
    r = random.Random(11)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lines = []
    for i in range(900):
        minute = i // 60  # later lines are up to four minutes late
        at = max(0, minute * 60 + r.randint(0, 59) - (r.randint(0, 240) if r.random() < 0.3 else 0))
        lines.append((f"2026-01-02 03:{at // 60:02d}:{at % 60:02d}.000", r.choice(["ERROR", "WARN", "INFO"]), "c", r.choice(["lost", "slow", "lost link"])))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts string, level string, component string, message string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for k in range(3):
        rows = [dict(zip(("ts", "level", "component", "message"), x, strict=True)) for x in lines[k * 300 : k * 300 + 300]]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    query = storms.peak_stream(stream, storm=8, late="5 minutes").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start()
    try:
        query.awaitTermination(240)
        assert query.exception() is None
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    df = spark.createDataFrame(lines, "ts string, level string, component string, message string")
    keyed = df.where("level <> 'INFO'").select(T.signature(F.col("level"), F.col("component"), F.col("message")).alias("signature"), "ts")
    want = {x["signature"]: (x["peak"], x["storm"]) for x in records.peaks(keyed, "signature", storm=8).collect()}
    last = {}
    for s, peak, storm in seen:
        assert peak > last.get(s, (0,))[0]
        last[s] = (peak, storm)
    assert last == want
    assert kept[-1] < max(kept) < 90  # slices that can't grow any more have gone


def test_a_signature_of_many_values(spark):
    n = 30_000
    at = F.col("id")
    recs = spark.range(n).select(F.lit("a.log").alias("file"), at.alias("rec_ord"), F.lit("2026-01-02 03:04:05.000").alias("ts"), F.lit("ERROR").alias("level"), F.lit("c").alias("component"), F.concat(F.lit("10."), (at / 65536).cast("int"), F.lit("."), ((at / 256).cast("int") % 256).cast("string"), F.lit("."), (at % 256).cast("string")).alias("address"), F.lit("lost").alias("message"), F.lit("7").alias("thread"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = records.signatures(recs, most=100).collect()
        assert len(got) == 1 and len(got[0]["addresses"]) == 100 and got[0]["n_addresses"] == n and got[0]["n_files"] == 1 and got[0]["files"] == ["a.log"]
        assert got[0]["addresses"][:2] == ["10.0.0.0", "10.0.0.1"] and got[0]["addresses"][99] == "10.0.0.99"
        every = records.signatures(recs).collect()[0]["addresses"]  # without a cap that nobody asked for
        assert len(every) == n and every[12_345] == "10.0.48.57" and every[-1] == "10.0.117.47"
        values = records.signature_values(recs).where("kind = 'addresses'")
        places = values.agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place"), F.count_if(F.col("place") == F.col("at.ord") + 1)).first()
        assert tuple(places) == (n, n, 1, n, n)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", ["zip", "tar", "tgz"])
def test_logs_of_an_archive(spark, tmp_path, kind):
    root = tmp_path / "plain"
    logs = root / "x" / "Report" / "Logs"
    logs.mkdir(parents=True)
    (logs / "a.log").write_bytes(("~[1]; 2026-01-02; 03:04:05.100; ERROR; c: é 1\r\n  more\n\n" * 4000).encode() + b"\xff last")
    (logs / "b.log").write_text("~[2]; 2026-01-02; 03:04:05.100; WARN; c: two")
    (logs / "empty.log").write_text("")
    (logs / "c.txt").write_text("not a log")
    at = tmp_path / f"all.{kind}"
    if kind == "zip":
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*")):
                z.write(f, f.relative_to(root))
            z.writestr("../../evil/Logs/a2.log", "outside")
    else:
        with tarfile.open(at, "w:gz" if kind == "tgz" else "w") as t:
            t.add(root, ".")
    before = sorted(p.name for p in tmp_path.iterdir())
    got = archive.log_lines(spark, str(at), r"(?:\./)?x/Report/Logs/[^/]+\.log")
    assert got.rdd.getNumPartitions() == (1 if kind == "tgz" else 3)
    want = bundle.log_lines(spark, str(root / "x" / "Report"))
    lines = lambda df: sorted(map(tuple, df.select("file", "line").collect()))
    assert lines(got) == lines(want)
    parsed = lambda df: sorted(map(tuple, records.records(df).select("file", "rec_ord", "level", "message").collect()))
    assert parsed(got) == parsed(want)
    assert sorted(p.name for p in tmp_path.iterdir()) == before  # nothing was unpacked
    assert archive.log_lines(spark, str(at), "nothing").count() == 0
