"""Metadata, storage, what a viewer derives, and the pluggable helpers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import evidence, lifecycle, lookup, player, pyramid, redact, timeline, view
from logloom.sources import sinks
from logloom.sources.store import Store


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_json("a/b.json", {"x": "é"})
    assert s.get_json("a/b.json") == {"x": "é"} and s.names("a") == ["b.json"] and s.size("a/b.json") == 11
    assert open(s.download("a/b.json", str(tmp_path / "local"))).read() == '{"x": "é"}'
    s.upload(str(tmp_path / "local"), "up")
    assert s.get("up") == s.get("a/b.json")
    with pytest.raises(FileNotFoundError):
        s.get("missing")
    with pytest.raises(ValueError):
        s.put("../out", b"")
    assert s.delete_prefix("a/") and not s.exists("a/b.json") and not s.delete("a/b.json")


def test_table_survives_a_restart(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path), "t", "id string, n int, l array<string>")
    for i in range(4):
        t.insert({"id": "a", "n": i, "l": ["x"]})
    again = sinks.Table(spark, str(tmp_path), "t", "id string, n int, l array<string>")
    assert again.get("a") == {"id": "a", "n": 3, "l": ["x"]} and again.get("b") is None
    assert len(again._versions()) == 3  # the current one and those that readers may still have


def test_analyses(spark, tmp_path):
    a = lifecycle.Analyses(spark, str(tmp_path))
    up = lifecycle.Uploads(a)
    key = up.begin("b.zip", 5)
    assert up.append(key, 0, b"abc") is None and up.offset(key) == 3
    with pytest.raises(lifecycle.Conflict):
        up.append(key, 0, b"ab")
    with pytest.raises(ValueError):
        up.append(key, 3, b"too many")
    id_ = up.append(key, 3, b"de")
    row = a.get(id_)
    assert a.store.get(row["storage_key"]) == b"abcde" and row["status"] == "queued" and a.by_storage_key(row["storage_key"])["id"] == id_
    with pytest.raises(lifecycle.Conflict):
        a.rerun(id_)
    report = {"profile": {"product": "P", "version": "5", "host": "h", "family": "current"}, "health": 73, "problems": [], "noise": [], "summary": "s", "analysed_by": "rules", "created_at": "now", "stats": {"signatures": 0, "errors": 0, "warnings": 0, "files": 0}}
    done = []
    assert a.run(id_, [("parse", lambda: done.append("parse")), ("rules", lambda: done.append("rules")), ("llm", lambda: report)])
    row = a.get(id_)
    assert (row["status"], row["product"], row["health_score"], row["problem_count"], row["available_stages"]) == ("done", "P", 73, 0, ["parse", "rules", "llm"])
    assert json.loads(a.exported(id_, "json"))["health"] == 73 and a.exported(id_).startswith("# Analysis of b.zip")
    with pytest.raises(lifecycle.Conflict):
        a.rerun(id_, "llm")  # nothing retrieved is stored
    with pytest.raises(ValueError):
        a.rerun(id_, "other")
    assert a.rerun(id_, "rules")["from_stage"] == "rules" and a.status(id_)["progress"] == 57
    assert a.run(id_, [("parse", lambda: done.append("again")), ("llm", lambda: report)], "rules") and done == ["parse", "rules"]
    assert [s["status"] for s in a.polled(id_, sleep=lambda _: None)] == ["done"]
    with pytest.raises(ZeroDivisionError):
        a.run(id_, [("parse", lambda: 1 / 0)])
    assert a.status(id_)["status"] == "error" and not a.cancel(id_)
    assert lifecycle.default_bundle(a.history()).count() == 1
    a.store.put_json(f"checkpoints/{id_}/x.json", 1)
    a.delete(id_)
    assert not a.store.exists(f"checkpoints/{id_}") and a.table.get(id_) is None and a.status(id_)["error"] == "not found"
    with pytest.raises(lifecycle.NotFound):
        a.get(id_)


def test_cancel_is_seen_between_stages(spark, tmp_path):
    a = lifecycle.Analyses(spark, str(tmp_path))
    id_ = a.insert("f", 1, "k")
    assert not a.run(id_, [("parse", lambda: a.cancel(id_)), ("rules", lambda: 1)])
    assert a.status(id_)["status"] == "cancelled" and a.get(id_)["available_stages"] == ["parse"]


def test_rules_brands_settings(spark, tmp_path):
    book = lifecycle.RuleBook(spark, str(tmp_path))
    with pytest.raises(ValueError):
        book.insert({"title": "t"})
    row = book.insert({"title": " Lost Link! ", "any_of": "a\n\n b ", "severity": "odd", "min_per_minute": "2.5"})
    assert (row["title"], row["any_of"], row["severity"], row["min_per_minute"]) == ("Lost Link!", ["a", "b"], "warning", 3) and row["key"].startswith("lost-link-")
    assert book.update(row["id"], {"component": " c ", "min_per_minute": 0})["component"] == "c"
    assert [(r["id"], r["component"], r["any_of"], r["min_per_minute"], r["all_of"]) for r in book.enabled()] == [(row["key"], "c", ["a", "b"], None, None)]
    book.update(row["id"], {"enabled": False})
    assert book.enabled() == [] and book.listed().count() == 1
    book.delete(row["id"])
    with pytest.raises(lifecycle.NotFound):
        book.update(row["id"], {})
    brands = lifecycle.Brands(spark, str(tmp_path))
    one = brands.insert({"product": "X", "head_log": "x.log"})
    assert brands.active().first()["head_log"] == "x.log"
    brands.update(one["id"], {"active": False})
    assert brands.active().count() == 0 and brands.listed().count() == 1
    brands.delete(one["id"])
    s = lifecycle.Settings(spark, str(tmp_path), {"model": "m", "api_key": None}, ("api_key",))
    assert s.save({"api_key": "k", "model": ""}) == {"model": "m", "api_key": "k"}
    assert s.save({"api_key": "", "model": "n"}) == {"model": "n", "api_key": "k"} and s.shown() == {"model": "n", "api_key_set": True}


def test_views():
    assert view.fetch_window(90_000) == (-180_000, 420_000, 120_000) and view.fetch_window(29_999)[2] == 0 and view.fetch_window(-30_000)[2] == 0
    assert view.visible_lanes(["a", "b", "c"], {"a"}) == ["b", "c"] and view.visible_lanes(["a", "b"], {"a"}, {"a"}) == ["a"]
    assert [lifecycle.current_step(p) for p in (0, 18, 99)] == [0, 1, 4] and lifecycle.current_step(0, "done") == 5
    assert [lifecycle.page_count(n) for n in (0, 10, 11)] == [1, 1, 2]


def kept_in_turn(rows, gap):
    want, last = [], None
    for t, i in sorted(rows):
        if last is None or t - last > gap:
            want.append(i)
            last = t
    return want


@pytest.mark.parametrize("slice_rows", [7, 65_536])
def test_debounce(spark, slice_rows):
    r = random.Random(2)
    every = {
        "dense": [(i * 700 + (i % 7) * 50, i) for i in range(1200)],
        "periodic": [(i * 20_000, i) for i in range(700)],  # two starts never keep the same rows
        "ties": [(i // 9 * 30_000, i) for i in range(900)],
        "negative": [(i * 9_999 - 5_000_000, i) for i in range(1000)],
        "random": [(r.randint(0, 40_000_000), i) for i in range(1500)],
        "one": [(-1, 0)],
        "bursts": [(k * 200_000 + r.randint(0, 29_000), 40 * k + j) for k in range(30) for j in range(40)],
    }
    for name, rows in every.items():
        df = spark.createDataFrame(rows, "ts_ms long, seq long").repartition(5)
        assert sorted(x["seq"] for x in timeline.debounced(df, rows=slice_rows).collect()) == sorted(kept_in_turn(rows, 30_000)), name


def test_debounce_takes_the_same_scans_however_many_slices(spark):
    df = spark.createDataFrame([(i * 20_000, i) for i in range(4000)], "ts_ms long, seq long")

    def jobs(rows):
        group = f"debounce-{rows}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            timeline.debounced(df, rows=rows).collect()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setJobGroup("", "")

    assert jobs(10) == jobs(1000)


def test_all_events_at_one_time(spark):
    df = spark.createDataFrame([(5, i) for i in range(1000)], "ts_ms long, k long").repartition(3)
    got = timeline.numbered(df, ["k"])
    assert sorted((r["seq"], r["k"]) for r in got.collect()) == [(i, i) for i in range(1000)]
    near = timeline.with_previous(df, ["k"], ["k"], ahead=True).collect()
    assert {r["k"]: r["next_k"] for r in near} == {i: i + 1 if i < 999 else None for i in range(1000)}


def test_chapters(spark):
    rows = [(0, "Server started"), (10_000, "New run at 5"), (31_000, "THIS IS APPHOST"), (31_500, "x")] + [(500_000, f"error {i}") for i in range(30)]
    df = spark.createDataFrame([(t, m, "ERROR" if m.startswith("error") else "INFO", "s", i) for i, (t, m) in enumerate(rows)], "ts_ms long, message string, level string, service string, seq long")
    got = timeline.chapters(df, timeline.histogram(df, 0, 500_000), 0, 500_000).orderBy("ts_ms").collect()
    assert [(r["ts_ms"], r["kind"], r["service"]) for r in got] == [(0, "restart", "s"), (31_000, "restart", "s"), (498_958, "storm", None)]


def test_helpers(spark):
    assert evidence.embedded(["a"], None) is None and evidence.embedded([], len) is None
    asked = []
    assert evidence.embedded(["x"] * 100, lambda b: asked.append(len(b)) or [[1.0]] * len(b)) == [[1.0]] * 100 and asked == [96, 4]
    assert evidence.embedded(["x"], lambda b: 1 / 0) is None
    calls = []

    def ask(**k):
        calls.append(k)
        return {"answer": "do", "confidence": 0.5, "sources": [{"title": "t", "url": "u", "product": "Jira: X"}] * 9} if k["query"] == "q" else None

    r = evidence.Retrieval(ask, {"current": "P"}, {"network": ["n"]})
    assert len(r.one("q", "5", "network", "current")["sources"]) == 6 and r.one("q", "5", "network")["answer"] == "do" and len(calls) == 1
    assert calls[0]["product_hint"] == "P" and calls[0]["topic_hints"] == ["n"] and r.one("other") is None
    assert evidence.Retrieval(lambda **k: 1 / 0).one("q") is None
    good = {"summary": "s", "health": 50, "problems": [{"severity": "info", "subsystem": "other", "title": "t", "confidence": 0.5, "evidence_refs": [0, 9]}]}
    found, words, health = evidence.model_findings(spark, "p", lambda _: good)
    assert (words, health, found.first()["evidence_refs"]) == ("s", 50, [0, 9])
    assert evidence.model_findings(spark, "p", lambda _: good | {"health": 101}) is None and evidence.model_findings(spark, "p", None) is None
    empty = spark.createDataFrame([], "severity string")
    assert evidence.summary(empty, 100).first()["summary"].startswith("No serious")
    assert evidence.explain_text([{"ts_text": "1", "service": "s", "level": "E", "message": "m"}] * 2, 9) == "1 s E m\n1"


def test_masked_events(spark):
    df = spark.createDataFrame([(0, "from 1.2.3.4", "2.2.2.2"), (1, "to 2.2.2.2", None)], "seq long, message string, component string")
    got = redact.masked_events(df).orderBy("seq").collect()
    assert [(r["message"], r["component"]) for r in got] == [("from <ip-1>", "<ip-2>"), ("to <ip-2>", None)]


def test_explain_without_errors(spark):
    df = spark.createDataFrame([(i, i, "INFO") for i in range(5)], "seq long, ts_ms long, level string")
    assert evidence.explain_sample(df, 3).count() == 3
    assert evidence.explain_sample(df.union(spark.createDataFrame([(9, 9, "WARN")], df.schema)), 3).collect()[0]["seq"] == 9
    assert timeline.capped(df.withColumn("f", F.lit(1)), ["f", "seq"], 5)[1] and not timeline.capped(df, ["seq"], 6)[1]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [("lost lunch", ["t lunch"]), (r"err\.code=\d+x", ["err.code="]), ("abc?def", ["ab", "def"]), ("abcd*", ["abc"]), ("abc{0,2}def", ["ab", "def"]), ("[abc]defg", ["defg"]), ("[^]x]defg", ["defg"]), ("(abcd)efg", ["efg"]), ("(abcd)?efg(hij(klm)nop)qr", ["efg", "qr"]), ("abc|def", []), ("(?i)abc", []), (r"\p{Lu}bcd", []), (r"\x41bcde", []), ("жabc", ["abc"]), ("abc+d", ["abc", "d"]), (r"\Qabc\E", []), (r"\b word", [" word"]), ("[a[bc]defg]hjl", [])],
)
def test_literals(pattern, want):
    assert lookup.literals(pattern) == [w for w in want if len(w) >= 3]


def test_search_by_index(spark, tmp_path):
    rows = [(i * 1000, i, f"svc{i // 400}", f"Message {i} of {'Ünit' if i % 97 == 0 else 'unit'} {i // 200} \u212aelvin" if i % 50 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "ts_ms long, seq long, service string, message string")
    path = sinks.timeline(df, str(tmp_path), "r", shard_rows=50)
    lookup.index(spark, path)
    shards = spark.read.parquet(path).select(F.col("_metadata.file_name")).distinct().count()
    for query, mode, fewer in (("message 19", "keyword", True), ("ÜNIT 4", "keyword", True), ("SVC3", "keyword", True), ("nowhere", "keyword", True), ("e", "keyword", False), (r"unit 7\b", "regex", True), (r"unit \d", "regex", False), ("kelvin", "regex", False), ("e 3|e 4", "regex", False)):
        want = [x["seq"] for x in player.search(df, query, mode, 5000).collect()]
        found, read = lookup.search(spark, path, query, mode, 5000)
        assert [x["seq"] for x in found.collect()] == want, query
        assert (read is not None and read < shards / 2) == fewer, (query, read, shards)


def test_pack(spark):
    problems = spark.createDataFrame([(0, "r", "T", "info", "other", 2, True, ["s" * 400], None, "q"), (1, None, "U", "warning", "network", 30, False, [], "c", "z")], "problem_ord int, rule_id string, title string, severity string, subsystem string, count long, storm boolean, samples array<string>, component string, retrieval_query string")
    answers = spark.createDataFrame([("q", "do " * 200, 0.5, [("jira", "t", "u"), ("doc", "w", None)] * 3)], "query string, answer string, confidence double, sources array<struct<kind: string, title: string, url: string>>")
    chains = spark.createDataFrame([(1, "L", "info", [(None, "other", "T", "p0"), ("2026", "network", "U", "p1")])], "ord int, label string, severity string, steps array<struct<ts: string, subsystem: string, title: string, id: string>>")
    hubs = spark.createDataFrame([(7, "D.1", "Disk", 2)], "component_id long, hub string, label string, size long")
    members = spark.createDataFrame([(7, "A.1", 0, "A", "n")], "component_id long, key string, ord long, cls string, name string")
    gear = evidence.gear_lines(spark.createDataFrame([("D", 1), ("A", 3)], "cls string, count long"), hubs, members)
    system = evidence.system_lines(spark, {"product": "P", "version": None}, {"dongle_found": False, "disks": [{"name": "C", "total_mb": 200.0, "free_mb": 5.0}], "notes": ["n"]})
    parts = [evidence.problem_lines(problems, answers), system, evidence.chain_lines(chains), gear]
    lines = evidence.pack(*parts).split("\n")
    assert lines == [
        "product=P", "dongle_found=False", "disk=C free_mb=5 of_mb=200", "note=n",
        "class name=A count=3", "class name=D count=1", "component 7: hub=D.1 | Disk", "- of 7: class=A name=n key=A.1",
        "problem 0: severity=info subsystem=other count=2 storm=yes rule=r | T", "- says " + "s" * 300, "- known confidence=0.50 | " + ("do " * 200)[:400], "- source jira t u", "- source doc w", "- source jira t u",
        "problem 1: severity=warning subsystem=network count=30 | U",
        "chain 1: by=L severity=info", "- no time p0 subsystem=other: T", "- 2026 p1 subsystem=network: U",
    ]
    assert evidence.pack(system, most=20) == "product=P\ndongle_fou\n[cut]"
    assert evidence.pack(evidence.problem_lines(problems.where("problem_ord > 5"))) == ""


def test_texts(spark):
    df = spark.createDataFrame([(0.0,), (512.0,), (1023.0,), (1024.0,), (1536.0,), (5.0 * 2**30,), (None,)], "n double")
    assert [r[0] for r in df.select(T.bytes_text(F.col("n"))).collect()] == ["0 B", "512 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 GB", "0 B"]
    assert spark.range(1).select(T.slug(F.lit("Ёж и Ель!"))).first()[0] == "ж-и-ель"
    times = spark.createDataFrame([("2026-05-07 15:48:27.155",), ("odd",), ("",), (None,)], "t string")
    assert [tuple(r) for r in times.select(T.short_time(F.col("t")), T.short_time(F.col("t"), True)).collect()] == [("15:48", "07.05 15:48"), ("odd", "odd"), ("\u2014", "\u2014"), ("\u2014", "\u2014")]


def test_explained(spark):
    df = spark.createDataFrame([(0, "a", "ERROR", "x 1"), (1, "a", "ERROR", "x 2"), (2, "b", "WARN", "y"), (3, "b", "ERROR", "z")], "seq long, service string, level string, message string")
    assert player.explained(df).first()["text"] == "events 4 errors 3 warnings 1 | busiest a | often x #: 2; z: 1"
    assert player.explained(df.where("seq > 9")).first()["text"] == "no events"


def test_a_crashed_write_blocks_nothing(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path), "t", "id string, n int")
    t.insert({"id": "a", "n": 1})
    (tmp_path / "t" / "new-dead").mkdir()  # a draft, and a version, that were never finished
    (tmp_path / "t" / "v-000000000001" / "_temporary").mkdir(parents=True)
    t.insert({"id": "b", "n": 2})
    t.insert({"id": "c", "n": 3})
    assert t.get("b") == {"id": "b", "n": 2} and t.read().count() == 3
    # a number that another writer has taken stays theirs
    assert not t.store.move("t/new-dead", "t/v-000000000002") and t.store.exists("t/new-dead") and t.read().count() == 3


def test_slots_and_edges():
    r = random.Random(1)
    for _ in range(500):
        lo, top = r.randint(-5000, 5000), r.randint(0, 6)
        hi = lo + r.randint(0, 3000)
        covered = [t for k, s in pyramid.slots(lo, hi, top) for t in range(s << 3 * k, (s + 1) << 3 * k)]
        assert sorted(covered) == list(range(lo, hi))
    # whatever the range holds, a bucket asks for some tens of slots
    assert max(len(pyramid.slots(r.randint(0, 10**12), 10**12 + r.randint(1, 10**12), 14)) for _ in range(200)) <= 14 * 14


def test_pyramid(spark, tmp_path):
    r = random.Random(8)
    base = 1_700_000_000_000
    rows = [(base + (r.randint(0, 5_000_000) if i % 3 else 777_777), f"s{i % 3}", r.choice(["ERROR", "WARN", "INFO"]), i) for i in range(4000)] + [(-5, "s0", "INFO", 4000)]
    df = spark.createDataFrame(rows, "ts_ms long, service string, level string, seq long").cache()
    path = pyramid.build(df, str(tmp_path / "p"))
    for start, end, buckets in ((base, base + 5_000_000, 240), (base + 777_000, base + 778_123, 60), (base + 777_777, base + 777_777, 40), (base - 10**7, base + 10**8, 97), (-5, base + 5_000_000, 10), (0, 10, 40), (base + 4_999_000, base + 9_000_000, 480)):
        want = sorted(map(tuple, timeline.histogram(df, start, end, buckets).collect()))
        assert sorted(map(tuple, pyramid.histogram(spark, path, start, end, buckets).collect())) == want, (start, end)
        used, asked = pyramid.needed(spark, path, start, end, buckets)
        assert used.count() <= 3 * len(asked) and len(asked) <= buckets * 2 * 14 * 14
    none = pyramid.build(df.where("seq < 0"), str(tmp_path / "none"))
    assert pyramid.histogram(spark, none, 0, 10, 5).count() == 0


def test_a_range_of_one_service_reads_few_shards(spark, tmp_path):
    r = random.Random(13)
    rows = [(1_700_000_000_000 + i * 1000, i, f"svc{r.randint(0, 31):02d}", f"message {i}") for i in range(16_000)]
    df = spark.createDataFrame(rows, "ts_ms long, seq long, service string, message string").cache()
    plain, by = sinks.timeline(df, str(tmp_path), "a", shard_rows=250), sinks.timeline_by_service(df, str(tmp_path), "b", shard_rows=250)
    lo, hi = rows[2000][0], rows[10_000][0]
    want = sorted(map(tuple, player.window(df, lo, hi, ["svc07"]).collect()))
    cost = {}
    for path in (plain, by):
        assert sorted(map(tuple, player.window(spark.read.parquet(path), lo, hi, ["svc07"]).select(df.columns).collect())) == want
        cost[path] = sinks.overlapping_service(sinks.service_zones(spark, path), lo, hi, "svc07").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    assert cost[by]["n"] * 3 < cost[plain]["n"] and cost[by]["b"] * 3 < cost[plain]["b"]
    assert sinks.timeline_by_service(df.where("seq < 0"), str(tmp_path), "c")
