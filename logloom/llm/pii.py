"""Personal data: fixed patterns, and further identifiers by bootstrapped contextual extraction. DataFrame functions only.

Fixed patterns give e-mail addresses, IPv4 addresses, card and phone numbers; these spans are the seeds. Every other run of up to nine tokens that each have a digit, one space apart, is a candidate if it has at least 8 characters and 4 digits in all and no base span in it; a longer run is several candidates, and what stands before the `=` or `:` of `key=value` isn't part of it. Each seed or candidate is an instance, known by its text; the words around it are its lexical patterns: the word before, the two words before, the word after, each if it lies whole within AROUND characters.

Rounds score the graph of patterns and instances. A pattern with at least MIN_SEEDS different seeds has as confidence good / (good + bad + UNSEEN * unseen + 1): good is its occurrences weighted by the scores of their instances, unseen the rest of its seeds and candidates, and bad its occurrences in the whole corpus beside other words. An instance that isn't a seed gets the noisy-or of its confident patterns. Candidates that end at FOUND or above become spans of kind `id`.

Places are code points, ends exclusive. Matches are leftmost and don't overlap within a kind; failing matches are dropped and not tried again. A null text counts as empty. Rows are known by id and text, so repeated rows get equal results, each its own; a null id is allowed. Extra columns are ignored; an empty table gives no rows. Without seeds no pattern is confident and nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import dropped, quoted, texts, written

#: Each starts where a run of its characters does, or where the last match ended, so that a long run is read once; possessive repeats don't give back.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_NUMBER = r"(?=[^\x20\x09-\x0D]*[0-9])[^\x20\x09-\x0D]++"
CANDIDATE = rf"(?<![^\x20\x09-\x0D]){_NUMBER}(?:\x20{_NUMBER}){{0,8}}+"

ROUNDS = 3
MIN_SEEDS = 3
CONFIDENT = 0.8
FOUND = 0.8
#: What an unseen instance counts against a pattern, where an ordinary word counts 1.
UNSEEN = 0.1
#: Characters around a span in which its neighbouring words are sought.
AROUND = 80
#: Rows, and spans in them, of a table that is broadcast; more are joined by a shuffle.
FEW = 100_000

_SPAN = "array<struct<s:int,e:int,t:string>>"


def located(text: Column, pattern: str) -> Column:
    """Start, end and text of every match of a Java pattern."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("t")))
    none = F.array().cast(_SPAN)

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["t"].alias("t")))).alias("out"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(matches) > 0, spans).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_part() -> str:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return rf"\A{part}\.{part}\.{part}\.{part}\z"


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the spans that hold."""
    found = {
        "email": F.when(text.contains("@"), located(text, EMAIL)),
        "ip": F.filter(located(text, IP), lambda x: x["t"].rlike(_small_part())),
        "card": F.filter(located(text, CARD), lambda x: F.when(F.length(_digits(x["t"])).between(16, 19), luhn(_digits(x["t"]))).otherwise(False)),
        "phone": F.when(text.contains("+"), F.filter(located(text, PHONE), lambda x: F.length(_digits(x["t"])).between(8, 15))),
    }
    none = F.array().cast(_SPAN)
    return {k: F.coalesce(F.when(text.rlike("[0-9@]"), v), none) for k, v in found.items()}


def _context(text: Column, x: Column, kind: Column) -> Column:
    """An occurrence with its lexical patterns."""
    near, last = x["s"] <= AROUND, F.length(text) - x["e"] <= AROUND
    before = F.lower(F.when(near, F.concat(F.lit(" "), F.substring(text, F.lit(1), x["s"]))).otherwise(F.substring(text, x["s"] - AROUND + 1, F.lit(AROUND))))
    after = F.lower(F.concat(F.substring(text, x["e"] + 1, F.lit(AROUND)), F.when(last, F.lit(" ")).otherwise(F.lit(""))))
    one = F.regexp_extract(before, r"[\x20\x09-\x0D]([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\z", 1)
    two = F.regexp_replace(F.regexp_extract(before, r"[\x20\x09-\x0D]([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\z", 1), r"[\x20\x09-\x0D]+", " ")
    right = F.regexp_extract(after, r"\A[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]", 1)
    marked = [F.when(F.length(w) > 0, F.concat(F.lit(mark), F.regexp_replace(w, "[0-9]", "0"))) for mark, w in (("<", one), ("<<", two), (">", right))]
    return F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lower(x["t"]).alias("x"), F.filter(F.array(*marked), lambda p: p.isNotNull()).alias("patterns"))


def _contexts(text: Column, kind: str):
    return lambda x: _context(text, x, F.lit(kind))


def _kinded(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _scanned(rows: DataFrame) -> DataFrame:
    """(doc_id, key, spans, seen): base spans and the occurrences of seeds and candidates; the text isn't kept."""
    text = F.col("text")
    rows = rows.withColumns({"key": F.xxhash64("text")} | {f"_{k}": v for k, v in base_spans(text).items()})
    rows = rows.withColumn("_tokens", F.when(text.rlike("[0-9]"), located(text, CANDIDATE)).otherwise(F.array().cast(_SPAN)))
    every = F.concat(*(F.col(f"_{k}") for k in KINDS))

    def trimmed(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["t"], r"\A(?:[^0-9]*[=:])?[^A-Za-z0-9]*", 0))
        core = F.regexp_replace(F.substring(x["t"], lead + 1, F.length(x["t"])), r"[^A-Za-z0-9]+\z", "")
        s = x["s"] + lead
        return F.struct(s.alias("s"), (s + F.length(core)).alias("e"), core.alias("t"))

    candidates = F.filter(F.transform("_tokens", trimmed), lambda x: (F.length(x["t"]) >= 8) & (F.length(_digits(x["t"])) >= 4) & ~F.exists(every, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    seen = F.concat(*(F.transform(f"_{k}", _contexts(text, k)) for k in KINDS), F.transform(candidates, _contexts(text, "id")))
    spans = F.concat(*(F.transform(f"_{k}", _kinded(k)) for k in KINDS))
    return rows.select("doc_id", "key", spans.alias("spans"), seen.alias("seen"))


def _totals(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(p, total): how often the words of each pattern stand in the texts."""
    patterns = patterns.withColumn("w", F.regexp_replace("p", r"\A(?:<<|<|>)", ""))
    sought = patterns.select("w").distinct()
    words = F.filter(F.split(F.translate(F.lower("text"), "123456789", "0" * 9), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.select(words.alias("words"))
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda u, v: F.concat(u, F.lit(" "), v))
    grams = rows.select(F.explode(F.concat("words", pairs)).alias("w"))
    if sought.limit(FEW + 1).count() <= FEW:  # each of at most AROUND characters
        grams = grams.join(F.broadcast(sought), "w", "left_semi")
    return patterns.join(grams.groupBy("w").agg(F.count("*").alias("total")), "w", "left").select("p", F.coalesce("total", F.lit(0)).alias("total"))


def discovered(scanned: DataFrame, rows: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT, found: float = FOUND) -> DataFrame:
    """(doc_id, key, s, e) of the candidates that the patterns vouch for; rows: the texts that were scanned."""
    seen = scanned.select("doc_id", "key", F.explode("seen").alias("o")).select("doc_id", "key", "o.*")
    every = seen.select(F.explode("patterns").alias("p"), "x", (F.col("kind") != "id").alias("seed")).groupBy("p", "x").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = written(every, "pii-edges")
    usual = edges.groupBy("p").agg(F.sum(F.col("seed").cast("int")).alias("seeds")).where(F.col("seeds") >= min_seeds).select("p")
    totals = written(_totals(rows, written(usual, "pii-usual")), "pii-totals")
    scores = written(edges.groupBy("x").agg(F.max(F.col("seed").cast("double")).alias("score")), "pii-scores")
    for _ in range(rounds):
        good, all_ = F.sum(F.col("n") * F.col("score")).alias("good"), F.sum("n").alias("all")
        patterns = edges.join(scores, "x").groupBy("p").agg(good, all_).join(totals, "p")
        bad = F.greatest(F.col("total") - F.col("all"), F.lit(0)) + F.lit(UNSEEN) * (F.col("all") - F.col("good"))
        sure = patterns.select("p", (F.col("good") / (F.col("good") + bad + 1)).alias("confidence")).where(F.col("confidence") >= confident)
        noisy_or = 1 - F.exp(F.sum(F.log1p(-F.coalesce("confidence", F.lit(0.0)))))
        new = written(edges.join(sure, "p", "left").groupBy("x").agg(F.when(F.max("seed"), 1.0).otherwise(noisy_or).alias("score")), "pii-scores")
        dropped(scores)
        scores = new
    good = scores.where(F.col("score") >= found).select("x")
    return seen.where("kind = 'id'").join(good, "x", "left_semi").select("doc_id", "key", "s", "e")


def _extra(scanned: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, doc_id, extra): the added spans of each document that has any, as a small table in the shared folder."""
    spans = F.array_sort(F.collect_set(F.struct("s", "e")))
    return written(discovered(scanned, rows).groupBy("doc_id", "key").agg(F.transform(spans, _kinded("id")).alias("extra")), "pii-extra")


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    extra = extra.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    size = extra.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("extra")), F.lit(0)).alias("spans")).first()
    few = size["rows"] <= FEW and size["spans"] <= FEW
    return rows.join(F.broadcast(extra) if few else extra, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.key == F.col("_key")), "left").drop("_id", "_key")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, the base spans' digest, and all spans, for every row."""
    known = texts(docs, id_col, text_col)
    scanned = written(_scanned(known), "pii-scan")
    rows = _with_extra(scanned.drop("seen"), _extra(scanned, known))
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"), listed(F.concat("spans", F.coalesce("extra", none))).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns; each span of the text is replaced by its kind in angle brackets, overlapping spans by the first one's."""
    plain = texts(docs, id_col, text_col)
    extra = _extra(written(_scanned(plain), "pii-scan"), plain)
    text = F.coalesce(quoted(text_col), F.lit(""))
    known = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"), F.struct(*(quoted(c) for c in docs.columns)).alias("_row"))
    kinds = base_spans(F.col("text"))
    rows = _with_extra(known, extra)
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    base = F.concat(*(F.transform(v, _kinded(k)) for k, v in kinds.items()))
    by_place = F.array_sort(F.transform(F.concat(base, F.coalesce("extra", none)), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x["kind"].alias("kind"))))

    def cut(acc: Column, x: Column) -> Column:
        e = -x["back"]
        piece = F.concat(F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
        fresh = F.struct(e.alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))
        return F.when(x["s"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], e).alias("at"), acc["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(F.col("_spans"), start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    rows = rows.withColumn("_spans", by_place)
    changed = F.when(F.size("_spans") > 0, clean).otherwise(F.col("_row")[text_col])
    return rows.select(*(changed.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
