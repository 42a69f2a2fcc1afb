"""Conversations by quotation links. DataFrame functions only.

Every line of a message has a quote level, the number of its leading `>` marks. A quoted passage is a run of lines of one level. Passages are normalised (lower case, runs of white space as one space) and hashed; a message offers the hashes of its whole own text, of its paragraphs and of its lines, and of the runs of two or more consecutive lines or paragraphs that are as long as a passage of the conversation; blank lines don't count. A passage is linked to the latest earlier message of the conversation that offers it as a whole, as its lines or as its paragraphs; a part of a line isn't offered. A message replies to the message that its shallowest linked passage comes from, without one to the message before it (turn - 1), if there is one. Replies give a tree; its roots and depths come from pointer doubling, so a long chain takes a logarithmic number of rounds. The order key (root, depth, turn) sorts each conversation so that a reply follows what it replies to; the texts are those without quotes.

Passages look back at the latest offer of their hash in one order of all of them, and joins are on conversation and turn, so one huge conversation, or one line that all its messages quote, is spread over all tasks.

A null text counts as empty. Rows that repeat (conv_id, turn) are messages of their own: they share the turn's place in the tree, and a link to the turn holds for each. A null conv_id or turn makes a message a root of its own. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import quoted, written
from logloom.operators.order import ordered

_MARKS = r"\A(?:[\x20\t]*>)+"


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), r"\A | \z", ""))


def parsed(text: Column) -> Column:
    """Lines as (level, text): the level counts the marks."""
    return F.transform(F.split(text, r"\r?\n", -1), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKS + r"\x20?", "").alias("t")))


def passages(lines: Column) -> Column:
    """Runs of lines of one level, as (level, text): a fold that extends the last run or begins another."""

    def add(acc: Column, x: Column) -> Column:
        same = F.size(acc) > 0
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x["level"].alias("level"), F.concat(last["t"], F.lit("\n"), x["t"]).alias("t"))))
        return F.when(same & (last["level"] == x["level"]), longer).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(lines, F.array().cast("array<struct<level:int,t:string>>"), add)


def own_text(lines: Column) -> Column:
    """The lines without marks, joined; lines that only announce a quote stay."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["t"]), "\n")


def _offered(text: Column) -> Column:
    """Normalised whole text, paragraphs and lines, none empty."""
    units = F.concat(F.array(text), F.split(text, r"\r?\n[\x20\t]*\r?\n", -1), F.split(text, r"\r?\n", -1))
    return F.array_distinct(F.filter(F.transform(units, normalised), lambda u: u != ""))


def _units(text: Column) -> list[tuple[str, Column]]:
    """Normalised lines and paragraphs, none empty, each with what joins a run of them: normalised texts hold no line break."""
    split = lambda at: F.filter(F.transform(F.split(text, at, -1), normalised), lambda u: u != "")
    return [("\n", split(r"\r?\n")), ("\n\n", split(r"\r?\n[\x20\t]*\r?\n"))]


def _asked(text: Column) -> Column:
    """A passage as a whole, and as runs of its lines and paragraphs if there are several; with the number of units of a run."""
    runs = [F.struct(F.when(F.size(u) > 1, F.array_join(u, by)).alias("u"), F.size(u).alias("n"), F.lit(by).alias("by")) for by, u in _units(text)]
    return F.filter(F.array(F.struct(normalised(text).alias("u"), F.lit(1).alias("n"), F.lit("").alias("by")), *runs), lambda x: x["u"].isNotNull())


def _runs(units: Column, by: str, lengths: Column) -> Column:
    """The runs of consecutive units of each of the lengths."""

    def of(n: Column) -> Column:
        starts = F.when(F.size(units) >= n, F.sequence(F.lit(1), F.size(units) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(units, i, n), by))

    return F.flatten(F.transform(lengths, of))


def _latest(asked: DataFrame, offers: DataFrame) -> DataFrame:
    """(conv_id, turn, i, level, source): the latest earlier offer of each passage that has one.

    Passages and offers lie in one order of (conversation, hash, turn), dealt by ranges, so a line that every message quotes is spread too, and each passage looks back at one row. A range's first key may go on from the ranges before, whose last key it is then: these hand on their latest offer.
    """
    key = ["conv_id", "hash"]
    none = F.lit(None).cast("long")
    questions = asked.select(*key, "turn", F.lit(0).alias("side"), F.col("i").cast("long").alias("i"), F.col("level").cast("long").alias("level"), none.alias("source"))
    own = ordered(questions.union(offers.select(*key, "source", F.lit(1), none, none, "source")), [*key, "turn", "side"], "quotes-order")
    inside = F.last("source", ignorenulls=True).over(Window.partitionBy("_part", *key).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    last = own.groupBy("_part").agg(F.max_by(F.struct(*key), "_place").alias("k")).select("_part", "k.*")  # a row for each range, like what follows
    tails = own.join(F.broadcast(last), ["_part", *key]).groupBy("_part", *key).agg(F.max("source").alias("_tail"))
    present = own.join(F.broadcast(last.select(*key).distinct()), key, "left_semi").select("_part", *key).distinct()
    before = F.max("_tail").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = present.join(tails, ["_part", *key], "left").withColumn("_carried", before).where("_carried is not null").select("_part", *key, "_carried")
    found = own.withColumn("_own", inside).where("side = 0").join(F.broadcast(carried), ["_part", *key], "left")
    return found.select("conv_id", "turn", "i", "level", F.coalesce("_own", "_carried").alias("source")).where("source is not null")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """For each message: conv_id, turn, role, reply_to (a turn), root (a turn), depth, n_quoted (passages), n_linked, clean_text."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = messages.select(quoted(conv_col).cast("long").alias("conv_id"), quoted(turn_col).cast("long").alias("turn"), quoted(role_col).alias("role"), text.alias("text"))
    lines = F.when(F.col("text").contains(">"), parsed(F.col("text")))
    rows = rows.withColumn("_lines", lines)
    clean = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(own_text(F.col("_lines")))
    quoted_ = F.filter(F.transform(F.filter(passages(F.col("_lines")), lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), p["t"].alias("t"))), lambda p: normalised(p["t"]) != "")
    none = F.array().cast("array<struct<level:int,t:string>>")
    rows = written(rows.select("conv_id", "turn", "role", clean.alias("clean_text"), F.coalesce(quoted_, none).alias("quotes")), "quotes-messages")

    asked = rows.where("size(quotes) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.posexplode("quotes").alias("i", "q"))
    asked = asked.select("conv_id", "turn", "i", F.col("q.level").alias("level"), F.explode(_asked(F.col("q.t"))).alias("x")).select("conv_id", "turn", "i", "level", "x.n", "x.by", F.sha2("x.u", 256).alias("hash")).distinct()
    asked = written(asked, "quotes-asked")
    wanted = asked.select("conv_id", "hash").distinct()
    own = rows.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").alias("source"), "clean_text")
    if asked.limit(1).count():
        offers = own.select("conv_id", "source", F.explode(_offered(F.col("clean_text"))).alias("u"))
        # a table of its own, so that the join of a huge conversation can be split
        units = _units(F.col("clean_text"))
        lengths = written(asked.where("n > 1").groupBy("conv_id").agg(*(F.collect_set(F.when(F.col("by") == by, F.col("n"))).alias(f"n{len(by)}") for by, _ in units)), "quotes-lengths")
        runs = F.concat(*(_runs(u, by, F.col(f"n{len(by)}")) for by, u in units))
        offers = offers.union(own.join(lengths, "conv_id").select("conv_id", "source", F.explode(F.array_distinct(runs)).alias("u")))
        offers = offers.select("conv_id", "source", F.sha2("u", 256).alias("hash")).join(wanted, ["conv_id", "hash"], "left_semi").distinct()
        linked = _latest(asked, offers).groupBy("conv_id", "turn", "i", "level").agg(F.max("source").alias("source"))
    else:  # nothing is quoted: no message needs to be taken apart
        linked = asked.select("conv_id", "turn", "i", "level", F.col("turn").alias("source"))
    replies = linked.groupBy("conv_id", "turn").agg(F.min_by("source", F.struct("level", -F.col("source"))).alias("quoted_turn"), F.count("*").alias("n_linked"))

    turns = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    tree = turns.join(before, ["conv_id", "turn"], "left").join(replies, ["conv_id", "turn"], "left")
    up = F.coalesce("quoted_turn", "previous")
    start = [up.alias("reply_to"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), F.coalesce(up, F.col("turn")).alias("top"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("depth"), up.isNull().alias("done")]
    tree = written(tree.select("conv_id", "turn", *start), "quotes-tree")
    settled, active = tree.where("done"), tree.where("not done")
    while active.limit(1).count():  # a message jumps to where its ancestor has got, and is done when that one is
        above = settled.union(active).select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("done").alias("there"))
        jumped = active.join(above, ["conv_id", "top"]).select("conv_id", "turn", "reply_to", "n_linked", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        new = written(jumped, "quotes-tree")
        settled, active = settled.union(new.where("done")), new.where("not done")
    tree = settled.drop("done")

    out = rows.join(tree, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("top", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.size("quotes").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "clean_text")
