"""Quality rules as a short-circuit cascade. DataFrame functions only.

Each rule is a condition on numbers of a text that rejects it. On a sample of at most SAMPLE rows every rule's cost is measured, the time that it and its numbers add to a scan of the sample, and all verdicts are counted together. The order is greedy: next comes the rule that rejects most of what the rules before it leave, for its cost; among those that reject none of it in the sample, the one that rejects most by itself. In the cascade a rule's numbers are computed only for texts that no rule before it rejects. Which texts are kept depends neither on the order nor on the sample; only the name of the rule that rejects a text first does.

`measured` gives the numbers of the first two rules and their like for every row. Words are the runs between white space. Windows of eight words found twice are first sought by a 64-bit hash made by doubling (no text with equal windows is missed); only where that has equal values are windows compared, by two 64-bit hashes, and sorted.

Null and empty texts have no words and are rejected. Long texts are read whole, each within its row. Repeated rows get equal results; a null id stays. Extra columns are kept by `kept` and ignored by `measured`; an empty table gives no rows, and then the rules stand in the order in which they are given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import dropped, quoted, texts, written

WHITE, BLACK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
WINDOW = 8
#: Rows of the sample that the order of the rules is estimated on, and the share of the rows met that it takes.
SAMPLE, SHARE = 2000, 0.125


class Rule(NamedTuple):
    """A name, the numbers that the rule needs (of NUMBERS), and the condition that rejects, made of their columns in that order."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]


# ---------------------------------------------------------------- numbers of a text


def _heads(c: str) -> Column:
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))


def _tails(c: str) -> Column:
    return F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))


def _doubled(c: str, k: int) -> Column:
    """Hashes of runs of k words to those of 2k words: the first run's, turned, and the second's. What runs over the end is left to the caller."""
    turned = lambda a: F.shiftleft(a, 9 * k).bitwiseXOR(F.shiftrightunsigned(a, 64 - 9 * k))
    return F.zip_with(c, F.slice(c, F.lit(k + 1), F.greatest(F.size(c), F.lit(0))), lambda a, b: turned(a).bitwiseXOR(b))


def _starts() -> Column:
    return F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))


def _window(i: Column) -> Column:
    return F.slice("words", i, F.lit(WINDOW))


def _same(x: Column, y: Column) -> Column:
    return F.when((x["h"] == y["h"]) & (x["k"] == y["k"]), F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>"))


def _length_of(pattern: str) -> Column:
    """Characters of the text that are not in runs of the pattern."""
    return F.length(F.regexp_replace("text", pattern, "")).cast("long")


#: Numbers that need columns of their own, in the order in which these are computed from `text`.
STEPS: dict[str, tuple[tuple[str, Callable[[], Column]], ...]] = {
    "words": (("words", lambda: F.array_remove(F.split("text", WHITE, -1), "")), ("n_words", lambda: F.size("words").cast("long"))),
    "lines": (("lines", lambda: F.filter(F.split("text", "\n", -1), lambda x: x.rlike(BLACK))),),
    "n_repeat_words": (
        ("_h1", lambda: F.when(F.col("n_words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w)))),
        ("_h2", lambda: _doubled("_h1", 1)),
        ("_h4", lambda: _doubled("_h2", 2)),
        ("_h8", lambda: F.slice(_doubled("_h4", 4), F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))),
        ("_often", lambda: F.coalesce(F.size(F.array_distinct("_h8")) < F.size("words") - (WINDOW - 1), F.lit(False))),
        ("_sorted", lambda: F.when(F.col("_often"), F.sort_array(F.transform(_starts(), lambda i: F.struct(F.xxhash64(_window(i)).alias("h"), F.xxhash64(F.lit(WINDOW), _window(i)).alias("k"), i.alias("i")))))),
        ("_at", lambda: F.when(F.col("_often"), F.sort_array(F.array_distinct(F.flatten(F.zip_with(_heads("_sorted"), _tails("_sorted"), _same)))))),
        ("n_repeat_words", lambda: F.when(F.size("_at") > 0, F.aggregate(F.zip_with(_heads("_at"), _tails("_at"), lambda x, y: F.least(y - x, F.lit(WINDOW))), F.lit(WINDOW), lambda a, x: a + x)).otherwise(0).cast("long")),
    ),
}
#: All other numbers, each an expression; and the steps that they stand on.
NUMBERS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "n_words": (("words",), lambda: F.col("n_words")),
    "word_chars": ((), lambda: _length_of(WHITE)),
    "n_symbols": ((), lambda: _length_of("[^#*$%&|<>]+")),
    "n_lines": (("lines",), lambda: F.size("lines").cast("long")),
    "n_dup_lines": (("lines",), lambda: F.when(F.size("lines") > 1, F.size("lines") - F.size(F.array_distinct("lines"))).otherwise(0).cast("long")),
    "n_repeat_words": (("words", "n_repeat_words"), lambda: F.col("n_repeat_words")),
    "n_wordless": (("words",), lambda: F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))).cast("long")),
    "n_capitals": ((), lambda: _length_of(r"\P{Lu}+")),
    "n_bullets": (("lines",), lambda: F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 2).isin("- ", "* ", "\u2022 "))).cast("long")),
    "n_ellipses": (("lines",), lambda: F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("\u2026"))).cast("long")),
}


def _stepped(rows: DataFrame, numbers: Sequence[str], guard: Column | None = None) -> DataFrame:
    """rows with the columns that the numbers stand on, computed where the guard holds."""
    for n in numbers:
        for step in NUMBERS[n][0]:
            if STEPS[step][-1][0] not in rows.columns:
                for name, how in STEPS[step]:
                    rows = rows.withColumn(name, how() if guard is None else F.when(guard, how()))
    return rows


# ---------------------------------------------------------------- rules


def _over(percent: int) -> Callable[..., Column]:
    return lambda whole, part: part * 100 > whole * percent


#: Bounds that are usual for web texts.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_words", ("n_words", "n_repeat_words"), _over(30)),
    Rule("symbols", ("n_words", "n_symbols"), _over(10)),
    Rule("word_length", ("n_words", "word_chars"), lambda n, chars: ~chars.between(n * 2, n * 12)),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), _over(30)),
    Rule("wordless", ("n_words", "n_wordless"), _over(40)),
    Rule("shouting", ("word_chars", "n_capitals"), _over(50)),
    Rule("bullets", ("n_lines", "n_bullets"), _over(90)),
    Rule("ellipses", ("n_lines", "n_ellipses"), _over(30)),
)
BASE = ("few_words", "repeated_words")


def _verdict(rows: DataFrame, r: Rule) -> Column:
    return r.rejects(*(F.col(n) if n in rows.columns else NUMBERS[n][1]() for n in r.needs))


def ordered(rows: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules in the order of the cascade, estimated on a sample of rows, which have a column text."""
    own = written(rows.select("text").sample(SHARE, seed=1).limit(sample), "quality-sample")
    if own.count() < sample // 10:  # a small table
        dropped(own)
        own = written(rows.select("text").limit(sample), "quality-sample")

    def flags(of: Sequence[Rule]) -> DataFrame:
        stepped = _stepped(own, [n for r in of for n in r.needs])
        return stepped.select("text", *(F.coalesce(_verdict(stepped, r), F.lit(False)).alias(f"r{i}") for i, r in enumerate(of)))

    def took(*of: Rule) -> float:
        times = []
        for _ in range(2):
            began = time.perf_counter()
            flags(of).agg(F.sum(F.length("text")), *(F.count_if(f"r{i}") for i in range(len(of)))).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    scan = took()
    costs = [max(took(r) - scan, 1e-4) for r in rules]
    patterns = flags(rules).groupBy(*(f"r{i}" for i in range(len(rules)))).count().collect()  # at most a row for each row of the sample
    dropped(own)
    alone = [sum(p["count"] for p in patterns if p[i]) for i in range(len(rules))]
    order: list[int] = []
    while len(order) < len(rules):
        left = [p for p in patterns if not any(p[i] for i in order)]
        rest = [i for i in range(len(rules)) if i not in order]
        order.append(max(rest, key=lambda i: (sum(p["count"] for p in left if p[i]) / costs[i], alone[i] / costs[i], -i)))
    return [rules[i] for i in order]


def cascade(rows: DataFrame, order: Sequence[Rule], rejected: Column | None = None) -> DataFrame:
    """rows with rejected_by, the first rule that rejects a text, null for texts that are kept. Texts that are `rejected` already aren't looked at; their name is ''.

    Rules are branches of one CASE expression, which is cut only where a rule stands on columns of its own.
    """
    by = F.when(F.lit(False) if rejected is None else rejected, F.lit(""))
    for i, r in enumerate(order):
        if any(STEPS[step][-1][0] not in rows.columns for n in r.needs for step in NUMBERS[n][0]):
            rows = rows.withColumn(f"_by{i}", by)
            rows = _stepped(rows, r.needs, F.col(f"_by{i}").isNull())
            by = F.when(F.col(f"_by{i}").isNotNull(), F.col(f"_by{i}"))
        by = by.when(_verdict(rows, r), F.lit(r.name))
    # an id of the row keeps the optimizer from writing the whole cascade into a filter on it, where each step would be computed anew
    rows = rows.withColumn("_by", by).withColumn("_step", F.monotonically_increasing_id())
    return rows.withColumn("rejected_by", F.when(F.col("_step") >= 0, F.col("_by")))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """A row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    known = texts(docs, id_col, text_col)
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = _stepped(known, numbers)
    rows = rows.select("doc_id", "text", "words", "lines", *(NUMBERS[n][1]().alias(n) for n in numbers))
    failed = F.lit(False)
    for r in rules:
        if r.name in BASE:
            failed = failed | _verdict(rows, r)
    rows = cascade(rows.withColumn("base_failed", failed), ordered(known, [r for r in rules if r.name not in BASE]), F.col("base_failed"))
    return rows.select("doc_id", *numbers, "base_failed", F.col("rejected_by").isNull().alias("kept"))


def kept(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    rows = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("_row"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    good = cascade(rows, ordered(rows, rules)).where("rejected_by is null")
    return good.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
