"""Repair of conversations by weighted finite-state composition.

Three machines are composed: an input acceptor (a conversation's rows in order), an edit transducer (Keep, Rerole, Delete a row; Insert a message without text) and an acceptor of the role grammar `(s?(ua)+)?`. The composition is built lazily, and its topological order is that of the rows: between two rows at most two Inserts stand, as a third would come back to a grammar state at a higher cost, so there is no cycle. The shortest path is taken over the lexicographic weights (cost, label string). Labels of one row, Inserts before it and then its edit, are prefix-free, so paths into the states after a row are ordered by the rank of the path before and then by the label; a step from one vector of (cost, rank) to the next depends on little and is remembered.

Rows are dealt by ranges of (conversation, turn, role, start of the text, hash of the text). A conversation that lies within a range and is not long is repaired where it lies. The others are cut into blocks of rows: each block gives the shortest path from every grammar state to every other, and these few rows are folded in the order of the blocks. So one huge conversation is spread over all tasks, and so are its messages; only its audit and its digest, one cell each, are put together in one task, block by block and row by row.

Rows of equal turn stand in the order of role, then of the first 64 characters of the text, then of a hash of it. Null turns come first; a null conv_id is a conversation of its own; null roles and texts are one space. Repeated rows are duplicates and deleted. Empty texts are blank. Long texts are read whole. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import lean, lean_group, quoted, written

# ---------------------------------------------------------------- machines

#: Costs of the edits, and of a truncated row that isn't deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
EMPTY, SYSTEM, ASKED, ANSWERED = range(4)
#: The acceptor of `(s?(ua)+)?`: state and initial of a role to the next state.
GRAMMAR = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
FINAL = {EMPTY: 0, ANSWERED: 0, ASKED: 1, SYSTEM: 2}  # the Inserts that lead to an accepting state
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")


class Symbol(NamedTuple):
    """What the input acceptor reads of a row."""

    initial: str
    must_go: bool
    truncated: bool


class Vector(NamedTuple):
    """For each grammar state the cost of its best path (None: not reached) over the least of them, and the rank of its labels."""

    costs: tuple[int | None, ...]
    ranks: tuple[int, ...]


def start(state: int) -> Vector:
    return Vector(tuple(0 if s == state else None for s in range(4)), (0,) * 4)


def symbol(role: str, must_go: bool, truncated: bool) -> Symbol:
    initial = role[:1]
    return Symbol("", True, False) if must_go else Symbol(initial if initial in ("s", "u", "a") else "", False, truncated)


@functools.cache
def arcs(state: int, x: Symbol) -> tuple[tuple[str, int, int], ...]:
    """The composed arcs of a state over one row: (label, cost, next state)."""
    out, labels, cost = [], "", 0
    for _ in range(3):
        out.append((labels + "D", cost + DELETE, state))
        if not x.must_go:
            more = cost + TRUNCATED * x.truncated
            if (state, x.initial) in GRAMMAR:
                out.append((labels + "K", more + KEEP, GRAMMAR[state, x.initial]))
            out += [(labels + "R", more + REROLE, GRAMMAR[state, r]) for r in ROLES if (state, r) in GRAMMAR]
        state = next(GRAMMAR[state, r] for r in ROLES if (state, r) in GRAMMAR)
        labels, cost = labels + "I", cost + INSERT
    return tuple(out)


def relaxed(v: Vector, each: Iterable[tuple[int, str, int, int]]) -> tuple[Vector, int, tuple]:
    """One step over arcs (from, label, cost, to): the next vector, what was taken off its costs, and for each state (from, label)."""
    best: dict[int, tuple] = {}
    for s, label, cost, to in each:
        if v.costs[s] is not None:
            found = (v.costs[s] + cost, v.ranks[s], label, s)
            if to not in best or found < best[to]:
                best[to] = found
    least = min(b[0] for b in best.values())
    order = {b: i for i, b in enumerate(sorted({b[1:3] for b in best.values()}))}
    new = Vector(tuple(best[s][0] - least if s in best else None for s in range(4)), tuple(order[best[s][1:3]] if s in best else 0 for s in range(4)))
    return new, least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


@functools.cache
def step(v: Vector, x: Symbol) -> tuple[Vector, int, tuple]:
    return relaxed(v, ((s, *a) for s in range(4) for a in arcs(s, x)))


def shortest(symbols: Iterable[Symbol], state: int = EMPTY) -> dict[int, tuple[int, list[str]]]:
    """The best path from a state over all symbols to each state: cost and the labels of each row."""
    v, total, back = start(state), 0, []
    for x in symbols:
        v, least, steps = step(v, x)
        total += least
        back.append(steps)
    out = {}
    for s, c in enumerate(v.costs):
        if c is not None:
            labels, at = [], s
            for steps in reversed(back):
                at, label = steps[at]
                labels.append(label)
            out[s] = (total + c, labels[::-1])
    return out


def finished(paths: dict[int, tuple[int, list[str]]]) -> tuple[int, list[str]]:
    """The best of the paths with the Inserts that end it."""
    cost, labels, n = min((c + INSERT * FINAL[s], labels, FINAL[s]) for s, (c, labels) in paths.items())
    return cost, labels[:-1] + [labels[-1] + "I" * n] if labels else labels


def edited(state: int, role: str, text: str, labels: str) -> tuple[int, list[tuple[str, str, str]]]:
    """The messages (edit, role, text) that a row becomes, and the state after them."""
    out = []
    for label in labels:
        if label == "D":
            continue
        fresh = next(r for r in ROLES if (state, r) in GRAMMAR)
        state = GRAMMAR[state, role[:1] if label == "K" else fresh]
        out.append((label, role if label == "K" else ROLES[fresh], "" if label == "I" else text))
    return state, out


# ---------------------------------------------------------------- faults of rows


def blank(text: str) -> bool:
    return not text.strip(WHITE)


def cut_short(text: str) -> bool:
    return not text.rstrip(WHITE).endswith(ENDS)


class Faults:
    """What is counted along a conversation's rows. Counts of parts that follow each other can be joined."""

    FIELDS = ("n", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn", "first_role", "last_role")

    def __init__(self, **known):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.__dict__.update(known)

    def join(self, more: Faults) -> None:
        if not more.n:
            return
        if self.n:
            self.illegal += self.last_role + more.first_role not in ("su", "ua", "au")
        else:
            self.first_role = more.first_role
        if more.first_turn is not None:
            self.n_turns -= self.last_turn is not None and self.last_turn == more.first_turn
            self.first_turn = more.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = more.last_turn
        for f in ("n", "blank", "duplicate", "truncated", "illegal", "n_turns"):
            setattr(self, f, getattr(self, f) + getattr(more, f))
        self.last_role = more.last_role

    def row(self, turn: int | None, role: str, is_blank: bool, repeated: bool, truncated: bool) -> Symbol:
        repeated, truncated = repeated and not is_blank, truncated and not is_blank and not repeated
        self.join(Faults(n=1, blank=int(is_blank), duplicate=int(repeated), truncated=int(truncated), n_turns=int(turn is not None), first_turn=turn, last_turn=turn, first_role=role[:1], last_role=role[:1]))
        return symbol(role, is_blank or repeated, truncated)

    @property
    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.n_turns if self.n_turns else 0

    def counts(self) -> tuple[int, ...]:
        return self.gaps, self.blank, self.duplicate, self.truncated, self.illegal


# ---------------------------------------------------------------- on Spark

#: A conversation of more characters than this isn't held by one task; rows in a block of such a conversation.
LONG, BLOCK = 4_000_000, 8192
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGE = "conv_id long, part long, row long, nth long, edit string, role string, text string"
_LATER = "part long, block long, at long, turn long, role string, text string, whole boolean"


def crc_of(conv: Column, turn: Column) -> Column:
    return F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and present: of 20 rows, by a checksum, one each is dropped (it stays, not present), emptied, robbed of its full stops, repeated, and made the user's. Nulls in role and text are one space."""
    conv, turn, space = quoted(conv_col).cast("long"), quoted(turn_col).cast("long"), F.lit(" ")
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(quoted(role_col), space).alias("role"), F.coalesce(quoted(text_col), space).alias("text"), (crc_of(conv, turn) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_k") != 0).alias("present"), F.explode(times).alias("_nth")).drop("_nth")


def _ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present, dealt by ranges and in order within them. Equal rows can lie in several ranges."""
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in conversations.columns else F.lit(True)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    rows = rows.withColumns({"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "role", "_head", "_hash", "_row"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_head", "_hash", "_row")


def _whole(rows: list[tuple]) -> tuple[Faults, int, list[str]]:
    """Faults, cost and labels of a conversation at hand."""
    faults, seen, symbols = Faults(), set(), []
    for turn, role, text in rows:
        symbols.append(faults.row(turn, role, blank(text), (role, text) in seen, cut_short(text)))
        seen.add((role, text))
    return faults, *finished(shortest(symbols))


def _messages(rows: list[tuple], labels: list[str]) -> Iterator[tuple[int, str, str, str]]:
    state = EMPTY
    for i, ((_, role, text), own) in enumerate(zip(rows, labels, strict=True)):
        state, out = edited(state, role, text, own)
        yield from ((i, *m) for m in out)


def _columns(schema: str) -> tuple[list[str], list[pa.DataType]]:
    names = [x.split() for x in schema.split(", ")]
    return [n for n, _ in names], [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[k] for _, k in names]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = _columns(schema)
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _local(texts_too: bool, long: int, block: int):
    """Rows in order to finished conversations (whole) and, of the first and last of a range and the long ones, rows by block (not whole)."""
    head = MESSAGE if texts_too else SUMMARY
    later = [c for c, k in (x.split() for x in _LATER.split(", ")) if c not in head.replace(",", "").split()]
    schema = ", ".join([head, *(x for x in _LATER.split(", ") if x.split()[0] in later)])
    names = _columns(schema)[0]

    def done(conv, rows, part):
        faults, cost, labels = _whole(rows)
        found = list(_messages(rows, labels)) if rows else []
        if texts_too:
            return [dict(conv_id=conv, part=part, row=i, nth=n, edit=e, role=r, text=t, whole=True) for n, (i, e, r, t) in enumerate(found)]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in found).encode()).hexdigest()
        return [dict(zip(_columns(SUMMARY)[0], (conv, *faults.counts(), cost, "".join(labels), digest), strict=True), whole=True)]

    def run(batches):
        part = TaskContext.get().partitionId()
        out, held, size, conv, first, open_, number, at = [], [], 0, None, True, False, -1, 0
        begun = False

        def put(turn, role, text):
            nonlocal number, at
            if at == block or number < 0:
                number, at = number + 1, 0
            out.append(dict(conv_id=conv, part=part, block=number, at=at, turn=turn, role=role, text=text, whole=False))
            at += 1

        def opened():
            """From here on this conversation's rows are handed on; a row without a place says that it is there."""
            nonlocal open_, number, at, held
            open_, number, at = True, number + 1, 0
            out.append(dict(conv_id=conv, part=part, block=number, at=None, whole=False))
            for r in held:
                put(*r)
            held = []

        def flush():
            nonlocal out
            rows = [tuple(r.get(n) for n in names) for r in out]
            out = []
            return _batch(rows, schema)

        for b in batches:
            for c, turn, role, text, present in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "present")), strict=True):
                if not begun or c != conv:
                    if begun and not open_:
                        out += done(conv, held, part)
                    first, begun, conv, held, size, open_ = not begun, True, c, [], 0, False
                    if first:
                        opened()
                if not present:
                    continue
                if open_:
                    put(turn, role, text)
                else:
                    held.append((turn, role, text))
                    size += len(text) + 64
                    if size > long:
                        opened()
            if len(out) >= 256:
                yield flush()
        if begun and not open_:
            opened()
        yield flush()

    return run, schema


_COUNTS = "n long, blank long, duplicate long, truncated long, illegal long, n_turns long, first_turn long, last_turn long, first_role string, last_role string"
PATHS = "conv_id long, part long, block long, begin int, end int, cost long, labels string, " + _COUNTS
CHOSEN = "conv_id long, part long, block long, begin int, nth long, labels string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _block_paths(key, t):
    """A block's rows to the shortest paths between all states; its counts stand on each of them."""
    own = t.sort_by("at").select(["at", "turn", "role", "is_blank", "first", "cut"]).to_pylist()
    faults = Faults()
    symbols = [faults.row(r["turn"], r["role"], r["is_blank"], not r["first"], r["cut"]) for r in own if r["at"] is not None]
    counts = tuple(getattr(faults, f) for f in Faults.FIELDS)
    rows = [(*(k.as_py() for k in key), s, e, cost, "".join(labels), *counts) for s in range(4) for e, (cost, labels) in shortest(symbols, s).items()]
    return pa.Table.from_batches([_batch(rows, PATHS)])


def _folded(batches):
    """Paths in order of conversation and block to the labels of each block, with the state and the number of messages before it; the last block's row has the conversation's result."""
    names = _columns(PATHS)[0]
    conv, begun, blocks, v, total, back, faults = None, False, [], start(EMPTY), 0, [], Faults()
    paths: list[tuple[int, str, int, int]] = []

    def closed():
        """The current block's paths are complete."""
        nonlocal v, total, paths
        if paths:
            v, least, steps = relaxed(v, paths)
            total += least
            back.append(steps)
            paths = []

    def result():
        closed()
        s = min((c + INSERT * FINAL[s], v.ranks[s], s) for s, c in enumerate(v.costs) if c is not None)[2]
        cost, labels, begins, at = total + v.costs[s] + INSERT * FINAL[s], [], [], s
        for steps in reversed(back):
            at, own = steps[at]
            labels.append(own)
            begins.append(at)
        labels, begins = labels[::-1], begins[::-1]
        last = max((i for i, x in enumerate(labels) if x), default=None)
        if last is not None:
            labels[last] += "I" * FINAL[s]
        nth = itertools.accumulate((len(x) - x.count("D") for x in labels), initial=0)
        rows = [(conv, *b, begin, n, own, *[None] * 7) for b, begin, n, own in zip(blocks, begins, nth, labels, strict=False)]
        rows[-1] = (*rows[-1][:6], *faults.counts(), cost, "".join(labels))
        return _batch(rows, CHOSEN)

    for b in batches:
        for r in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            if not begun or r[0] != conv:
                if begun:
                    yield result()
                conv, begun, blocks, v, total, back, faults, paths = r[0], True, [], start(EMPTY), 0, [], Faults(), []
            if not blocks or blocks[-1] != r[1:3]:
                closed()
                blocks.append(r[1:3])
                faults.join(Faults(**dict(zip(Faults.FIELDS, r[7:], strict=True))))
            paths.append((r[3], r[6], r[5], r[4]))
    if begun:
        yield result()


def _long_rows(later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rows with their labels) of the conversations that were handed on."""
    rows = later.select("conv_id", "part", "block", "at", "turn", "role", "text")
    place = F.struct("part", "block", "at")
    kept = rows.where("at is not null")
    firsts = kept.groupBy("conv_id", "role", F.sha2("text", 256).alias("h")).agg(F.min(place).alias("p")).select("p.*", F.lit(True).alias("first"))
    white = r"[\x20\x09-\x0D]"
    light = rows.select("conv_id", "part", "block", "at", "turn", F.substring("role", 1, 1).alias("role"), (~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).alias("is_blank"), (~F.coalesce(F.col("text"), F.lit("")).rlike(rf"[.!?]{white}*\z")).alias("cut"))
    light = light.join(firsts, ["part", "block", "at"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    paths = light.groupBy("conv_id", "part", "block").applyInArrow(lean_group(_block_paths), PATHS)
    chosen = written(paths.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(lean(_folded), CHOSEN), "repair-chosen")
    each = chosen.select("part", "block", "begin", "nth", F.posexplode(F.regexp_extract_all("labels", F.lit(r"I*[KRD](?:I+\z)?"), F.lit(0))).alias("at", "labels"))
    return chosen.where("audit is not null"), kept.join(each.withColumn("at", F.col("at").cast("long")), ["part", "block", "at"])


def _put_together(rows: DataFrame, texts_too: bool) -> DataFrame:
    """Rows with labels to messages, block by block, or to each conversation's digest, for which one task gets all its rows in order."""
    schema = MESSAGE if texts_too else "conv_id long, repaired_sha256 string"

    def run(batches):
        of, state, digest, n, out = None, EMPTY, hashlib.sha256(), 0, []
        for b in batches:
            for c, part, blk, at, role, text, begin, nth, labels in zip(*(b.column(k).to_pylist() for k in ("conv_id", "part", "block", "at", "role", "text", "begin", "nth", "labels")), strict=True):
                unit = (c, part, blk) if texts_too else (c,)
                if unit != of:
                    if of is not None and not texts_too:
                        out.append((of[0], digest.hexdigest()))
                    of, state, digest, n = unit, begin, hashlib.sha256(), nth
                state, found = edited(state, role, text, labels)
                for e, r, t in found:
                    if texts_too:
                        out.append((c, part, blk << 32 | at, n, e, r, t))
                    else:
                        digest.update(f"{chr(10) * (n > 0)}{r}:{t}".encode())
                    n += 1
            if len(out) >= 256:
                yield _batch(out, schema)
                out = []
        if of is not None and not texts_too:
            out.append((of[0], digest.hexdigest()))
        yield _batch(out, schema)

    dealt = rows.repartition("part", "block") if texts_too else rows.repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "part", "block", "at").mapInArrow(lean(run), schema)


def _split(conversations: DataFrame, texts_too: bool, long: int, block: int) -> tuple[DataFrame, DataFrame]:
    run, schema = _local(texts_too, long, block)
    found = written(_ordered(conversations).mapInArrow(lean(run), schema), "repair")
    head = _columns(MESSAGE if texts_too else SUMMARY)[0]
    return found.where("whole").select(*head), found.where("not whole")


def audited(conversations: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    conversations has conv_id, turn, role, text and may have present: a row that isn't present only says that its conversation exists.
    """
    whole, later = _split(conversations, False, long, block)
    results, rows = _long_rows(later)
    digests = _put_together(rows, False).withColumnRenamed("conv_id", "_conv")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    ended = results.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing))
    return whole.union(ended.select(*whole.columns))


def repaired(conversations: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """The messages of the repaired conversations: conv_id, nth (from 0), edit (K, R or I), role and text."""
    whole, later = _split(conversations, True, long, block)
    return whole.union(_put_together(_long_rows(later)[1], True)).select("conv_id", "nth", "edit", "role", "text")
