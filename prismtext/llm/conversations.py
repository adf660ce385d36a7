"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation is empty or has an optional system turn and then pairs
of user and assistant turns: role initials ``(s?(ua)+)?``. Backward dynamic
programming gives the cost to go from every turn and grammar state; a forward
walk from the start then takes, of the edits that keep to that cost, the one
whose initial comes first in ASCII (Delete, Insert, Keep, Rerole). The state
fixes what is inserted or what a turn's role becomes, so the initials tell the
whole repair.

Turns are ordered by ranges of (conversation, turn, role, text), so the rows of
a long conversation lie in many tasks, and are numbered in that order. Runs of
at most ``RUN`` numbers are worked out apart: costs over a run are a min-plus
matrix from state to state, and only these matrices (and later the state that
each run hands on) pass along a conversation in turn, streamed row by row. The
last pass streams a conversation's edits in order through a running hash.

Defined results: null roles and texts are one space; rows of a null id are one
conversation; a null turn comes first; rows of one turn go by role, then text;
repeated rows are kept side by side, and all but the first are duplicates; an
initial other than s, u or a can't be kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RUN_BITS = 12
RUN = 1 << RUN_BITS
#: Costs of edits, and what a truncated turn that stays adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that an inserted or changed turn has in a state, and the state after it.
FILL = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
FULL = {"u": "user", "a": "assistant"}
#: Cost to go from each state after the last turn.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
INITIALS = "sua?"


def _filled(costs: list[int]) -> tuple[int, ...]:
    for _ in range(2):
        costs = [min(c, INSERT + costs[FILL[q][1]], FAR) for q, c in enumerate(costs)]
    return tuple(costs)


def _edits(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """What may be done with a turn in a state, in ASCII order: initial, cost, next state. A code is 3 times the place of its initial, plus 1 if truncated or 2 if it must go."""
    initial, fault = INITIALS[code // 3], code % 3
    yield "D", DELETE, state
    if fault < 2:
        if (state, initial) in NEXT:
            yield "K", TRUNCATED * fault, NEXT[state, initial]
        yield "R", REROLE + TRUNCATED * fault, FILL[state][1]


@lru_cache(maxsize=100_000)
def _before(code: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a turn from those after it."""
    return _filled([min(cost + ahead[to] for _, cost, to in _edits(code, q)) for q in range(4)])


@lru_cache(maxsize=100_000)
def _choice(code: int, state: int, here: tuple[int, ...], ahead: tuple[int, ...]) -> tuple[tuple[tuple[str, str | None], ...], int]:
    """The edits at a turn on the cheapest way, ASCII-least, each with the role that it gives; the state after it."""
    out: list[tuple[str, str | None]] = []
    while True:
        tight = {edit: to for edit, cost, to in _edits(code, state) if cost + ahead[to] == here[state]}
        if INSERT + here[FILL[state][1]] == here[state]:
            tight["I"] = FILL[state][1]
        edit = min(tight)
        out.append((edit, FILL[state][0] if edit in "IR" else None))
        state = tight[edit]
        if edit != "I":
            return tuple(out), state


def _relative(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs above the least, of which there are few kinds, and the least."""
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs), least


def backward(codes: list[int], ahead: tuple[int, ...]) -> tuple[list[tuple[tuple[int, ...], tuple[int, ...]]], tuple[int, ...]]:
    """For each turn the costs to go before and after it (both above some common base), and the costs before the first."""
    out, base = [], 0
    for code in reversed(codes):
        ahead, least = _relative(ahead)
        base += least
        here = _before(code, ahead)
        out.append((here, ahead))
        ahead = here
    return out[::-1], tuple(c + base if c < FAR else FAR for c in ahead)


def walk(codes: list[int], ahead: tuple[int, ...], state: int, last: bool) -> tuple[list[tuple[tuple[str, str | None], ...]], int]:
    """The edits of each turn of a run, and the state after it. After a conversation's last turn what is missing is inserted."""
    out = []
    for code, (here, after) in zip(codes, backward(codes, ahead)[0]):
        edits, state = _choice(code, state, here, after)
        out.append(edits)
    while last and END[state]:
        out[-1] += (("I", FILL[state][0]),)
        state = FILL[state][1]
    return out, state


def _faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character that is no blank is other than ``.``, ``!`` or ``?``."""
    end = F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1))
    return end == "", ~end.isin(".", "!", "?")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows in order of conversation and turn, with seq, which grows in that order, and code."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    dealt = rows.repartitionByRange(*keys, F.substring("text", 1, 64)).sortWithinPartitions(*keys, "text")
    initial = F.substring("role", 1, 1)
    blank, cut = _faults(F.col("text"))
    named = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = materialize(dealt.select("*", F.monotonically_increasing_id().alias("seq"), initial.alias("initial"), blank.alias("blank"), cut.alias("cut"), F.unhex(named).alias("said")), "turns", "zstd")
    first = placed.groupBy("conv_id", "said").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    marked = placed.select("conv_id", "seq", "initial", "blank", "cut").join(first, "seq", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    marked = marked.withColumn("fault", fault)
    place = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = 3 * place + F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    return placed.select("conv_id", "turn", "role", "text", "seq", "initial").join(materialize(marked.select("seq", "fault", code.alias("code")), "codes", "zstd"), "seq")


def _mapped(df: DataFrame, schema: str, do, names: list[str]) -> DataFrame:
    """``do`` takes the rows of a task as an iterator of tuples and gives rows; batches go in and out."""
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, held = to_arrow_schema(types), []

        def out() -> pa.RecordBatch:
            columns = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

        for row in do(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            held.append(row)
            if len(held) >= 8192:
                yield out()
                held.clear()
        if held:
            yield out()

    return df.select(*names).mapInArrow(run, types)


def _matrix(rows):
    """Of a run: its least cost from each state (rows) to each state (columns)."""
    for conv, first, codes in rows:
        columns = [backward(codes, tuple(0 if q == to else FAR for q in range(4)))[1] for to in range(4)]
        yield conv, first, [columns[to][q] for q in range(4) for to in range(4)]


def _costs_after(rows):
    """The runs of a conversation from its last to its first: the costs to go after each."""
    of, ahead = object(), END
    for conv, first, flat in rows:
        if conv != of:
            of, ahead = conv, END
        yield first, list(ahead)
        ahead = tuple(min(flat[4 * q + to] + ahead[to] for to in range(4)) for q in range(4))


def _states_after(rows):
    """The state that a run hands on, for each state in which it may begin."""
    for conv, first, codes, ahead in rows:
        yield conv, first, [walk(codes, tuple(ahead), q, False)[1] for q in range(4)]


def _states_before(rows):
    """The runs of a conversation from its first to its last: the state in which each begins."""
    of, state = object(), 0
    for conv, first, after in rows:
        if conv != of:
            of, state = conv, 0
        yield first, state
        state = after[state]


def _walked(rows):
    for first, codes, ahead, state, last in rows:
        for i, edits in enumerate(walk(codes, tuple(ahead or END), state or 0, last)[0]):
            for k, (edit, fill) in enumerate(edits):
                yield first + i, k, edit, FULL.get(fill)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in order: conv_id, seq, k (their order), edit, role and text (after it), turn, was (initial before it), fault, cost.

    What is not deleted is the repaired conversation. ``rows`` has conv_id, turn, role and text.
    """
    turns = _ordered(rows)
    codes = turns.select("conv_id", "seq", "code")
    run = F.shiftright("seq", RUN_BITS)
    # A conversation's numbers follow one another within a run, so the first tells them all.
    runs = codes.groupBy("conv_id", run.alias("run")).agg(F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"]).alias("codes"))
    ends = codes.groupBy("conv_id").agg(F.min("seq").alias("begin"), F.max("seq").alias("last"))
    by_last = ends.select(F.col("last").alias("end"), F.lit(True).alias("is_last"), (F.shiftright("begin", RUN_BITS) == F.shiftright("last", RUN_BITS)).alias("whole"))
    by_first = ends.select(F.col("begin").alias("first"), F.lit(True).alias("is_first"))
    runs = runs.withColumn("end", F.col("first") + F.size("codes") - 1).join(by_last, "end", "left").join(by_first, "first", "left")
    runs = materialize(runs.select("conv_id", "first", "codes", F.coalesce("is_last", F.lit(False)).alias("last"), F.coalesce("whole", F.lit(False)).alias("whole")), "runs", "zstd")

    split = runs.where(~F.col("whole"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    if split.isEmpty():
        states = runs.sparkSession.createDataFrame([], "first long, ahead array<long>, state int")
    else:
        matrices = _mapped(split, f"conv_id {conv}, first long, flat array<long>", _matrix, ["conv_id", "first", "codes"])
        inward = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first"))
        after = materialize(_mapped(inward, "first long, ahead array<long>", _costs_after, ["conv_id", "first", "flat"]), "after")
        handed = _mapped(split.join(after, "first"), f"conv_id {conv}, first long, after array<int>", _states_after, ["conv_id", "first", "codes", "ahead"])
        onward = handed.repartition("conv_id").sortWithinPartitions("conv_id", "first")
        states = after.join(_mapped(onward, "first long, state int", _states_before, ["conv_id", "first", "after"]), "first")
    edits = _mapped(runs.join(states, "first", "left"), "seq long, k int, edit string, fill string", _walked, ["first", "codes", "ahead", "state", "last"])

    new = F.col("edit") == "I"
    own = lambda c: F.when(~new, F.col(c))
    price = F.when(F.col("edit") == "D", DELETE).otherwise(F.when(new, INSERT).when(F.col("edit") == "R", REROLE).otherwise(0) + F.when(~new & (F.col("fault") == "truncated"), TRUNCATED).otherwise(0))
    return turns.join(edits, "seq").select(
        "conv_id", "seq", "k", "edit", F.coalesce("fill", "role").alias("role"), F.when(new, "").otherwise(F.col("text")).alias("text"), own("turn").alias("turn"), own("initial").alias("was"), own("fault").alias("fault"), price.cast("long").alias("cost")
    )


class _Report:
    """What is told of one conversation, from its edits in order."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.least = self.most = self.before = None
        self.distinct, self.audit, self.left, self.empty = 0, [], hashlib.sha256(), True

    def add(self, edit: str, role: str, text: str, turn: int | None, was: str | None, fault: str | None, cost: int) -> None:
        self.audit.append(edit)
        self.cost += cost
        if was is not None:  # not inserted
            if turn is not None and turn != self.most:
                self.least, self.most, self.distinct = turn if self.least is None else self.least, turn, self.distinct + 1
            if fault:
                self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + was not in ("su", "ua", "au")
            self.before = was
        if edit != "D":
            self.left.update((b"" if self.empty else b"\n") + f"{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.left.hexdigest()


def report(edits: DataFrame) -> DataFrame:
    """A row for each conversation: gaps in its turns, faults, illegal neighbours, cost, the edits' initials, and the hash of what is left.

    A row without an edit stands for a conversation and nothing else. Turns are whole numbers.
    """

    def stream(rows):
        one = None
        for conv, *row in rows:
            if one is None or conv != one.conv:
                if one:
                    yield one.row()
                one = _Report(conv)
            if row[0] is not None:
                one.add(*row)
        if one:
            yield one.row()

    conv = edits.schema["conv_id"].dataType.simpleString()
    ordered = edits.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "k")
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _mapped(ordered, schema, stream, ["conv_id", "edit", "role", "text", "turn", "was", "fault", "cost"])


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults, by a hash of the id and turn; a dropped row has the column gone."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times).drop("copy")


def op11_conversations(rows: DataFrame) -> DataFrame:
    broken = damaged(rows)
    edits = repair(broken.where(~F.col("gone")))
    known = broken.where("gone").select("conv_id").distinct()
    blank = known.select(*[F.col(f.name) if f.name == "conv_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in edits.schema])
    return report(edits.unionByName(blank))
