"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is right when its role initials read (s?(ua)+)?. Rows are kept, given another role, deleted, or rows without
text are inserted; the cheapest repair is wanted, of equally cheap ones the one whose audit, the initials of its edits, comes
first in ASCII. The search walks prefixes of edits with a stack of its own. It cuts off prefixes whose cost and a lower bound of
the rest exceed the best repair found, and those that a table for each (place, state) shows to be worse than another prefix
that got there; what is left when the stack is empty is proved best.

Faults are found by Spark. Rows get places in one range-partitioned order, and each BLOCK of places is searched by itself. A
conversation in several blocks is searched from every state of the grammar to every other in each block, and the same search
then runs over blocks as its steps, FAN of them at a time, so no task gets more than BLOCK rows or FAN blocks of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, Scratch, importable

#: Rows in a block, and blocks that are joined by one search.
BLOCK, FAN = 256, 64
#: Costs of edits, and of a truncated row that stays.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: States of the grammar: nothing yet, behind system, behind user, behind assistant; END stands for a right ending.
START, SYSTEM, USER, ASSISTANT, END = range(5)
#: Which initial leads where.
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
RIGHT = (START, ASSISTANT)
#: What stands for a row in a block's code: its initial (x: any other) in capitals where it must go, then * if it is truncated.
INITIALS = "suax"
#: Kinds of faults, as digits beside the initial.
FINE, BLANK, DUPLICATE, CUT = range(4)

Step = dict[int, list[tuple[str, int, int]]]  # by state: (edits, next state, cost)


def row_step(symbol: str) -> Step:
    """Edits of one row by state, without insertions. symbol is a letter of A.. for (initial, fault)."""
    initial, fault = divmod(ord(symbol) - ord("A"), 4)
    own, stays = INITIALS[initial], fault in (FINE, CUT)
    extra = TRUNCATED if fault == CUT else 0
    step: Step = {}
    for state, ways in GRAMMAR.items():
        step[state] = [("D", state, DELETE)]
        if stays and own in ways:
            step[state].append(("K", ways[own], extra))
        if stays:
            step[state] += [("R", to, RETYPE + extra) for letter, to in ways.items() if letter != "s"]
    return step


STEPS = {chr(ord("A") + k): row_step(chr(ord("A") + k)) for k in range(16)}
#: Insertions by state.
INSERTIONS = {state: [("I", to, INSERT) for letter, to in ways.items() if letter != "s"] for state, ways in GRAMMAR.items()}


def bounds(steps: list[Step], goals: tuple[int, ...]) -> list[dict[int, int]]:
    """Lower bounds of the cost of all steps from the k-th on, by state, whatever the audit: the cheapest edit of each step that
    leads on, and at most two insertions before it. As tight a bound leaves the search little but ties to walk."""
    far = 1 << 60
    shut = lambda at: {q: min([at[q], *(INSERT + at[to] for _, to, _ in INSERTIONS[q]), *(2 * INSERT + at[end] for _, to, _ in INSERTIONS[q] for _, end, _ in INSERTIONS[to])]) for q in GRAMMAR}
    out = [shut({q: 0 if q in goals else far for q in GRAMMAR})]
    for step in reversed(steps):
        after = out[-1]
        out.append(shut({q: min((cost + after[to] for _, to, cost in step.get(q, ())), default=far) for q in GRAMMAR}))
    return out[::-1]


def search(steps: list[Step], entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest way through all steps from `entry` to one of `goals`, ASCII-least audit; None if there is none.

    Two prefixes that reach one (place, state) at one cost have the same number of edits that use up rows, so neither's audit
    begins with the other's, and the order of audits is that of the prefixes: the worse prefix can go.
    """
    rest, n = bounds(steps, goals), len(steps)
    if rest[0][entry] >= 1 << 60:
        return None
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        place, state, cost, audit = stack.pop()
        bound = cost + rest[place][state]
        if best and (bound > best[0] or bound == best[0] and audit > best[1][: len(audit)]):
            continue
        before = reached.get((place, state))
        if before and before <= (cost, audit):
            continue
        reached[place, state] = (cost, audit)
        if place == n and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        children = [(place, to, cost + price, audit + edit) for edit, to, price in INSERTIONS[state]]
        if place < n:
            children += [(place + 1, to, cost + price, audit + edits) for edits, to, price in steps[place].get(state, ())]
        # The stack gives the last one first: the lowest bound, then the ASCII-least audit.
        children.sort(key=lambda c: (c[2] + rest[c[0]][c[1]], c[3]), reverse=True)
        stack += children
    return best


@lru_cache(maxsize=200_000)
def solve(code: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of at most BLOCK rows."""
    return search([STEPS[c] for c in code], START, RIGHT)


@lru_cache(maxsize=2_000)
def ways(code: str) -> tuple[tuple[int, int, int, str], ...]:
    """(entry, exit, cost, audit) of a block from every state to every other."""
    return through([STEPS[c] for c in code])


def through(steps: list[Step]) -> tuple[tuple[int, int, int, str], ...]:
    found = ((p, q, search(steps, p, (q,))) for p in GRAMMAR for q in GRAMMAR)
    return tuple((p, q, *x) for p, q, x in found if x)


def illegal_pairs(initials: str) -> int:
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))


# Rows and faults


def damage(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) after the damage of the contract, with `copy` (1 on a repetition).

    By crc32 of conv_id:turn, remainder 20: 0 drops a row, 1 empties its text, 2 takes its marks [.!?] away, 3 repeats it, 4
    makes its role user. A null is read as one blank in that key, in role and in text; conv_id and turn stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows stored with `place`, which rises by conversation and turn, nulls first; equal turns are ordered by role, text and copy.

    Ranges are cut by the order itself, so that a long conversation spreads over tasks.
    """
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32), "copy")
    return scratch.write(ranged.sortWithinPartitions("conv_id", "turn", "role", "text", "copy").withColumn("place", F.monotonically_increasing_id()), "rows")


def symbols(stored: DataFrame) -> DataFrame:
    """(conv_id, turn, place, symbol) of stored rows: the first fault that holds, and the role's initial.

    Texts are compared by SHA-256. A row repeats another when the first row of its conversation with its role and text
    stands before it; those firsts are minima, and only of repeated texts are they joined to the rows.
    """
    bare = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    bare = F.when(bare == "", "").otherwise(F.right(bare, F.lit(1)))
    rows = stored.select("conv_id", "turn", "place", "role", F.unhex(F.sha2("text", 256)).alias("digest"), bare.alias("last"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("last") == "", BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(~F.col("last").isin(".", "!", "?"), CUT).otherwise(FINE)
    own = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1))
    own = F.when((F.col("role") == "") | (own == 0), 3).otherwise(own - 1)
    return joined.select("conv_id", "turn", "place", F.chr(ord("A") + 4 * own + fault).alias("symbol"))


def fault_counts(marked: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, first_block, last_block) of each conversation that has rows."""
    fault = F.pmod(F.ascii("symbol") - ord("A"), F.lit(4))
    kinds = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": CUT}
    turns = marked.groupBy("conv_id", "turn").agg(*(F.count_if(fault == k).alias(n) for n, k in kinds.items()), F.min("place").alias("low"), F.max("place").alias("high"))
    wide = F.max("turn").cast("decimal(30,0)") - F.min("turn").cast("decimal(30,0)") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(
        F.coalesce(wide, F.lit(0)).try_cast("long").alias("gaps"), *(F.sum(n).alias(n) for n in kinds), _block(F.min("low")).alias("first_block"), _block(F.max("high")).alias("last_block")
    )


def _block(place: Column) -> Column:
    return F.call_function("div", place, F.lit(BLOCK))


SEGMENT = "block long, alone boolean, first string, last string, illegal long, ways array<struct<entry:int,exit:int,cost:long,audit:string>>"


def segments(marked: DataFrame, counts: DataFrame) -> DataFrame:
    """(conv_id, block, alone, first, last, illegal, ways) of each block of a conversation; alone: it is the whole conversation."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x.symbol), "")
    blocks = marked.groupBy("conv_id", _block(F.col("place")).alias("block")).agg(line.alias("code"))
    alone = counts.select(F.col("conv_id").alias("c"), (F.col("first_block") == F.col("last_block")).alias("alone"))
    rows = blocks.join(alone, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "block", "code", "alone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for code, whole in zip(batch.column("code").to_pylist(), batch.column("alone").to_pylist(), strict=True):
                initials = "".join(INITIALS[(ord(c) - ord("A")) // 4] for c in code)
                cells = [(START, END, *solve(code))] if whole else ways(code)
                found.append((initials[0], initials[-1], illegal_pairs(initials), [dict(zip(("entry", "exit", "cost", "audit"), x, strict=True)) for x in cells]))
            first, last, illegal, cells = zip(*found, strict=True) if found else ([], [], [], [])
            kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            arrays = [batch.column("conv_id"), batch.column("block"), batch.column("alone"), pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(illegal, pa.int64()), pa.array(cells, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", *(x.split()[0] for x in SEGMENT.split(", "))])

    return rows.mapInArrow(run, f"conv_id {dict(marked.dtypes)['conv_id']}, {SEGMENT}")


def join_segments(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Segments of long conversations joined, FAN of them at a time, until each conversation is one."""

    def run(key: tuple, part):
        import pandas as pd

        part = part.sort_values("block")
        steps: list[Step] = []
        for cells in part["ways"]:
            step: Step = {}
            for x in cells:
                step.setdefault(x["entry"], []).append((x["audit"], x["exit"], x["cost"]))
            steps.append(step)
        illegal = int(part["illegal"].sum()) + sum(illegal_pairs(x + y) for x, y in zip(part["last"], part["first"][1:]))
        cells = [dict(zip(("entry", "exit", "cost", "audit"), x, strict=True)) for x in through(steps)]
        out = part.iloc[[0]][["conv_id", "block", "alone", "first"]].assign(last=part["last"].iloc[-1], illegal=illegal)
        return out.assign(ways=pd.Series([cells], index=out.index))

    while True:
        sizes = parts.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"))
        if not (sizes.agg(F.max("n").alias("n")).first().n or 0) > 1:
            return parts
        sized = parts.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")))
        group = F.when(F.col("n") <= FAN, 0).otherwise(F.call_function("div", F.col("block"), F.lit(FAN))).alias("part")
        merged = sized.select(*parts.columns, group).groupBy("conv_id", "part").applyInPandas(lambda key, x: run(key, x.drop(columns="part")), parts.schema)
        merged = merged.withColumn("block", F.call_function("div", F.col("block"), F.lit(FAN)))
        parts = scratch.write(merged, "segments")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repaired(stored: DataFrame, plans: DataFrame) -> DataFrame:
    """plans (conv_id, RESULT) with repaired_sha256 of each conversation's rows after the edits of its audit.

    SHA-256 reads a conversation's text from front to end, so one task streams it; it keeps the audit and a batch of rows.
    """
    names = [x.split()[0] for x in RESULT.split(", ")]
    kind = dict(stored.dtypes)["conv_id"]
    plan = plans.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*names).alias("plan"))
    rows = stored.select("conv_id", "place", "role", "text", F.lit(None).cast(plan.schema["plan"].dataType).alias("plan"))
    together = plan.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None

        class Open:
            def __init__(self, conv_id, plan: dict):
                self.conv_id, self.plan, self.audit = conv_id, plan, plan["audit"]
                self.at, self.last, self.count, self.sha = 0, "", 0, hashlib.sha256()

            def emit(self, role: str, text: str) -> None:
                self.sha.update(("\n" if self.count else "").encode() + f"{role}:{text}".encode())
                self.count += 1
                self.last = role[:1]

            def role(self) -> str:
                return "assistant" if self.last == "u" else "user"

            def insertions(self) -> None:
                while self.audit[self.at : self.at + 1] == "I":
                    self.emit(self.role(), "")
                    self.at += 1

            def row(self, role: str, text: str) -> None:
                self.insertions()
                edit = self.audit[self.at]
                self.at += 1
                if edit != "D":
                    self.emit(role if edit == "K" else self.role(), text)

            def close(self) -> None:
                self.insertions()
                done.append((self.conv_id, *(self.plan[c] for c in names), self.sha.hexdigest()))

        def flush() -> pa.RecordBatch:
            types = [column_type, *([pa.int64()] * 6), pa.string(), pa.string()]
            columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *names, "repaired_sha256"])

        for batch in batches:
            column_type = batch.column("conv_id").type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for conv_id, place, role, text, plan_ in zip(*(part.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", "plan")), strict=True):
                    if place < 0:
                        if now:
                            now.close()
                        now = Open(conv_id, plan_)
                    else:
                        now.row(role, text)
                if done:
                    yield flush()
        if now:
            now.close()
            yield flush()

    return together.mapInArrow(run, f"conv_id {kind}, {RESULT}, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each conv_id of
    conversations (conv_id, turn, role, text), a null id being one like others.

    rows are the conversations' rows with a column `copy`; by default `damage(conversations)`. Rows with equal turns are taken by
    role, then text; null turns come first and don't count for gaps; a null role or text is one blank, and a role that begins
    with none of s, u, a can only be given another role or deleted. Repeated rows are duplicates. Conversations without rows have
    zeros, an empty audit and the hash of the empty text. Very long texts are hashed whole; other columns are left out; an empty
    table gives an empty one. gaps beyond 64 bits are null.
    """
    spark = conversations.sparkSession
    importable(spark)
    scratch = Scratch(spark)
    stored = ordered(rows if rows is not None else damage(conversations), scratch)
    marked = scratch.write(symbols(stored), "symbols")
    counts = scratch.write(fault_counts(marked), "counts")
    parts = scratch.write(segments(marked, counts), "segments")
    pick = F.filter("ways", lambda x: (x.entry == START) & x.exit.isin(START, ASSISTANT, END))
    best = F.array_min(F.transform(pick, lambda x: F.struct(x.cost.alias("cost"), x.audit.alias("audit"))))
    whole = parts.filter("alone").unionByName(join_segments(parts.filter("NOT alone"), scratch))
    whole = whole.select(F.col("conv_id").alias("c"), "illegal", best.alias("best"))
    plans = counts.join(whole, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")
    done = repaired(stored, plans).withColumnRenamed("conv_id", "c")
    ids = conversations.select("conv_id").distinct()
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("repaired_sha256").isNull(), 0).otherwise(F.col("gaps")).cast("long").alias("gaps")
    return ids.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
