"""Conversation repair: the search against all edit sequences and a plain dynamic programme, faults and texts against SQL, long
conversations in blocks, hard rows."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import conversations
from ledgerlens.llm.common import Scratch
from ledgerlens.llm.queries import _REPAIR_SQL

SCHEMA = "conv_id long, turn long, role string, text string"
RIGHT = re.compile(r"(s?(ua)+)?")


def by_all_sequences(rows, most_insertions):
    """The least (cost, audit) over all edit sequences of rows (initial, must go, truncated)."""
    best = None
    for inserted in itertools.product(range(most_insertions + 1), repeat=len(rows) + 1):
        if sum(inserted) > most_insertions:
            continue
        options = []
        for k, n in enumerate(inserted):
            options += [[("I", "u"), ("I", "a")]] * n
            if k < len(rows):
                own, gone, _ = rows[k]
                options.append([("D", "")] + ([] if gone else [("K", own), ("R", "u"), ("R", "a")]))
        for edits in itertools.product(*options):
            if not RIGHT.fullmatch("".join(x for _, x in edits)):
                continue
            at = cost = 0
            for edit, _ in edits:
                cost += {"D": 3, "K": 0, "R": 2, "I": 2}[edit]
                if edit != "I":
                    cost += edit != "D" and rows[at][2]
                    at += 1
            got = (cost, "".join(e for e, _ in edits))
            best = got if best is None or got < best else best
    return best


def by_table(rows):
    """The same by a table over rows and states."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    table = {"": (0, "")}

    def put(new, state, value):
        if state not in new or value < new[state]:
            new[state] = value

    def inserted(table):
        new = dict(table)
        for _ in range(2):
            for state, (cost, audit) in list(new.items()):
                for letter, to in moves[state].items():
                    if letter != "s":
                        put(new, to, (cost + 2, audit + "I"))
        return new

    for own, gone, cut in rows:
        new = {}
        for state, (cost, audit) in inserted(table).items():
            put(new, state, (cost + 3, audit + "D"))
            if not gone:
                for letter, to in moves[state].items():
                    if letter == own:
                        put(new, to, (cost + cut, audit + "K"))
                    if letter != "s":
                        put(new, to, (cost + 2 + cut, audit + "R"))
        table = new
    table = inserted(table)
    return min(table[s] for s in ("", "a") if s in table)


def symbol(row):
    own, gone, cut = row
    return chr(ord("A") + 4 * conversations.INITIALS.index(own) + (conversations.BLANK if gone else conversations.CUT if cut else conversations.FINE))


def random_row(rng):
    fault = rng.random()
    return rng.choice("ssuuuaaax"), fault < 0.2, 0.2 <= fault < 0.5


def test_search_proves_the_best_of_all_edit_sequences():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(25):
            rows = [random_row(rng) for _ in range(n)]
            assert conversations.solve("".join(map(symbol, rows))) == by_all_sequences(rows, 3) == by_table(rows)


def test_search_equals_the_table_on_long_rows():
    rng = random.Random(2)
    for _ in range(200):
        rows = [random_row(rng) for _ in range(rng.randrange(1, 60))]
        assert conversations.solve("".join(map(symbol, rows))) == by_table(rows)
    rows = [random_row(rng) for _ in range(256)]
    assert conversations.solve("".join(map(symbol, rows))) == by_table(rows)
    same = [("u", False, True)] * 256
    assert conversations.solve("".join(map(symbol, same))) == by_table(same)


def test_searches_over_blocks_equal_one_search():
    rng = random.Random(3)
    for _ in range(40):
        rows = [random_row(rng) for _ in range(rng.randrange(2, 40))]
        cuts = sorted({0, len(rows), *(rng.randrange(1, len(rows)) for _ in range(3))})
        steps = []
        for a, b in zip(cuts, cuts[1:]):
            step = {}
            for p, q, cost, audit in conversations.ways("".join(map(symbol, rows[a:b]))):
                step.setdefault(p, []).append((audit, q, cost))
            steps.append(step)
        assert conversations.search(steps, conversations.START, conversations.RIGHT) == by_table(rows)


def conversation_rows(seed=4):
    rng = random.Random(seed)
    say = lambda: rng.choice(["Yes.", "no", "What?", "\n", "", " ", "So be it! ", "Well. \t", None, "same text.", "ü…"])
    rows = []
    for conv in [None, *range(60), -(2**63), 2**63 - 1]:
        turn = 0
        for _ in range(rng.randrange(0, 12)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            rows.append((conv, rng.choice([turn, turn, turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), say()))
    rows += [(1000, t, "user" if t % 2 else "assistant", f"Turn {t % 40}." if t % 7 else "cut off") for t in range(400)]
    rows += [(1001, 5, "user", "the same row.")] * 30 + [(1002, None, None, None)] * 3 + [(1003, -(2**63), "user", "a."), (1003, 2**63 - 1, "assistant", "b.")]
    return rows


@pytest.mark.parametrize("block,fan", [(conversations.BLOCK, conversations.FAN), (4, 2)])
def test_repair_equals_sql(spark, block, fan, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "FAN", fan)
    rows = [r for r in conversation_rows() if r[0] != 1003]
    given = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = conversations.repair(given.select("*", *(F.lit(1).alias(c) for c in ("place", "c", "copy", "block", "n"))))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(_REPAIR_SQL)
    order = lambda r: (r[0] is None, r[0] or 0)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want.fetchall(), key=order)


def test_turns_far_apart_and_no_rows(spark):
    rows = [r for r in conversation_rows() if r[0] == 1003]
    plain = spark.createDataFrame(rows, SCHEMA)
    one = conversations.repair(plain, plain.withColumn("copy", F.lit(0))).first()
    assert one.gaps is None and one.cost == 0 and one.audit == "KK"
    near = spark.createDataFrame([(1, 3, "user", "a."), (1, 7, "assistant", "b.")], SCHEMA)
    assert conversations.repair(near, near.withColumn("copy", F.lit(0))).first().gaps == 3
    gone = conversations.repair(near, near.withColumn("copy", F.lit(0)).filter("false")).first()
    assert (gone.gaps, gone.cost, gone.audit) == (0, 0, "") and gone.repaired_sha256.startswith("e3b0c442")
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_places_follow_the_order_and_long_conversations_spread(spark):
    rows = [(7, t, "user", "x.") for t in range(3000)]
    stored = conversations.ordered(spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit(0)).repartition(8), Scratch(spark))
    turns = [r.turn for r in stored.orderBy("place").collect()]
    assert turns == sorted(turns)
