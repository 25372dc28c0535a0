"""Exact dedup: groups, the rows that stay and the identifiers by brute force; hard cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exactdedup

WS = re.compile(r"[\x20\x09-\x0D]")


def rows_of(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["der", "Über.", "naïve!", "日本。", "end?", "a,", "It", "\U0001f600", "x"]) + str(rng.randrange(30))
    text = lambda n: " ".join(word() for _ in range(n))
    long, body = text(6000), text(400)
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one two"), (5, "onetwo"), (5, "onetwo"), (6, "one  two "), (7, "One two"), (None, "one\ntwo"), (None, "alone"),
        (8, long), (9, long.replace(" ", "\n")), (10, long + "."), (11, long[1:]), (12, "q" * 20_000), (13, "q" * 20_001), (14, "q" * 10_000 + " " + "q" * 10_000),
        (15, "no break"), (16, "nobreak"), (17, " "), (-(2**63), body), (2**63 - 1, body), (18, body + "\U0001f600"), (None, body), (None, body),
    ]
    return rows + [(100 + i, rng.choice([body, text(3), text(200), "x1 x2"])) for i in range(60)]


def expected(rows):
    same = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        same[WS.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, k, doc_id))
    out = []
    for t, members in same.items():
        first = min(members)
        out += [(m[4], first[4], len(members), m[3] == first[3], hashlib.sha256(t.encode()).hexdigest()) for m in members]
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_groups(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("row", "recipe", "n_chars", "keep_id")))
    got = [tuple(r) for r in exactdedup.exact_digest(docs).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_one_row_of_each_group_stays_with_its_columns(spark):
    rows = [(i, t, f"x{k}", k) for k, (i, t) in enumerate(rows_of())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_row` string, `a.b` int")
    got = exactdedup.drop_copies(docs)
    assert got.columns == docs.columns
    left = [tuple(r) for r in got.collect()]
    assert set(left) <= set(rows)
    want = [x for x in expected([r[:2] for r in rows]) if x[3]]
    assert sorted((r[0] for r in left), key=lambda x: (x is None, x or 0)) == sorted((x[0] for x in want), key=lambda x: (x is None, x or 0))
    texts = [WS.sub("", r[1] or "") for r in left]
    assert len(texts) == len(set(texts))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, keep_id int")
    assert exactdedup.exact_digest(none).count() == 0 and exactdedup.drop_copies(none).count() == 0


def test_chunks_join_to_the_text_and_follow_the_content(spark):
    rows = rows_of()
    both = spark.createDataFrame(rows, "doc_id long, text string").select(exactdedup.normalised(F.col("text")).alias("t"))
    for t, parts in both.select("t", exactdedup.chunks(F.col("t"))).collect():
        assert "".join(parts) == t and all(0 < len(x) <= exactdedup.LONGEST for x in parts)
        assert all(len(x) >= exactdedup.SHORTEST for x in parts[:-1])
    rng = random.Random(5)
    long = "".join(rng.choice(["on", "Unter", "wall", "every", "stone", "is", "and"]) + rng.choice(["", "", "", "", ".", ","]) for _ in range(20_000))
    cut = lambda t: spark.range(1).select(exactdedup.chunks(F.lit(t)).alias("c")).first().c
    whole, shifted = cut(long), cut("Something else stands before. " + long)
    assert len(set(whole) & set(shifted)) > len(whole) / 2


def test_identifiers_are_verified(spark):
    """Under a seed whose identifiers clash nothing may be called equal: the next seed is taken."""
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda c, seed: F.struct((F.length(c) % 7).cast("long").alias("a"), F.lit(0).cast("long").alias("b")) if seed == 0 else exactdedup.identifier(c, seed)
    assert exactdedup.verified_seed(docs) == 0 and exactdedup.verified_seed(docs, weak) == 1
    got = [tuple(r) for r in exactdedup.groups(docs, identify=weak).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    with pytest.raises(ValueError, match="identifier"):
        exactdedup.verified_seed(docs, lambda c, seed: F.struct(F.lit(1).alias("a")))
