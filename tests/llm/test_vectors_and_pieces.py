"""Vectors and pieces against brute force and the public library; the pipeline; the registered queries against their SQL."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ledgerlens.llm import neardup, pieces, queries

SF = "/root/testdata/sf0.001"


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((len(rows), [float(x) for x in base + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])], int(g % 3)))
    rows += [(len(rows) + i, list(rows[5][1]), 2) for i in range(4)] + [(len(rows) + 10 + i, list(rows[5][1]), rows[5][2]) for i in range(3)]
    n = 10_000
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0] * 4, [2.0] * 4]
    return rows + [(n + i, v, 1) for i, v in enumerate(odd)] + [(n + 100, rows[0][1], None), (n + 101, rows[0][1], None), (n + 7, [2.0] * 4, 1)]


def linked(rows):
    ok = [r[1] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(r[1]) and r[2] is not None for r in rows]
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i < j and ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], n[i], low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("shard", [8192, 60])
def test_neardup(spark, monkeypatch, shard):
    monkeypatch.setattr(neardup, "SHARD_ROWS", shard)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == linked(rows)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(3000, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = neardup.Graph(unit)
    ids, _ = graph.search(unit[:200], 64)
    best = np.argsort(-(unit[:200] @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, best, strict=True)]) > 0.9


def test_links_of_a_dense_group_are_all_found():
    rng = np.random.default_rng(2)
    unit = np.concatenate([rng.normal(size=(2500, 24)), rng.normal(size=24) + rng.normal(size=(500, 24)) * 0.1])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    q, node = neardup.linked(neardup.Graph(unit), unit)
    a, b = np.nonzero(unit @ unit.T >= 0.93)
    found = set(zip(q.tolist(), node.tolist(), strict=True))
    assert len(found & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.995 * len(a)


TEXTS = ["", " ", "Hello world.", "  two  blanks ", "tabs\tand\n\nlines\r\n", "日本語 🙂 naïve", "a" * 300, "mixed " + "é" * 90, "x▁y", "<s> </s> <unk> <0x41>", "1234567 3.14", "​﻿\x00z", "ab" * 400 + " end"]


def test_pieces_equal_the_library():
    data = pieces.model_file()
    sp, enc = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Encoder(pieces.PieceModel.load(data))
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("abcdefgh eiou \n.,'éß日") for _ in range(rng.randrange(200))) for _ in range(300)]
    got = enc.encode(texts)
    assert [x.tolist() for x in got] == sp.encode(texts)
    assert enc.decode(got) == [sp.decode(x.tolist()) for x in got]


def test_viterbi_equals_the_library_on_a_unigram_model():
    """The same pieces with their type set to unigram, as the library reads it."""
    data = pieces.model_file()
    out, spec = bytearray(), None

    def varint(n):
        b = bytearray()
        while n > 127:
            b.append(n & 127 | 128)
            n >>= 7
        return bytes([*b, n])

    for number, value in pieces._fields(data):
        if number == 2:
            spec = bytearray()
            for n, v in pieces._fields(value):
                if n == 3:
                    v = pieces.UNIGRAM
                if isinstance(v, int):
                    spec += varint(n << 3) + varint(v)
                elif len(v) == 4 and n in (10, 11, 16, 17, 15):
                    spec += varint(n << 3 | 5) + v
                else:
                    spec += varint(n << 3 | 2) + varint(len(v)) + v
            value = bytes(spec)
        out += varint(number << 3 | 2) + varint(len(value)) + value
    model = pieces.PieceModel.load(bytes(out))
    assert model.kind == pieces.UNIGRAM
    try:
        sp = sentencepiece.SentencePieceProcessor(model_proto=bytes(out))
    except RuntimeError as error:
        pytest.skip(f"the library doesn't read the changed model: {error}")
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeiounrst") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    score = lambda ids: sum(model.scores[i] for i in ids)
    for w, ids in zip(words, pieces.Encoder(model).encode(words), strict=True):
        assert score(ids) == pytest.approx(score(sp.encode(w)))


def test_encode_table(spark):
    data = pieces.model_file()
    df = spark.createDataFrame([(1, None, 5), *((i, t, 5) for i, t in enumerate(TEXTS))], "doc_id long, text string, ids int")
    out = pieces.decode(pieces.encode(df, data), data)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert [list(r.ids) for r in out.collect()] == [sp.encode(t) for t in ["", *TEXTS]]
    digest = pieces.pieces_digest(df.select("doc_id", "text"), data)
    assert digest.filter("NOT round_trip").count() == 0 and pieces.pieces_digest(df.limit(0), data).count() == 0


def test_pipeline(spark, tmp_path):
    names = ["extra", "n_words", "fail_bits", "n_lines", "n_dropped", "ids", "__row", "__k", "__t", "__m", "__c", "__first", "__gone", "_aside"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.concat_ws(" ", F.lit(c), "doc_id") for c in names})
    odd = [(None, None), (7, None), (-1, ""), (None, "word " * 80), (-2, "other words here " * 30)]
    docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "ids_"]
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_file())
    rows = out.collect()
    assert len(rows) > 50
    for r in rows:
        assert list(r["ids_"]) == sp.encode(r.text or "") and r.n_chars == len(r.text)
        assert all(r[c] == (None if r.doc_id is None or r.doc_id < 0 else f"{c} {r.doc_id}") for c in names)
    spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_many_vectors_of_a_label_go_through_the_graphs_of_several_shards(spark, monkeypatch):
    """20,000 vectors in 3 shards: pairs, a family of 400 and lone vectors; graphs walk, as a beam is far below a quarter."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(9_800, 24))
    near = base + rng.normal(size=base.shape) * rng.choice([0.02, 0.2, 0.6], size=(len(base), 1))
    family = rng.normal(size=24) + rng.normal(size=(400, 24)) * 0.05
    rows = np.concatenate([base, near, family])
    calls = []
    plain = neardup.Graph.search
    monkeypatch.setattr(neardup.Graph, "search", lambda self, *a: (calls.append(len(self.unit)), plain(self, *a))[1])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    expected = np.zeros(len(rows), int)
    for at in range(0, len(rows), 2_000):
        expected[at : at + 2_000] = (unit[at : at + 2_000] @ unit.T >= neardup.THRESHOLD).sum(axis=1) - 1
    neardup.linked(neardup.Graph(unit[:4_000]), unit[:200])
    assert calls == [4_000]
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(rows.tolist())], "vec_id long, embedding array<double>, label int")
    got = df.transform(neardup.near_duplicates).select("vec_id", "n_links").toPandas().sort_values("vec_id")["n_links"].to_numpy()
    recall = got.sum() / expected.sum()
    print("recall", recall)
    assert (got <= expected).all() and recall >= 0.995
