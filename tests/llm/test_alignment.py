"""Cross-tokenizer alignment by brute force: both libraries' ids, overlaps of all pairs, counts by plain sets; hard texts."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import alignment
from ledgerlens.llm.common import Scratch


@pytest.fixture(scope="module")
def libraries():
    path = public_tokenizers.path("byte_bpe_50k.json")
    a = Tokenizer.from_file(path)
    a.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = alignment.byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spelled = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, {i: bytes(letters[c] for c in w) for w, i in vocab.items()}, b, spelled


def texts(seed=2):
    rng = random.Random(seed)
    words = ["the", "Über", "naïve", "日本語", "\U0001f600", "don't", "x=1;", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "ﬁ", "á", "1234567", "ΑΒ", "​", "łąka", "ⅷ"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [None, "", " ", "a", "two  blanks", " leading", "trailing ", "line\nline\r\n\ttab", "▁mark", "<s>", "<|endoftext|>", "\x00\x01", "\u0085 ", text(3000), "a" * 3000, text(40), text(40)]
    out += [text(rng.randrange(1, 60)) for _ in range(40)] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD800), rng.randrange(0x10000, 0x11000)])) for _ in range(80)) for _ in range(20)]
    return out


def expected(rows, libraries):
    a, a_bytes, b, b_bytes = libraries
    per, holds = [], defaultdict(set)
    for k, (doc_id, text) in enumerate(rows):
        want = (" " + (text or "")).encode()
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids
        y = b.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in x) != want or b"".join(b_bytes[i] for i in y) != want:
            per.append((doc_id, [], [], [], ""))
            continue
        ends = [np.cumsum([len(s[i]) for i in ids]).tolist() for s, ids in ((a_bytes, x), (b_bytes, y))]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts, links = [], []
        start = 0
        for c in cuts:
            inside = [[(e - len(s[i]), e, i) for i, e in zip(ids, es) if start < e <= c] for s, ids, es in ((a_bytes, x, ends[0]), (b_bytes, y, ends[1]))]
            links += [(i, j) for p, q, i in inside[0] for r, t, j in inside[1] if max(p, r) < min(q, t)]
            parts.append("|".join(",".join(str(i) for _, _, i in side) for side in inside))
            start = c
        for pair in links:
            holds[pair].add(k)
        per.append((doc_id, x, y, links, ";".join(parts)))
    most = defaultdict(int)
    for (i, _), docs in holds.items():
        most[i] = max(most[i], len(docs))
    return [
        (doc_id, len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(len(holds[p]) == most[p[0]] for p in links), sum(len(holds[p]) for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for doc_id, x, y, links, g in per
    ]


@pytest.mark.parametrize("piece", [3, 1000, alignment.PIECE])
def test_documents(spark, libraries, piece, monkeypatch):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts())] + [(5, "again and again"), (5, "again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("row", "pairs", "n_a", "a")))
    want = expected(rows, libraries)
    assert sum(x[1] > 0 for x in want) > 40
    if piece == alignment.PIECE:
        assert Counter(map(tuple, alignment.alignment(docs).collect())) == Counter(want)
    else:
        got = alignment.aligned(alignment.Speller(alignment.Vocabularies.load()), [t for _, t in rows], piece)
        assert [tuple(int(got[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")) for k in range(len(rows))] == [x[1:5] for x in want]
        assert [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]] == [x[7] for x in want]
        assert [int(got["times"][p:q].sum()) for p, q in zip(got["owner"], got["owner"][1:])] == [x[4] for x in want]


def test_rare_and_frequent_pairs_score_alike(spark, libraries):
    rows = list(enumerate(texts(7)))
    scratch, vocabularies = Scratch(spark), alignment.Vocabularies.load()
    stored = scratch.write(alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabularies), "aligned")
    counts = scratch.write(alignment.pair_counts(stored, alignment.Speller(vocabularies).b_bits), "counts")
    want = {(x[0], x[5], x[6]) for x in expected(rows, libraries)}
    for hot in (1e-9, 2e-3, 2.0):
        scores = alignment.link_scores(stored, counts, scratch, hot)
        assert {tuple(r) for r in stored.join(scores, "row").select("doc_id", "n_best", "count_sum").collect()} == want


def test_merge_path_pieces():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2))
        whole = alignment.align(a, b, 10**9)
        piece = int(rng.integers(1, 20))
        i, j = alignment.diagonals(a, b, piece)
        assert np.all(np.diff(i + j)[:-1] == piece) and (i[-1], j[-1]) == (len(a), len(b))
        for x, y in zip(whole, alignment.align(a, b, piece), strict=True):
            assert x.tolist() == y.tolist()
        starts = [np.append(0, x[:-1]) for x in (a, b)]
        brute = [(p, q) for p in range(len(a)) for q in range(len(b)) if max(starts[0][p], starts[1][q]) < min(a[p], b[q])]
        assert brute == list(zip(whole[0].tolist(), whole[1].tolist()))


def test_ids_equal_the_file_s_own_library(libraries):
    a = libraries[0]
    speller = alignment.Speller(alignment.Vocabularies.load())
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(160, 0x3000), rng.randrange(0xE000, 0x11000), rng.randrange(0x1F000, 0x20000), 32, 10, 39])) for _ in range(rng.randrange(60)))
        assert speller.a.encode_ordinary(text) == a.encode(text, add_special_tokens=False).ids


def test_groups_as_text_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string, row int")
    assert alignment.alignment(none).count() == 0
    one = alignment.align_documents(spark.createDataFrame([("x", "a b")], "doc_id string, text string"), alignment.Vocabularies.load(), with_groups=True).first()
    assert one.doc_id == "x" and one.groups.count("|") == one.n_groups == one.groups.count(";") + 1
    assert hashlib.sha256(one.groups.encode()).hexdigest() == one.groups_sha256
