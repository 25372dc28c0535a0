"""Operators on documents: contracts by brute force, and hard cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import linededup, lm, minhash, mixing, quality, sharding, tokencounts, toxicity, words
from ledgerlens.llm.common import Scratch, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hard_rows(seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "Über", "naïve", "x#", "end.", "a", "idiot", "ΑΒ", "日本"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    long = text(9000)
    body = text(80)
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n\x0b ", "en", None, 5), (4, "one two", "en", "b", 7), (5, "ONE two", "en", "b", 7),
        (6, long, "en", "a", len(long)), (7, long + " more", "en", "c", 0), (8, body, "de", None, 1), (9, body + " tail", "de", "a", 1), (10, body.upper(), "de", "a", 1),
        (None, body, "en", "a", 1), (None, "lonely text here", "en", "b", 1), (11, "dup dup dup dup\nx\nx\n y\n", "en", "b", 3), (12, "dup dup dup dup\nx\nx\n y\n", "en", "b", 3),
        (12, "dup dup dup dup\nx\nx\n y\n", "en", "b", 3), (13, "ZERO width\u0085next line\r\nline", "xx", "\U0001f600", 9),
    ]
    return rows + [(100 + i, text(rng.randrange(1, 120)) + "\n Shared LINE \nshared line", "en", rng.choice("abc"), 1) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = [F.lit(7).alias(c) for c in ("n_words", "size", "h", "row", "n", "bucket", "node", "words", "n_lines", "__x")]
    return spark.createDataFrame(hard_rows(), SCHEMA).select("*", *clash).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def quality_of(text):
    t = text or ""
    w = WORD.findall(t)
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    rep = len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, rep, len(w) < 50 or 100 * rep > 50 * len(w)


def test_quality(docs, none):
    got = bag(quality.quality_digest(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((r[0], *quality_of(r[1])) for r in hard_rows())
    out = quality.quality_digest(docs)
    assert out.filter("kept AND base_failed").count() == 0
    assert quality.quality_digest(none).count() == 0


def test_quality_ablation(docs):
    led = quality.ledger(docs)
    bits = [r.fail_bits for r in led.select("fail_bits").collect()]
    full = quality.POLICIES["v1"]
    for r in quality.ablation(led, "v1").collect():
        b = quality.mask(r.rule)
        assert (r.failed, r.only_by_this, r.kept_without) == (sum(bool(x & b) for x in bits), sum(x & full == b for x in bits), sum(not x & full & ~b for x in bits))


def test_ledger_is_kept(spark, docs, tmp_path):
    quality.stored(docs, f"file://{tmp_path}/ledger")
    led = spark.read.parquet(f"file://{tmp_path}/ledger")  # as a later session finds it
    assert "text" not in led.columns
    for policy in quality.POLICIES:
        want = quality.ledger(docs).filter(quality.verdict(policy))
        assert bag(led.filter(quality.verdict(policy)), "doc_id", "fail_bits") == bag(want, "doc_id", "fail_bits")
    rows = lambda x: sorted(map(tuple, quality.ablation(x, "v2").collect()))
    assert rows(led) == rows(quality.ledger(docs))


def test_sharding(docs, none):
    out = sharding.shard(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in hard_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    n = len(out)
    assert sorted(r.row_no for r in out) == list(range(n)) and sorted(r.place for r in out) == list(range(n))
    assert all(r.shard == r.place % 40 and r.slot == r.place // 40 for r in out)
    key = lambda rows: Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(sharding.shard(docs.repartition(3, "lang")).collect()) == key(out)
    assert sharding.sharding_digest(none).count() == 0


def test_feistel_by_brute_force(spark):
    def one(x, n, seed):
        a = int((n - 1) ** 0.5) + 1
        b = -(-n // a)
        h = lambda v, k: np.int64(np.uint64(xxhash.xxh64_intdigest(int(k).to_bytes(4, "little"), xxhash.xxh64_intdigest(int(seed).to_bytes(4, "little"), xxhash.xxh64_intdigest(int(v).to_bytes(8, "little"), 42)))))
        while True:
            l, r = divmod(x, b)
            for k in range(sharding.ROUNDS):
                if k % 2:
                    r = (r + int(h(l, k)) % b) % b
                else:
                    l = (l + int(h(r, k)) % a) % a
            x = l * b + r
            if x < n:
                return x

    for n in (1, 2, 3, 10, 997):
        got = [r.p for r in spark.range(n).select(sharding.permute(F.col("id"), n, 7).alias("p"), "id").orderBy("id").collect()]
        assert sorted(got) == list(range(n))
        if n > 1:
            assert got == [one(x, n, 7) for x in range(n)]


def test_numbering_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 64)
    monkeypatch.setattr(sharding, "ROWS_IN_BUCKET", 3)
    df = spark.range(1000).select(F.when(F.col("id") > 300, 5).otherwise(F.col("id") % 7).cast("long").alias("k"))
    out, n = sharding.numbered(df, ["k"], Scratch(spark))
    rows = out.collect()
    assert n == 1000 and sorted(r.row_no for r in rows) == list(range(1000))
    assert Counter(r.k for r in rows) == Counter(r.k for r in df.collect())


def fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        w = sum(weight[s] for s in names if s not in full)
        level = (total - sum(2 * sizes[s] for s in full)) / w if w else 0
        new = {s for s in names if s not in full and weight[s] * level >= 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= new


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r[0], r[3], size(r[1])) for r in hard_rows())
    sizes = Counter()
    for r in hard_rows():
        sizes[r[3]] += size(r[1])
    want = fill(sizes)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
    assert all(taken[s] == round(want[s]) for s in sizes)
    assert mixing.mix(none).count() == 0


def test_ranges_of_the_mix_do_not_change_it(docs, monkeypatch):
    whole = Counter(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "ROWS_IN_BUCKET", 3)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == whole


def test_training_order_follows_the_mix(docs):
    mixed = mixing.mix(docs)
    out = mixing.training_order(docs, mixed)
    assert out.columns == docs.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    for r in mixed.collect():
        want[r.doc_id] += r.taken
    assert got == +want
    positions = [r.p for r in mixed.filter("position is not null").select((F.col("position")).alias("p")).collect()]
    assert all(0 <= p <= mixing.TICKS for p in positions)


def test_training_order_places_every_chunk_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 2)
    rows = [(1, "a b c", "en", s, 5) for s in "abc" for _ in range(21)] + [(i, f"w{i} x{i}", "en", s, 5) for s in "abc" for i in range(2, 40)]
    data = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(data).cache()
    got, want = Counter(), Counter()
    for r in mixing.training_order(data, mixed).collect():
        got[r.doc_id, r.source] += len(WORD.findall(r.text))
    for r in mixed.collect():
        want[r.doc_id, r.source] += r.taken
    assert got == +want


def test_inverse_demand(spark):
    row = spark.range(101).select((F.col("id") / 100).alias("y"), *(mixing.inverse_demand(F.col("id") / 100, F.lit(a)).alias(f"t{i}") for i, a in enumerate(mixing.SLOPES))).collect()
    for r in row:
        for i, a in enumerate(mixing.SLOPES):
            t = r[f"t{i}"]
            assert t + a * (t * t - t) == pytest.approx(r.y, abs=1e-12)


def kept_lines(rows, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    count = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if not (key(x) and count[key(x)] >= least)]
        out.append((r[0], len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("least", "batches"), [(10, 5), (2, 9)])
def test_line_dedup(docs, none, least, batches):
    out = linededup.drop_frequent_lines(docs, least, batches).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert bag(out, "doc_id", "n_lines", "n_dropped", "sha") == kept_lines(hard_rows(), least)
    assert linededup.line_dedup_digest(none).count() == 0


def test_line_runs_are_levelled(spark):
    runs = linededup.LineRuns(spark, min_docs=3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(f"common\nonly {k}\nodd" if k % 2 else f"common\nonly {k}",)], "text string"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.settled().count() == 1


def test_line_runs_go_on_where_they_stopped(spark, tmp_path):
    path, want = f"file://{tmp_path}/runs", Counter()
    assert linededup.LineRuns(spark, path=path).settled().count() == 0
    for k in range(11):
        runs = linededup.LineRuns(spark, min_docs=3, fanout=2, path=path)  # each batch as by a session of its own
        assert runs.batches == k
        texts = [f"common\nevery {k % 3}\nonly {k}", f"pair {k // 2}"]
        runs.add(spark.createDataFrame([(x,) for x in texts], "text string"))
        want.update(x for t in texts for x in t.split("\n"))
        hashed = spark.createDataFrame([(x,) for x, n in want.items() if n >= 3], "x string").select(linededup.line_hash(F.col("x")).alias("h")).select("h.*")
        assert bag(runs.settled(), "h1", "h2") == bag(hashed, "h1", "h2")
    assert len(runs.done) <= 2


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            root[find(j)] = find(i)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), low.get(find(i))) for i, r in enumerate(rows)]


def test_minhash(docs, none):
    got = minhash.minhash_digest(docs)
    assert bag(got, "doc_id", "n_shingles", "component_id") == Counter(groups(hard_rows()))
    assert got.filter("kept <> (doc_id <=> component_id)").count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()
    assert minhash.minhash_digest(none).count() == 0


def test_keep_one_leaves_one_row_of_a_group(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(5, text("a")), (5, text("a")), (5, text("a")), (None, text("b")), (None, text("b")), (-1, text("c")), (None, text("c")), (6, text("d")), (6, text("d") + " x"), (7, text("a")), (8, ""), (None, None)]
    data = spark.createDataFrame([(i, t, "en", "a", n) for n, (i, t) in enumerate(rows)], SCHEMA)
    got = Counter((r.doc_id, (r.text or "")[:1]) for r in minhash.keep_one(data).collect())
    assert got == Counter([(5, "a"), (None, "b"), (-1, "c"), (6, "d"), (8, ""), (None, "")])


def test_minhash_on_edited_copies(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(120)] = "edit"
            rows.append((len(rows), " ".join(copy), "en", "a", 1))
    got = bag(minhash.minhash_digest(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_shingles", "component_id")
    assert got == Counter(groups(rows))


def test_toxicity(spark, none):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        parts = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            parts[2] += " vile" if i % 8 else " nasty"
        rows.append((i, ". ".join(parts), "en", "a", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (None, "vile words. fine words", "en", "a", 1)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (1000, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_digest(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    model = toxicity.fit(docs, labels)
    worst = {r.doc_id: r.worst_sentence for r in toxicity.score(docs, model).collect()}
    assert sum("vile" in worst[i] or "nasty" in worst[i] for i in range(0, 400, 4)) >= 95
    assert worst[1000] is None and worst[1001] is None
    assert toxicity.toxicity_digest(none, labels).count() == 0
    unlabelled = toxicity.toxicity_digest(docs, labels.limit(0)).collect()
    assert all(r.score < 0.1 and r.predicted == 0 for r in unlabelled)


def test_toxicity_without_two_kinds_of_labels_does_not_follow_length(spark):
    rows = [(n, ". ".join(f"plain words number {k}" for k in range(n)), "en", "a", 1) for n in (1, 2, 10, 200, 1000, 10_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for toxic, said in ((None, 0), (0, 0), (1, 1)):
        labels = spark.createDataFrame([(r[0], 1, toxic) for r in rows], "doc_id long, quality int, toxic int")
        got = toxicity.toxicity_digest(docs, labels).collect()
        assert {r.predicted for r in got} == {said} and max(r.score for r in got) - min(r.score for r in got) < 1e-6


def test_toxicity_score_and_gradient_by_hand(spark):
    """The noisy-or of a bag's sentences, and the gradient of its likelihood, against plain loops and differences."""
    rng = random.Random(4)
    texts = [". ".join(" ".join(f"w{chr(97 + rng.randrange(12))}" for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 5))) for _ in range(30)]
    buckets = toxicity.Buckets()
    names = sorted({buckets[f"w{chr(97 + i)}"] for i in range(12)})
    weights = np.zeros(1 << toxicity.BITS)
    weights[names] = [rng.uniform(-2, 2) for _ in names]
    model = toxicity.Model(weights, -1.5)

    def by_hand(text, w, bias):
        clean = 1.0
        for part in text.split(". "):
            clean *= 1 - 1 / (1 + math.exp(-(bias + sum(w[names.index(buckets[x])] for x in set(part.split())))))
        return 1 - clean

    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in toxicity.score(data, model).collect():
        assert r.score == pytest.approx(by_hand(texts[r.doc_id], weights[names], -1.5), abs=1e-9)
    parts = [toxicity.bag(t, buckets) for t in texts]
    y = np.array([rng.randrange(2) for _ in texts])
    sizes = np.concatenate([np.bincount(which) for _, which, _ in parts])
    bags = toxicity.Bags(y, np.array([len(s) for _, _, s in parts]), sizes, np.searchsorted(names, np.concatenate([i for i, _, _ in parts])))
    likelihood = lambda w, bias: -sum(math.log(p if t else 1 - p) for t, p in zip(y, (by_hand(x, w, bias) for x in texts), strict=True))
    g, gb = toxicity.gradient(bags, weights[names], -1.5)
    for k in range(len(names)):
        step = np.eye(len(names))[k] * 1e-5
        assert g[k] == pytest.approx((likelihood(weights[names] + step, -1.5) - likelihood(weights[names] - step, -1.5)) / 2e-5, abs=1e-5)
    assert gb == pytest.approx((likelihood(weights[names], -1.5 + 1e-5) - likelihood(weights[names], -1.5 - 1e-5)) / 2e-5, abs=1e-5)
    monkey, toxicity.BLOCK = toxicity.BLOCK, 20
    try:
        cut = bags.blocks()
    finally:
        toxicity.BLOCK = monkey
    assert len(cut) > 3 and sum(len(b.y) for b in cut) == len(y)
    assert np.allclose(sum(toxicity.gradient(b, weights[names], -1.5)[0] for b in cut), g)


def test_edits_follow_a_full_count():
    vocabulary = tokencounts.default_vocabulary()
    tok = tokencounts.Tokenizer(*vocabulary)
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "'s", "'", "1", "é", "the ", "!!", "\n\n ", "x y z", " "]
    make = lambda n: "".join(rng.choice(parts) for _ in range(n))
    for _ in range(300):
        tree = tokencounts.TokenTree(tok, make(rng.randrange(0, 900)))
        for _ in range(3):
            a = rng.randrange(0, len(tree.text) + 1)
            b = min(len(tree.text), a + rng.choice([0, 1, 3, 60]))
            new = make(rng.choice([0, 1, 4, 400]))
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.n_tokens == len(tok.encoding.encode_ordinary(want)) and tree.n_pretokens == len(tok.cut(want))


def test_edits_touch_little():
    tok = tokencounts.Tokenizer(*tokencounts.default_vocabulary())
    tree = tokencounts.TokenTree(tok, "some words in a row " * 5000)
    tree.edit(50_000, 50_004, "other")
    assert tree.reencoded < 12


def test_token_digest(docs, none):
    vocabulary = tokencounts.default_vocabulary()
    tok = tokencounts.Tokenizer(*vocabulary)
    rows = docs.select("doc_id", "text").withColumn("edits", tokencounts.revision_edits())
    out = tokencounts.count_edited(rows, vocabulary).collect()
    assert len(out) == len(hard_rows())
    assert all(r.n_tokens == len(tok.encoding.encode_ordinary(r.edited_text)) for r in out)
    assert Counter(r.n_tokens_before for r in out) == Counter(len(tok.encoding.encode_ordinary(r[1] or "")) for r in hard_rows())
    bare = tokencounts.count_edited(docs.select("doc_id", "text").withColumn("edits", F.lit(None).cast("array<struct<start:int,end:int,new:string>>")), vocabulary)
    assert bare.filter("n_tokens <> n_tokens_before OR n_reencoded <> 0").count() == 0
    assert tokencounts.token_digest(none, vocabulary).count() == 0
    far = docs.sparkSession.createDataFrame([(x, "a far id. " * 5) for x in (-(2**63), 2**63 - 1, 2**60, -(2**62))], "doc_id long, text string")
    places = far.select("doc_id", tokencounts.revision_edits()[1]["start"].alias("at"), F.length("text").alias("n")).collect()
    assert all(r.at == r.doc_id * 7919 % (r.n + 1) for r in places)
    assert tokencounts.token_digest(far, vocabulary).count() == 4


def lm_by_hand(rows, good, v):
    """(doc_id, n_tokens, loss_target, loss_background) by the formula, each document taken out of the counts first."""
    grams = [list(itertools.pairwise([None, *(r[1] or "").lower().split()])) for r in rows]
    own = [Counter(g) for g in grams]
    sums = [Counter(), Counter()]
    for r, c in zip(rows, own, strict=True):
        sums[1].update(c)
        if r[0] in good:
            sums[0].update(c)
    starts = [Counter(), Counter()]
    for k in range(2):
        for (a, _), n in sums[k].items():
            starts[k][a] += n
    scale = [1.0, sum(sums[0].values()) / max(1, sum(sums[1].values()))]
    out = []
    for r, g, c in zip(rows, grams, own, strict=True):
        first = Counter(a for a, _ in g)
        loss = []
        for k in range(2):
            mine = 1 if k == 1 or r[0] in good else 0
            p = lambda a, b: (scale[k] * (sums[k][a, b] - mine * c[a, b]) + lm.BETA) / (scale[k] * (starts[k][a] - mine * first[a]) + lm.BETA * v)  # noqa: B023, E731
            loss.append(-sum(math.log(p(a, b)) for a, b in g) / len(g) if g else None)
        out.append((r[0], len(g), *loss))
    return out


def test_lm_prefers_the_target(spark, docs, none):
    rng = random.Random(8)
    text = lambda good: " ".join(rng.choice("abcde" if good else "cdefg") for _ in range(40))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    data = spark.createDataFrame([(i, text(i % 2), "en", "a", 1) for i in range(60)], SCHEMA)
    out = {r.doc_id: r.score for r in lm.lm_digest(data, labels).collect()}
    assert max(out[i] for i in range(1, 60, 2)) < min(out[i] for i in range(0, 60, 2))
    assert {r.score for r in lm.lm_digest(data, labels.limit(0)).collect()} == {0.0}
    hard = lm.lm_digest(docs, labels).collect()
    assert len(hard) == len(hard_rows()) and all((r.score is None) == (r.n_tokens == 0) for r in hard)
    assert lm.lm_digest(none, labels).count() == 0


@pytest.mark.parametrize(("hot", "length"), [(2e-6, 6000), (2e-3, 300)])
def test_lm_against_the_formula(spark, tmp_path, monkeypatch, hot, length):
    """Words and bigrams of every frequency, by buckets only and with broadcast counts; equal rows, null ids, no words."""
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "SAMPLE", 2)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(30)}" if rng.random() < 0.8 else f"R{rng.randrange(40000)}"
    rows = [(i, " ".join(word() for _ in range(length)), "en", "a", 1) for i in range(45)]
    rows += [(None, "lone rare pair", "en", "a", 1), (7, "lone rare pair", "en", "a", 1), (7, "lone rare pair", "en", "a", 1), (8, "w1", "en", "a", 1), (9, None, "en", "a", 1)]
    good = set(range(0, 45, 3)) | {7}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(45)] + [(7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/docs")
    data = spark.read.parquet(f"{tmp_path}/docs")
    v = lm.vocabulary_size(data)
    assert v - 1 == pytest.approx(len({w for r in rows for w in (r[1] or "").lower().split()}), rel=0.03)
    order = lambda r: (r[0] is None, r[0], r[1])
    want, got = lm_by_hand(rows, good, v), lm.lm_digest(data, labels).collect()
    assert len(got) == len(rows)
    for r, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert tuple(r[:2]) == w[:2] and all(x is y is None or x == pytest.approx(y, abs=1e-5) for x, y in zip(r[2:4], w[2:], strict=True))
        assert r.score is None if w[1] == 0 else r.score == pytest.approx(w[2] - w[3], abs=1e-5)


def test_word_hashes_of_all_texts():
    rng = random.Random(1)
    parts = ["a", "B", "b", "\u00e9", " ", " ", "\n", "\t", "x" * 5000, "Y" * 200000, "yz", "", "\x0b\x0c\r", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) if rng.random() < 0.9 else None for _ in range(300)]
    column, seen = pa.array(texts), {}
    for part in (column, column[7:100], pa.array([None], pa.string()), pa.array([], pa.string()), pa.array(["", " "])):
        for i, j, hashes, n in words.hashed_parts(part):
            want = [(t.as_py() or "").encode().lower().split() for t in part[i:j]]
            assert list(n) == [len(x) for x in want]
            assert all(seen.setdefault(w, h) == h for w, h in zip(itertools.chain(*want), hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_minhash_rest_in_blocks(spark, monkeypatch):
    """Pairs that leaders leave, over several blocks of a key: those at the threshold or above, and no others."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(copy), "en", "a", 1))
    data = spark.createDataFrame(rows, SCHEMA)
    scratch = Scratch(spark)
    signed = scratch.write(data.select("doc_id", F.col("doc_id").alias("row"), "text").mapInArrow(minhash._sign, "doc_id long, row long, n long, node long, a array<long>, b array<long>, sketch array<long>"), "signed")
    sets = scratch.write(data.select("text").mapInArrow(minhash._sets, "node long, shingles array<long>"), "sets")
    comp = F.when(F.col("doc_id") < 25, F.lit(0).cast("long")).otherwise(F.col("node"))  # one component, and single nodes
    got = minhash._rest(signed.withColumn("comp", comp), signed, sets, scratch).collect()
    ids = {r.node: r.doc_id for r in signed.collect()}
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(86)} for _, t, *_ in rows]
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if b >= 25 and 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b])}
    found = [tuple(sorted((ids[r.u], ids[r.v]))) for r in got]
    assert len(found) == len(set(found)) and want and set(found) <= want

    def united(pairs):
        at = list(range(60))
        for a, b in pairs:
            at = [at[a] if x == at[b] else x for x in at]
        return [at.index(x) for x in at]

    assert united(found) == united(want)


def test_kept_trees_take_batches_of_edits(spark):
    """A second batch encodes its own regions only; other documents' rows stay as they are, and counts equal a new count."""
    vocabulary = tokencounts.default_vocabulary()
    tok = tokencounts.Tokenizer(*vocabulary)
    texts = [(1, "some words in a row, and more of them " * 300), (2, None), (3, ""), (3, "same id"), (None, "no id"), (4, "never edited")]
    kept = tokencounts.build_trees(spark.createDataFrame(texts, "doc_id long, text string"), vocabulary).cache()
    one = "doc_id long, edits array<struct<start:int,end:int,new:string>>"
    first = spark.createDataFrame([(1, [(5, 10, "things")]), (2, [(0, 0, "new text")]), (9, [(0, 0, "nowhere")])], one)
    second = spark.createDataFrame([(1, [(4000, 4005, None)]), (3, [(0, 0, "x ")]), (None, [(0, 2, "an")])], one)
    after = tokencounts.apply_edits(tokencounts.apply_edits(kept, first, vocabulary), second, vocabulary).collect()
    want = [texts[0][1][:5] + "things" + texts[0][1][10:], "new text", "x ", "x same id", "an id", "never edited"]
    want[0] = want[0][:4000] + want[0][4005:]
    assert sorted(r.text for r in after) == sorted(want)
    for r in after:
        words = tok.cut(r.text)
        assert r.lengths == [len(w) for w in words] and r.n_pretokens == len(words) == sum(r.leaves) and r.n_tokens == sum(r.tokens) == sum(tok.counts[w] for w in words)
    again = tokencounts.edit_trees(kept.join(second, "doc_id"), vocabulary).filter("doc_id = 1").first()
    assert 0 < again.n_reencoded < 8 and again.n_tokens_before == kept.filter("doc_id = 1").first().n_tokens
