"""MinHash near-dedup with tensored banding.

A document has two small collections of keys, A and B, each key made of ROWS minhashes. Every pair (A_i, B_j) is the key of
one table: COLLECTION^2 tables from 2 * COLLECTION * ROWS minhashes, about the square root of what as many tables would
need by themselves. Two documents meet in a table as soon as they share one A key and one B key. Candidates are confirmed
on their full shingle sets, and links are united to groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, set_aside
from .words import finish, hashed_parts

SHINGLE = 5
PERCENT = 75
#: A pair of similarity 0.75 shares a key of a collection with 1 - (1 - 0.75^4)^24 = 0.9999, so it is found with 0.9998.
ROWS, COLLECTION = 4, 24
#: 4 bits of every minhash make a sketch, 16 of them a long; sketches are compared before full sets are. Of the first 96, a
#: pair of similarity 0.75 agrees in 73.5 on average with a deviation of 4.2, so in fewer than 57 once in 20,000 pairs; of all
#: 192 in 147 with a deviation of 5.9, so in fewer than 123 once in 20,000 pairs. At similarity 0.5 these are 51 and 102.
SKETCH, SKETCH_AGREE = 96, 57
WHOLE, WHOLE_AGREE = 2 * COLLECTION * ROWS, 123
#: Rounds in which a bucket is compared with one leader, before its remaining pairs are.
LEADER_ROUNDS = 3
#: Nodes of one key that are compared with each other, or with as many others, in one go.
BLOCK = 512
CELLS = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_seeds = np.random.default_rng(20240501).integers(0, 2**31, size=(2, WHOLE), dtype=np.uint32)
_MUL, _ADD = _seeds[0] * np.uint32(2) + np.uint32(1), _seeds[1]
_NIBBLES = 0x1111111111111111


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct 5-word shingles (A-Z lower-cased, ASCII white space), whole texts.

    A text of fewer words is one shingle, a text without words has none.
    """
    with np.errstate(over="ignore"):
        for _, _, w, counts in hashed_parts(column):
            w, at = w * _MIX, 0
            size = max(0, len(w) - SHINGLE + 1)
            h = np.full(size, np.uint64(SHINGLE))
            for i in range(SHINGLE):
                h = finish(h + w[i : i + size])
            for n in counts.tolist():
                if n >= SHINGLE:
                    yield np.unique(h[at : at + n - SHINGLE + 1])
                else:
                    one = np.full(min(n, 1), np.uint64(n))
                    for i in range(n):
                        one = finish(one + w[at + i])
                    yield one
                at += n


def signature(s: np.ndarray) -> np.ndarray:
    """The minhashes of a non-empty set, in slices of bounded size."""
    low, s = None, s.astype(np.uint32)
    step = max(1, CELLS // len(_MUL))
    for at in range(0, len(s), step):
        part = (s[None, at : at + step] * _MUL[:, None] + _ADD[:, None]).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low.astype(np.uint64)


def _keys(mins: np.ndarray) -> np.ndarray:
    """2 x COLLECTION keys of ROWS minhashes each; the place of a key is part of it."""
    m = mins.reshape(2 * COLLECTION, ROWS)
    h = np.arange(2 * COLLECTION, dtype=np.uint64)
    for r in range(ROWS):
        h = finish(h * _MIX + m[:, r])
    return h.astype(np.int64).reshape(2, COLLECTION)


def _sketch(mins: np.ndarray) -> np.ndarray:
    """4 low bits of the minhashes, 16 to a long."""
    bits = (mins.reshape(-1, 16) >> np.uint64(5)) & np.uint64(15)
    return np.bitwise_or.reduce(bits << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).astype(np.int64)


def _agree(x: str, y: str):
    """Whether enough of two sketches agrees."""
    wrong = F.lit(0)
    for k in range(SKETCH // 16):
        z = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        wrong = wrong + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return wrong <= SKETCH - SKETCH_AGREE


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists, kinds = pa.list_(pa.int64()), (pa.int64(), pa.int64())
    with np.errstate(over="ignore"):
        for batch in batches:
            out = []
            for s in shingle_sets(batch.column("text")):
                if len(s):
                    mins = signature(s)
                    out.append((len(s), _node(s), *_keys(mins), _sketch(mins)))
                else:
                    out.append((0, None, None, None, None))
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((*kinds, lists, lists, lists))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "n", "node", "a", "b", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = list(shingle_sets(batch.column("text").slice(at, 256)))
                yield pa.record_batch([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, link) of pairs (x, y), decided on the full sets."""
    left = pairs.join(sets.withColumnsRenamed({"node": "x", "shingles": "sx"}), "x")
    both = left.join(sets.withColumnsRenamed({"node": "y", "shingles": "sy"}), "y")
    common = both.select("x", "y", F.size("sx").alias("nx"), F.size("sy").alias("ny"), F.size(F.array_intersect("sx", "sy")).alias("i"))
    return common.select("x", "y", (F.col("i") * 100 >= PERCENT * (F.col("nx") + F.col("ny") - F.col("i"))).alias("link"))


def _fits(a: str, b: str):
    """Whether two set sizes allow a link at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, n, sketch) of the tables' buckets with two nodes or more.

    A table's key needs an A key and a B key that another document has too, so only those are paired.
    """
    shared, tables = {}, []
    for c in ("a", "b"):
        rows = scratch.write(nodes.select("node", F.explode(c).alias("key")), c)
        tables.append(rows)
        again = rows.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
        shared[c] = rows.join(again, "key", "left_semi").withColumnRenamed("key", c)
    rows = scratch.write(shared["a"].join(shared["b"], "node").select(F.xxhash64("a", "b").alias("bucket"), "node"), "tables")
    again = rows.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1").select("bucket")
    kept = rows.join(again, "bucket", "left_semi")
    first = F.slice("sketch", 1, SKETCH // 16).alias("sketch")
    found = scratch.write(kept.join(nodes.select("node", "n", first), "node"), "buckets")
    for table in (*tables, rows):
        scratch.drop(table)
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal lengths as rows."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _compared(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """A row and the rows it may be linked with, of one block or of two: nodes with a common A key that sizes and whole sketches allow, each pair at its first common key."""
    key, p, q = (table.column(c)[0].as_py() for c in ("key", "p", "q"))
    node, comp, n, mine = (table.column(c).to_numpy() for c in ("node", "comp", "n", "mine"))
    a, sketch = _matrix(table.column("a")), _matrix(table.column("sketch")).view(np.uint64)
    left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
    place = int(np.argmax(a[0] == key))
    for at in range(0, len(left), 64):
        i = left[at : at + 64]
        wrong = np.zeros((len(i), len(right)), np.int64)
        for k in range(sketch.shape[1]):
            z = sketch[i, k][:, None] ^ sketch[right, k][None, :]
            z |= z >> np.uint64(1)
            z |= z >> np.uint64(2)
            wrong += np.bitwise_count(z & np.uint64(_NIBBLES))
        small, large = np.minimum(n[i][:, None], n[right][None, :]), np.maximum(n[i][:, None], n[right][None, :])
        may = (wrong <= WHOLE - WHOLE_AGREE) & (small * 100 >= large * PERCENT) & (comp[i][:, None] != comp[right][None, :])
        for x, row in zip(i, may, strict=True):
            y = right[row]
            y = y[~(a[x, :place] == a[y, :place]).any(axis=1)]
            if p == q:
                y = y[node[x] > node[y]]
            if len(y):
                yield x, y


def _wanted(table: pa.Table) -> pa.Table:
    """The nodes of a block, or of two, that have something to compare."""
    some = np.zeros(len(table), bool)
    for x, y in _compared(table):
        some[x] = some[y] = True
    return table.filter(pa.array(some)).select(["key", "p", "q", "node"])


def _confirmed(table: pa.Table, sets: pa.Table) -> pa.Table:
    """Links of a block, or of two, decided on the full sets; of links that close a circle one is left out."""
    u, v, root = [], [], {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    if len(table) and len(sets):
        node = table.column("node").to_numpy()
        shingles = dict(zip(sets.column("node").to_numpy(), (x.values.to_numpy() for x in sets.column("shingles")), strict=True))
        for x, found in _compared(table):
            own = np.sort(shingles[node[x]])
            for at in range(0, len(found), 64):
                others = [shingles[k] for k in node[found[at : at + 64]]]
                sizes, every = np.array([len(o) for o in others]), np.concatenate(others)
                hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
                for k in node[found[at : at + 64][common * 100 >= PERCENT * (len(own) + sizes - common)]].tolist():
                    if (i := find(int(node[x]))) != (j := find(k)):
                        root[i] = j
                        u.append(int(node[x]))
                        v.append(k)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _rest(rows: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) between nodes of different components that share an A key: of all such links, enough to connect the same nodes.

    The nodes of a key are split into blocks of BLOCK, those of its largest component apart from all others; blocks of the
    others are compared with every block, so that a component of any size costs one comparison with each node outside it.
    A pair counts only at the first A key it shares. Sizes and whole sketches choose pairs, which are never rows: a first
    pass gives the nodes that have any, their full sets go to the blocks, once each, and decide in a second pass.
    """
    found = scratch.write(rows.select("node", "comp").distinct().join(nodes.select("node", "n", "a", "sketch"), "node"), "rest")
    keyed = found.select("node", "comp", F.explode("a").alias("key"))
    by_comp = keyed.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("all"), F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = by_comp.filter("comps > 1").select("key", F.col("top.comp").alias("most"), blocks(F.col("all") - F.col("top.k")).alias("few"), blocks(F.col("top.k")).alias("many"))
    placed = found.withColumn("key", F.explode("a")).join(mixed, "key")
    hashed, outside = F.xxhash64("node"), F.col("comp") != F.col("most")
    placed = placed.withColumn("mine", F.when(outside, F.pmod(hashed, F.col("few"))).otherwise(F.col("few") + F.pmod(hashed, F.col("many"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(outside, F.col("few") + F.col("many")).otherwise(F.col("few")) - 1))
    placed = placed.withColumn("other", other).select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine", "node", "comp", "n", "a", "sketch")
    wanted = scratch.write(placed.groupBy("key", "p", "q").applyInArrow(_wanted, "key long, p int, q int, node long"), "wanted")
    some = placed.join(wanted.select("key", "p", "q").distinct(), ["key", "p", "q"], "left_semi")
    shingles = wanted.join(sets, "node").select("node", "shingles", "key", "p", "q").toDF("node", "shingles", "in_key", "in_p", "in_q")
    return some.groupBy("key", "p", "q").cogroup(shingles.groupBy("in_key", "in_p", "in_q")).applyInArrow(_confirmed, "u long, v long")


def _links(rows: DataFrame, nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Confirmed links (u, v) that connect all nodes which any chain of links in the buckets connects.

    Round by round each bucket picks one leader by hash, which is compared with the members of other components and then
    leaves the bucket, so a group of g near copies costs g comparisons a round instead of g^2, and small buckets are done
    with after a few rounds. What several components still share a bucket with is compared pair by pair, in `_rest`. A pair
    goes to the full sets only if sizes allow a link and the sketches agree. Nothing is capped.
    """
    links, tested = None, None
    rows = rows.withColumn("comp", F.col("node"))
    for t in range(LEADER_ROUNDS):
        lead = rows.groupBy("bucket").agg(F.min_by(F.struct("node", "comp", "n", "sketch"), F.xxhash64(F.lit(t), "node")).alias("z"))
        lead = lead.select("bucket", F.col("z.node").alias("node_z"), F.col("z.comp").alias("comp_z"), F.col("z.n").alias("n_z"), F.col("z.sketch").alias("sketch_z"))
        met = rows.join(lead, "bucket")
        pairs = met.filter(F.col("comp") != F.col("comp_z")).filter(_fits("n", "n_z") & _agree("sketch", "sketch_z"))
        pairs = pairs.select(F.greatest("node", "node_z").alias("x"), F.least("node", "node_z").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        done = scratch.write(_verify(pairs, sets), "verified")
        tested = done.select("x", "y") if tested is None else tested.unionByName(done.select("x", "y"))
        good = done.filter("link").select(F.col("x").alias("u"), F.col("y").alias("v"))
        left = met.filter("node <> node_z").select(*rows.columns)
        if not t or good.take(1):
            links = good if links is None else links.unionByName(good)
            comp = components(links, scratch).distinct().select("node", F.col("component").alias("comp"))
            left = left.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        named = scratch.write(left, "named")
        mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
        rows = scratch.write(named.join(mixed, "bucket", "left_semi"), "open")
        scratch.drop(named)
        if not rows.take(1):
            return links
    return scratch.write(links.unionByName(_rest(rows, nodes, sets, scratch)), "links")


def near_duplicates(docs: DataFrame, root: bool = False) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    `row` is a hash of id and text by which a caller meets its rows. component_id is the smallest doc_id that links reach,
    the document's own included; kept is doc_id = component_id. Documents without words link with nothing; equal sets are
    one node. A row with a null id is kept when its group has no other id. Extra columns are ignored.
    With root there is a last column, the group's node, null for documents without words.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), "text")
    signed = scratch.write(rows.mapInArrow(_sign, "doc_id long, row long, n long, node long, a array<long>, b array<long>, sketch array<long>"), "signed")
    members = signed.select("doc_id", "row", "n", "node")
    nodes = scratch.write(signed.filter("node is not null").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by("row", F.struct("doc_id", "row")).alias("row"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("sketch").alias("sketch")), "nodes")
    buckets = _buckets(nodes, scratch)
    wanted = buckets.select("node").distinct().join(nodes.select("node", "row"), "node").select("row", "node")
    texts = rows.select("row", "text").join(wanted.select("row").distinct(), "row", "left_semi")
    sets = scratch.write(texts.mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    links = _links(buckets, nodes, sets, scratch)
    group = components(links, scratch).distinct().withColumnRenamed("component", "root")
    named = nodes.select("node", "doc_id").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.write(named, "groups")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_node = scratch.write(named.join(least, "root").select("node", "component_id", *["root"] * root), "ids")
    out = members.join(by_node, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *["root"] * root)


def row_key():
    """Hash of a row's id, null or not, and text."""
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, one with the smallest id; columns and order of columns as given.

    Of equal rows, of rows with one id and near texts, and of a group without ids, one stays too. Documents without words are
    no group and all stay. Columns of any name travel along unchanged.
    """
    docs, back = set_aside(docs, "doc_id", "text")
    scratch, cols = Scratch(docs.sparkSession), docs.columns
    rows = near_duplicates(docs, root=True).filter("kept").groupBy("root", F.col("row").alias("__row")).agg(F.count("*").alias("__m"))
    rows = scratch.write(rows, "kept")
    one = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct("__row", "__m")).alias("s")).select("s.*")
    stay = one.unionByName(rows.filter("root is null").select("__row", F.lit(1).cast("long").alias("__m")))
    found = docs.withColumn("__row", row_key()).join(stay, "__row")
    again = found.filter("__m > 1").groupBy("__row").agg(F.min_by(F.struct(*cols), F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t))).alias("__s")).select("__s.*")
    return back(found.filter("__m = 1").select(*cols).unionByName(again))


def minhash_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
