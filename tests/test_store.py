"""Saved results: point lookups read one bucket, commits are whole, readers follow them, cards and calls work in a new session."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cards, lookup
from ledgerlens.plans import registry
from ledgerlens.plans.saved import Saved, save
from ledgerlens.sources.store import MANIFEST, Store

SF = "/root/testdata/sf0.001"


def test_lookups_read_one_bucket(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias("v")).unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("k"), (F.col("id") + 9000).alias("v")))
    rows = rows.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, -1L AS v"))
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(LookupError):
        store.snapshot()
    snap = store.commit({"t": (rows, "k", ["v"])}, {"n": 1}, bucket_rows=500)
    assert snap.manifest["tables"]["t"]["rows"] == 8001 and snap.manifest["tables"]["t"]["buckets"] == 17 and snap.summary == {"n": 1}
    for key in (7, 0, 699):
        found = snap.rows("t", key)
        assert sorted(r.v for r in found.collect()) == sorted(r.v for r in rows.filter(F.col("k") == key).collect())
        assert len({r.f.rsplit("/", 2)[-2] for r in found.select(F.input_file_name().alias("f")).distinct().collect()}) == 1
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan or "_bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {r.k for r in snap.rows("t", 1, 2, 3).collect()} == {1, 2, 3}
    assert snap.rows("t", 10**9).count() == 0 == snap.rows("t", None).count() and snap.table("t").count() == 8001
    with pytest.raises(LookupError):
        snap.table("u")


def test_commits_are_whole_and_followed(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    writer, reader = Store(spark, path), Store(spark, path)
    one = writer.commit({"t": (spark.range(10), "id", [])})
    first = reader.snapshot()
    assert first.version == one.version and reader.snapshot() is first
    monkeypatch.setattr(writer.files, "replace", lambda *x: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        writer.commit({"t": (spark.range(99), "id", [])})
    assert reader.snapshot() is first and first.table("t").count() == 10
    monkeypatch.undo()
    two = writer.commit({"t": (spark.range(20), "id", [])})
    assert reader.snapshot().version == two.version and reader.snapshot().table("t").count() == 20
    assert first.table("t").count() == 10, "a reader of the commit before is not disturbed"
    three = writer.commit({"t": (spark.range(30), "id", [])})
    left = {p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith((MANIFEST, "."))}
    assert left == {two.version, three.version}


def test_cards_and_calls_of_a_saved_analysis(spark, tmp_path):
    a = registry.analysis(spark, SF, by_component=True)
    path = f"file://{tmp_path}/results"
    save(a, path, bucket_rows=20)
    saved = Saved(spark.newSession(), path)
    gids = [r.gid for r in a.scored.orderBy("rank").limit(2).collect()] + [a.scored.orderBy(F.desc("rank")).first().gid]
    for gid in gids:
        assert cards.card(saved, gid).first().text == cards.card(a, gid).first().text
    ask = lambda of, name, **given: json.loads(lookup.call(of, name, given))
    for name, given in [
        ("neighbors", {"gid": gids[0]}), ("top_nodes", {"n": 3}), ("cluster_summary", {"cluster_id": a.scored.first().cluster_id}), ("search_nodes", {"role": "transit", "limit": 2}),
        ("overview", {}), ("find_paths", {"src": gids[0], "dst": gids[1], "max_len": 3}), ("common_counterparties", {"gids": gids[:2]}), ("resolve", {"text": "7"}), ("shortest_path", {"src": gids[0], "dst": gids[1]}),
    ]:
        got, want = ask(saved, name, **given), ask(a, name, **given)
        assert got == want and (name == "shortest_path" or "error" not in got)
    record = ask(saved, "get_node", gid=str(gids[0]))
    assert record["gid"] == gids[0] and record["why_top"] and record["cluster_n_nodes"] and {"role", "first", "last"} <= set((record["top_payers"] + record["top_payees"])[0])
    assert ask(saved, "get_node", gid="999999")["error"] == "not_found" and ask(saved, "get_node", gid="x")["error"] == "bad_arguments"
    assert ask(saved, "common_counterparties", gids=[gids[0]])["error"] == "bad_arguments" and ask(saved, "common_counterparties", gids=[gids[0], 123456789])["error"] == "not_found"
    assert not saved.refresh()
    save(a, path, bucket_rows=20)
    assert saved.refresh() and not saved.refresh()


def test_ids_by_last_digits(spark, tmp_path):
    ids = [100000001234, 200000001234, 300000005678, 412345, 5]
    scored = spark.createDataFrame([(g, k) for k, g in enumerate(ids)], "gid long, rank int")
    Store(spark, f"file://{tmp_path}/r").commit({"nodes": (scored, "gid", []), "suffixes": (scored.selectExpr("right(CAST(gid AS STRING), 4) AS suffix", "gid", "rank"), "suffix", ["gid"])}, bucket_rows=1)
    saved = Saved(spark, f"file://{tmp_path}/r")
    assert lookup.one_id(saved, "5678") == 300000005678 == lookup.one_id(saved, 300000005678) and lookup.one_id(saved, "1000000012") == 100000001234 and lookup.one_id(saved, "5") == 5
    with pytest.raises(lookup.Ambiguous) as many:
        lookup.one_id(saved, "001234")
    assert many.value.matches == [100000001234, 200000001234]
    for bad, kind in (("99999", LookupError), ("x", ValueError)):
        with pytest.raises(kind):
            lookup.one_id(saved, bad)
