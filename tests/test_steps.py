"""Which steps of an analysis a query makes: none whose results it doesn't read."""

from __future__ import annotations

import shutil
from functools import cached_property

import pytest

from ledgerlens.plans import registry
from ledgerlens.plans.analysis import Analysis

#: Queries whose SQL knows no shortest paths, no cycles and no ranks.
LIGHT = ("p_forward", "robust_anomaly", "resolve_suffix", "cluster_flows", "modularity", "seed_cluster_span", "cluster_numbers")


@pytest.mark.parametrize("name", LIGHT)
def test_light_queries_make_no_heavy_steps(spark, tmp_path, monkeypatch, name):
    def refused(step):
        def make(self):
            raise AssertionError(f"{name} made {step}")

        made = cached_property(make)
        made.__set_name__(Analysis, step)
        return made

    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path)
    for step in ("betweenness", "pagerank", "cycles", "routes", "communities", "features", "scored"):
        monkeypatch.setattr(Analysis, step, refused(step))
    assert registry.queries()[name](spark, str(tmp_path)).count() > 0
