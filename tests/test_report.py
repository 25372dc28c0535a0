"""The summary of a run, as the write observes it."""

from __future__ import annotations

import json
from pathlib import Path

from ledgerlens.plans import registry, report


def test_written_summary_equals_the_tables(spark, tmp_path):
    a = registry.analysis(spark, "/root/testdata/sf0.001", True)
    a.write(f"file://{tmp_path}/out").collect()
    (part,) = Path(tmp_path, "out/metrics").glob("part-*.json")
    found = json.loads(part.read_text())
    assert found.pop("seconds") > 0
    want = report.summary(a, report.counts(a)).first().asDict(recursive=True)
    assert {k: v for k, v in want.items() if v is not None} == found
    assert {r["depth"] for r in found["rate_by_depth"]} <= {1, 2, 3} and sum(r["n"] for r in found["rate_by_depth"]) == found["n_train"]
