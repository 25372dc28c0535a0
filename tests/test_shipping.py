"""The package reaches workers that cannot see the driver's folders."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import ledgerlens
from ledgerlens.functions import cuts

PACKAGE = Path(ledgerlens.__file__).resolve().parent

#: A driver whose executors know nothing of the package; its path is taken from the driver's own search path only.
DRIVER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from ledgerlens.functions.cuts import Scratch
spark = SparkSession.builder.master("local-cluster[2,1,512]").config("spark.executor.memory", "512m").config("spark.checkpoint.dir", sys.argv[2]).config("spark.ui.enabled", "false").getOrCreate()
Scratch(spark)

def lines(batches):
    import pandas as pd
    import ledgerlens.config
    for b in batches:
        yield pd.DataFrame({"at": [ledgerlens.config.__file__] * len(b)})

print("AT", *{r.at for r in spark.range(0, 8, 1, 4).mapInPandas(lines, "at string").collect()})
"""


def test_the_archive_holds_every_module(tmp_path):
    (tmp_path / "code.zip").write_bytes(cuts.archive(PACKAGE))
    script = "import sys; sys.path.insert(0, sys.argv[1]); from ledgerlens import config; print(config.__file__)"
    said = subprocess.run([sys.executable, "-c", script, f"{tmp_path}/code.zip"], capture_output=True, text=True, cwd=tmp_path, timeout=60)
    assert "code.zip" in said.stdout


def test_workers_of_a_cluster_import_the_archive(tmp_path):
    (tmp_path / "shared").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    said = subprocess.run([sys.executable, "-c", DRIVER, str(PACKAGE.parent), f"file://{tmp_path}/shared"], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=150)
    at = [x for x in said.stdout.splitlines() if x.startswith("AT ")]
    assert at and all(".zip" in x for x in at[0].split()[1:]), said.stderr[-2000:]
