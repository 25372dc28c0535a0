"""Command line, started by spark-submit or plain Python.

    python -m ledgerlens analyse INPUT RESULTS [--set NAME=VALUE ...]   tables, their check, and the saved results
    python -m ledgerlens card RESULTS QUERY                             a node's card, by id or last digits
    python -m ledgerlens ask RESULTS LOOKUP [JSON]                      a lookup by name

The last two read what the first has saved. analyse ends with 1 if the written tables break a rule.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession

from .config import Config
from .operators import cards, lookup
from .plans.analysis import INFORMATIVE, Analysis
from .plans.saved import Saved
from .sources import network

STORE = "store"


def settings(given: list[str]) -> Config:
    """The configuration with NAME=VALUE settings, each of the type of its default."""
    own = {f.name: f for f in dataclasses.fields(Config)}
    changed = {}
    for text in given:
        name, _, value = text.partition("=")
        if name not in own:
            raise SystemExit(f"no setting {name}: one of {', '.join(sorted(own))}")
        kind = type(getattr(Config(), name))
        changed[name] = kind(value) if kind in (int, float, str) else kind(json.loads(value))
    return Config(**changed)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerlens")
    todo = parser.add_subparsers(dest="todo", required=True)
    analyse = todo.add_parser("analyse")
    analyse.add_argument("input")
    analyse.add_argument("results")
    analyse.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    for name, more in (("card", ("query",)), ("ask", ("lookup",))):
        one = todo.add_parser(name)
        for word in ("results", *more):
            one.add_argument(word)
    todo.choices["ask"].add_argument("arguments", nargs="?", default="{}", type=json.loads)
    asked = parser.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerlens").getOrCreate()
    if asked.todo == "analyse":
        found = Analysis(network.load(spark, asked.input), settings(asked.set)).write(asked.results).collect()
        for rule, violations in found:
            print(f"{rule}\t{violations}")
        return int(any(n for rule, n in found if rule not in INFORMATIVE))
    saved = Saved(spark, f"{asked.results.rstrip('/')}/{STORE}")
    print(cards.explain(saved, asked.query) if asked.todo == "card" else lookup.call(saved, asked.lookup, asked.arguments))
    return 0


if __name__ == "__main__":
    sys.exit(main())
