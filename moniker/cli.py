"""Command line: python -m moniker.cli COMMAND."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from .config import Settings
from .sources import readers, writers
from .store import Store, get_store

VERSION = "0.1.0"


def _out(rows: DataFrame, to: str) -> None:
    if to == "-":
        for line in rows.toJSON().toLocalIterator():
            print(line)
    else:
        writers.mentions_json(rows, to)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="moniker")
    p.add_argument("--version", action="store_true")
    p.add_argument("--settings", action="store_true")
    p.add_argument("--uri")
    sub = p.add_subparsers(dest="command")
    for name in ("load-entities", "load-names", "load-dataset", "load-catalog", "extract", "percolate"):
        sub.add_parser(name).add_argument("-i", default="-")
    for name in ("iterate", "extract", "percolate"):
        (sub.choices.get(name) or sub.add_parser(name)).add_argument("-o", default="-")
    sub.choices["percolate"].add_argument("--slop", type=int, default=0)
    sub.add_parser("build")
    look = sub.add_parser("lookup")
    look.add_argument("query")
    look.add_argument("--threshold", type=float)
    a = p.parse_args(args)
    if a.version:
        print(VERSION)
        return 0
    if a.settings:
        print(asdict(Settings.from_env()))
        return 0
    if not a.command:
        p.print_help()
        return 2
    spark = spark or SparkSession.builder.appName("moniker").getOrCreate()
    store: Store = get_store(spark, a.uri)
    if a.command.startswith("load-"):
        {"load-entities": store.load_entities, "load-names": store.load_names, "load-dataset": store.load_dataset, "load-catalog": store.load_catalog}[a.command](a.i)
    elif a.command == "build":
        store.build()
    elif a.command == "iterate":
        _out(store.clusters(), a.o)
    elif a.command == "lookup":
        hit = store.lookup(a.query, a.threshold)
        print(hit.asDict() if hit else "not found")
    elif a.command == "extract":
        _out(store.extract_all(readers.document(spark, a.i)).drop("doc_id"), a.o)
    elif a.command == "percolate":
        _out(store.percolate_all(readers.document(spark, a.i), a.slop).drop("doc_id"), a.o)
    return 0


if __name__ == "__main__":
    sys.exit(main())
