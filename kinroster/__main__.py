"""Commands: ``python -m kinroster load|build|test|residual-candidates|residual-report|residual-evaluate``.

``load`` takes CSV files into the raw tables, ``build`` makes and checks models, ``test`` checks what is
there. The review commands print where no ``--out`` is given.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession

from .config import settings
from .operators import export, gates, metrics, residual
from .plans import build
from .plans.engine import Engine
from .sources import fixture, raw

REVIEW = ("residual-candidates", "residual-report", "residual-evaluate")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="kinroster", description="Identity resolution and workforce analytics.")
    parser.add_argument("command", choices=("load", "build", "test", *REVIEW))
    tables = parser.add_mutually_exclusive_group(required=True)
    tables.add_argument("--raw", help="folder of the six raw tables")
    tables.add_argument("--derived", help="folder of order tables from which staff tables are derived")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv"), help="of the raw tables")
    parser.add_argument("--files", help="load: folder of CSV files, one for each raw table")
    parser.add_argument("--most-rejected", type=float, default=1.0, help="load: share of rejected rows beyond which a table keeps its old rows")
    parser.add_argument("--out", help="folder to write; review commands print without it")
    parser.add_argument("--config", help="TOML file of settings")
    parser.add_argument("--as-of", type=dt.date.fromisoformat, help="last snapshot day")
    parser.add_argument("--select", default="", help="build, test: models, as in 'canonical_person+ +stewardship_queue'; all without it")
    parser.add_argument("--warn", action="append", default=[], metavar="RULE", help="build, test: a rule that stops nothing")
    parser.add_argument("--incremental", action="store_true", help="build: only the months since the last build of a mart")
    parser.add_argument("--publish", action="store_true", help="build: name the tables in the catalog's database of the settings")
    parser.add_argument("--limit", type=int, help="review the first so many queued identities only")
    parser.add_argument("--top-n", type=int, default=3)
    parser.add_argument("--top-candidates", type=int, default=10, help="best candidates of all in a report")
    parser.add_argument("--minimum", type=float, default=0.75, help="least score of a candidate")
    parser.add_argument("--mode", choices=("parity", "normalized"), default="parity")
    return parser


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 1 if a rule of severity "error" is broken."""
    parser = arguments()
    args = parser.parse_args(given)
    for command, option in (("load", "files"), ("build", "out")):
        if args.command == command and not getattr(args, option):
            parser.error(f"{command} needs --{option}")
    spark = spark or SparkSession.builder.appName("kinroster").getOrCreate()
    known = settings(file=args.config)
    if args.command == "load":
        for name, (rows, bad) in raw.bulk_load(spark, args.files, args.raw, most_rejected=args.most_rejected).items():
            print(f"{name}: {rows} rows, {bad} rejected")
        return 0
    sources = raw.read(spark, args.raw, args.format) if args.raw else fixture.sources(spark, args.derived)
    engine = Engine(spark, sources, dataclasses.replace(known.engine, as_of=args.as_of) if args.as_of else known.engine)
    try:
        return _COMMANDS[args.command](engine, args, known)
    finally:
        engine.drop()


def _build(engine: Engine, args: argparse.Namespace, known) -> int:
    try:
        results, code = build.run(engine, args.out, args.select, args.incremental, gates.softened(gates.rules_of(engine.cfg), *args.warn)), 0
    except build.BuildFailed as failed:
        results, code = failed.results, 1
    for r in results:
        print(f"{r.model}: {r.state}" + (f" from {r.since}" if r.since else "") + f", {len(r.checks)} rules" + "".join(f"\n  {n}: {v}" for n, v in r.broken.items()))
    if args.publish and not code:
        build.publish(engine.spark, args.out, known.database)
    return code


def _test(engine: Engine, args: argparse.Namespace, known) -> int:
    if args.out:
        build.use_built(engine, args.out)
    rules = gates.of_models(gates.softened(gates.rules_of(engine.cfg), *args.warn), build.selected(args.select))
    found = {r["check_name"]: r["violations"] for r in gates.counts(lambda m: getattr(engine, m), rules).collect()}
    for rule in rules:
        if found[rule.name]:
            print(f"{rule.severity}: {rule.name}: {found[rule.name]}")
    print(f"{len(rules)} rules, {sum(1 for v in found.values() if v)} broken")
    return int(any(found[r.name] and r.severity == "error" for r in rules))


def _review(engine: Engine, args: argparse.Namespace, known) -> int:
    spark = engine.spark
    queue = residual.source_identities(engine.stewardship_queue, args.limit)
    people = residual.canonical_identities(engine.canonical_person, args.mode)
    ranked = engine.store.table("ranked", residual.best(queue, people, engine.store.table, args.top_n, args.minimum))
    if args.command == "residual-candidates":
        if args.out:
            export.write_csv(residual.exported(ranked), args.out)
        else:  # row by row: the driver holds one partition at a time
            for row in metrics.as_json(residual.exported(ranked)).toLocalIterator():
                print(json.dumps(row.asDict(), sort_keys=True))
        return 0
    title, measure = ("Residual review", residual.summary) if args.command == "residual-report" else ("Alignment with hints", residual.proxy_evaluation)
    found = engine.store.table("measured", measure(queue, ranked))
    page = export.review_report(title, found, ranked, args.top_candidates)
    if args.out:
        export.write_text(spark, export.metrics_json(found), f"{args.out}/metrics.json")
        export.write_text(spark, page, f"{args.out}/report.md")
    else:
        print(page)
    return 0


_COMMANDS = {"build": _build, "test": _test} | dict.fromkeys(REVIEW, _review)

if __name__ == "__main__":
    sys.exit(main())
