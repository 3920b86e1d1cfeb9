"""Command line: publish a version of the tables, check it, or ask a tool. Exit code 0, 1 or 2."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lawloom", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    build = sub.add_parser("build", help="load escaped tables and publish a version")
    build.add_argument("--source", required=True, help="folder of NAME_TBL.dat files")
    build.add_argument("--layout", required=True, help="JSON file: table name -> list of columns")
    build.add_argument("--out", required=True)
    build.add_argument("--meta", default="{}", help="JSON object of facts about the version")
    archive = sub.add_parser("build-archive", help="load one folder a session, resuming where a run stopped")
    archive.add_argument("--source", required=True, help="folder of folders named by session")
    archive.add_argument("--table", required=True)
    archive.add_argument("--columns", required=True)
    archive.add_argument("--out", required=True)
    sanity = sub.add_parser("sanity", help="run the quality gate on a folder of tables")
    sanity.add_argument("--tables", required=True)
    ask = sub.add_parser("ask", help="ask a tool of a published version")
    ask.add_argument("--root", required=True)
    ask.add_argument("tool")
    ask.add_argument("args", nargs="*")
    return p


def _build(spark, args) -> int:
    from lawloom.sources.artifacts import publish, report
    from lawloom.sources.escaped import load_table

    with open(args.layout) as f:
        layout = json.load(f)
    tables, bad = {}, {}
    for name, columns in layout.items():
        tables[name], wrong = load_table(spark, os.path.join(args.source, f"{name.upper()}_TBL.dat"), columns)
        bad[name] = wrong.count()
    indexes = {name: keys for name, keys in {"law_section": ("id", "content_text")}.items() if name in tables and set(keys) <= set(tables[name].columns)}
    version = publish(tables, args.out, json.loads(args.meta), indexes=indexes)
    print(report({"version": version}, bad_rows=bad, rows={n: t.count() for n, t in tables.items()}))
    return 0


def _archive(spark, args) -> int:
    from lawloom.sources.bundles import ingest_sessions
    from lawloom.sources.escaped import load_table

    columns = args.columns.split(",")
    names = sorted(d for d in os.listdir(args.source) if d.isdigit() and len(d) == 4)
    load = {s: (lambda s=s: load_table(spark, os.path.join(args.source, s, f"{args.table.upper()}_TBL.dat"), columns)[0]) for s in names}
    done = ingest_sessions(spark, load, f"{args.out}/{args.table}.parquet", f"{args.out}/_done")
    print(json.dumps(done, sort_keys=True))
    return int(any(v.startswith("failed") for v in done.values()))


def _sanity(spark, args) -> int:
    from pyspark.sql import functions as F

    from lawloom.plans.survey_gate import survey_gate

    rows = survey_gate(spark, args.tables, F.current_timestamp()).collect()
    print(json.dumps([r.asDict() for r in rows], sort_keys=True))
    return int(any(r.level == "fail" and not r.ok for r in rows))


def _ask(spark, args) -> int:
    from lawloom.catalog import Catalog
    from lawloom.tools import Tools

    tool = getattr(Tools(Catalog.published(spark, args.root)), args.tool, None) if not args.tool.startswith("_") else None
    if tool is None:
        print(f"no tool {args.tool}", file=sys.stderr)
        return 2
    answer = tool(*args.args)
    print(json.dumps(answer, ensure_ascii=False))
    return int(answer is None or "error" in answer)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lawloom").getOrCreate()
    return {"build": _build, "build-archive": _archive, "sanity": _sanity, "ask": _ask}[args.what](spark, args)


if __name__ == "__main__":
    sys.exit(main())
