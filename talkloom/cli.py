"""python -m talkloom: list the queries, run one, or write a recording's artifacts again under new names."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from talkloom.session import build_session, ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="talkloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="one query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="Parquet folder; without it, the first rows are shown")
    again = sub.add_parser("reexport", help="artifacts of result documents with other speaker names")
    again.add_argument("root", help="folder with */result.json")
    again.add_argument("out")
    again.add_argument("--name", action="append", default=[], metavar="LABEL=NAME")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from talkloom.plans import artifacts, catalog, exports, inputs, kernels, meetings, more, owners, review, scoring, speech, streams  # noqa: F401

    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = build_session()
    ship(spark)
    if args.command == "run":
        if args.query not in catalog.QUERIES:
            print(f"no query {args.query}", file=sys.stderr)
            return 2
        df = catalog.QUERIES[args.query](spark, args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, truncate=60)
        return 0
    names = dict(x.split("=", 1) for x in args.name)
    files = spark.read.text(f"{args.root}/*/result.json", wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("media_id"), "value")
    artifacts.reexported(files, names).write.mode("overwrite").partitionBy("artifact").parquet(args.out)
    return 0
