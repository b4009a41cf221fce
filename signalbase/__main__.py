"""Command lines: ``python -m signalbase build|update|job``, each over a store.

Build and update read the drops below ``--source NAME=FOLDER`` (several may be
given) and print the build's meta document; job writes the job descriptor of
the store's newest generation. How the session runs is up to ``spark-submit``.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from signalbase import config
from signalbase.plans.build import build, update
from signalbase.sources.store import dump_json, job_descriptor, load_json, newest, read_taxonomy


def _source(value: str) -> tuple[str, str]:
    name, found, folder = value.partition("=")
    if not found or name not in {s.name for s in config.SOURCES}:
        raise argparse.ArgumentTypeError(f"not NAME=FOLDER of a known source: {value}")
    return name, folder


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="signalbase")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "update"):
        of = commands.add_parser(name)
        of.add_argument("store")
        of.add_argument("--source", type=_source, action="append", required=True, metavar="NAME=FOLDER")
        of.add_argument("--taxonomy", default="", help="JSON file with version and leaves")
        of.add_argument("--extract", action="store_true", help="extract parameters")
        of.add_argument("--classify", action="store_true", help="classify by keywords")
        of.add_argument("--keep", type=int, help="generations to keep")
    job = commands.add_parser("job")
    job.add_argument("store")
    job.add_argument("output")
    job.add_argument("--limit", type=int, default=config.TARGET_ROWS, help="records to classify")
    return parser.parse_args(argv)


def main(spark: SparkSession, argv: Sequence[str] | None = None) -> dict:
    """Runs one command; returns the document that it prints."""
    args = arguments(argv)
    if args.command == "job":
        at = newest(spark, args.store)
        if at is None:
            raise SystemExit(f"no store at {args.store}")
        meta = load_json(spark, f"{at}/meta", {})
        row = (meta.get("processed_at"), meta.get("taxonomy_version"))
        frame = spark.createDataFrame([row], "processed_at string, taxonomy_version string")
        done = json.loads(job_descriptor(frame, args.limit).first()["job"])
        dump_json(spark, args.output, done, 2)
        return done
    version, leaves = read_taxonomy(spark, args.taxonomy) if args.taxonomy else (config.UNKNOWN, [])
    how = {"extract": args.extract, "classify": args.classify, "keep": args.keep}
    done = {"build": build, "update": update}[args.command](spark, dict(args.source), args.store, leaves, version, **how)
    if args.command == "build":
        return done.document()
    report, months = done
    return report.document() | {"months": months}


if __name__ == "__main__":
    print(json.dumps(main(SparkSession.builder.getOrCreate()), ensure_ascii=False))
