"""Command line: python -m bundlefold pack | unpack | dump | workload | suite."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .config import CODECS, INTEGRITY, OWNER, PackConfig, UnpackConfig
from .errors import UsageError, describe


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bundlefold", description="Archives of very many small files, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("pack", help="pack a folder into a container")
    a.add_argument("input_dir")
    a.add_argument("output_archive")
    a.add_argument("--codec", choices=[c for c in CODECS if c != "none"], default="zstd")
    a.add_argument("--threads", type=int, default=os.cpu_count() or 1)
    a.add_argument("--bundle-target-bytes", type=int, default=4 << 20)
    a.add_argument("--small-file-threshold", type=int, default=256 << 10)
    a.add_argument("--integrity", choices=INTEGRITY, default="fast")
    a.add_argument("--preserve-owner", action="store_true")
    b = sub.add_parser("unpack", help="restore a container, or standard input (-), below a folder")
    b.add_argument("input_archive")
    b.add_argument("-C", "--directory", default=".")
    b.add_argument("--threads", type=int)
    b.add_argument("--overwrite", action="store_true")
    b.add_argument("--integrity", choices=INTEGRITY, default="fast")
    b.add_argument("--restore-owner", choices=OWNER, default="auto")
    for x in (a, b):
        x.add_argument("--dry-run", action="store_true")
        x.add_argument("--stats-format", choices=("human", "json"), default="human")
    c = sub.add_parser("dump", help="tell a container as JSON")
    c.add_argument("archive")
    c.add_argument("manifest_json")
    c.add_argument("--summary-out")
    d = sub.add_parser("workload", help="write the files of a workload recipe")
    d.add_argument("recipe")
    d.add_argument("output_dir")
    e = sub.add_parser("suite", help="pack and unpack a workload with this engine and with tar, and write a report")
    e.add_argument("recipe")
    e.add_argument("output_dir")
    e.add_argument("report_json")
    e.add_argument("--dry-run", action="store_true")
    return p


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]")).appName("bundlefold").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(args: argparse.Namespace, spark=None) -> str:
    """Does what the arguments say and returns what is to be printed."""
    if args.command == "unpack" and args.input_archive == "-" and args.dry_run:
        raise UsageError("a dry run can't read standard input")
    spark = spark or _session()
    from .plans import dump, pack, stats, unpack, workload

    if args.command == "pack":
        config = PackConfig(args.codec, -3, args.threads, args.bundle_target_bytes, args.small_file_threshold, args.integrity, args.preserve_owner)
        row, title = (pack.estimate_pack(spark, args.input_dir, config) if args.dry_run else pack.pack(spark, args.input_dir, args.output_archive, config)), "Pack Summary"
    elif args.command == "unpack":
        config, title = UnpackConfig(args.overwrite, args.integrity, args.restore_owner, args.threads), "Unpack Summary"
        if args.dry_run:
            row = unpack.estimate_unpack(spark, args.input_archive, args.threads)
        elif args.input_archive == "-":
            row = unpack.unpack_stream(spark, sys.stdin.buffer, args.directory, config)
        else:
            row = unpack.unpack(spark, args.input_archive, args.directory, config)
    elif args.command == "dump":
        told = dump.dump(spark, args.archive)
        dump.write_json(told, args.manifest_json)
        if args.summary_out:
            dump.write_json(dump.summary(told), args.summary_out)
        return ""
    elif args.command == "suite":
        from .plans import report, suite

        report.write_report(args.report_json, suite.run_suite(spark, workload.Recipe(spark, args.recipe), args.output_dir, args.dry_run))
        return ""
    else:
        recipe = workload.Recipe(spark, args.recipe)
        broken = workload.broken_terms(workload.planned_summary(spark, recipe), recipe.fields["expected_contract"]).collect()
        if broken:
            raise UsageError(f"the recipe doesn't keep its contract: {[r.asDict() for r in broken]}")
        workload.materialise(spark, recipe, args.output_dir)
        return workload.summary_json(workload.planned_summary(spark, recipe))
    return (stats.as_json(row) if args.stats_format == "json" else stats.summary_text(row, title)).first()[0]


def main(argv: list[str] | None = None) -> int:
    try:
        print(run(parser().parse_args(argv)))
        return 0
    except Exception as e:  # noqa: BLE001
        told = describe(e)
        print(json.dumps(told), file=sys.stderr)
        return int(told["exit_code"])
