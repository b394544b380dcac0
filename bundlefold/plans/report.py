"""The benchmark report: read, checked, told as tables, written."""

from __future__ import annotations

import json
import os
import resource
import subprocess
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import mib, per_second
from ..schemas import REPORT_RECORD, TOOL


def report_schema(tool: str) -> str:
    """The schema of a report whose archive tool is called `tool`."""
    return (
        "generated_at_unix_s long, invocation string, dry_run boolean, "
        f"environment struct<host_os: string, host_arch: string, tar: {TOOL}, {tool}: {TOOL}, zstd: {TOOL}, resource_sampler: struct<name: string, supported: boolean, note: string>>, "
        "workload struct<name: string, recipe_path: string, package_count: long, regular_file_count: long, directory_count: long, total_bytes: long, max_package_depth: int, dominant_file_types: array<string>>, "
        f"records array<struct<{REPORT_RECORD.format(stats=tool + '_stats')}>>"
    )


def read_report(spark: SparkSession, path: str, tool: str) -> DataFrame:
    return spark.read.schema(report_schema(tool)).json(path, multiLine=True)


def records(report: DataFrame) -> DataFrame:
    """A row a record: baseline (archive tool or tar), phase (pack or unpack) and what was measured."""
    return report.select(F.explode("records").alias("r"), F.col("workload.regular_file_count").alias("regular_file_count"), F.col("workload.total_bytes").alias("total_bytes")).select("r.*", "regular_file_count", "total_bytes")


def with_rates(rows: DataFrame) -> DataFrame:
    """files_per_sec and mib_per_sec from elapsed_ms; null where none has passed."""
    return rows.withColumns({"files_per_sec": per_second("regular_file_count", "elapsed_ms", None), "mib_per_sec": per_second(mib("total_bytes"), "elapsed_ms", None)})


def missing_and_extra(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are expected and missing, or there and not expected; repeated keys count as often as they are."""
    have, want = rows.select(*keys), expected.select(*keys)
    return want.exceptAll(have).withColumn("problem", F.lit("missing")).unionAll(have.exceptAll(want).withColumn("problem", F.lit("extra")))


def ratios(rows: DataFrame, baseline: str, other: str) -> DataFrame:
    """How many times as long the other baseline took, by workload and phase, and how many times as large its output is."""
    pick = lambda b, s: rows.where(F.col("baseline") == b).select("workload", "phase", F.col("elapsed_ms").alias(f"ms_{s}"), F.col("output_size_bytes").alias(f"bytes_{s}"))
    both = pick(baseline, "a").join(pick(other, "b"), ["workload", "phase"])
    return both.select("workload", "phase", (F.col("ms_b") / F.col("ms_a")).alias("time_ratio"), (F.col("bytes_b") / F.col("bytes_a")).alias("size_ratio"))


def measured_command(command: list[str], cwd: str | None = None) -> dict:
    """Runs a command to its end: elapsed_ms, exit_status, output, and what it used."""
    before, begun = resource.getrusage(resource.RUSAGE_CHILDREN), time.monotonic()
    try:
        done = subprocess.run(command, cwd=cwd, capture_output=True, text=True)
    except FileNotFoundError as e:
        return {"command": " ".join(command), "exit_status": None, "notes": str(e)}
    after = resource.getrusage(resource.RUSAGE_CHILDREN)
    ms = lambda f: int((getattr(after, f) - getattr(before, f)) * 1000)
    return {
        "command": " ".join(command), "elapsed_ms": int((time.monotonic() - begun) * 1000), "exit_status": done.returncode, "stdout": done.stdout, "stderr": done.stderr,
        "resource_observation": {"sampler": "rusage", "user_cpu_ms": ms("ru_utime"), "system_cpu_ms": ms("ru_stime"), "max_rss_kib": after.ru_maxrss, "note": None},
    }


def first_line(lines: DataFrame, column: str, order: str) -> DataFrame:
    """The first line, by order, that isn't blank."""
    return lines.where(F.trim(F.col(column)) != "").orderBy(order).limit(1).select(column)


def write_report(path: str, report: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(report, f, indent=2)
