"""The benchmark suite: a workload packed and unpacked by this engine and by tar, told as one report."""

from __future__ import annotations

import os
import platform
import shutil
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PackConfig
from . import report, workload
from .pack import pack
from .stats import as_json
from .unpack import unpack

BASELINES, PHASES = ("bundlefold", "tar"), ("pack", "unpack")


def commands(tree: str, out: str) -> dict[tuple[str, str], list[str]]:
    """The command of each (baseline, phase); a baseline's unpack reads what its pack has written."""
    archive = f"{out}/tree.tar"
    coder = ["--zstd"] if shutil.which("zstd") else ["-z"]
    return {
        ("bundlefold", "pack"): ["python", "-m", "bundlefold", "pack", tree, f"{out}/tree.archive"],
        ("bundlefold", "unpack"): ["python", "-m", "bundlefold", "unpack", f"{out}/tree.archive", "-C", f"{out}/own"],
        ("tar", "pack"): ["tar", *coder, "-cf", archive, "-C", tree, "."],
        ("tar", "unpack"): ["tar", *coder, "-xf", archive, "-C", f"{out}/tar"],
    }


def expected_records(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(name, b, p) for b in BASELINES for p in PHASES], "workload string, baseline string, phase string")


def tool(name: str) -> dict:
    """A tool's place and the first line, not blank, that it says of its version."""
    path = shutil.which(name)
    said = report.measured_command([name, "--version"]) if path else {}
    lines = [x.strip() for x in f"{said.get('stdout') or ''}\n{said.get('stderr') or ''}".split("\n")]
    return {"name": name, "path": path, "version": next((x for x in lines if x), None)}


def run_suite(spark: SparkSession, recipe: workload.Recipe, out: str, dry_run: bool = False) -> dict:
    """Runs every job, or only names its command, and returns the report. Tools that are missing leave a note."""
    summary = workload.planned_summary(spark, recipe)
    broken = workload.broken_terms(summary, recipe.fields["expected_contract"]).collect()
    if broken:
        raise ValueError(f"the recipe doesn't keep its contract: {[r.asDict() for r in broken]}")
    told = summary.first().asDict()
    tree = f"{out}/tree"
    os.makedirs(f"{out}/tar", exist_ok=True)
    if not dry_run:
        workload.materialise(spark, recipe, tree)
    records = []
    for (baseline, phase), command in commands(tree, out).items():
        r = {"workload": told["name"], "baseline": baseline, "phase": phase, "command": " ".join(command), "notes": "dry run" if dry_run else None}
        if not dry_run and baseline == "tar":
            r |= report.measured_command(command) | {"notes": None if shutil.which("tar") else "tar isn't installed"}
        elif not dry_run:
            begun = time.monotonic()
            row = pack(spark, tree, f"{out}/tree.archive", PackConfig()) if phase == "pack" else unpack(spark, f"{out}/tree.archive", f"{out}/own")
            r |= {"elapsed_ms": int((time.monotonic() - begun) * 1000), "exit_status": 0, "stdout": as_json(row).first()[0], "bundlefold_stats": row.select(F.struct(F.lit(phase).alias("type"), *row.columns).alias("s")).first()["s"].asDict(recursive=True)}
        made = f"{out}/tree.archive" if baseline == "bundlefold" else f"{out}/tree.tar"
        if not dry_run and phase == "pack" and os.path.exists(made):
            r["output_size_bytes"] = os.path.getsize(made)
        if ms := r.get("elapsed_ms"):
            r |= {"files_per_sec": told["regular_file_count"] / (ms / 1000), "mib_per_sec": told["total_bytes"] / 2**20 / (ms / 1000)}
        records.append(r)
    tools = {n: tool(n) for n in ("tar", "zstd")}
    environment = {"host_os": platform.system().lower(), "host_arch": platform.machine(), **tools, "bundlefold": {"name": "bundlefold", "path": None, "version": None}, "resource_sampler": {"name": "rusage", "supported": True, "note": None}}
    return {"generated_at_unix_s": int(time.time()), "invocation": "run_suite", "dry_run": dry_run, "environment": environment, "workload": told, "records": records}


def complete(spark: SparkSession, path: str) -> DataFrame:
    """Records that a report lacks or has too many of."""
    rows = report.records(report.read_report(spark, path, "bundlefold"))
    name = report.read_report(spark, path, "bundlefold").select("workload.name").first()[0]
    return report.missing_and_extra(rows, expected_records(spark, name), ["workload", "baseline", "phase"])
