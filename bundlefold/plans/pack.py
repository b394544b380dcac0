"""Packing a tree into a container: scan, number, plan, encode, write."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PackConfig
from ..functions.columns import estimated_bundles, estimated_encoded
from ..operators.frames import frames_from_contents, frames_from_files
from ..operators.numbering import with_entry_ids, with_hardlinks
from ..operators.planner import bundles_of, extents_of, feature_bits, planned_entries
from ..sources import layout
from ..sources.tree import read_tree
from ..sources.writer import manifest_bytes, write_container
from ..tables import keep
from .stats import pack_stats


class Plan:
    """The plan of a container: its entries, extents and bundles."""

    def __init__(self, entries: DataFrame, extents: DataFrame, bundles: DataFrame):
        self.entries, self.extents, self.bundles = entries, extents, bundles


def plan_archive(scan: DataFrame, config: PackConfig, partitions: int | None = None, kept: bool = False) -> Plan:
    """scan: numbered entries with hard links resolved; kept: they are a table in the shared folder."""
    scan = scan if kept else keep(scan, "scan")
    extents = keep(extents_of(scan, config.bundle_target_bytes, config.small_file_threshold, partitions), "extents")
    return Plan(planned_entries(scan, extents, partitions), extents, bundles_of(extents))


def normalised(scan: DataFrame, mtime_sec: int = 0, uid: int = 0, gid: int = 0) -> DataFrame:
    """The same owner and time for every entry, so that equal trees give equal manifests."""
    return scan.withColumns({"uid": F.lit(uid).cast("long"), "gid": F.lit(gid).cast("long"), "mtime_sec": F.lit(mtime_sec).cast("long"), "mtime_nsec": F.lit(0)})


class _Clock:
    def __init__(self):
        self.begun = self.last = time.monotonic()
        self.ms: dict[str, int] = {}

    def lap(self, name: str) -> None:
        now = time.monotonic()
        self.ms[name] = int((now - self.last) * 1000)
        self.last = now

    def total(self) -> int:
        return int((time.monotonic() - self.begun) * 1000)


def pack(spark: SparkSession, source: str | DataFrame, output: str, config: PackConfig | None = None, contents: DataFrame | None = None) -> DataFrame:
    """Packs a folder, or a numbered scan with its contents (entry_id, content), into a container; returns its
    statistics as one row."""
    config, clock = config or PackConfig(), _Clock()
    scan = keep(with_hardlinks(with_entry_ids(read_tree(spark, source))) if isinstance(source, str) else source, "scan")
    clock.lap("scan")
    plan = plan_archive(scan, config, kept=True)
    entries, extents, bundles = keep(plan.entries, "entries"), plan.extents, keep(plan.bundles, "bundles")
    flags = entries.agg(feature_bits(entries, config.integrity == "strong", config.preserve_owner)).first()[0]
    raw = manifest_bytes(entries, extents, bundles)
    counts = (entries.count(), extents.count(), bundles.count())
    clock.lap("plan")
    frames = frames_from_files(extents, scan, source, config.codec, config.level) if isinstance(source, str) else frames_from_contents(extents, contents, config.codec, config.level)
    frames = keep(frames, "frames")
    clock.lap("encode")
    done = write_container(output, raw, counts, flags, frames, config)
    clock.lap("write")
    values = {
        "codec": config.codec, "threads": config.threads, "bundle_target_bytes": config.bundle_target_bytes, "small_file_threshold": config.small_file_threshold,
        "entry_count": counts[0], "bundle_count": counts[2], "raw_bytes": done["total_raw_bytes"], "encoded_bytes": done["archive_bytes"], "duration_ms": clock.total(),
    }
    return pack_stats(spark, values, clock.ms)


def tree_totals(files: DataFrame) -> DataFrame:
    """entry_count, regular_file_count, directory_count (the root included) and raw_bytes of a scan; hard links count each."""
    regular = F.col("kind").isin("regular", "hardlink")
    return files.agg(
        F.count("*").alias("entry_count"), F.count_if(regular).alias("regular_file_count"), F.count_if(F.col("kind").isin("root", "directory")).alias("directory_count"),
        F.coalesce(F.sum(F.when(regular, F.col("size"))), F.lit(0)).alias("raw_bytes"),
    )


def estimate_pack(spark: SparkSession, source: str, config: PackConfig | None = None) -> DataFrame:
    """What packing a folder would give, from its files' sizes alone."""
    config, clock = config or PackConfig(), _Clock()
    r = tree_totals(read_tree(spark, source, "keep")).select("*", estimated_bundles("raw_bytes", config.bundle_target_bytes).alias("b"), estimated_encoded("raw_bytes", config.codec).alias("e")).first()
    values = {
        "codec": config.codec, "threads": config.threads, "bundle_target_bytes": config.bundle_target_bytes, "small_file_threshold": config.small_file_threshold,
        "entry_count": r["entry_count"], "bundle_count": r["b"], "raw_bytes": r["raw_bytes"], "encoded_bytes": r["e"], "duration_ms": clock.total(),
    }
    return pack_stats(spark, values, None)


def archive_bytes(manifest_encoded: int, payload: int, frames: int, trailer: bool) -> int:
    """The size of a container from its parts."""
    return layout.HEADER_LEN + manifest_encoded + payload + layout.FRAME_LEN * frames + layout.TRAILER_LEN * trailer
