"""Unpacking a container into a folder: read, check, create folders, write files, link, finish."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import UnpackConfig
from ..errors import EngineError, FileSystemError, IntegrityError
from ..functions.columns import estimated_bundles
from ..operators import restore
from ..operators.frames import archive_digest, pieces_of
from ..operators.paths import entry_paths
from ..operators.planner import extent_sequence
from ..sources.container import read_container, spooled
from ..tables import keep
from .pack import _Clock, archive_bytes
from .stats import unpack_stats

# The fields of the four groups of an unpacking run's counters.
DIAGNOSTICS = {
    "config": "worker_count decode_worker_count queue_depth writer_shard_count max_open_files max_open_files_per_shard",
    "pipeline": "decode_dispatch_wait_ns decode_dispatch_wait_count scatter_dispatch_wait_ns scatter_dispatch_wait_count bundles_observed total_bundle_extents "
    "total_bundle_unique_entries total_bundle_entry_switches max_bundle_extent_count max_bundle_unique_entries",
    "scatter": "writer_lock_wait_ns dir_cache_hits dir_cache_misses file_cache_hits file_cache_misses file_create_count file_reopen_count handle_eviction_count "
    "directory_open_ns file_open_ns write_ns extents_written bytes_written",
    "finalize": "regular_finalize_ns regular_finalize_count dir_finalize_ns dir_finalize_count symlink_create_ns symlink_create_count hardlink_create_ns "
    "hardlink_create_count trailer_verify_ns trailer_verify_count",
}
#: Environment variable that names a file for the counters.
DIAGNOSTICS_ENV = "BUNDLEFOLD_DIAGNOSTICS_JSON"


def diagnostics_row(spark: SparkSession, counters: dict[str, int]) -> DataFrame:
    """The counters as one row of four structs; what Spark's scheduler has no counterpart of stays 0."""
    names = [(g, n) for g, ns in DIAGNOSTICS.items() for n in ns.split()]
    flat = spark.createDataFrame([tuple(int(counters.get(n, 0)) for _, n in names)], ", ".join(f"{n} long" for _, n in names))
    return flat.select(*[F.struct(*ns.split()).alias(g) for g, ns in DIAGNOSTICS.items()])


def bundle_counters(extents: DataFrame) -> DataFrame:
    """Sums and maxima of the shapes of all bundles."""
    s = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    m = lambda c, name: F.coalesce(F.max(c), F.lit(0)).alias(name)
    return extent_sequence(extents).agg(
        F.count("*").alias("bundles_observed"), s("extent_count", "total_bundle_extents"), s("unique_entries", "total_bundle_unique_entries"), s("entry_switches", "total_bundle_entry_switches"),
        m("extent_count", "max_bundle_extent_count"), m("unique_entries", "max_bundle_unique_entries"),
    )


def _checked_trailer(spark: SparkSession, archive: str, frames: DataFrame, totals: tuple[int, int, int]) -> None:
    found = read_container(spark, archive, "trailer").collect()
    if not found:
        raise IntegrityError("the container has no trailer")
    t = found[0]
    if totals != (t["bundle_count"], t["total_raw_bytes"], t["total_encoded_bytes"]) or archive_digest(frames).hex() != t["archive_hash_hex"]:
        raise IntegrityError("the trailer doesn't match the frames")


def unpack(spark: SparkSession, archive: str, output: str, config: UnpackConfig | None = None, counters: dict[str, int] | None = None) -> DataFrame:
    """Restores the tree of a container below output; returns the run's statistics as one row, and puts counters into a
    dict that is given. The root's own metadata aren't restored."""
    if not os.path.isfile(archive):
        raise FileSystemError(f"no such archive: {archive}")
    try:
        return _unpack(spark, archive, output, config or UnpackConfig(), {} if counters is None else counters)
    except Exception as e:
        raise _cause(e) from e


def _unpack(spark: SparkSession, archive: str, output: str, config: UnpackConfig, counters: dict[str, int]) -> DataFrame:
    clock = _Clock()
    owner = config.restore_owner == "preserve"
    header = read_container(spark, archive, "header").first()
    clock.lap("header")
    entries, extents = keep(read_container(spark, archive, "entries"), "entries"), keep(read_container(spark, archive, "extents"), "extents")
    clock.lap("manifest")
    frames = keep(read_container(spark, archive, "frames"), "frames")
    totals = tuple(frames.agg(F.count("*"), F.coalesce(F.sum("raw_len"), F.lit(0)), F.coalesce(F.sum("encoded_len"), F.lit(0))).first())
    clock.lap("frame_read")
    trailer = bool(header["feature_flags_bits"] & 16)
    restore.check_names(entries)
    paths = keep(entry_paths(entries).select("entry_id", "components", "depth").join(entries.select("entry_id", "kind", "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "size", "link_target", "extent_count", "hardlink_master_entry_id"), "entry_id"), "targets")
    if trailer and config.trailer_first:
        _checked_trailer(spark, archive, frames, totals)
        counters["trailer_verify_count"] = 1
    os.makedirs(output, exist_ok=True)
    restore.clear_marker(output)
    folders = paths.where("kind = 'directory'")
    if not config.overwrite:
        restore.check_free(paths.where("depth > 0 and kind <> 'directory'"), output)
    restore.make_folders(folders, output)
    setup = clock.total()
    pieces = pieces_of(frames, extents, header["data_codec"])
    clock.lap("decode")
    run = uuid.uuid4().hex
    files = restore.write_files(pieces, paths.where("kind = 'regular'"), output, owner, run)
    clock.lap("scatter")
    pipeline = clock.total() - setup
    symlinks = restore.make_symlinks(paths.where("kind = 'symlink'"), output, run)
    masters = paths.select(F.col("entry_id").alias("hardlink_master_entry_id"), F.col("components").alias("master"))
    links = paths.where("kind = 'hardlink'").drop("master").join(masters, "hardlink_master_entry_id")
    hardlinks = restore.make_hardlinks(links, output, run)
    restore.sweep(paths.where("kind in ('root', 'directory')"), output, run)
    finished = restore.finish_folders(folders, output, owner)
    if trailer and not config.trailer_first:
        try:
            _checked_trailer(spark, archive, frames, totals)
        except IntegrityError:
            restore.set_marker(output)
            raise
        counters["trailer_verify_count"] = 1
    clock.lap("restore_finalize")
    counters |= bundle_counters(extents).first().asDict() | {
        "worker_count": config.threads or header["suggested_parallelism"], "file_create_count": files["files"], "extents_written": files["extents"], "bytes_written": files["bytes"], "write_ns": files["ns"],
        "regular_finalize_count": files["files"], "dir_finalize_count": finished, "symlink_create_count": symlinks["files"], "symlink_create_ns": symlinks["ns"], "hardlink_create_count": hardlinks["files"], "hardlink_create_ns": hardlinks["ns"],
    }
    values = {
        "codec": header["data_codec"], "threads": config.threads or header["suggested_parallelism"], "bundle_target_bytes": header["bundle_target_bytes"], "small_file_threshold": header["small_file_threshold"],
        "entry_count": header["entry_count"], "bundle_count": header["bundle_count"], "raw_bytes": totals[1],
        "encoded_bytes": archive_bytes(header["manifest_encoded_len"], totals[2], totals[0], trailer), "duration_ms": clock.total(),
    }
    stats = unpack_stats(spark, values, clock.ms | {"setup": setup, "pipeline": pipeline})
    if path := os.environ.get(DIAGNOSTICS_ENV):
        write_diagnostics(path, stats, diagnostics_row(spark, counters))
    return stats


def write_diagnostics(path: str, stats: DataFrame, counters: DataFrame) -> None:
    one = lambda df: json.loads(df.select(F.to_json(F.struct("*"))).first()[0])
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump({"stats": one(stats), "diagnostics": one(counters)}, f, indent=2)


def unpack_stream(spark: SparkSession, stream, output: str, config: UnpackConfig | None = None) -> DataFrame:
    """unpack() of bytes that can only be read in order, such as standard input."""
    return unpack(spark, spooled(spark, stream), output, config)


def estimate_unpack(spark: SparkSession, archive: str, threads: int | None = None) -> DataFrame:
    """What can be told of a container without reading it; a header that can't be read leaves defaults."""
    clock = _Clock()
    if not os.path.isfile(archive):
        raise FileSystemError(f"no such archive: {archive}")
    found = read_container(spark, archive, "header", mode="permissive").collect()
    header = found[0].asDict() if found else {}
    size = os.path.getsize(archive)
    bundles = spark.range(1).select(estimated_bundles(F.lit(size), 4 << 20)).first()[0]
    values = {"codec": header.get("data_codec", "zstd"), "threads": threads or max(1, header.get("suggested_parallelism") or os.cpu_count() or 1), "entry_count": 0, "bundle_count": bundles, "raw_bytes": size, "encoded_bytes": size, "duration_ms": clock.total()}
    return unpack_stats(spark, values, None)


def _cause(error: Exception) -> Exception:
    """The engine's own error behind one that a task has raised."""
    from .. import errors

    if isinstance(error, EngineError):
        return error
    text = str(error)
    for kind in (errors.IntegrityError, errors.TruncatedError, errors.UnsupportedValue, errors.FormatError, errors.UnsafePath, errors.FileSystemError):
        mark = f"errors.{kind.__name__}: "
        if mark in text:
            return kind(text.split(mark, 1)[1].split("\n", 1)[0])
    return error
