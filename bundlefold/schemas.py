"""Schemas of the engine's tables, and the codes of its enumerations and flags.

Unsigned 32-bit fields are longs; unsigned 64-bit counts and sizes are longs, below 2**63; "no parent" and "no master"
are null. Names and link targets are bytes, as file systems have them. Times are seconds and nanoseconds: a Spark
timestamp would lose the last three digits.
"""

from __future__ import annotations

# The codes and names of the container format.
DATA_CODEC = {0: "none", 1: "lz4", 2: "zstd"}
MANIFEST_CODEC = {0: "none", 1: "zstd"}
INTEGRITY_MODE = {0: "off", 1: "fast", 2: "strong"}
FRAME_HASH = {0: "none", 1: "xxh3_64"}
MANIFEST_HASH = {0: "none", 1: "blake3_256"}
ENTRY_KIND = {0: "root", 1: "directory", 2: "regular", 3: "symlink", 4: "hardlink", 5: "char_device", 6: "block_device", 7: "fifo"}
BUNDLE_KIND = {0: "aggregate", 1: "single_file"}
FEATURE_FLAGS = ("has_symlink", "has_hardlink", "has_special_file", "has_metadata", "has_trailer", "preserve_owner")
ENTRY_FLAGS = ("empty_file", "path_validated", "has_metadata")
EXTENT_FLAGS = ("last_extent", "aggregate_bundle", "single_file_bundle")

SCAN = (
    "entry_id long, parent_id long, components array<binary>, relative_path binary, name binary, kind string, mode long, uid long, gid long, "
    "mtime_sec long, mtime_nsec int, size long, dev long, ino long, symlink_target binary"
)
ENTRIES = (
    "entry_id long, parent_id long, kind string, flags_bits int, mode long, uid long, gid long, mtime_sec long, mtime_nsec int, size long, "
    "name binary, link_target binary, name_off long, name_len long, link_off long, link_len long, first_extent long, extent_count long, "
    "hardlink_master_entry_id long, meta_off long, meta_len long"
)
EXTENTS = "extent_id long, entry_id long, bundle_id long, file_offset long, raw_offset_in_bundle long, raw_len long, flags_bits long"
BUNDLES = "bundle_id long, kind string, raw_len long, file_count long, extent_count long, flags int"
FRAMES = "bundle_id long, raw_len long, encoded_len long, flags int, frame_hash long, frame_hash_hex string, payload binary"
HEADER = (
    "version_major int, version_minor int, writer_version_major int, writer_version_minor int, data_codec string, manifest_codec string, "
    "integrity_mode string, frame_hash_algo string, manifest_hash_algo string, suggested_parallelism int, bundle_target_bytes long, "
    "small_file_threshold long, entry_count long, extent_count long, bundle_count long, manifest_raw_len long, manifest_encoded_len long, "
    "feature_flags_bits long, manifest_hash_hex string"
)
TRAILER = "bundle_count long, total_raw_bytes long, total_encoded_bytes long, archive_hash_hex string"

METRIC = "struct<status: string, value: long, note: string>"
TOOL = "struct<name: string, path: string, version: string>"
_STATS = (
    "type: string, codec: string, threads: long, bundle_target_bytes: long, small_file_threshold: long, entry_count: long, bundle_count: long, "
    "raw_bytes: long, encoded_bytes: long, duration_ms: long"
)
_PHASES = ", ".join(f"{p}_ms: {METRIC}" for p in ("scan", "plan", "encode", "write", "header", "manifest", "frame_read", "decode", "scatter", "restore_finalize"))
_WALL = ", ".join(f"{p}_ms: {METRIC}" for p in ("setup", "pipeline", "finalize"))
REPORT_RECORD = (
    "workload: string, baseline: string, phase: string, command: string, elapsed_ms: long, files_per_sec: double, mib_per_sec: double, "
    "output_size_bytes: long, exit_status: int, stdout: string, stderr: string, notes: string, "
    f"{{stats}}: struct<{_STATS}, phase_breakdown: struct<{_PHASES}>, wall_breakdown: struct<{_WALL}>>, "
    "resource_observation: struct<sampler: string, user_cpu_ms: long, system_cpu_ms: long, max_rss_kib: long, note: string>"
)
RECIPE = (
    "name string, description string, root_package_name string, root_packages int, fanout_per_depth array<int>, scoped_package_period int, "
    "scopes array<string>, root_templates array<struct<relative_path: string, template: string>>, "
    "package_templates array<struct<relative_path: string, template: string>>, "
    "expected_contract struct<package_count: long, regular_file_count: long, max_package_depth: int, min_directory_count: long, "
    "dominant_file_types: array<string>>"
)
