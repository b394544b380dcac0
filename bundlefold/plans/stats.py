"""One-row tables of a run's statistics, their rates, and the summary for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import measured, mib, per_second, unavailable, wall_buckets

_BASE = "codec string, threads long, bundle_target_bytes long, small_file_threshold long, entry_count long, bundle_count long, raw_bytes long, encoded_bytes long, duration_ms long"
DRY = "a dry run measures no phases"


def _row(spark: SparkSession, values: dict, ms: dict[str, int] | None) -> DataFrame:
    names = [c.split()[0] for c in _BASE.split(", ")]
    schema = _BASE + "".join(f", __{k} long" for k in ms or {})
    return spark.createDataFrame([tuple(values.get(n) for n in names) + tuple((ms or {}).values())], schema)


def _phases(names: tuple[str, ...], have: dict[str, int] | None) -> Column:
    return F.struct(*[(unavailable(DRY) if have is None else measured(f"__{n}") if n in have else unavailable("not run")).alias(f"{n}_ms") for n in names])


def pack_stats(spark: SparkSession, values: dict, ms: dict[str, int] | None) -> DataFrame:
    """The statistics of a packing run; ms: milliseconds of scan, plan, encode and write, None after a dry run."""
    names = ("scan", "plan", "encode", "write")
    out = _row(spark, values, ms).withColumn("phase_breakdown", _phases(names, ms))
    return out.drop(*[f"__{n}" for n in ms or {}])


def unpack_stats(spark: SparkSession, values: dict, ms: dict[str, int] | None) -> DataFrame:
    """The statistics of an unpacking run; ms also has setup and pipeline, the wall clock's buckets."""
    out = _row(spark, values, ms).withColumn("phase_breakdown", _phases(("header", "manifest", "frame_read", "decode", "scatter", "restore_finalize"), ms))
    wall = wall_buckets("duration_ms", "__setup", "__pipeline") if ms else {}
    buckets = [(measured(wall[k]) if ms else unavailable(DRY)).alias(k) for k in ("setup_ms", "pipeline_ms", "finalize_ms")]
    return out.withColumn("wall_breakdown", F.struct(*buckets)).drop(*[f"__{n}" for n in ms or {}])


def with_rates(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"files_per_second": per_second("entry_count", "duration_ms"), "mib_per_second": per_second(mib("raw_bytes"), "duration_ms")})


def summary_text(stats: DataFrame, title: str) -> DataFrame:
    """One text column: the statistics as lines for people."""
    shown = with_rates(stats)
    seconds = F.greatest(F.col("duration_ms") / 1000.0, F.lit(0.000001))
    plain = ("codec", "threads", "bundle_target_bytes", "small_file_threshold", "entry_count", "bundle_count", "raw_bytes", "encoded_bytes")
    rows = [F.lit(title), *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in plain]]
    rows += [F.format_string("duration_seconds: %.4f", seconds), F.format_string("files_per_second: %.2f", "files_per_second"), F.format_string("mib_per_second: %.2f", "mib_per_second")]
    return shown.select(F.array_join(F.array(*rows), "\n").alias("text"))


def as_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("text"))
