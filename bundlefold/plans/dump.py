"""A container told as nested JSON: all of its tables, with names for codes and flags, and a one-row summary.

dump() is one row that holds the manifest; write_dump() writes the same text for containers of any size, its lists in
runs of rows that tasks put into text, and dumped_extents() reads it element by element."""

from __future__ import annotations

import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flag_names, hex_lower, lossy_utf8, octal_mode
from ..operators.frames import decoded
from ..operators.paths import entry_paths
from ..schemas import ENTRY_FLAGS, EXTENT_FLAGS, FEATURE_FLAGS
from ..sources.container import read_container
from ..tables import bound_batches, keep, shared_folder

#: Elements of a list that one task puts into text.
RUN = 50_000


def entry_rows(entries: DataFrame) -> DataFrame:
    paths = entry_paths(entries).select("entry_id", "path")
    return entries.join(paths, "entry_id").select(
        "entry_id", "parent_id", "kind", "flags_bits", flag_names("flags_bits", ENTRY_FLAGS).alias("flags"), "path",
        lossy_utf8("name").alias("name_utf8"), hex_lower("name").alias("name_hex"), octal_mode("mode").alias("mode_octal"), "uid", "gid", "mtime_sec", "mtime_nsec", "size",
        lossy_utf8("link_target").alias("link_target_utf8"), hex_lower("link_target").alias("link_target_hex"), "first_extent", "extent_count", "hardlink_master_entry_id", "meta_len",
    )


def extent_rows(extents: DataFrame, paths: DataFrame) -> DataFrame:
    named = extents.join(paths.select("entry_id", F.col("path").alias("entry_path")), "entry_id")
    return named.select("extent_id", "entry_id", "entry_path", "bundle_id", "file_offset", "raw_offset_in_bundle", "raw_len", "flags_bits", flag_names("flags_bits", EXTENT_FLAGS).alias("flags"))


def dump(spark: SparkSession, archive: str, verify: bool = True) -> DataFrame:
    """One row: archive_bytes, header, manifest, frames and trailer. verify decodes every frame and checks its hash. The
    result holds the whole manifest; it is for archives of a size that people look at."""
    if verify:
        _verify(spark, archive)
    lists = lambda df, key, drop=(): df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("__k"), F.struct(*[c for c in df.columns if c not in drop]).alias("__r")))), lambda x: x["__r"]).alias("rows"))
    return _told(spark, archive, {name: lists(df, key, drop) for name, (df, key, drop) in _lists(spark, archive).items()})


def _verify(spark: SparkSession, archive: str) -> None:
    header = read_container(spark, archive, "header").first()
    decoded(read_container(spark, archive, "frames"), header["data_codec"]).agg(F.count("*")).collect()


def _lists(spark: SparkSession, archive: str, kept: bool = False) -> dict[str, tuple[DataFrame, str, tuple[str, ...]]]:
    """The rows of a dump's lists, the column they are ordered by, and columns that aren't told."""
    table = lambda name: read_container(spark, archive, name).drop("archive")
    told = entry_rows(keep(table("entries"), "entries") if kept else table("entries"))
    told = keep(told, "told") if kept else told
    frames = table("frames").select("bundle_id", "raw_len", "encoded_len", "flags", "frame_hash_hex")
    return {"entries": (told, "entry_id", ()), "extents": (extent_rows(table("extents"), told), "extent_id", ("extent_id",)), "bundles": (table("bundles"), "bundle_id", ()), "frames": (frames, "bundle_id", ())}


def _told(spark: SparkSession, archive: str, lists: dict[str, DataFrame]) -> DataFrame:
    """The one row of a dump; lists: for each list one row, `rows`, that stands for it."""
    table = lambda name: read_container(spark, archive, name).drop("archive")
    heads = table("header").withColumn("feature_flags", flag_names("feature_flags_bits", FEATURE_FLAGS))
    names = table("entries").agg(F.sum(F.col("name_len") + F.col("link_len")).alias("name_arena_bytes"), F.sum("meta_len").alias("meta_blob_bytes"))
    trailer = table("trailer").agg(F.first(F.struct("*")).alias("trailer"))
    parts = [*(df.select(F.col("rows").alias(name)) for name, df in lists.items()), names, trailer]
    out = heads.select(F.struct("*").alias("header"))
    for p in parts:  # each of one row
        out = out.join(p, F.lit(True))
    counts = [F.col(f"header.{c}").alias(c) for c in ("entry_count", "extent_count", "bundle_count")]
    return out.select(F.lit(os.path.getsize(archive)).cast("long").alias("archive_bytes"), "header", F.struct(*counts, "name_arena_bytes", "meta_blob_bytes", "entries", "extents", "bundles").alias("manifest"), "frames", "trailer")


def summary(dumped: DataFrame) -> DataFrame:
    """The one-row summary of a dump."""
    h = "version_major version_minor data_codec manifest_codec integrity_mode frame_hash_algo manifest_hash_algo feature_flags entry_count extent_count bundle_count".split()
    add = lambda field: F.aggregate("frames", F.lit(0).cast("long"), lambda s, f: s + f[field])
    return dumped.select(
        "archive_bytes", *[F.col(f"header.{c}").alias(c) for c in h], F.size("frames").cast("long").alias("frame_count"), F.col("header.manifest_raw_len").alias("manifest_raw_len"),
        F.col("header.manifest_encoded_len").alias("manifest_encoded_len"), add("raw_len").alias("total_frame_raw_bytes"), add("encoded_len").alias("total_frame_encoded_bytes"), F.col("trailer").isNotNull().alias("has_trailer"),
    )


def archive_summary(spark: SparkSession, archive: str) -> DataFrame:
    """The same row for an archive of any size: its tables are added up, not gathered."""
    table = lambda name: read_container(spark, archive, name).drop("archive")
    heads = table("header").withColumn("feature_flags", flag_names("feature_flags_bits", FEATURE_FLAGS))
    add = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    frames = table("frames").agg(F.count("*").alias("frame_count"), add("raw_len", "total_frame_raw_bytes"), add("encoded_len", "total_frame_encoded_bytes"))
    trailer = table("trailer").agg((F.count("*") > 0).alias("has_trailer"))
    h = "version_major version_minor data_codec manifest_codec integrity_mode frame_hash_algo manifest_hash_algo feature_flags entry_count extent_count bundle_count manifest_raw_len manifest_encoded_len".split()
    return heads.join(frames, F.lit(True)).join(trailer, F.lit(True)).select(F.lit(os.path.getsize(archive)).cast("long").alias("archive_bytes"), *h, "frame_count", "total_frame_raw_bytes", "total_frame_encoded_bytes", "has_trailer")  # one row each


_PRETTY = {"pretty": "true", "ignoreNullFields": "false"}


def _texts(rows: DataFrame, key: str, drop: tuple[str, ...], depth: int, folder: str) -> list[str]:
    """The files, in order, of a list's elements put into text: a file a run of RUN values of the key, elements `depth`
    levels inside, with a comma after each."""
    spark = rows.sparkSession
    bound_batches(spark)
    os.makedirs(folder, exist_ok=True)
    element = F.regexp_replace(F.to_json(F.struct(*[c for c in rows.columns if c not in drop]), _PRETTY), "\n", "\n" + "  " * depth)
    schema = pa.schema([("run", pa.int64()), ("name", pa.string())])
    most = rows.agg(F.max(key)).first()[0]
    tasks = min(8192, (most or 0) // RUN + 1)
    dealt = rows.select(F.col(key).alias("k"), element.alias("t")).repartition(tasks, F.expr(f"k div {RUN}")).sortWithinPartitions("k")

    def work(batches):
        run, out, name, done = None, None, "", []
        try:
            for batch in batches:
                for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if k // RUN != run:
                        if out:
                            out.close()
                        run, name = k // RUN, uuid.uuid4().hex  # a task that runs again writes other files
                        out = open(os.path.join(folder, name), "w")  # noqa: SIM115
                        done.append((run, name))
                    out.write(t + ", ")
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], schema=schema)

    found = dealt.mapInArrow(work, "run long, name string").orderBy("run").collect()  # a row a run
    return [os.path.join(folder, r["name"]) for r in found]


def write_dump(spark: SparkSession, archive: str, path: str, verify: bool = True) -> None:
    """The file that write_json(dump()) writes; tasks put the lists' elements into text, the driver strings their files
    together, a small buffer at a time."""
    if verify:
        _verify(spark, archive)
    mark = uuid.uuid4().hex
    folder = f"{shared_folder(spark).removeprefix('file://')}/texts-{mark}"
    lists = _lists(spark, archive, kept=True)
    marks = {name: spark.range(1).select(F.lit(f"{mark}-{name}").alias("rows")) for name in lists}
    text = _told(spark, archive, marks).select(F.to_json(F.struct("*"), _PRETTY)).first()[0]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    try:
        with open(f"{path}.partial", "wb") as out:
            for name, (df, key, drop) in lists.items():  # in the text's order
                before, text = text.split(f'"{mark}-{name}"', 1)
                files = _texts(df, key, drop, 1 if name == "frames" else 2, f"{folder}/{name}")
                out.write(f"{before}[ ".encode())
                for file in files:
                    with open(file, "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 20)
                if files:
                    out.seek(-2, os.SEEK_CUR)  # the last comma
                    out.write(b" ")
                out.write(b"]")
            out.write(text.encode())
            out.truncate()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    os.replace(f"{path}.partial", path)


def dumped_extents(spark: SparkSession, path: str) -> DataFrame:
    """The extents that a dump's file tells. Elements of the lists end with a brace, a comma and a brace before a line end,
    which no string of a JSON text can hold, so tasks read stretches of the file an element at a time."""
    parts = spark.read.option("lineSep", "}, {\n").text(f"file://{path}")
    body = F.substring_index(F.substring_index("value", '\n    "extents" : [ {\n', -1), "\n    } ]", 1)
    named = parts.select(F.concat(F.lit("\n"), body).alias("body")).where(F.contains("body", F.lit('\n      "entry_path" : ')))
    fields = "entry_id long, entry_path string, bundle_id long, file_offset long, raw_offset_in_bundle long, raw_len long, flags_bits long, flags array<string>"
    return named.select(F.from_json(F.concat(F.lit("{"), "body", F.lit("}")), fields, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def write_json(df: DataFrame, path: str) -> None:
    """One row as an indented JSON file, nulls written out."""
    text = df.select(F.to_json(F.struct("*"), _PRETTY)).first()[0]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
