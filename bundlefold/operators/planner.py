"""The bundle planner: next-fit over files in entry order, exact, and spread over tasks.

A small file (below the threshold) goes into the open aggregate bundle, unless that isn't empty and would grow beyond
the target; then the bundle is closed first. A large file closes the open bundle and fills single-file bundles of
`target` bytes, the last one shorter. Files without bytes and hard links take no part.

Next-fit is one long chain of decisions, but all that a stretch of files has to know of those before it is how full the
open bundle is. For each stretch (a partition of the order) a task works out that function: at which file the first
bundle closes, given the fill; and for each such file, how many bundles are closed from there to the end of the stretch,
and how full the last one then is. The driver runs through these summaries once, one at a time, which gives each
stretch its first fill and bundle id; then all stretches are planned at once. A stretch without large files, however
long the order, is nothing special.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..tables import in_order, keep

_SUMMARY = pa.schema([("part", pa.int64()), ("files", pa.int64()), ("total", pa.int64()), ("reach", pa.list_(pa.int64())), ("fill", pa.list_(pa.int64())), ("closed", pa.list_(pa.int64())), ("large", pa.bool_())])
_EXTENTS = pa.schema([("entry_id", pa.int64()), ("bundle_id", pa.int64()), ("file_offset", pa.int64()), ("raw_offset_in_bundle", pa.int64()), ("raw_len", pa.int64()), ("flags_bits", pa.int64())])


def carries_data() -> Column:
    """Regular files that aren't hard links and have bytes."""
    return (F.col("kind") == "regular") & F.col("hardlink_master_entry_id").isNull() & (F.col("size") > 0)


def fresh_from(sizes: np.ndarray, target: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: how full the open bundle is at the end, and how many are closed on the way, if the files from that
    place on meet no open bundle. The place after the last has (0, 0)."""
    n = len(sizes)
    fill, closed = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    large = sizes >= threshold
    chunks = np.where(large, -(-sizes // target), 0)
    sums = np.concatenate([[0], np.cumsum(np.where(large, 0, sizes))])
    next_large = np.full(n + 1, n)
    at = np.flatnonzero(large)
    if len(at):
        k = np.searchsorted(at, np.arange(n + 1))
        next_large = np.where(k < len(at), at[np.minimum(k, len(at) - 1)], n)
    # the file at which a bundle begun here is closed: the first that doesn't fit, or a large one
    stop = np.minimum(np.maximum(np.searchsorted(sums, sums[:-1] + target, "right") - 1, np.arange(n) + 1), next_large[:-1]).tolist()
    big, chunk, total = large.tolist(), chunks.tolist(), sums.tolist()
    fills, counts = fill.tolist(), closed.tolist()
    for i in range(n - 1, -1, -1):
        if big[i]:
            fills[i], counts[i] = fills[i + 1], counts[i + 1] + chunk[i]
        elif stop[i] == n:
            fills[i], counts[i] = total[n] - total[i], 0
        else:
            fills[i], counts[i] = fills[stop[i]], counts[stop[i]] + 1
    return np.array(fills), np.array(counts)


def summary(sizes: np.ndarray, target: int, threshold: int) -> dict:
    """A stretch as a function of the fill it begins with: `reach` are running sums of the files up to the first that
    closes any open bundle; a bundle that is f full is closed at the first file with f + reach > target, and from there
    on `fill` and `closed` hold."""
    fill, closed = fresh_from(sizes, target, threshold)
    large = np.flatnonzero(sizes >= threshold)
    head = int(large[0]) if len(large) else len(sizes)
    reach = np.cumsum(sizes[:head])
    head = min(head, int(np.searchsorted(reach, target, "right")) + 1)
    return {"files": len(sizes), "total": int(sizes.sum()), "reach": reach[:head], "fill": fill[: head + 1], "closed": closed[: head + 1], "large": bool(len(large))}


def follow(s: dict, fill: int, target: int) -> tuple[int, int]:
    """The fill after a stretch that begins with `fill`, and how many bundles it closes."""
    if not s["files"]:
        return fill, 0
    if not fill:
        return int(s["fill"][0]), int(s["closed"][0])
    reach = np.asarray(s["reach"])
    at = int(np.searchsorted(reach, target - fill, "right"))
    if at == len(reach) == s["files"] and not s["large"]:
        return fill + int(s["total"]), 0
    return int(s["fill"][at]), int(s["closed"][at]) + 1


def plan_stretch(ids: np.ndarray, sizes: np.ndarray, fill: int, bundle: int, target: int, threshold: int):
    """The extents of a stretch that begins with an open bundle `fill` full. Columns of _EXTENTS."""
    out: list[tuple[int, int, int, int, int, int]] = []
    for i, size in zip(ids.tolist(), sizes.tolist(), strict=True):
        if size < threshold:
            if fill and fill + size > target:
                bundle, fill = bundle + 1, 0
            out.append((i, bundle, 0, fill, size, 0b011))
            fill += size
        else:
            if fill:
                bundle, fill = bundle + 1, 0
            for at in range(0, size, target):
                n = min(target, size - at)
                out.append((i, bundle, at, 0, n, 0b101 if at + n == size else 0b100))
                bundle += 1
    return list(zip(*out, strict=True)) if out else [()] * len(_EXTENTS)


def extents_of(entries: DataFrame, target: int, threshold: int, partitions: int | None = None) -> DataFrame:
    """extent_id, entry_id, bundle_id, file_offset, raw_offset_in_bundle, raw_len and flags_bits of all extents."""
    if target <= 0 or threshold < 0:
        raise ConfigError("the bundle target has to be above 0, the threshold 0 or more")
    spark = entries.sparkSession
    files = in_order(entries.where(carries_data()).select("entry_id", "size"), ["entry_id"], partitions=partitions, cheap=True)
    stretch = files.select("__part", "__at", "entry_id", "size")

    def summarise(key, table):
        sizes = table.column("size").to_numpy()[np.argsort(table.column("__at").to_numpy())]
        s = summary(sizes, target, threshold)
        return pa.table([[key[0].as_py()], *([s[f.name]] for f in list(_SUMMARY)[1:])], schema=_SUMMARY)

    found = keep(stretch.groupBy("__part").applyInArrow(summarise, "part long, files long, total long, reach array<long>, fill array<long>, closed array<long>, large boolean"), "summaries")
    fill, bundle, begin = 0, 0, []
    for r in found.orderBy("part").toLocalIterator():  # one stretch's summary at a time
        begin.append((r["part"], fill, bundle))
        fill, closed = follow(r.asDict(), fill, target)
        bundle += closed
    starts = spark.createDataFrame(begin, "__part long, fill long, bundle long")  # a row a stretch

    def plan(key, table):
        order = np.argsort(table.column("__at").to_numpy())
        ids, sizes = table.column("entry_id").to_numpy()[order], table.column("size").to_numpy()[order]
        columns = plan_stretch(ids, sizes, table.column("fill")[0].as_py(), table.column("bundle")[0].as_py(), target, threshold)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _EXTENTS, strict=True)], schema=_EXTENTS)

    planned = stretch.join(F.broadcast(starts), "__part").groupBy("__part").applyInArrow(plan, "entry_id long, bundle_id long, file_offset long, raw_offset_in_bundle long, raw_len long, flags_bits long")
    return in_order(planned, ["entry_id", "file_offset"], number="extent_id", partitions=partitions).drop("__part", "__at")


def bundles_of(extents: DataFrame) -> DataFrame:
    """bundle_id, kind, raw_len, file_count, extent_count and flags of the bundles of some extents."""
    single = F.bit_or(F.col("flags_bits").bitwiseAND(4)) != 0
    return extents.groupBy("bundle_id").agg(
        F.when(single, "single_file").otherwise("aggregate").alias("kind"), F.sum("raw_len").alias("raw_len"), F.count("*").alias("file_count"), F.count("*").alias("extent_count"), F.lit(0).alias("flags")
    )


def planned_entries(entries: DataFrame, extents: DataFrame, partitions: int | None = None) -> DataFrame:
    """The manifest's entry rows: heap offsets of names and link targets, the first extent (for entries without data, how
    many extents there are before), the number of extents, and flags."""
    per_entry = extents.groupBy("entry_id").agg(F.count("*").alias("extent_count"))
    name, link = F.octet_length("name"), F.coalesce(F.octet_length("symlink_target"), F.lit(0))
    wide = entries.join(per_entry, "entry_id", "left").withColumn("extent_count", F.coalesce("extent_count", F.lit(0)).cast("long"))
    out = in_order(wide, ["entry_id"], sums={"name_off": name + link, "first_extent": F.col("extent_count")}, partitions=partitions)
    empty = (F.col("kind") == "regular") & (F.col("size") == 0)
    return out.select(
        "entry_id", "parent_id", "kind", F.when(empty, 1).otherwise(0).alias("flags_bits"), "mode", "uid", "gid", "mtime_sec", "mtime_nsec", "size",
        "name", F.col("symlink_target").alias("link_target"), F.col("name_off").cast("long").alias("name_off"), name.cast("long").alias("name_len"),
        F.when(link > 0, F.col("name_off") + name).otherwise(0).cast("long").alias("link_off"), link.cast("long").alias("link_len"),
        F.col("first_extent").cast("long").alias("first_extent"), "extent_count", "hardlink_master_entry_id", F.lit(0).cast("long").alias("meta_off"), F.lit(0).cast("long").alias("meta_len"),
    )


def feature_bits(entries: DataFrame, trailer: bool, preserve_owner: bool) -> Column:
    """The container's feature flags, as an aggregate over its entries."""
    bit = lambda kinds, b: F.when(F.bool_or(F.col("kind").isin(*kinds)), b).otherwise(0)
    found = bit(["symlink"], 1) + bit(["hardlink"], 2) + bit(["char_device", "block_device", "fifo"], 4) + F.when(F.sum("meta_len") > 0, 8).otherwise(0)
    return (F.coalesce(found, F.lit(0)) + F.lit(16 * trailer + 32 * preserve_owner)).cast("long")


def extent_sequence(extents: DataFrame) -> DataFrame:
    """For each bundle the number of its extents, of different entries, and of changes from one entry to the next."""
    before = F.lag("entry_id").over(Window.partitionBy("bundle_id").orderBy("raw_offset_in_bundle", "extent_id"))
    steps = extents.withColumn("__new", (before.isNotNull() & (before != F.col("entry_id"))).cast("long"))
    return steps.groupBy("bundle_id").agg(F.count("*").alias("extent_count"), F.countDistinct("entry_id").alias("unique_entries"), F.sum("__new").alias("entry_switches"))
