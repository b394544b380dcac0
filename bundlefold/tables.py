"""Tables in the shared folder, and numbers and running sums over an order that no single task holds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to a Python worker, the same for all of the package, so that it doesn't matter
#: which part of it was called last.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Rows of a partition whose numbers are given in one task.
ROWS = 500_000
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode (tests), where driver and executors are one
    process, a temporary one stands in where that is unset; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="bundlefold-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def bound_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes that a Python worker is given at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which ends its lineage there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: Sequence[str | Column], number: str | None = None, sums: dict[str, Column] | None = None, partitions: int | None = None, cheap: bool = False) -> DataFrame:
    """df with, over the order of some columns (which has to be total), `number` (rows before) and for each of `sums` the
    sum over the rows before. Rows are dealt out by ranges of the order and numbered in their partition; the totals of
    the partitions, one row each, make up the offsets. __part and __at keep the order: partition and place in it. cheap: df is
    little more than a table in the shared folder, which is read again rather than written once more."""
    spark = df.sparkSession
    sums = sums or {}
    at = F.monotonically_increasing_id()  # partition << 33 | place in the partition
    if not partitions and not cheap:
        df = keep(df, "unordered")  # else what leads to df is computed for the count, for the ranges and for the rows
    n = partitions or max(1, -(-df.count() // ROWS))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order) if n > 1 else df.coalesce(1).sortWithinPartitions(*order)
    steps = {f"__step_{k}": c for k, c in sums.items()}
    kept = keep(ordered.withColumns({"__mono": at, **steps}), "ordered").withColumns({"__part": F.shiftright("__mono", 33), "__at": F.col("__mono").bitwiseAND((1 << 33) - 1)})
    totals = kept.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(s).alias(s) for s in steps]).orderBy("__part").collect()  # a row a partition
    before, rows = {c: 0 for c in ["__n", *steps]}, []
    for r in totals:
        rows.append((r["__part"], *before.values()))
        before = {c: before[c] + (r[c] or 0) for c in before}
    offsets = spark.createDataFrame(rows or [(0,) + (0,) * len(before)], "__part long, " + ", ".join(f"__first{c} long" for c in before))
    out = kept.join(F.broadcast(offsets), "__part")
    if sums:
        earlier = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({k: F.col(f"__first__step_{k}") + F.coalesce(F.sum(f"__step_{k}").over(earlier), F.lit(0)) for k in sums})
    if number:
        out = out.withColumn(number, F.col("__first__n") + F.col("__at"))
    return out.drop("__mono", *steps, *[f"__first{c}" for c in before])
