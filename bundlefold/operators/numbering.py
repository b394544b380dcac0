"""Entry ids in pre-order, parents and hard links of a scanned tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import in_order


def with_entry_ids(files: DataFrame) -> DataFrame:
    """entry_id and parent_id for the files of a tree. Ids follow the pre-order of a walk that takes siblings in the byte
    order of their names, which is the order of the paths' component arrays (not that of the joined paths). The root,
    without components, is 0; parent_id of the root is null. A missing parent stops the query."""
    ordered = in_order(files, ["components"], number="entry_id")
    parents = ordered.where(F.col("kind").isin("root", "directory")).select(F.col("components").alias("__of"), F.col("entry_id").alias("parent_id"))
    above = F.when(F.size("components") > 0, F.slice("components", 1, F.size("components") - 1))
    out = ordered.withColumn("__of", above).join(parents, "__of", "left").drop("__of")
    lost = (F.size("components") > 0) & F.col("parent_id").isNull()
    return out.withColumn("parent_id", F.when(lost, F.raise_error(F.concat(F.lit("missing parent of "), F.make_valid_utf8(F.col("relative_path").cast("string")))).cast("long")).otherwise(F.col("parent_id")))


def with_hardlinks(entries: DataFrame) -> DataFrame:
    """hardlink_master_entry_id: for a regular file, the first entry with its (dev, ino), if that is another; such files
    become kind hardlink and keep no data. Groups of any size are joined by their least id, never gathered."""
    first = entries.where("kind = 'regular'").groupBy("dev", "ino").agg(F.min("entry_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    out = entries.join(first, ["dev", "ino"], "left")
    follows = (F.col("kind") == "regular") & (F.col("__first") < F.col("entry_id"))
    return out.select(
        *[c for c in entries.columns if c != "kind"],
        F.when(follows, F.lit("hardlink")).otherwise(F.col("kind")).alias("kind"),
        F.when(follows, F.col("__first")).alias("hardlink_master_entry_id"),
    )
