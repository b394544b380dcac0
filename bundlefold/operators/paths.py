"""Paths from parent pointers, and the folders of a tree level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lossy_utf8
from ..tables import keep


def entry_paths(entries: DataFrame) -> DataFrame:
    """entry_id, components (array<binary>), path (segments joined, "." for the root) and depth, from entry_id, parent_id
    and name. Every round doubles the stretch of ancestors that a parent knows, so a tree of depth d takes log2(d) joins of
    what has children; the rest, most of a tree, is joined with its parents once. A parent that isn't there, or a circle,
    stops the query."""
    lost = lambda above: F.raise_error(F.concat(F.lit("missing parent "), above.cast("string")))
    own = F.when(F.col("parent_id").isNull(), F.array().cast("array<binary>")).otherwise(F.array("name"))
    rows = entries.select("entry_id", F.col("parent_id").alias("above"), own.alias("components"))
    parents = keep(rows.where("above is not null").select(F.col("above").alias("entry_id")).distinct(), "parents")
    at, rounds = rows.join(parents, "entry_id", "left_semi"), 0
    while True:
        at = keep(at, "paths")
        if rounds > 40 or at.where("above is not null").isEmpty():
            break
        up = at.select(F.col("entry_id").alias("above"), F.col("above").alias("__above"), F.col("components").alias("__before"), F.lit(True).alias("__there"))
        joined = at.join(up, "above", "left")
        at = joined.select(
            "entry_id",
            F.when(F.col("above").isNotNull() & F.col("__there").isNull(), lost(F.col("above")).cast("long")).otherwise(F.col("__above")).alias("above"),
            F.when(F.col("above").isNull(), F.col("components")).otherwise(F.concat("__before", "components")).alias("components"),
        )
        rounds += 1
    if rounds > 40:
        raise ValueError("parents go round in a circle")
    over = at.select(F.col("entry_id").alias("above"), F.col("components").alias("__before"))
    whole = F.when(F.col("above").isNull(), F.col("components")).when(F.col("__before").isNull(), lost(F.col("above")).cast("array<binary>")).otherwise(F.concat("__before", "components"))
    rest = rows.join(parents, "entry_id", "left_anti").join(over, "above", "left").select("entry_id", whole.alias("components"))
    text = F.array_join(F.transform("components", lambda x: lossy_utf8(x)), "/")
    every = at.select("entry_id", "components").unionAll(rest)
    return every.select("entry_id", "components", F.when(F.size("components") == 0, ".").otherwise(text).alias("path"), F.size("components").alias("depth"))


def entry_paths_sql(entries: DataFrame) -> DataFrame:
    """entry_id, path and depth by a recursive SQL query: a join a level, for trees of up to 99 levels."""
    return entries.sparkSession.sql(
        """
        WITH RECURSIVE p (entry_id, path, depth) AS (
          SELECT entry_id, '', 0 FROM {e} WHERE parent_id IS NULL
          UNION ALL
          SELECT e.entry_id, concat(p.path, CASE WHEN p.path = '' THEN '' ELSE '/' END, make_valid_utf8(cast(e.name AS STRING))), p.depth + 1
          FROM {e} e JOIN p ON e.parent_id = p.entry_id)
        SELECT entry_id, CASE WHEN depth = 0 THEN '.' ELSE path END AS path, depth FROM p
        """,
        e=entries,
    )


def frontiers(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """The folders of each depth: depth and how many there are, the root's depth 0 included, parents before children."""
    folders = entries.where("kind in ('root', 'directory')").select("entry_id")
    return paths.join(folders, "entry_id").groupBy("depth").agg(F.count("*").alias("directories")).orderBy("depth")


def ancestors(paths: DataFrame, column: str = "path") -> DataFrame:
    """All folders above some paths, once each, the empty path of the root included."""
    parts = F.split(column, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return paths.select(F.explode(above).alias("directory")).distinct()
