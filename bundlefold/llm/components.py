"""Connected components of an edge table by Spark joins, in alternating star steps.

A large-star step hands each node's greater neighbours to the least of its neighbourhood, a small-star step its smaller
ones; both keep the components, and the two alternating reach one star for each component in O(log(n) ** 2) rounds
whatever the ids are (Kiveris et al., Connected Components in MapReduce and Beyond, 2014). No number of rounds is set:
edges only move to smaller nodes, so the steps come to rest. Each round's edges are a table in the shared folder, so no
round computes earlier ones again. A node with very many edges is one key of a minimum, which is combined before the
shuffle, and of a join with one row for it on the other side, which Spark splits where it is skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _moved(pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (hi, lo), hi > lo."""
    both = pairs.unionAll(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("a", "b")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi")
    return small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of its component), from edges (a, b) of two longs. Only nodes with an edge
    to another are listed; null ends and repeated edges add nothing."""
    spark = edges.sparkSession
    digest = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    path = common.new_folder(spark, "edges")
    edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct().write.parquet(path)
    pairs = spark.read.schema("hi long, lo long").parquet(path)
    now = digest(pairs)
    while True:
        old, path = path, common.new_folder(spark, "edges")
        _moved(pairs).write.parquet(path)
        pairs = spark.read.schema("hi long, lo long").parquet(path)
        common.drop_folder(spark, old)
        was, now = now, digest(pairs)
        if was == now:
            break
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(pairs.select("lo", "lo").distinct())
