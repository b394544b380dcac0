"""Virtual file trees over tables: the same rows as a scan of a folder, without a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTORY, REGULAR = 0o40755, 0o100644


def tree_of(files: DataFrame, components: Column, size: Column, inode: Column, seconds: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """A tree of one regular file a row, at components (array of strings), and the folders above. Rows of one inode are
    hard links of one file. `extra` columns of files are kept, null for folders."""
    z = lambda kind: F.lit(0).cast(kind)
    leaves = files.select(components.alias("__c"), size.cast("long").alias("size"), inode.alias("ino"), seconds.cast("long").alias("mtime_sec"), *extra)
    regular = leaves.select("__c", F.lit("regular").alias("kind"), F.lit(REGULAR).cast("long").alias("mode"), "size", "ino", "mtime_sec", *extra)
    above = leaves.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("__c") - 1), lambda n: F.slice("__c", 1, n))).alias("__c")).distinct()
    kinds = dict(leaves.dtypes)
    folders = above.select(
        "__c", F.when(F.size("__c") == 0, "root").otherwise("directory").alias("kind"), F.lit(DIRECTORY).cast("long").alias("mode"), z("long").alias("size"),
        F.lit(None).cast(kinds["ino"]).alias("ino"), z("long").alias("mtime_sec"), *[F.lit(None).cast(kinds[c]).alias(c) for c in extra],
    )
    every = regular.unionByName(folders)
    name = F.try_element_at("__c", F.lit(-1))
    return every.select(
        F.transform("__c", lambda x: x.cast("binary")).alias("components"), F.array_join("__c", "/").cast("binary").alias("relative_path"), F.coalesce(name, F.lit("")).cast("binary").alias("name"),
        "kind", "mode", z("long").alias("uid"), z("long").alias("gid"), "mtime_sec", z("int").alias("mtime_nsec"), "size", F.lit(1).cast("long").alias("dev"), "ino",
        F.lit(None).cast("binary").alias("symlink_target"), *extra,
    )


def document_tree(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """root / source / lang / doc_<id>: documents with the same text are hard links of one file."""
    parts = F.array(F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    text = F.coalesce("text", F.lit(""))
    return tree_of(documents, parts, F.octet_length(text), F.md5(text.cast("binary")), F.lit(1_700_000_000) + F.col("doc_id"), ("doc_id", "text") if with_text else ("doc_id",))


def place_tree(region: DataFrame, nation: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """region / nation / customer or supplier, whose size is that of its name."""
    who = customer.select(F.col("c_nationkey").alias("n"), F.col("c_name").alias("who")).unionAll(supplier.select(F.col("s_nationkey").alias("n"), F.col("s_name").alias("who")))
    rows = who.join(F.broadcast(nation), F.col("n") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return tree_of(rows, F.array("r_name", "n_name", "who"), F.octet_length("who"), F.col("who"), F.lit(0))


def order_tree(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """year / order_<key>: an order's size is 100 bytes a line item, so that some are empty and some large."""
    n = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("items"))
    rows = orders.select("o_orderkey", "o_orderdate").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return tree_of(rows, F.array(F.year("o_orderdate").cast("string"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))), F.coalesce("items", F.lit(0)) * 100, F.col("o_orderkey").cast("string"), F.lit(0))
