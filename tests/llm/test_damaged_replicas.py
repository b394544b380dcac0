"""Operator 9 on replicas that are damaged, cut off, longer, or hold files too many."""

import os

from bundlefold.llm import fixity
from pyspark.sql import functions as F
from tests.llm.test_models import pages


def test_damaged_members_are_not_intact(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    index = fixity.write_warc(pages(spark, 120), one, 2, file_bytes=30_000)
    fixity.copy_replica(index, one, two, "page_id % 5 = 1")
    got = fixity.read_warc(index, two)
    assert got.count() == index.count()
    keys = {(r.file, r.ordinal): r.page_id for r in index.collect()}
    assert {keys[r.file, r.ordinal] for r in got.where("not intact").collect()} == {k for k in range(120) if k % 5 == 1}
    names = sorted(os.listdir(one))
    fixity.copy_replica(index, one, two)
    with open(f"{two}/{names[0]}", "r+b") as f:  # cut off inside its last record
        f.truncate(os.path.getsize(f"{one}/{names[0]}") - 5)
    with open(f"{two}/{names[1]}", "ab") as f:
        f.write(b"more")
    with open(f"{two}/other.warc.gz", "wb") as f:
        f.write(b"stray")
    os.remove(f"{two}/{names[2]}")
    last = {r.file: r.n for r in index.groupBy("file").agg(F.max("ordinal").alias("n")).collect()}
    bad = {(r.file, r.ordinal) for r in fixity.read_warc(index, two).where("not intact").collect()}
    gone = {k for k in keys if k[0] == names[2]}
    assert bad == gone | {(names[0], last[names[0]])}
    told = [r for r in fixity.audit(index, one, two).collect()]
    assert len(told) == len(keys) + 2
    hurt = {(r.file, r.ordinal, r.length if r.page_id is None and (r.file, r.ordinal) not in keys else None) for r in told if r.damaged}
    assert hurt == {(*k, None) for k in gone} | {(names[0], last[names[0]], None), (names[1], last[names[1]] + 1, 4), ("other.warc.gz", None, 5)}


def test_order_of_pages_that_share_a_url(spark, tmp_path):
    rows = [(1, "u", f"{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = [[r.length for r in fixity.write_warc(df.repartition(n), str(tmp_path / str(n)), 2).orderBy("file", "ordinal").collect()] for n in (1, 7)]
    read = [[bytes(r.payload) for r in fixity.read_warc(fixity.write_warc(df.repartition(n), str(tmp_path / f"r{n}"), 2), str(tmp_path / f"r{n}")).orderBy("file", "ordinal").collect()] for n in (1, 7)]
    assert kept[0] == kept[1] and read[0] == read[1] == sorted(str(k).encode() for k in range(40))
