"""What restoring leaves behind: no open files in a worker, and no temporary names, whatever becomes of a task."""

import os
import resource

import pyarrow as pa
import pytest
from bundlefold.config import PackConfig
from bundlefold.operators import restore
from bundlefold.plans.pack import pack
from bundlefold.plans.unpack import unpack

FILES = "entry_id long, components array<binary>, size long, mode long, uid long, gid long, mtime_sec long, mtime_nsec int"
PIECES = "entry_id long, file_offset long, piece binary"


def most_open(spark):
    """The most files that any worker has open."""

    def work(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(os.listdir("/proc/self/fd"))]})

    return spark.range(0, 64, 1, 64).mapInArrow(work, "n long").agg({"n": "max"}).first()[0]


def rows(n):
    return [(k, [b"f%d" % k], 1, 0o644, 0, 0, 1, 0) for k in range(1, n + 1)], [(k, 0, b"x") for k in range(1, n + 1)]


def test_no_open_files(spark, tmp_path):
    files, pieces = rows(900)
    before = most_open(spark)
    done = restore.write_files(spark.createDataFrame(pieces, PIECES), spark.createDataFrame(files, FILES), str(tmp_path), False)
    assert done["files"] == 900 and len(os.listdir(tmp_path)) == 900
    assert most_open(spark) < before + 100 < resource.getrlimit(resource.RLIMIT_NOFILE)[0]


def test_failed_task(spark, tmp_path):
    files, pieces = rows(3)
    with pytest.raises(Exception, match="1 bytes instead of 2"):
        restore.write_files(spark.createDataFrame(pieces, PIECES), spark.createDataFrame([(*f[:2], 2, *f[3:]) for f in files], FILES), str(tmp_path), False)
    assert os.listdir(tmp_path) == []


def test_lost_task(spark, tmp_path, monkeypatch):
    """A task that was killed has left a file of the run in two folders; a file of the user's with such a name stays."""
    source, to = tmp_path / "tree", tmp_path / "to"
    (source / "a").mkdir(parents=True)
    for name in ("x", "a/y", "a/.mine.part"):
        (source / name).write_bytes(b"text")
    os.utime(source / "a", ns=(0, 10**18))
    pack(spark, str(source), str(tmp_path / "archive"), PackConfig())
    plain = restore.write_files

    def lost(pieces, files, root, owner, *run):
        done = plain(pieces, files, root, owner, *run)
        for folder in (to, to / "a"):
            (folder / os.fsdecode(restore._temporary(*run))).write_bytes(b"te")
        return done

    monkeypatch.setattr(restore, "write_files", lost)
    unpack(spark, str(tmp_path / "archive"), str(to))
    assert sorted(os.listdir(to)) == ["a", "x"] and sorted(os.listdir(to / "a")) == [".mine.part", "y"]
    assert os.stat(to / "a").st_mtime_ns == 10**18
