"""File trees as tables: spark.read.format("tree").load(folder).

Rows are the folder and all that lies below it, links not followed, with what lstat says; names are bytes. Device
files, pipes and sockets are rejected, or listed with option special=keep. The listing is split over tasks: the folders
of the first levels are listed by the driver until there are `splits` of them, whose trees tasks list. Rows come
without ids; operators.numbering gives them.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import FileSystemError

FILES = (
    "components array<binary>, relative_path binary, name binary, kind string, mode long, uid long, gid long, mtime_sec long, mtime_nsec int, "
    "size long, dev long, ino long, symlink_target binary"
)
_ARROW = pa.schema([
    ("components", pa.list_(pa.binary())), ("relative_path", pa.binary()), ("name", pa.binary()), ("kind", pa.string()), ("mode", pa.int64()), ("uid", pa.int64()), ("gid", pa.int64()),
    ("mtime_sec", pa.int64()), ("mtime_nsec", pa.int32()), ("size", pa.int64()), ("dev", pa.int64()), ("ino", pa.int64()), ("symlink_target", pa.binary()),
])
_KINDS = ((stat.S_ISDIR, "directory"), (stat.S_ISREG, "regular"), (stat.S_ISLNK, "symlink"), (stat.S_ISCHR, "char_device"), (stat.S_ISBLK, "block_device"), (stat.S_ISFIFO, "fifo"))


def _row(root: bytes, parts: tuple[bytes, ...], special: str) -> tuple:
    path = os.path.join(root, *parts)
    s = os.lstat(path)
    kind = next((k for test, k in _KINDS if test(s.st_mode)), "socket")
    if special != "keep" and kind not in ("directory", "regular", "symlink"):
        raise FileSystemError(f"unsupported entry kind {kind}: {os.fsdecode(path)}")
    return (
        list(parts), b"/".join(parts), parts[-1] if parts else b"", "root" if not parts else kind, s.st_mode, s.st_uid, s.st_gid,
        s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, 0 if kind == "directory" else s.st_size, s.st_dev, s.st_ino, os.readlink(path) if kind == "symlink" else None,
    )


def _children(root: bytes, parts: tuple[bytes, ...]) -> list[tuple[tuple[bytes, ...], bool]]:
    with os.scandir(os.path.join(root, *parts)) as found:
        return [((*parts, e.name), e.is_dir(follow_symlinks=False)) for e in found]


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[bytes, ...]], folders: list[tuple[bytes, ...]]):
        self.rows, self.folders = rows, folders


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options.get("path")
        if not path or not os.path.isdir(path) or os.path.islink(path.rstrip("/")):
            raise FileSystemError(f"not a folder: {path}")
        self.root, self.special, self.splits = os.fsencode(os.path.abspath(path)), options.get("special", "reject"), int(options.get("splits", 32))

    def partitions(self) -> list[_Part]:
        rows: list[tuple[bytes, ...]] = [()]
        folders: list[tuple[bytes, ...]] = [()]
        while folders and len(folders) < self.splits:  # one level after the other
            found = [c for f in folders for c in _children(self.root, f)]
            rows += [parts for parts, _ in found]
            folders = [parts for parts, folder in found if folder]
        parts = [_Part([], folders[k :: self.splits]) for k in range(min(self.splits, len(folders)))]
        return [*(_Part(rows[k::4], []) for k in range(min(4, len(rows)))), *parts]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        def found():
            yield from partition.rows
            todo = list(partition.folders)
            while todo:
                for parts, folder in _children(self.root, todo.pop()):
                    yield parts
                    if folder:
                        todo.append(parts)

        held = []
        for parts in found():
            held.append(_row(self.root, parts, self.special))
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, path: str, special: str = "reject") -> DataFrame:
    """The files of a tree, without ids."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("special", special).load(path)
