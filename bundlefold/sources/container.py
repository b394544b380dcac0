"""Containers as tables: spark.read.format("container").option("table", ...).load(file or folder).

The tables are header, entries, extents, bundles, frames and trailer; each row says which archive it comes from. Tables
other than frames read no payload. Frames are read in ranges: the driver walks their headers, whose lengths lead from
one to the next, and tasks read the payloads. With option pushdown=true (and spark.sql.python.filterPushdown.enabled)
conditions on bundle_id leave frames out before they are read. The same source serves as a stream of frames.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..errors import EngineError, FileSystemError, FormatError, UsageError
from ..schemas import BUNDLE_KIND, BUNDLES, ENTRIES, ENTRY_KIND, EXTENTS, FRAMES, HEADER, TRAILER
from ..tables import shared_folder
from . import layout

TABLES = {"header": HEADER, "entries": ENTRIES, "extents": EXTENTS, "bundles": BUNDLES, "frames": FRAMES, "trailer": TRAILER}
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
#: Encoded bytes of the frames that one task reads.
RANGE_BYTES = 32 << 20


def _arrow(table: str) -> pa.Schema:
    return pa.schema([("archive", pa.string()), *((n, _TYPES[t]) for n, t in (x.split() for x in TABLES[table].split(", ")))])


class Archive:
    """An open container: its header and manifest, and where its frames begin."""

    def __init__(self, path: str):
        self.path = path
        try:
            self.file = open(path, "rb")  # noqa: SIM115
        except OSError as e:
            raise FileSystemError(f"{path}: {e.strerror}") from e
        self.header = layout.read_header(self.file.read(layout.HEADER_LEN))
        self.frames_at = layout.HEADER_LEN + self.header["manifest_encoded_len"]

    def manifest(self) -> layout.Manifest:
        self.file.seek(layout.HEADER_LEN)
        raw = layout.decode_manifest(self.header, self.file.read(self.header["manifest_encoded_len"]))
        m = layout.Manifest(raw)
        if (len(m.entries), len(m.extents), len(m.bundles)) != (self.header["entry_count"], self.header["extent_count"], self.header["bundle_count"]):
            raise FormatError("the manifest's counts aren't the header's")
        return m

    def frame_headers(self, known: list | tuple = ()) -> Iterator[tuple[int, tuple[int, int, int, int, int]]]:
        """Offset of the payload and header of each frame after those known, which have to ascend by bundle."""
        at, last = (known[-1][0] + known[-1][1][2], known[-1][1][0]) if known else (self.frames_at, -1)
        for _ in range(len(known), self.header["bundle_count"]):
            self.file.seek(at)
            h = layout.read_frame_header(self.file.read(layout.FRAME_LEN))
            if h[0] <= last:
                raise FormatError(f"frame {h[0]} follows frame {last}")
            last = h[0]
            yield at + layout.FRAME_LEN, h
            at += layout.FRAME_LEN + h[2]
        self.end = at

    def trailer(self) -> tuple[int, int, int, bytes] | None:
        if not self.header["feature_flags"] & 16:
            return None
        for _ in self.frame_headers():
            pass
        self.file.seek(self.end)
        return layout.read_trailer(self.file.read(layout.TRAILER_LEN))


def _columns(archive: Archive, table: str) -> list:
    h, name = archive.header, archive.path
    if table == "header":
        fields = [f.name for f in _arrow("header")][1:]
        row = h | {"feature_flags_bits": h["feature_flags"], "manifest_hash_hex": h["manifest_hash"].hex()}
        return [[name], *([row[f]] for f in fields)]
    if table == "trailer":
        t = archive.trailer()
        return [[]] * 5 if t is None else [[name], [t[0]], [t[1]], [t[2]], [t[3].hex()]]
    m = archive.manifest()
    if table == "bundles":
        b = m.bundles
        return [[name] * len(b), b["bundle_id"].astype(np.int64), [BUNDLE_KIND[k] for k in b["kind"].tolist()], *(b[c].astype(np.int64) for c in ("raw_len", "file_count", "extent_count")), b["flags"].astype(np.int32)]
    if table == "extents":
        x = m.extents
        return [[name] * len(x), np.arange(len(x)), *(x[c].astype(np.int64) for c in ("entry_id", "bundle_id", "file_offset", "raw_offset_in_bundle", "raw_len", "flags_bits"))]
    e = m.entries
    cut = lambda off, n: [m.names[a : a + k] for a, k in zip(e[off].tolist(), e[n].tolist(), strict=True)]
    ids = lambda c: pa.array(e[c].astype(np.int64), mask=e[c] == layout.NONE)
    links = [x or None for x in cut("link_off", "link_len")]
    plain = lambda *cs: (e[c].astype(np.int64) for c in cs)
    return [
        [name] * len(e), np.arange(len(e)), ids("parent_id"), [ENTRY_KIND[k] for k in e["kind"].tolist()], e["flags_bits"].astype(np.int32), *plain("mode", "uid", "gid", "mtime_sec"),
        e["mtime_nsec"].astype(np.int32), e["size"].astype(np.int64), cut("name_off", "name_len"), links, *plain("name_off", "name_len", "link_off", "link_len", "first_extent", "extent_count"),
        ids("hardlink_master_entry_id"), *plain("meta_off", "meta_len"),
    ]


class _Part(InputPartition):
    def __init__(self, path: str, frames: list | None = None):
        self.path, self.frames = path, frames


def _ranges(path: str, frames: Iterable) -> list[_Part]:
    """Frames dealt out to tasks by their encoded bytes."""
    out, held, size = [], [], 0
    for at, h in frames:
        held.append((at, h))
        size += h[2]
        if size >= RANGE_BYTES:
            out.append(_Part(path, held))
            held, size = [], 0
    return [*out, _Part(path, held)] if held else out


def _frame_batches(path: str, frames: list) -> Iterator[pa.RecordBatch]:
    with open(path, "rb") as f:
        for at, (bundle_id, raw_len, encoded_len, flags, value) in frames:
            f.seek(at)
            payload = layout.read_exactly(f, encoded_len)
            row = (path, bundle_id, raw_len, encoded_len, flags, value, f"{value & (1 << 64) - 1:016x}", payload)
            yield pa.RecordBatch.from_arrays([pa.array([x], c.type) for x, c in zip(row, _arrow("frames"), strict=True)], schema=_arrow("frames"))


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options.get("path")
        if not path:
            raise UsageError("a container source needs a path")
        self.table, self.permissive = options.get("table", "entries"), options.get("mode") == "permissive"
        path = path.removeprefix("file:")
        self.paths = sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_"))) if os.path.isdir(path) else [path]
        self.tests: list = []

    def partitions(self) -> list[_Part]:
        if self.table != "frames":
            return [_Part(p) for p in self.paths]
        out = []
        for path in self.paths:
            out += _ranges(path, (f for f in Archive(path).frame_headers() if all(test(f[1][0]) for test in self.tests)))
        return out or [_Part("", [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.frames is not None:
            yield from _frame_batches(partition.path, partition.frames) if partition.frames else ()
            return
        try:
            columns = _columns(Archive(partition.path), self.table)
        except EngineError:
            if self.permissive:  # a file that can't be read has no rows
                return
            raise
        schema = _arrow(self.table)
        whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        for k in range(0, whole.num_rows, 4096):
            yield whole.slice(k, 4096)


#: How conditions on bundle_id are asked of a frame's header.
_TESTS = {
    EqualTo: lambda v: lambda x: x == v, GreaterThan: lambda v: lambda x: x > v, GreaterThanOrEqual: lambda v: lambda x: x >= v, LessThan: lambda v: lambda x: x < v,
    LessThanOrEqual: lambda v: lambda x: x <= v, In: lambda v: frozenset(v).__contains__,
}


class PushingReader(ContainerReader):
    def pushFilters(self, filters):
        for f in filters:
            make = _TESTS.get(type(f))
            test = make(f.value) if make and self.table == "frames" and f.attribute == ("bundle_id",) else None
            if test:
                self.tests.append(test)
            else:
                yield f


class FrameStream(DataSourceStreamReader):
    """A stream of the frames that are whole; a container may still be written at its end. A batch is all of them that
    have come, read in ranges by as many tasks, or framesPerBatch at most."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"].removeprefix("file:"), int(options.get("framesPerBatch", 0))
        self.known: list = []
        self.given = 0

    def _whole(self) -> list:
        size, out = os.path.getsize(self.path), self.known
        try:
            for at, h in Archive(self.path).frame_headers(out):
                if at + h[2] > size:
                    break
                out.append((at, h))
        except EngineError:
            pass  # the rest hasn't been written yet
        return out

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        self.known = self._whole()
        self.given = min(len(self.known), self.given + self.most) if self.most else len(self.known)
        return {"frame": self.given}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        self.given = max(self.given, end["frame"])
        known = self.known if len(self.known) >= end["frame"] else self._whole()
        return _ranges(self.path, known[start["frame"] : end["frame"]]) or [_Part(self.path, [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from _frame_batches(partition.path, partition.frames)


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        table = self.options.get("table", "entries")
        if table not in TABLES:
            raise UsageError(f"table {table!r} is none of {tuple(TABLES)}")
        return "archive string, " + TABLES[table]

    def reader(self, schema) -> ContainerReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ContainerReader)(self.options)

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options)


def read_container(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    spark.dataSource.register(ContainerSource)
    return spark.read.format("container").option("table", table).options(**options).load(path)


def spooled(spark: SparkSession, stream) -> str:
    """The bytes of a stream, read in order and to its end, as a file in the shared folder."""
    folder = shared_folder(spark).removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/spool-{uuid.uuid4().hex}"
    with open(path, "wb") as out:
        while part := stream.read(1 << 20):
            out.write(part)
    return path
