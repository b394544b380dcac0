"""Restoring a tree: folders by depth, files by entry, then links, then the folders' own metadata.

Every path is opened segment by segment below the output folder, links not followed, so no link in the way leads out of
it. Files are written under another name and renamed, so a task that runs again does no harm; the other names hold the
mark of the run, and what lost tasks have left under them is removed by sweep(). Whether something stands in the way is
found out before anything is written.
"""

from __future__ import annotations

import contextlib
import os
import stat
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FileSystemError, UnsafePath
from ..tables import bound_batches

#: Files in a run that one task writes, and the most tasks they are dealt to.
FILES, MOST_TASKS = 1000, 8192
MARKER = ".bundlefold-untrusted"
_DIR = os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW
_COUNTS = pa.schema([("files", pa.int64()), ("extents", pa.int64()), ("bytes", pa.int64()), ("ns", pa.int64())])


def check_names(entries: DataFrame) -> None:
    """Every name but the root's has to be one plain segment, and no link target may hold a NUL byte."""
    name, link = F.col("name"), F.col("link_target")
    holds = lambda column, byte: F.instr(F.hex(column), byte)  # bytes begin at odd places
    text = F.regexp_replace(F.hex(name), "(..)", "$1 ")
    bad = name.isin(b".", b"..") | (F.octet_length(name) == 0) | F.contains(text, F.lit("2F ")) | F.contains(text, F.lit("00 "))
    bad_link = F.contains(F.regexp_replace(F.hex(link), "(..)", "$1 "), F.lit("00 "))
    found = entries.where((F.col("kind") != "root") & bad | F.coalesce(bad_link, F.lit(False))).select("entry_id", F.hex("name")).limit(1).collect()
    if found:
        raise UnsafePath(f"entry {found[0][0]} has an unsafe name or link target ({found[0][1]})")


class Folders:
    """Open folders below a root, found by their segments without following links."""

    def __init__(self, root: str, most: int = 128):
        self.root, self.most, self.held = os.open(root, os.O_RDONLY | os.O_DIRECTORY), most, {}

    def at(self, parts: tuple[bytes, ...]) -> int:
        if not parts:
            return self.root
        if parts in self.held:
            return self.held[parts]
        fd, mine = self.root, False
        try:
            for p in parts:
                new = os.open(p, _DIR, dir_fd=fd)
                if mine:
                    os.close(fd)
                fd, mine = new, True
        except OSError as e:
            if mine:
                os.close(fd)
            raise (UnsafePath if e.errno in (20, 40) else FileSystemError)(f"{os.fsdecode(b'/'.join(parts))}: {e.strerror}") from e
        if len(self.held) >= self.most:
            self.close()
        self.held[parts] = fd
        return fd

    def make(self, parts: tuple[bytes, ...]) -> int:
        """As at(), but what isn't there is created; anything but a folder in the way is an error."""
        if not parts:
            return self.root
        if parts in self.held:
            return self.held[parts]
        above = self.make(parts[:-1])
        with contextlib.suppress(FileExistsError):
            os.mkdir(parts[-1], 0o700, dir_fd=above)
        try:
            fd = os.open(parts[-1], _DIR, dir_fd=above)
        except OSError as e:
            raise (UnsafePath if e.errno in (20, 40) else FileSystemError)(f"{os.fsdecode(b'/'.join(parts))} is in the way: {e.strerror}") from e
        if len(self.held) >= self.most:
            self.close()
        self.held[parts] = fd
        return fd

    def close(self) -> None:
        for fd in self.held.values():
            os.close(fd)
        self.held = {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
        os.close(self.root)


def _split(parts) -> tuple[tuple[bytes, ...], bytes]:
    parts = tuple(bytes(p) for p in parts)
    return parts[:-1], parts[-1]


def _metadata(fd: int, mode: int, uid: int, gid: int, sec: int, nsec: int, owner: bool) -> None:
    if owner and os.geteuid() == 0:
        with contextlib.suppress(OSError):
            os.fchown(fd, uid, gid)
    os.fchmod(fd, stat.S_IMODE(mode))
    os.utime(fd, ns=(sec * 10**9 + nsec,) * 2)


def _each(df: DataFrame, root: str, act) -> dict:
    """Runs act(folders, row) for every row, in the tasks; sums what it returns (files, extents, bytes)."""

    def work(batches):
        total = [0, 0, 0]
        begun = time.monotonic_ns()
        with Folders(root) as folders:
            for batch in batches:
                for row in batch.to_pylist():
                    got = act(folders, row) or (1, 0, 0)
                    total = [a + b for a, b in zip(total, got, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*total, time.monotonic_ns() - begun)], schema=_COUNTS)

    r = df.mapInArrow(work, "files long, extents long, bytes long, ns long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS.names]).first()
    return r.asDict()


def make_folders(folders: DataFrame, root: str) -> int:
    """Creates folders, and those above them, in one job: a folder that another task has made is as good as one's own.
    Existing folders are kept; anything else in the way is an error."""
    os.makedirs(root, exist_ok=True)

    def make(at: Folders, row):
        at.make(tuple(bytes(p) for p in row["components"]))

    return _each(folders.where("depth > 0").select("components"), root, make)["files"]


def check_free(paths: DataFrame, root: str) -> None:
    """Stops if one of the paths exists, whatever it is."""

    def look(at: Folders, row):
        above, name = _split(row["components"])
        try:
            os.stat(name, dir_fd=at.at(above), follow_symlinks=False)
        except FileNotFoundError:
            return
        except FileSystemError as e:
            if isinstance(e.__cause__, FileNotFoundError):
                return
            raise
        raise FileSystemError(f"{os.fsdecode(b'/'.join((*above, name)))} exists already")

    _each(paths.select("components"), root, look)


def _temporary(run: str) -> bytes:
    """The name of what isn't whole yet."""
    return f".{run}-{uuid.uuid4().hex}.part".encode()


def _replace(fd: int, temporary: bytes, name: bytes, where: tuple[bytes, ...]) -> None:
    try:
        with contextlib.suppress(FileNotFoundError):
            if stat.S_ISDIR(os.stat(name, dir_fd=fd, follow_symlinks=False).st_mode):
                raise FileSystemError(f"{os.fsdecode(b'/'.join((*where, name)))} is a folder")
        os.rename(temporary, name, src_dir_fd=fd, dst_dir_fd=fd)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(temporary, dir_fd=fd)
        raise


class _Writing:
    """A file that is written under another name, until finish() or drop(); holds two open files meanwhile."""

    def __init__(self, folders: Folders, row: dict, run: str):
        self.row, self.temporary, self.written, self.out = row, _temporary(run), 0, -1
        self.where, self.name = _split(row["components"])
        self.fd = os.dup(folders.at(self.where))  # stays open if the cache lets its own go
        try:
            self.out = os.open(self.temporary, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600, dir_fd=self.fd)
        except BaseException:
            os.close(self.fd)
            raise

    def add(self, data: bytes, at: int) -> None:
        self.written += len(data)
        while data:
            n = os.pwrite(self.out, data, at)
            data, at = data[n:], at + n

    def finish(self, owner: bool) -> None:
        row = self.row
        if self.written != row["size"]:
            raise FileSystemError(f"{os.fsdecode(self.name)}: {self.written} bytes instead of {row['size']}")
        _metadata(self.out, row["mode"], row["uid"], row["gid"], row["mtime_sec"], row["mtime_nsec"], owner)
        out, self.out = self.out, -1
        os.close(out)
        _replace(self.fd, self.temporary, self.name, self.where)
        os.close(self.fd)

    def drop(self) -> None:
        if self.out >= 0:
            os.close(self.out)
        with contextlib.suppress(OSError):
            os.unlink(self.temporary, dir_fd=self.fd)
        os.close(self.fd)


def write_files(pieces: DataFrame, files: DataFrame, root: str, owner: bool, run: str = "") -> dict:
    """Writes regular files from their pieces (entry_id, file_offset, piece); files has components and metadata. A file
    without pieces is empty. All pieces of a file go to one task, in order, and are written one after the other."""
    bound_batches(files.sparkSession)
    columns = ("entry_id", "components", "size", "mode", "uid", "gid", "mtime_sec", "mtime_nsec")
    # files of neighbouring ids share folders; a run of them is a task's, however few bytes they have
    tasks = max(1, min(MOST_TASKS, -(-files.count() // FILES)))
    stretch = F.expr(f"entry_id div {FILES}")
    rows = files.select(*columns).join(pieces, "entry_id", "left").repartition(tasks, stretch).sortWithinPartitions("entry_id", "file_offset")

    def work(batches):
        total = [0, 0, 0]
        begun = time.monotonic_ns()
        held = None
        with Folders(root) as folders:
            try:
                for batch in batches:
                    for row in batch.to_pylist():
                        if held and held.row["entry_id"] != row["entry_id"]:
                            held.finish(owner)
                            held = None
                            total[0] += 1
                        if held is None:
                            held = _Writing(folders, row, run)
                        if row["piece"] is not None:
                            held.add(row["piece"], row["file_offset"])
                            total[1] += 1
                            total[2] += len(row["piece"])
                if held:
                    held.finish(owner)
                    held = None
                    total[0] += 1
            finally:
                if held:
                    held.drop()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*total, time.monotonic_ns() - begun)], schema=_COUNTS)

    r = rows.mapInArrow(work, "files long, extents long, bytes long, ns long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS.names]).first()
    return r.asDict()


def make_symlinks(links: DataFrame, root: str, run: str = "") -> dict:
    """Symbolic links with their targets' bytes as they are; times and modes of links aren't restored."""

    def make(at: Folders, row):
        where, name = _split(row["components"])
        fd, temporary = at.at(where), _temporary(run)
        os.symlink(row["link_target"], temporary, dir_fd=fd)
        _replace(fd, temporary, name, where)

    return _each(links.select("components", "link_target"), root, make)


def make_hardlinks(links: DataFrame, root: str, run: str = "") -> dict:
    """Hard links to their masters, which are there by now. links: components, master (the master's components)."""

    def make(at: Folders, row):
        (where, name), (there, old) = _split(row["components"]), _split(row["master"])
        fd, temporary = os.dup(at.at(where)), _temporary(run)
        try:
            os.link(old, temporary, src_dir_fd=at.at(there), dst_dir_fd=fd, follow_symlinks=False)
            _replace(fd, temporary, name, where)
            with contextlib.suppress(FileNotFoundError):  # rename() leaves both names if they are one file already
                os.unlink(temporary, dir_fd=fd)
        finally:
            os.close(fd)

    return _each(links.select("components", "master"), root, make)


def sweep(folders: DataFrame, root: str, run: str) -> int:
    """Removes what tasks of this run that were lost or run again have left under temporary names, in the folders given,
    the root among them. How many there were. Folders' times change, so it comes before finish_folders()."""
    mark = f".{run}-".encode()

    def look(at: Folders, row):
        fd, n = at.at(tuple(bytes(p) for p in row["components"])), 0
        for name in map(os.fsencode, os.listdir(fd)):
            if name.startswith(mark) and name.endswith(b".part"):
                os.unlink(name, dir_fd=fd)
                n += 1
        return n, 0, 0

    return _each(folders.select("components"), root, look)["files"]


def finish_folders(folders: DataFrame, root: str, owner: bool) -> int:
    """Modes and times of all folders but the root. Where one of them will be closed to its owner, deepest first."""
    inner = folders.where("depth > 0")
    if inner.where(F.col("mode").bitwiseAND(0o700) != 0o700).isEmpty():
        levels = [inner]
    else:
        levels = [inner.where(F.col("depth") == r["depth"]) for r in inner.select("depth").distinct().orderBy(F.desc("depth")).collect()]

    def finish(at: Folders, row):
        where, name = _split(row["components"])
        fd = os.open(name, _DIR, dir_fd=at.at(where))
        try:
            _metadata(fd, row["mode"], row["uid"], row["gid"], row["mtime_sec"], row["mtime_nsec"], owner)
        finally:
            os.close(fd)

    columns = ("components", "mode", "uid", "gid", "mtime_sec", "mtime_nsec")
    return sum(_each(level.select(*columns), root, finish)["files"] for level in levels)


def set_marker(root: str) -> None:
    with open(os.path.join(root, MARKER), "w") as f:
        f.write("the trailer of this archive did not match\n")


def clear_marker(root: str) -> None:
    with contextlib.suppress(FileNotFoundError):
        os.remove(os.path.join(root, MARKER))
