"""Packing and unpacking folders: round trips, damage at every region, what must not be written."""

import json
import os
import stat

import pytest
from bundlefold import cli
from bundlefold.config import PackConfig, UnpackConfig
from bundlefold.errors import EngineError, FileSystemError, FormatError, IntegrityError, TruncatedError, UnsafePath
from bundlefold.operators import restore
from bundlefold.plans.dump import dump, summary
from bundlefold.plans.pack import pack
from bundlefold.plans.unpack import DIAGNOSTICS_ENV, unpack, unpack_stream
from bundlefold.sources import layout
from bundlefold.sources.container import read_container


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in") / "tree"
    for d in ("a/b/c", "a-b", "empty"):
        (root / d).mkdir(parents=True)
    (root / "a/x").write_bytes(b"hello " * 50)
    (root / "a/b/big").write_bytes(bytes(range(256)) * 40)
    (root / "a-b/none").write_bytes(b"")
    os.symlink("../x", root / "a/b/link")
    os.link(root / "a/x", root / "z-hard")
    with open(os.fsencode(root) + b"/\xff\xfename", "wb") as f:
        f.write(b"odd")
    os.chmod(root / "a/x", 0o640)
    os.utime(root / "a/x", ns=(0, 1_700_000_000_123_456_789))
    os.utime(root / "a/b", ns=(0, 1_600_000_000_000_000_001))
    return str(root)


@pytest.fixture(scope="module")
def archive(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("out") / "strong")
    row = pack(spark, folder, path, PackConfig(codec="none", integrity="strong", bundle_target_bytes=4096, small_file_threshold=2048, threads=3)).first()
    assert row.encoded_bytes == os.path.getsize(path)
    return path


def tree(root):
    out = {}
    for at, folders, files in os.walk(os.fsencode(root)):
        for n in folders + files:
            p = os.path.join(at, n)
            s = os.lstat(p)
            data = os.readlink(p) if stat.S_ISLNK(s.st_mode) else open(p, "rb").read() if stat.S_ISREG(s.st_mode) else None
            out[os.path.relpath(p, os.fsencode(root))] = (stat.S_IFMT(s.st_mode), data, None if stat.S_ISLNK(s.st_mode) else (s.st_mode, s.st_mtime_ns))
    return out


def test_round_trip(spark, folder, archive, tmp_path, monkeypatch):
    out, counters = str(tmp_path / "back"), str(tmp_path / "counters.json")
    monkeypatch.setenv(DIAGNOSTICS_ENV, counters)
    row = unpack(spark, archive, out).first()
    assert tree(out) == tree(folder)
    assert os.stat(f"{out}/a/x").st_ino == os.stat(f"{out}/z-hard").st_ino
    w = row.wall_breakdown
    assert w.setup_ms.value + w.pipeline_ms.value + w.finalize_ms.value == row.duration_ms
    told = json.load(open(counters))["diagnostics"]
    assert told["scatter"]["bytes_written"] == row.raw_bytes and told["finalize"]["hardlink_create_count"] == 1
    with pytest.raises(FileSystemError, match="exists already"):
        unpack(spark, archive, out)
    os.remove(f"{out}/a/x")
    unpack(spark, archive, out, UnpackConfig(overwrite=True))
    assert tree(out) == tree(folder)


class Drops:
    """A stream that gives seven bytes at a time."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def read(self, n):
        self.at += min(n, 7)
        return self.raw[self.at - min(n, 7) : self.at]


def test_stream(spark, folder, archive, tmp_path):
    unpack_stream(spark, Drops(open(archive, "rb").read()), str(tmp_path / "s"))
    assert tree(tmp_path / "s") == tree(folder)


def damaged(archive, to, at, cut=None):
    raw = bytearray(open(archive, "rb").read())
    if cut is not None:
        raw = raw[:cut]
    else:
        raw[at] ^= 0x41
    open(to, "wb").write(bytes(raw))
    return str(to)


def test_damage(spark, archive, tmp_path):
    raw = open(archive, "rb").read()
    header = layout.read_header(raw)
    first = layout.HEADER_LEN + header["manifest_encoded_len"]
    cases = [
        (0, FormatError), (9, FormatError), (40, FormatError), (layout.HEADER_LEN + 20, (IntegrityError, FormatError)), (first, FormatError), (first + layout.FRAME_LEN + 5, IntegrityError),
        (first + 26, IntegrityError), (len(raw) - 1, IntegrityError), (len(raw) - 64, FormatError),
    ]
    for at, error in cases:
        bad = damaged(archive, tmp_path / f"bad{at}", at)
        with pytest.raises(error):
            unpack(spark, bad, str(tmp_path / f"out{at}"))
    for cut in (3, 100, 200, first + 10, first + 60, len(raw) - 10):
        with pytest.raises((TruncatedError, FormatError)):
            unpack(spark, damaged(archive, tmp_path / f"cut{cut}", 0, cut), str(tmp_path / f"outc{cut}"))


def test_marker(spark, archive, tmp_path):
    bad, out = damaged(archive, tmp_path / "bad", os.path.getsize(archive) - 1), tmp_path / "out"
    with pytest.raises(IntegrityError):
        unpack(spark, bad, str(out), UnpackConfig(trailer_first=False))
    assert (out / restore.MARKER).exists() and (out / "a/x").exists()
    unpack(spark, archive, str(out), UnpackConfig(overwrite=True, trailer_first=False))
    assert not (out / restore.MARKER).exists()


def test_links_in_the_way(spark, archive, tmp_path):
    out, outside = tmp_path / "out", tmp_path / "outside"
    outside.mkdir()
    out.mkdir()
    os.symlink(outside, out / "a")
    with pytest.raises((UnsafePath, FileSystemError)):
        unpack(spark, archive, str(out), UnpackConfig(overwrite=True))
    assert not list(outside.iterdir())


def test_closed_folders(spark, tmp_path):
    src = tmp_path / "src"
    (src / "shut/inner").mkdir(parents=True)
    (src / "shut/inner/f").write_bytes(b"x")
    pack(spark, str(src), str(tmp_path / "a"))
    os.chmod(src / "shut", 0o500)
    try:
        pack(spark, str(src), str(tmp_path / "a"))
        unpack(spark, str(tmp_path / "a"), str(tmp_path / "out"))
        assert stat.S_IMODE(os.stat(tmp_path / "out/shut").st_mode) == 0o500 and (tmp_path / "out/shut/inner/f").read_bytes() == b"x"
    finally:
        for d in (src / "shut", tmp_path / "out/shut"):
            if d.exists():
                os.chmod(d, 0o700)


def test_unsafe_names(spark):
    rows = lambda name: spark.createDataFrame([(0, "root", b"", None), (1, "regular", name, None)], "entry_id long, kind string, name binary, link_target binary")
    restore.check_names(rows(b"\xff/".strip(b"/")))
    for name in (b"..", b".", b"", b"a/b", b"a\0b"):
        with pytest.raises(UnsafePath):
            restore.check_names(rows(name))
    with pytest.raises(UnsafePath):
        restore.check_names(spark.createDataFrame([(1, "symlink", b"l", b"a\0")], "entry_id long, kind string, name binary, link_target binary"))


def test_special_files(spark, tmp_path):
    os.mkfifo(tmp_path / "pipe")
    with pytest.raises(Exception, match="unsupported entry kind"):
        pack(spark, str(tmp_path), str(tmp_path / "out"))


def test_tables(spark, archive):
    frames = read_container(spark, archive, "frames", pushdown="true").where("bundle_id >= 1 and bundle_id < 3")
    assert sorted(r.bundle_id for r in frames.collect()) == [1, 2]
    assert read_container(spark, archive, "header").first().suggested_parallelism == 3
    assert read_container(spark, archive, "trailer").count() == 1
    told = dump(spark, archive)
    one, s = told.first(), summary(told).first()
    assert one.manifest.entries[0].path == "." and [e.entry_id for e in one.manifest.entries] == list(range(one.manifest.entry_count))
    assert (s.frame_count, s.has_trailer) == (one.manifest.bundle_count, True)
    by_path = {e.path: e for e in one.manifest.entries}
    assert by_path["a/b/link"].link_target_utf8 == "../x" and by_path["z-hard"].hardlink_master_entry_id == by_path["a/x"].entry_id
    order = [e.path for e in one.manifest.entries]
    assert order.index("a/x") < order.index("a-b")
    with pytest.raises(Exception, match="none of"):
        read_container(spark, archive, "nothing").collect()


def test_cli(spark, folder, archive, tmp_path, capsys, monkeypatch):
    run = lambda *a: cli.run(cli.parser().parse_args(a), spark)
    assert json.loads(run("pack", folder, "unused", "--dry-run", "--stats-format", "json"))["phase_breakdown"]["scan_ms"]["status"] == "unavailable"
    text = run("unpack", archive, "-C", str(tmp_path / "c"))
    assert "files_per_second" in text and "bundle_count" in text
    assert json.loads(run("unpack", archive, "--dry-run", "--stats-format", "json"))["threads"] == 3
    run("dump", archive, str(tmp_path / "m.json"), "--summary-out", str(tmp_path / "s.json"))
    assert json.load(open(tmp_path / "s.json"))["has_trailer"] is True
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["unpack", "-", "--dry-run"]) == 2
    assert cli.main(["unpack", str(tmp_path / "missing"), "-C", str(tmp_path)]) == 20
    assert cli.main(["unpack", damaged(archive, tmp_path / "d", 0), "-C", str(tmp_path / "e")]) == 30
    assert issubclass(UnsafePath, EngineError)
