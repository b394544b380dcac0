"""The bundle planner against a plain fold, and against manifests whose hashes are known."""

import random

import numpy as np
import pytest
from bundlefold.config import PackConfig
from bundlefold.errors import ConfigError
from bundlefold.functions import blake3
from bundlefold.operators import planner
from bundlefold.plans.pack import plan_archive
from bundlefold.sources import layout
from bundlefold.sources.writer import manifest_bytes


def fold(sizes, target, threshold):
    """Extents (file, bundle, file_offset, raw_offset, raw_len, flags) of a plain next-fit."""
    out, bundle, fill = [], 0, 0
    for i, size in enumerate(sizes):
        if size < threshold:
            if fill and fill + size > target:
                bundle, fill = bundle + 1, 0
            out.append((i, bundle, 0, fill, size, 3))
            fill += size
            continue
        if fill:
            bundle, fill = bundle + 1, 0
        for at in range(0, size, target):
            n = min(target, size - at)
            out.append((i, bundle, at, 0, n, 5 if at + n == size else 4))
            bundle += 1
    return out


def test_stretches_make_the_whole():
    rng = random.Random(7)
    for _ in range(1500):
        target, threshold = rng.choice([1, 5, 8, 20, 50]), rng.choice([0, 3, 8, 20, 60])
        sizes = np.array([rng.randint(1, rng.choice([3, 10, 60])) for _ in range(rng.randrange(40))], np.int64)
        cuts = [0, *sorted(rng.choices(range(len(sizes) + 1), k=rng.randrange(5))), len(sizes)]
        fill = bundle = 0
        got = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            got += list(zip(*planner.plan_stretch(np.arange(a, b), sizes[a:b], fill, bundle, target, threshold), strict=True))
            fill, closed = planner.follow(planner.summary(sizes[a:b], target, threshold), fill, target)
            bundle += closed
        assert got == fold(sizes.tolist(), target, threshold)


def scan(spark, rows):
    """Entries from (kind, size, parent, name, target, master) rows in order."""
    data = [
        (i, p, name.encode(), kind, mode(kind), 0, 0, 1704067200, 0, size, target.encode() if target else None, master)
        for i, (kind, size, p, name, target, master) in enumerate(rows)
    ]
    return spark.createDataFrame(data, "entry_id long, parent_id long, name binary, kind string, mode long, uid long, gid long, mtime_sec long, mtime_nsec int, size long, symlink_target binary, hardlink_master_entry_id long")


def mode(kind):
    return {"root": 0o40755, "directory": 0o40755, "symlink": 0o120755}.get(kind, 0o100644)


def files(sizes):
    return [("root", 0, None, "", None, None), *(("regular", s, 0, f"f{i:04d}", None, None) for i, s in enumerate(sizes))]


@pytest.mark.parametrize("partitions", [1, 3])
def test_plan_on_spark(spark, partitions):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 5, 9, 40, 200]) for _ in range(120)]
    got = planner.extents_of(scan(spark, files(sizes)), 50, 100, partitions).orderBy("extent_id").collect()
    some = [(i, s) for i, s in enumerate(sizes, 1) if s]
    want = [(some[i][0], *rest) for i, *rest in fold([s for _, s in some], 50, 100)]
    assert [tuple(r)[1:] if False else (r.entry_id, r.bundle_id, r.file_offset, r.raw_offset_in_bundle, r.raw_len, r.flags_bits) for r in got] == want
    assert [r.extent_id for r in got] == list(range(len(want)))


@pytest.mark.parametrize(
    ("sizes", "target", "threshold", "bundles", "extents"),
    [([3, 20], 8, 8, 4, 4), ([96] * 8, 128, 1024, 8, 8), ([], 8, 8, 0, 0), ([0, 0], 8, 8, 0, 0), ([8], 8, 8, 1, 1), ([79] * 4, 64, 1024, 4, 4), ([3, 20, 3], 8, 8, 5, 5)],
)
def test_known_plans(spark, sizes, target, threshold, bundles, extents):
    x = planner.extents_of(scan(spark, files(sizes)), target, threshold)
    assert (planner.bundles_of(x).count(), x.count()) == (bundles, extents)


def test_no_target():
    with pytest.raises(ConfigError):
        PackConfig(bundle_target_bytes=0)


# Trees, and the length and BLAKE3 hash of the manifests that they have in the container format.
TREES = {
    "links": (
        [("root", 0, None, "", None, None), ("regular", 22, 0, "alpha.txt", None, None), ("directory", 96, 0, "config", None, None), ("regular", 30, 2, "app.toml", None, None), ("symlink", 15, 0, "link-to-beta", "nested/beta.txt", None), ("directory", 128, 0, "nested", None, None), ("regular", 21, 5, "beta.txt", None, None), ("regular", 0, 5, "empty.txt", None, None)],
        4 << 20, 256 << 10, 1033, "0c32b9d261958868ec6175dc9f50a92b6a3a67bdf3342f41db18699e3d7bf781",
    ),
    "hard links": (
        [("root", 0, None, "", None, None), ("symlink", 15, 0, "alias-to-master", "docs/master.txt", None), ("directory", 96, 0, "config", None, None), ("regular", 67, 2, "profile.toml", None, None), ("directory", 128, 0, "docs", None, None), ("regular", 99, 4, "master-peer.txt", None, None), ("hardlink", 99, 4, "master.txt", None, 5)],
        4 << 20, 256 << 10, 909, "60712d982aaea5b32b620c0093c73d7e440287e8f21395183fc85714644c20f5",
    ),
    "several bundles": (
        [("root", 0, None, "", None, None), ("directory", 192, 0, "chunks", None, None), *(("regular", 79, 1, f"part-0{i}.txt", None, None) for i in (1, 2, 3, 4))],
        64, 1024, 946, "3e53c4352ac748c808a44d3e1a75b84d36c08316edc5a46690eb9a2fd03815a0",
    ),
}


@pytest.mark.parametrize("name", TREES)
def test_known_manifests(spark, name):
    rows, target, threshold, length, digest = TREES[name]
    plan = plan_archive(scan(spark, rows), PackConfig(bundle_target_bytes=target, small_file_threshold=threshold))
    raw = manifest_bytes(plan.entries, plan.extents, plan.bundles)
    assert (len(raw), blake3.digest(raw).hex()) == (length, digest)
    m = layout.Manifest(raw)
    assert len(m.entries) == len(rows)
