"""A dump that is written in pieces is the one that is written whole."""

import json
import os

import pytest
from bundlefold.config import PackConfig
from bundlefold.plans import dump
from bundlefold.plans.pack import pack


@pytest.mark.parametrize("files", [23, 0])
def test_pieces(spark, tmp_path, monkeypatch, files):
    source = tmp_path / "tree"
    source.mkdir()
    names = ['a "entry_path" : }, {\n x', "b\n    } ],", 'c\n    "extents" : [ {\n', *(f"f{k}" for k in range(20))][:files]
    for name in names:
        (source / name).write_bytes(os.urandom(150))
    archive, whole, pieces = (str(tmp_path / x) for x in ("archive", "whole", "pieces"))
    pack(spark, str(source), archive, PackConfig(codec="none", integrity="strong", bundle_target_bytes=100, small_file_threshold=90))
    told = dump.dump(spark, archive)
    dump.write_json(told, whole)
    monkeypatch.setattr(dump, "RUN", 7)
    dump.write_dump(spark, archive, pieces)
    assert open(pieces).read() == open(whole).read()
    want = json.load(open(whole))["manifest"]["extents"]
    assert len(want) == 2 * files
    key = lambda x: (x["entry_id"], x["file_offset"])
    assert sorted((r.asDict() for r in dump.dumped_extents(spark, pieces).collect()), key=key) == sorted(want, key=key)
