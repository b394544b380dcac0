"""Batches of a stream of frames."""

import os

import numpy as np
from bundlefold.config import PackConfig
from bundlefold.sources import container, layout, writer


def written(path, n):
    """A container of n frames, without entries."""
    raw = layout.write_manifest(np.zeros(0, layout.ENTRY), np.zeros(0, layout.EXTENT), np.zeros(0, layout.BUNDLE), b"")
    encoded = layout.encode_manifest(raw, "zstd")
    frames = b"".join(layout.write_frame_header(k, 100, 100, k) + bytes([k % 256]) * 100 for k in range(n))
    path.write_bytes(writer.header_bytes(raw, encoded, (0, 0, n), 0, PackConfig(codec="none")) + encoded + frames)


def bundles(stream, parts):
    return [b for p in parts for batch in stream.read(p) for b in batch.column("bundle_id").to_pylist()]


def test_all_that_has_come(tmp_path, monkeypatch):
    path = tmp_path / "growing"
    written(path, 200)
    whole = path.read_bytes()
    path.write_bytes(whole[:-10])  # the last frame is still being written
    stream = container.FrameStream({"path": str(path)})
    assert stream.latestOffset() == {"frame": 199}
    monkeypatch.setattr(container, "RANGE_BYTES", 1000)
    parts = stream.partitions({"frame": 0}, {"frame": 199})
    assert len(parts) == 20 and bundles(stream, parts) == list(range(199))
    path.write_bytes(whole)
    assert stream.latestOffset() == {"frame": 200} == stream.latestOffset()
    assert bundles(stream, stream.partitions({"frame": 199}, {"frame": 200})) == [199]
    again = container.FrameStream({"path": str(path)})  # begins where another has stopped
    assert bundles(again, again.partitions({"frame": 150}, {"frame": 200})) == list(range(150, 200))
    assert again.latestOffset() == {"frame": 200}


def test_bounded_batches(tmp_path):
    path = tmp_path / "whole"
    written(path, 100)
    stream = container.FrameStream({"path": str(path), "framesPerBatch": "64"})
    assert [stream.latestOffset()["frame"] for _ in range(3)] == [64, 100, 100]
    assert os.path.getsize(path) > 100 * 148
