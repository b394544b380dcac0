"""Writing containers: header and manifest by the driver, frames by the tasks, each at its place in the file."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PackConfig
from ..errors import FormatError
from ..functions import blake3
from ..operators.frames import archive_digest
from ..schemas import BUNDLE_KIND, ENTRY_KIND
from ..tables import bound_batches, in_order
from . import layout


def _numbers(table: pa.Table, kind: np.dtype, codes: dict[str, dict[int, str]] | None = None) -> np.ndarray:
    out = np.zeros(table.num_rows, kind)
    for name in kind.names:
        if name not in table.column_names:
            continue
        column = table.column(name)
        if codes and name in codes:
            back = {v: k for k, v in codes[name].items()}
            out[name] = [back[v] for v in column.to_pylist()]
        else:
            out[name] = (column.fill_null(layout.NONE) if column.null_count else column).to_numpy()
    return out


def manifest_bytes(entries: DataFrame, extents: DataFrame, bundles: DataFrame) -> bytes:
    """The manifest as the container holds it. It is one object by the format's definition, so the driver makes it."""
    e = entries.orderBy("entry_id").toArrow()
    x = extents.orderBy("extent_id").drop("extent_id").toArrow()
    b = bundles.orderBy("bundle_id").toArrow()
    names = b"".join(part for pair in zip(e.column("name").to_pylist(), e.column("link_target").to_pylist(), strict=True) for part in pair if part)
    if len(names) >= 1 << 32 or e.num_rows >= layout.NONE:
        raise FormatError("more entries or bytes of names than a container can number")
    return layout.write_manifest(_numbers(e, layout.ENTRY, {"kind": ENTRY_KIND}), _numbers(x, layout.EXTENT), _numbers(b, layout.BUNDLE, {"kind": BUNDLE_KIND}), names)


def header_bytes(manifest_raw: bytes, manifest_encoded: bytes, counts: tuple[int, int, int], feature_flags: int, config: PackConfig, manifest_codec: str = "zstd") -> bytes:
    return layout.write_header({
        "data_codec": config.codec, "manifest_codec": manifest_codec, "integrity_mode": config.integrity, "frame_hash_algo": "xxh3_64", "manifest_hash_algo": "blake3_256",
        "suggested_parallelism": config.threads, "bundle_target_bytes": config.bundle_target_bytes, "small_file_threshold": config.small_file_threshold,
        "entry_count": counts[0], "extent_count": counts[1], "bundle_count": counts[2], "manifest_raw_len": len(manifest_raw), "manifest_encoded_len": len(manifest_encoded),
        "feature_flags": feature_flags, "manifest_hash": blake3.digest(manifest_raw),
    })


def write_container(path: str, manifest_raw: bytes, counts: tuple[int, int, int], feature_flags: int, frames: DataFrame, config: PackConfig, manifest_codec: str = "zstd") -> dict:
    """Writes a container under another name beside path, then renames it. Frames' places follow from their lengths, so
    tasks write them side by side, and again if they must. Returns total_raw_bytes, payload_bytes and archive_bytes."""
    bound_batches(frames.sparkSession)
    encoded = layout.encode_manifest(manifest_raw, manifest_codec)
    begin = header_bytes(manifest_raw, encoded, counts, feature_flags, config, manifest_codec) + encoded
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temporary = f"{os.path.abspath(path)}.partial"
    with open(temporary, "wb") as out:
        out.write(begin)
    step = F.col("encoded_len") + layout.FRAME_LEN
    places = in_order(frames.select("bundle_id", "encoded_len"), ["bundle_id"], sums={"place": step}, cheap=True).select("bundle_id", "place")
    n, raw, payload = frames.agg(F.count("*"), F.coalesce(F.sum("raw_len"), F.lit(0)), F.coalesce(F.sum("encoded_len"), F.lit(0))).first()
    if n != counts[2]:
        raise FormatError(f"{n} frames for {counts[2]} bundles")
    first = len(begin)
    schema = pa.schema([("n", pa.int64())])

    def work(batches):
        fd = os.open(temporary, os.O_WRONLY)
        try:
            for batch in batches:
                for place, bundle_id, raw_len, encoded_len, flags, value, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block, at = layout.write_frame_header(bundle_id, raw_len, encoded_len, value, flags) + data, first + place
                    while block:
                        done = os.pwrite(fd, block, at)
                        block, at = block[done:], at + done
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], schema=schema)
        finally:
            os.close(fd)

    joined = frames.join(places, "bundle_id").select("place", "bundle_id", "raw_len", "encoded_len", "flags", "frame_hash", "payload")
    written = joined.mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if written != n:
        raise FormatError(f"{written} of {n} frames were written")
    size = first + payload + layout.FRAME_LEN * n
    if config.integrity == "strong":
        with open(temporary, "r+b") as out:
            out.seek(size)
            out.write(layout.write_trailer(n, raw, payload, archive_digest(frames)))
        size += layout.TRAILER_LEN
    os.replace(temporary, path)
    return {"total_raw_bytes": raw, "payload_bytes": payload, "archive_bytes": size}
