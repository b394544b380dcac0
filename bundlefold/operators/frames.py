"""Bundles as binary rows: gathered, hashed and encoded; decoded, checked and cut up again."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FileSystemError, IntegrityError
from ..functions import blake3, codecs
from ..tables import bound_batches, in_order

_FRAMES = "bundle_id long, raw_len long, encoded_len long, flags int, frame_hash long, payload binary"
_ARROW = pa.schema([("bundle_id", pa.int64()), ("raw_len", pa.int64()), ("encoded_len", pa.int64()), ("flags", pa.int32()), ("frame_hash", pa.int64()), ("payload", pa.binary())])


def _frame(bundle_id: int, raw: bytes, codec: str, level: int) -> pa.RecordBatch:
    payload = codecs.encode(codec, raw, level)
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bundle_id, len(raw), len(payload), 0, codecs.frame_hash(raw), payload), _ARROW, strict=True)], schema=_ARROW)


def frames_from_contents(extents: DataFrame, contents: DataFrame, codec: str = "zstd", level: int = codecs.ZSTD_LEVEL) -> DataFrame:
    """Frames of all bundles, from the files' contents (entry_id, content)."""
    piece = F.expr("substring(content, cast(file_offset + 1 as int), cast(raw_len as int))")
    pieces = extents.join(contents, "entry_id").select("bundle_id", "raw_offset_in_bundle", "raw_len", piece.alias("piece"))

    def encode(key, table):
        order = np.argsort(table.column("raw_offset_in_bundle").to_numpy())
        found = table.column("piece").to_pylist()
        lengths = table.column("raw_len").to_pylist()
        for k in order:
            if found[k] is None or len(found[k]) != lengths[k]:
                raise FileSystemError(f"bundle {key[0].as_py()}: a file is shorter than planned")
        return pa.Table.from_batches([_frame(key[0].as_py(), b"".join(found[k] for k in order), codec, level)])

    return pieces.groupBy("bundle_id").applyInArrow(encode, _FRAMES)


def frames_from_files(extents: DataFrame, entries: DataFrame, root: str, codec: str = "zstd", level: int = codecs.ZSTD_LEVEL) -> DataFrame:
    """Frames of all bundles, the tasks reading the files below root themselves, so that only names are shuffled. A file
    that has become shorter since it was scanned stops the query."""
    base = os.fsencode(os.path.abspath(root))
    parts = extents.join(entries.select("entry_id", "relative_path"), "entry_id").select("bundle_id", "raw_offset_in_bundle", "raw_len", "file_offset", "relative_path")

    def encode(key, table):
        bundle, at = bytearray(), 0
        order = np.argsort(table.column("raw_offset_in_bundle").to_numpy()).tolist()
        lengths, offsets, names = (table.column(c).to_pylist() for c in ("raw_len", "file_offset", "relative_path"))
        for k in order:
            bundle += _read(os.path.join(base, names[k]), offsets[k], lengths[k])
            at += lengths[k]
        return pa.Table.from_batches([_frame(key[0].as_py(), bytes(bundle), codec, level)])

    return parts.groupBy("bundle_id").applyInArrow(encode, _FRAMES)


def _read(path: bytes, offset: int, length: int) -> bytes:
    fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
    try:
        out = b""
        while len(out) < length:
            x = os.pread(fd, length - len(out), offset + len(out))
            if not x:
                raise FileSystemError(f"{os.fsdecode(path)} is shorter than planned")
            out += x
        return out
    finally:
        os.close(fd)


def decoded(frames: DataFrame, codec: str, check: bool = True) -> DataFrame:
    """bundle_id and raw bytes of frames; payloads have to decode to raw_len bytes whose hash is the frame's."""
    bound_batches(frames.sparkSession)
    schema = pa.schema([("bundle_id", pa.int64()), ("raw", pa.binary())])

    def work(batches):
        for batch in batches:
            for bundle_id, raw_len, want, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = codecs.decode(codec, payload, raw_len)
                if check and codecs.frame_hash(raw) != want:
                    raise IntegrityError(f"the hash of frame {bundle_id} is wrong")
                yield pa.RecordBatch.from_arrays([pa.array([bundle_id], pa.int64()), pa.array([raw], pa.binary())], schema=schema)

    return frames.select("bundle_id", "raw_len", "frame_hash", "payload").mapInArrow(work, "bundle_id long, raw binary")


def file_pieces(bundles: DataFrame, extents: DataFrame) -> DataFrame:
    """entry_id, file_offset and piece of every extent, cut from the raw bundles."""
    cut = F.expr("substring(raw, cast(raw_offset_in_bundle + 1 as int), cast(raw_len as int))")
    return bundles.join(extents, "bundle_id").select("entry_id", "file_offset", cut.alias("piece"))


def pieces_of(frames: DataFrame, extents: DataFrame, codec: str) -> DataFrame:
    """entry_id, file_offset and piece of every extent: each frame is decoded and checked once, and cut up where it is."""
    bound_batches(frames.sparkSession)
    schema = pa.schema([("entry_id", pa.int64()), ("file_offset", pa.int64()), ("piece", pa.binary())])

    def work(batches):
        for batch in batches:
            for bundle_id, raw_len, want, payload, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = codecs.decode(codec, payload, raw_len)
                if codecs.frame_hash(raw) != want:
                    raise IntegrityError(f"the hash of frame {bundle_id} is wrong")
                cut = [raw[x["raw_offset_in_bundle"] : x["raw_offset_in_bundle"] + x["raw_len"]] for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array([x["entry_id"] for x in parts], pa.int64()), pa.array([x["file_offset"] for x in parts], pa.int64()), pa.array(cut, pa.binary())], schema=schema)

    rows = with_extents(frames.select("bundle_id", "raw_len", "frame_hash", "payload"), extents)
    return rows.select("bundle_id", "raw_len", "frame_hash", "payload", "extents").mapInArrow(work, "entry_id long, file_offset long, piece binary")


def with_extents(frames: DataFrame, extents: DataFrame) -> DataFrame:
    """Frames with the ordered list of their extents; a frame of no known bundle has an empty list."""
    fields = ("raw_offset_in_bundle", "entry_id", "file_offset", "raw_len", "flags_bits")
    lists = extents.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("extents"))
    return frames.join(lists, "bundle_id", "left").withColumn("extents", F.coalesce("extents", F.expr("filter(array(cast(null as struct<raw_offset_in_bundle: long, entry_id: long, file_offset: long, raw_len: long, flags_bits: long>)), x -> x is not null)")))


def archive_digest(frames: DataFrame) -> bytes:
    """BLAKE3 over the little-endian hashes of all frames in the order of their bundles. A chunk of the digest's tree
    holds 128 hashes; tasks make the chunks' values, of which there is one to 32 GiB of data at the usual target, and
    the driver joins them."""
    rows = in_order(frames.select("bundle_id", "frame_hash"), ["bundle_id"], number="place", cheap=True)
    per_chunk = blake3.CHUNK // 8
    count = rows.count()
    if count <= per_chunk:
        return codecs.archive_digest_of([r["frame_hash"] for r in rows.orderBy("place").collect()])
    schema = pa.schema([("chunk", pa.int64()), ("value", pa.binary())])

    def values(key, table):
        order = np.argsort(table.column("place").to_numpy())
        chunk = key[0].as_py()
        data = table.column("frame_hash").to_numpy()[order].astype("<i8").tobytes()
        return pa.table([[chunk], [blake3.chunk_values(data, chunk)[0].astype("<u4").tobytes()]], schema=schema)

    got = rows.withColumn("chunk", F.expr(f"place div {per_chunk}")).groupBy("chunk").applyInArrow(values, "chunk long, value binary").orderBy("chunk").collect()
    return blake3.join(np.stack([np.frombuffer(r["value"], "<u4") for r in got]).astype(np.uint32))


def trailer_matches(frames: DataFrame, trailer: dict) -> bool:
    """Whether bundle count, raw bytes, encoded bytes and digest of some frames are those of a trailer."""
    n, raw, encoded = frames.agg(F.count("*"), F.coalesce(F.sum("raw_len"), F.lit(0)), F.coalesce(F.sum("encoded_len"), F.lit(0))).first()
    return (n, raw, encoded) == (trailer["bundle_count"], trailer["total_raw_bytes"], trailer["total_encoded_bytes"]) and archive_digest(frames).hex() == trailer["archive_hash_hex"]
