"""The byte layout of the container: fixed-width little-endian records, read and written with numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

from ..errors import FormatError, IntegrityError, TruncatedError, UnsupportedValue
from ..functions import blake3
from ..schemas import BUNDLE_KIND, DATA_CODEC, ENTRY_KIND, FRAME_HASH, INTEGRITY_MODE, MANIFEST_CODEC, MANIFEST_HASH

# Magic bytes, record sizes and the number that stands for "none" in 32-bit id fields.
HEADER_MAGIC, MANIFEST_MAGIC, FRAME_MAGIC, TRAILER_MAGIC = b"SFA\0\r\n\x1a\n", b"MFST", b"FRME", b"TRLR"
HEADER_LEN, MANIFEST_LEN, FRAME_LEN, TRAILER_LEN = 128, 64, 48, 64
NONE = 0xFFFFFFFF

HEADER = np.dtype([
    ("magic", "V8"), ("header_len", "<u2"), ("version_major", "<u2"), ("version_minor", "<u2"), ("data_codec", "<u2"), ("manifest_codec", "<u2"),
    ("integrity_mode", "u1"), ("frame_hash_algo", "u1"), ("manifest_hash_algo", "u1"), ("reserved0", "u1"), ("suggested_parallelism", "<u2"),
    ("bundle_target_bytes", "<u4"), ("small_file_threshold", "<u4"), ("entry_count", "<u8"), ("extent_count", "<u8"), ("bundle_count", "<u8"),
    ("manifest_raw_len", "<u8"), ("manifest_encoded_len", "<u8"), ("feature_flags", "<u8"), ("manifest_hash", "V32"), ("header_crc32", "<u4"),
    ("writer_version_major", "<u2"), ("writer_version_minor", "<u2"), ("reserved1", "V8"),
])
ENTRY = np.dtype([
    ("parent_id", "<u4"), ("kind", "u1"), ("flags_bits", "u1"), ("reserved0", "<u2"), ("mode", "<u4"), ("uid", "<u4"), ("gid", "<u4"),
    ("mtime_sec", "<i8"), ("mtime_nsec", "<u4"), ("size", "<u8"), ("name_off", "<u4"), ("name_len", "<u4"), ("link_off", "<u4"), ("link_len", "<u4"),
    ("first_extent", "<u8"), ("extent_count", "<u4"), ("hardlink_master_entry_id", "<u4"), ("dev_major", "<u4"), ("dev_minor", "<u4"),
    ("meta_off", "<u4"), ("meta_len", "<u4"), ("reserved1", "V8"),
])
EXTENT = np.dtype([("bundle_id", "<u8"), ("file_offset", "<u8"), ("raw_offset_in_bundle", "<u4"), ("raw_len", "<u4"), ("flags_bits", "<u4"), ("entry_id", "<u4")])
BUNDLE = np.dtype([("bundle_id", "<u8"), ("raw_len", "<u4"), ("file_count", "<u4"), ("extent_count", "<u4"), ("kind", "u1"), ("flags", "u1"), ("reserved", "V10")])
_MANIFEST = struct.Struct("<4sHHQQQQQ16x")
_FRAME = struct.Struct("<4sHHQIIQ16x")
_TRAILER = struct.Struct("<4sHHQQQ32s")
assert (HEADER.itemsize, ENTRY.itemsize, EXTENT.itemsize, BUNDLE.itemsize) == (128, 96, 32, 32)


def _named(codes: dict[int, str], value: int, what: str) -> str:
    if value not in codes:
        raise UnsupportedValue(f"unsupported {what}: {value}")
    return codes[value]


def _code(codes: dict[int, str], name: str) -> int:
    return next(k for k, v in codes.items() if v == name)


_ENUMS = (("data_codec", DATA_CODEC), ("manifest_codec", MANIFEST_CODEC), ("integrity_mode", INTEGRITY_MODE), ("frame_hash_algo", FRAME_HASH), ("manifest_hash_algo", MANIFEST_HASH))


def read_header(raw: bytes) -> dict:
    """The header's fields, enumerations by name. manifest_hash stays bytes."""
    if len(raw) < HEADER_LEN:
        raise TruncatedError(f"a header has {HEADER_LEN} bytes; there are {len(raw)}")
    r = np.frombuffer(raw[:HEADER_LEN], HEADER)[0]
    if r["magic"].tobytes() != HEADER_MAGIC:
        raise FormatError("no container: wrong magic bytes")
    if r["header_len"] != HEADER_LEN:
        raise FormatError(f"header length {r['header_len']} instead of {HEADER_LEN}")
    if zlib.crc32(raw[:112] + b"\0\0\0\0" + raw[116:HEADER_LEN]) != r["header_crc32"]:
        raise FormatError("the header's checksum is wrong")
    if r["version_major"] != 1:
        raise UnsupportedValue(f"unsupported major version {r['version_major']}")
    out = {n: r[n].tobytes() if HEADER[n].kind == "V" else int(r[n]) for n in HEADER.names if not n.startswith("reserved") and n not in ("magic", "header_len", "header_crc32")}
    return out | {n: _named(codes, out[n], n) for n, codes in _ENUMS}


def write_header(fields: dict) -> bytes:
    r = np.zeros(1, HEADER)
    r["magic"], r["header_len"], r["version_major"], r["writer_version_minor"] = np.void(HEADER_MAGIC), HEADER_LEN, 1, 1
    for name, value in fields.items():
        codes = dict(_ENUMS).get(name)
        r[name] = np.void(value) if HEADER[name].kind == "V" else _code(codes, value) if codes and isinstance(value, str) else value
    r["header_crc32"] = 0
    r["header_crc32"] = zlib.crc32(r.tobytes())
    return r.tobytes()


def manifest_length(entries: int, extents: int, bundles: int, names: int, meta: int = 0) -> int:
    return MANIFEST_LEN + ENTRY.itemsize * entries + EXTENT.itemsize * extents + BUNDLE.itemsize * bundles + names + meta


def write_manifest(entries: np.ndarray, extents: np.ndarray, bundles: np.ndarray, names: bytes, meta: bytes = b"") -> bytes:
    return b"".join([_MANIFEST.pack(MANIFEST_MAGIC, MANIFEST_LEN, 0, len(entries), len(extents), len(bundles), len(names), len(meta)), entries.tobytes(), extents.tobytes(), bundles.tobytes(), names, meta])


class Manifest:
    """A manifest's three record arrays and its two heaps of bytes."""

    def __init__(self, raw: bytes):
        if len(raw) < MANIFEST_LEN:
            raise TruncatedError("the manifest is shorter than its header")
        magic, length, _, n_entries, n_extents, n_bundles, n_names, n_meta = _MANIFEST.unpack_from(raw)
        if magic != MANIFEST_MAGIC or length != MANIFEST_LEN:
            raise FormatError("no manifest: wrong magic bytes or header length")
        if len(raw) != manifest_length(n_entries, n_extents, n_bundles, n_names, n_meta):
            raise FormatError("the manifest's length doesn't match its counts")
        at = MANIFEST_LEN
        parts = []
        for kind, n in ((ENTRY, n_entries), (EXTENT, n_extents), (BUNDLE, n_bundles)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += n * kind.itemsize
        self.entries, self.extents, self.bundles = parts
        self.names, self.meta = raw[at : at + n_names], raw[at + n_names :]
        self._check()

    def _check(self) -> None:
        e, x, b = self.entries, self.extents, self.bundles
        for what, codes, kinds in (("entry kind", ENTRY_KIND, e["kind"]), ("bundle kind", BUNDLE_KIND, b["kind"])):
            bad = np.setdiff1d(kinds, list(codes))
            if len(bad):
                raise UnsupportedValue(f"unsupported {what}: {bad[0]}")
        number = np.arange(len(e))
        parent = e["parent_id"].astype(np.int64)
        if len(e) and (parent[0] != NONE or e["kind"][0] != 0):
            raise FormatError("the first entry isn't a root")
        if (parent[1:] >= number[1:]).any():
            raise FormatError("an entry comes before its parent")
        for off, n in (("name_off", "name_len"), ("link_off", "link_len")):
            if (e[off].astype(np.int64) + e[n] > len(self.names)).any():
                raise FormatError("a name lies outside the names' bytes")
        if (x["entry_id"] >= len(e)).any():
            raise FormatError("an extent belongs to no entry")
        if (np.diff(b["bundle_id"].astype(np.int64)) <= 0).any():
            raise FormatError("bundle ids don't ascend")
        end = {int(i): int(n) for i, n in zip(b["bundle_id"], b["raw_len"], strict=True)}
        over = [int(i) for i, a, n in zip(x["bundle_id"], x["raw_offset_in_bundle"].astype(np.int64), x["raw_len"], strict=True) if int(a) + int(n) > end.get(int(i), -1)]
        if over:
            raise FormatError(f"an extent reaches beyond bundle {over[0]}")


def encode_manifest(raw: bytes, codec: str) -> bytes:
    return zstandard.ZstdCompressor(level=-3).compress(raw) if codec == "zstd" else raw


def decode_manifest(header: dict, encoded: bytes) -> bytes:
    """The manifest's raw bytes, checked against the header's length and hash."""
    size = header["manifest_raw_len"]
    if len(encoded) < header["manifest_encoded_len"]:
        raise TruncatedError("the container ends inside its manifest")
    try:
        raw = zstandard.ZstdDecompressor().decompress(encoded, max_output_size=max(1, size)) if header["manifest_codec"] == "zstd" else encoded
    except zstandard.ZstdError as e:
        raise FormatError(f"the manifest doesn't decode: {e}") from e
    if len(raw) != size:
        raise FormatError(f"the manifest decodes to {len(raw)} bytes, not {size}")
    want = header["manifest_hash"]
    if header["manifest_hash_algo"] == "blake3_256" and blake3.digest(raw) != want:
        raise IntegrityError("the manifest's hash is wrong")
    return raw


def write_frame_header(bundle_id: int, raw_len: int, encoded_len: int, frame_hash: int, flags: int = 0) -> bytes:
    return _FRAME.pack(FRAME_MAGIC, FRAME_LEN, flags, bundle_id, raw_len, encoded_len, frame_hash & (1 << 64) - 1)


def read_frame_header(raw: bytes) -> tuple[int, int, int, int, int]:
    """bundle_id, raw_len, encoded_len, flags and the hash as a signed number."""
    if len(raw) < FRAME_LEN:
        raise TruncatedError("the container ends inside a frame's header")
    magic, length, flags, bundle_id, raw_len, encoded_len, frame_hash = _FRAME.unpack_from(raw)
    if magic != FRAME_MAGIC or length != FRAME_LEN:
        raise FormatError("no frame: wrong magic bytes or header length")
    return bundle_id, raw_len, encoded_len, flags, frame_hash - (1 << 64) * (frame_hash >> 63)


def write_trailer(bundles: int, raw_bytes: int, encoded_bytes: int, digest: bytes) -> bytes:
    return _TRAILER.pack(TRAILER_MAGIC, TRAILER_LEN, 0, bundles, raw_bytes, encoded_bytes, digest)


def read_trailer(raw: bytes) -> tuple[int, int, int, bytes]:
    if len(raw) < TRAILER_LEN:
        raise TruncatedError("the container ends inside its trailer")
    magic, length, _, bundles, raw_bytes, encoded_bytes, digest = _TRAILER.unpack_from(raw)
    if magic != TRAILER_MAGIC or length != TRAILER_LEN:
        raise FormatError("no trailer: wrong magic bytes or header length")
    return bundles, raw_bytes, encoded_bytes, digest


def read_exactly(stream, n: int) -> bytes:
    """n bytes of a stream that may give fewer at a time; fewer in all is an error."""
    parts, left = [], n
    while left:
        x = stream.read(left)
        if not x:
            raise TruncatedError(f"the container ends {left} bytes too early")
        parts.append(x)
        left -= len(x)
    return b"".join(parts)
