"""Codecs and digests of bundles, for the binary rows of a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..errors import FormatError, UnsupportedValue
from . import blake3

#: Level of the zstd codec where none is given: fast.
ZSTD_LEVEL = -3


def encode(codec: str, raw: bytes, level: int = ZSTD_LEVEL) -> bytes:
    if codec == "none":
        return bytes(raw)
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=level, write_content_size=True).compress(raw)
    if codec == "lz4":
        return pa.Codec("lz4_raw").compress(raw, asbytes=True) if raw else b"\0"
    raise UnsupportedValue(f"unknown data codec {codec!r}")


def decode(codec: str, payload: bytes, raw_len: int) -> bytes:
    """The raw bytes, which have to be raw_len of them."""
    try:
        if codec == "none":
            raw = bytes(payload)
        elif codec == "zstd":
            raw = zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, raw_len))
        elif codec == "lz4":
            raw = pa.Codec("lz4_raw").decompress(payload, decompressed_size=raw_len, asbytes=True) if raw_len else b""
        else:
            raise UnsupportedValue(f"unknown data codec {codec!r}")
    except (zstandard.ZstdError, OSError, pa.ArrowException) as e:
        raise FormatError(f"payload doesn't decode: {e}") from e
    if len(raw) != raw_len:
        raise FormatError(f"payload decodes to {len(raw)} bytes, not {raw_len}")
    return raw


def frame_hash(raw: bytes) -> int:
    """XXH3-64 of a raw bundle, seed 0, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64))


def hash_hex(column: str | Column) -> Column:
    """The 16 lower-case digits of a 64-bit hash kept as a long."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.lpad(F.hex(c), 16, "0"))


@F.pandas_udf(LongType())
def xxh3_64(raw: pd.Series) -> pd.Series:
    """XXH3-64 (Spark's xxhash64 is another function)."""
    return raw.map(frame_hash, na_action="ignore").astype("Int64")


@F.pandas_udf(BinaryType())
def blake3_256(raw: pd.Series) -> pd.Series:
    there = raw.notna()
    out = pd.Series([None] * len(raw), index=raw.index, dtype=object)
    out[there] = pd.Series(blake3.digests([bytes(x) for x in raw[there]]), index=raw.index[there], dtype=object)
    return out


def archive_digest_of(hashes) -> bytes:
    """BLAKE3-256 over little-endian frame hashes in order."""
    return blake3.digest(np.asarray(hashes, np.int64).astype("<i8").tobytes())
