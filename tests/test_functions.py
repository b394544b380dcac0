"""Digests against published values, codecs, columns and paths."""

import numpy as np
import pytest
from bundlefold.errors import FormatError, UnsupportedValue
from bundlefold.functions import blake3, codecs
from bundlefold.functions import columns as C
from pyspark.sql import functions as F


def test_blake3():
    # Digests of the empty input, of "abc", and of one frame hash.
    assert blake3.digest(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.digest(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert codecs.archive_digest_of([0x3B59273A4AFF5511]).hex() == "f413243953e7b6bd7b06642ef9da3d006839290962fc107a9ff7855d21a76729"
    data = np.random.default_rng(0).integers(0, 256, 9000, dtype=np.uint8).tobytes()
    for n in (1024, 1025, 2048, 2049, 3072, 5000, 9000):
        parts = [blake3.chunk_values(data[a : min(n, a + 2048)], a // 1024) for a in range(0, n, 2048)]
        assert n <= 1024 or blake3.join(np.concatenate(parts)) == blake3.digest(data[:n])


def test_xxh3():
    assert codecs.frame_hash(b"") == 0x2D06800538D394C2


@pytest.mark.parametrize("codec", ["none", "lz4", "zstd"])
def test_codecs(codec):
    for raw in (b"", b"x", b"abc" * 1000):
        assert codecs.decode(codec, codecs.encode(codec, raw), len(raw)) == raw
    with pytest.raises(FormatError):
        codecs.decode(codec, codecs.encode(codec, b"abc" * 1000), 2999)
    with pytest.raises(UnsupportedValue):
        codecs.encode("brotli", b"")


def test_path_errors(spark):
    cases = {"a/b/c": None, "": None, "../x": "parent segment", "/x": "absolute path", "./x": "current segment", "a/../b": "parent segment", "a/./b": None, "a//b": None, "a\0b": "NUL byte", None: "null path"}
    got = {r.p: r.e for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", C.path_error("p").alias("e")).collect()}
    assert got == cases
    strict = {r.p: r.e for r in spark.createDataFrame([("a//b",), ("a/./b",), ("a/b",)], "p string").select("p", C.path_error("p", True).alias("e")).collect()}
    assert strict == {"a//b": "idle segment", "a/./b": "idle segment", "a/b": None}


def test_names(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(C.safe_name(F.lit("@types/a.b")), C.octal_mode(F.lit(33188)), C.shell_word(F.lit("it's")), C.shell_word(F.lit("")), C.shell_word(F.lit("a/b:c"))) == ("types-a-b", "0o100644", "'it'\"'\"'s'", "''", "a/b:c")
    bad = bytes([0x61, 0xFF, 0xC3, 0x28, 0xE2, 0x82, 0x62, 0xF0, 0x9F, 0x98])
    assert one(C.lossy_utf8(F.lit(bad))) == (bad.decode("utf-8", "replace"),)
    with pytest.raises(Exception, match="unsupported codec: 9"):
        one(C.name_of(F.lit(9), {0: "none"}, "codec"))


def test_wall_buckets(spark):
    rows = spark.createDataFrame([(17, 5, 8), (10, 20, 5), (10, 4, 20), (0, 0, 0)], "t long, s long, p long")
    got = [tuple(r) for r in rows.select(*C.wall_buckets("t", "s", "p").values()).collect()]
    assert got == [(5, 8, 4), (10, 0, 0), (4, 6, 0), (0, 0, 0)]


def test_running_order(spark):
    from bundlefold.tables import in_order

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    rows = in_order(df, ["k"], number="n", sums={"s": F.col("v")}, partitions=6).orderBy("n").collect()
    total = 0
    for i, r in enumerate(rows):
        assert (r.n, r.k, r.s) == (i, i, total)
        total += r.v
    assert in_order(df.limit(0), ["k"], number="n").count() == 0


def test_blake3_together():
    """Many digests at a time are those of the texts one by one, in far less time."""
    import time

    rng = np.random.default_rng(5)
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 5000, 31745, (1 << 22) + 1, *rng.integers(0, 9000, 400).tolist()]
    texts = [rng.bytes(n) for n in rng.permutation(sizes)]
    begun = time.process_time()
    alone = [blake3.digest(t) for t in texts]
    between = time.process_time()
    assert blake3.digests(texts) == alone
    assert time.process_time() - between < (between - begun) / 4
    assert blake3.digests([]) == [] and blake3.digests([b"abc"])[0].hex().startswith("6437b3ac")
