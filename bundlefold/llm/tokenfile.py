"""Token-id files (operator 5): frequency-ranked ids in a byte-aligned variable-length code.

A file holds at most FILE_IDS ids (and the rest of its last document). Its rank table lists the ids that occur in it,
most frequent first, ties by id. Ranks are coded in blocks of BLOCK ids: two bits an id in separate control bytes
(how many bytes follow, less one), then one to four data bytes an id, little endian. Readers look lengths up in a
table of 256 control bytes.

    8s magic, u32 ranks, u32 documents, u32 blocks, u64 ids
    u32[ranks] rank table, i64[documents] doc ids, u8[documents] 1 where the id is null, u64[documents] ids of each
    u32[blocks] data bytes of each, then for each block its control and data bytes; u32 crc32 of all before

Documents lie in ascending doc_id order (nulls first, ties by the text's hash); file names are unique to a task attempt and a
manifest lists those that count, so a task that is run again does no harm. A null or empty text has only the end id. Repeated
rows are written each. A very long text is encoded in stretches and never split between files. An empty table gives no files
and empty results. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC, BLOCK, FILE_IDS = b"BFTOKEN1", 1 << 18, 4 << 20
_HEAD = struct.Struct("<8sIIIQ")
#: Lengths of the four ids of a control byte.
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1
_MANIFEST = "shard long, part long, path string, n_docs long, n_ids long, n_bytes long"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def code_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some ranks."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    width = int(code.max(initial=0)) + 1  # bytes that any of them takes
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) <= code[:, None]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_parts(doc_ids: list[int | None], ids: list[bytes]):
    """The bytes of one file, part by part."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    counts = np.bincount(flat)  # as long as the largest id
    used = np.flatnonzero(counts)
    order = used[np.argsort(-counts[used], kind="stable")]  # ties by id
    place = np.zeros(len(counts), "<u4")
    place[order] = np.arange(len(order), dtype="<u4")
    ranks = place[flat]
    blocks = [code_block(ranks[k : k + BLOCK]) for k in range(0, len(ranks), BLOCK)]
    parts = [_HEAD.pack(MAGIC, len(used), len(ids), len(blocks), len(flat)), order.astype("<u4").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.array([len(x) // 4 for x in ids], "<u8").tobytes(), np.array([len(d) for _, d in blocks], "<u4").tobytes()]
    crc = 0
    for p in [*parts, *(x for b in blocks for x in b)]:
        crc = zlib.crc32(p, crc)
        yield p
    yield struct.pack("<I", crc)


class TokenFile:
    """A file's header, documents and blocks."""

    def __init__(self, raw: bytes):
        magic, n_rank, n_docs, n_blocks, self.n_ids = _HEAD.unpack_from(raw)
        if magic != MAGIC or zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("not a token file, or damaged")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rank = take("<u4", n_rank)
        self.doc_ids, self.null, self.n_tokens, self.sizes = take("<i8", n_docs), take(np.uint8, n_docs).astype(bool), take("<u8", n_docs).astype(np.int64), take("<u4", n_blocks)
        self.raw, self.at = memoryview(raw), at

    def ids(self) -> np.ndarray:
        """All ids of the file."""
        out, at = np.empty(self.n_ids, "<u4"), self.at
        for k, size in enumerate(self.sizes.tolist()):
            n = min(BLOCK, self.n_ids - k * BLOCK)
            c = -(-n // 4)
            out[k * BLOCK : k * BLOCK + n] = self.rank[decode_block(self.raw[at : at + c], self.raw[at + c : at + c + size], n)]
            at += c + size
        return out


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents into files below folder, in ascending doc_id order, and returns the manifest: shard and
    part (the files' order), path, n_docs, n_ids, n_bytes."""
    spark = docs.sparkSession
    common.prepare(spark)
    end = struct.pack("<I", end_id)

    def work(batches):
        from pyspark import TaskContext

        from . import files
        from .encoder import encoder

        shard, part, doc_ids, ids, total = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            size = 0

            def sized(parts):
                nonlocal size
                for p in parts:
                    size += len(p)
                    yield p

            path = files.write(folder, f"tokens-{shard:06d}-{part:04d}", sized(file_parts(doc_ids, ids)))
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": path, "n_docs": len(ids), "n_ids": total, "n_bytes": size}])

        for batch in batches:
            for rows, data, offs in common.text_slices(batch, "text"):
                found, firsts = encoder(tokenizer).encode(data, offs)
                raw, firsts = found.astype("<u4").tobytes(), (4 * firsts).tolist()
                for d, a, b in zip(rows.column(0).to_pylist(), firsts[:-1], firsts[1:], strict=True):
                    doc_ids.append(d)
                    ids.append(raw[a:b] + end)
                    total += (b - a) // 4 + 1
                    if total >= FILE_IDS:
                        yield close()
                        part, doc_ids, ids, total = part + 1, [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ranges are chosen from samples that go to the driver: ids and hashes, not texts
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return common.cut(ordered.mapInArrow(common.lean(work, "token files"), _MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files of a
    manifest; with_ids adds the ids themselves."""
    spark = manifest.sparkSession
    n = max(1, manifest.count())
    # one row a file of millions of ids: small enough for one task's running sum
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = _ROWS.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _ROWS

    def work(batches):
        from . import files

        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(files.read(path))
                ids = f.ids()
                ends = np.cumsum(f.n_tokens)
                raw = memoryview(ids.tobytes())
                for lo in range(0, len(ends), 2000):
                    e = ends[lo : lo + 2000]
                    s = e - f.n_tokens[lo : lo + 2000]
                    cols = [pa.array(f.doc_ids[lo : lo + 2000], pa.int64(), mask=f.null[lo : lo + 2000]), before + s, e - s, [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]]
                    if with_ids:
                        cols.append([ids[a:b].astype(np.int64) for a, b in zip(s, e, strict=True)])
                    yield common.batch_of(schema, *cols)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return placed.select("path", "before").repartition(n, "path").mapInArrow(common.lean(work, "token files"), out)


def shard_count(rows: DataFrame, most: int = 12 << 20) -> int:
    """Shards of about `most` stored bytes, by Spark's own estimate of a table's size (its files are not read)."""
    return max(1, -(-int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // most))
