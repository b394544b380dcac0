"""Sequence packing (operator 4): shortest-pack-first over the length histogram.

Each document's ids (and an end id) are cut into full sequences and a rest. The histogram of piece lengths (at most
`size` rows, whatever the corpus) is packed on the driver: lengths longest first, each into the packs that are
shortest so far, counts of equal packs moved together. The resulting patterns go back to the pieces by rank: a piece
knows its rank among the pieces of its length, and the patterns say which ranks of a length lie in which sequences.

Ranks come from a salted window: counts by (length, bucket) give each bucket's first rank, so that no length, however
frequent, lies in one task. A bucket has PER_BUCKET pieces at most, save by chance.

Null and empty texts have the end id only. Repeated rows are packed each, rows with a null id too. A very long text is encoded
in stretches and cut into several pieces. Pieces that tie go by id, start and checksum; those alike in all stand for each
other. An empty table gives an empty result. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE = 4096
#: Pieces of one length that one task ranks.
PER_BUCKET = 2_000
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, their lengths in falling order), from how many pieces there are of each length.

    There are at most two patterns more for each length than before it: packs of one pattern are moved together, and
    only the last of those touched is split."""
    packs: list[tuple[int, int, tuple[int, ...], int]] = []  # filled, order, lengths, how many
    order = 0
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, touched = counts[length], []
        while left:
            if packs and packs[0][0] + length <= size:
                filled, _, lengths, n = heapq.heappop(packs)
                put = min(n, left)
                if put < n:
                    order += 1
                    heapq.heappush(packs, (filled, order, lengths, n - put))
                touched.append((filled + length, (*lengths, length), put))
                left -= put
            elif touched:
                for filled, lengths, n in touched:
                    order += 1
                    heapq.heappush(packs, (filled, order, lengths, n))
                touched = []
                if packs[0][0] + length > size:
                    continue
            else:
                order += 1
                touched.append((length, (length,), left))
                left = 0
        for filled, lengths, n in touched:
            order += 1
            heapq.heappush(packs, (filled, order, lengths, n))
    return [(n, lengths) for _, _, lengths, n in sorted(packs)]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length and each pattern that holds it: the first rank, the first sequence, how many of the length a
    sequence holds, and the offset of the first of them. Sorted by length and rank."""
    rows, used, base = [], {}, 0
    for n, lengths in patterns:
        at = 0
        for length in sorted(set(lengths), reverse=True):
            m = lengths.count(length)
            rows.append((length, used.get(length, 0), base, m, at))
            used[length] = used.get(length, 0) + n * m
            at += m * length
        base += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), a.T, strict=True))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids cut into pieces of at most `size`: doc_id, start, length, ids_crc32, doc_tokens."""
    common.prepare(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def work(batches):
        from .encoder import encoder

        for batch in batches:
            for rows, data, offs in common.text_slices(batch, "text"):
                out = []
                ids, firsts = encoder(tokenizer).encode(data, offs)
                raw, firsts = ids.astype("<u4").tobytes(), (4 * firsts).tolist()
                for d, a, b in zip(rows.column(0).to_pylist(), firsts[:-1], firsts[1:], strict=True):
                    x = raw[a:b] + end
                    n = len(x) // 4
                    out += [(d, s, min(size, n - s), zlib.crc32(x[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                yield common.batch_of(_PIECES, *zip(*out, strict=True))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(common.lean(work, tokenizer), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = PER_BUCKET) -> DataFrame:
    """The pieces with the sequence and the offset in it that each is given. Sequences are filled from offset 0
    without gaps, up to `size`."""
    cut = common.cut(pieces(docs, tokenizer, end_id, size, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    buckets = max(1, -(-max(histogram.values(), default=0) // per_bucket))
    key = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    first = key.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = key.withColumn("inside", inside).join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("inside"))
    table = docs.sparkSession.sparkContext.broadcast(slots(pack_histogram(histogram, size)))  # bounded by `size` alone
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches):
        t = table.value
        key = (t["length"] << 44) + t["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            after = rank - t["rank"][at]
            sequence, offset = t["sequence"][at] + after // t["each"][at], t["offset"][at] + after % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in _PIECES), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.select(*[f.name for f in _PIECES], "rank").mapInArrow(common.lean(place, tokenizer), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
