"""WARC files and their Merkle fixity audit (operator 9).

write_warc writes pages as WARC/1.1 files, a gzip member a record, in the order of page ids. Its index lists each
record's file, ordinal, offset and length. An audit hashes, for each replica of a file, the byte range of every record
(and what follows the last) into leaves, and runs of FAN nodes into the nodes above, each with the range it covers, up
to one root a file; that happens where the file is read, one task a file. Roots of two replicas are joined, then only
the children of nodes that differ, level by level, until the damaged records are left. Bytes that a file has beyond its
records, and files that the index doesn't know, are told too.

A null page is an empty payload, a null URL leaves its header out, null ids leave theirs out. Repeated rows are records
each; pages that share id and URL lie in the order of their html. A long page is a record like any other, held whole by
one task. A file that a replica lacks counts as empty: all of its records differ, and reading gives records without
payload that aren't intact, as it does for members that are damaged or cut off. An empty table has no files and gives
empty results. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FAN, FILE_BYTES, WINDOW = 16, 32 << 20, 1 << 13
_INDEX = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())])
_NODES = pa.schema([("file", pa.string()), ("level", pa.int32()), ("node", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())])
_RECORDS = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())])


def record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """One record as a gzip member, the same on every machine."""
    digest = hashlib.sha256(payload).hexdigest()
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:sha256:{hashlib.sha256(f'{page_id} {url} {digest}'.encode()).hexdigest()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + payload + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str, shards: int, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages below folder and returns the index: file, n_records, ordinal, offset, length, page_id."""
    common.prepare(pages.sparkSession)

    def work(batches):
        from pyspark import TaskContext

        from . import files

        shard, part, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            name = files.write(folder, f"pages-{shard:06d}-{part:04d}.warc.gz", held).rpartition("/")[2]
            at = [0]
            for r in held:
                at.append(at[-1] + len(r))
            for k in range(0, len(ids), 10_000):
                m = len(ids[k : k + 10_000])
                yield common.batch_of(_INDEX, [name] * m, [len(ids)] * m, range(k, k + m), at[k : k + m], [len(r) for r in held[k : k + m]], ids[k : k + m])

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = record(page_id, url, (html or "").encode())
                held.append(r)
                ids.append(page_id)
                size += len(r)
                if size >= file_bytes:
                    yield from close()
                    part, held, ids, size = part + 1, [], [], 0
        if held:
            yield from close()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    ordered = rows.repartitionByRange(shards, "page_id", "url").sortWithinPartitions("page_id", "url", "html")
    return common.cut(ordered.mapInArrow(common.lean(work), "file string, n_records long, ordinal long, offset long, length long, page_id long"), "warc-index")


def _dealt(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files dealt to tasks: the rows that name them are few and small, so Spark would put them into one. Few files have
    some three tasks each, so that two seldom meet; many have a task for eight."""
    n = index.select("file").distinct().count()
    return files.repartition(max(1, min(3 * n, max(4096, n // 8))), "file")


def _files(index: DataFrame) -> DataFrame:
    """One row a file, with its records' lengths in order; records of one file are bounded by its size."""
    return _dealt(index.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", "length"))).alias("records")), index)


def parse(member: bytes) -> tuple[int | None, str | None, bytes | None, bool]:
    """page_id, url, payload and whether it is intact, of one record's gzip member; a damaged one has what could be read."""
    unpack, text, at = zlib.decompressobj(31), [], 0
    try:
        while at < len(member) and not unpack.eof:
            text.append(unpack.decompress(memoryview(member)[at : at + WINDOW]))
            at += WINDOW
        head, _, body = b"".join(text).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        payload = body[: int(fields[b"Content-Length"])]
        page, url = fields.get(b"X-Page-ID"), fields.get(b"WARC-Target-URI")
        whole = unpack.eof and not unpack.unused_data and at >= len(member)
        digest = f"sha256:{hashlib.sha256(payload).hexdigest()}".encode()
        return None if page is None else int(page), None if url is None else url.decode(), payload, bool(whole and fields[b"WARC-Payload-Digest"] == digest)
    except (zlib.error, ValueError, KeyError):
        return None, None, None, False


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """Every record of an index, as the files in folder have it: file, ordinal, page_id, url, payload, and whether it is
    intact: a whole member whose payload has the digest that its header gives."""
    common.prepare(index.sparkSession)

    def work(batches):
        from . import files

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    raw = files.read(f"{folder}/{name}")
                except FileNotFoundError:
                    raw = b""
                at, out, held = 0, [], 0
                for r in records:
                    out.append((name, r["ordinal"], *parse(raw[at : at + r["length"]])))
                    at, held = at + r["length"], held + len(out[-1][4] or b"")
                    if held > common.SLICE_BYTES or len(out) == 2000:
                        yield common.batch_of(_RECORDS, *zip(*out, strict=True))
                        out, held = [], 0
                if out:
                    yield common.batch_of(_RECORDS, *zip(*out, strict=True))

    return _files(index).mapInArrow(common.lean(work), "file string, ordinal long, page_id long, url string, payload binary, intact boolean")


def copy_replica(index: DataFrame, source: str, target: str, damaged: str = "false") -> DataFrame:
    """Copies the files of an index to another folder; of each record for which `damaged`, a SQL condition on the index,
    holds, one byte is changed on the way (for drills). Returns the files copied."""
    marked = index.withColumn("hurt", F.expr(damaged))
    per_file = marked.groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("hurt"), F.col("offset") + F.expr("length div 2")))).alias("spots"))

    def work(batches):
        from . import files

        for batch in batches:
            for name, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = bytearray(files.read(f"{source}/{name}"))
                for s in spots:
                    raw[s] ^= 0x20
                path = files.write(target, name, [bytes(raw)])
                files.rename(path, f"{target}/{name}")
                yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [len(raw)]})

    return common.cut(_dealt(per_file, index).mapInArrow(common.lean(work), "file string, n_bytes long"), "replica")


def tree(raw: bytes, lengths: list[int]) -> list[list[tuple[int, int, bytes]]]:
    """Levels of (start, end, hash), leaves first: a leaf a record and one for what follows the last."""
    level, at = [], 0
    for n in [*lengths, max(0, len(raw) - sum(lengths))]:
        level.append((at, at + n, hashlib.sha256(b"\0" + struct.pack("<QQ", at, at + n) + raw[at : at + n]).digest()))
        at += n
    levels = [level]
    while len(level) > 1:
        level = [(r[0][0], r[-1][1], hashlib.sha256(b"\1" + struct.pack("<QQ", r[0][0], r[-1][1]) + b"".join(h for *_, h in r)).digest()) for r in (level[k : k + FAN] for k in range(0, len(level), FAN))]
        levels.append(level)
    return levels


def replica_trees(index: DataFrame, folder: str) -> DataFrame:
    """The nodes of the trees over the files of an index, as a replica in folder has them."""

    def work(batches):
        from . import files

        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    raw = files.read(f"{folder}/{name}")
                except FileNotFoundError:
                    raw = b""
                for k, level in enumerate(tree(raw, [r["length"] for r in records])):
                    for lo in range(0, len(level), 10_000):
                        starts, ends, hashes = zip(*level[lo : lo + 10_000], strict=True)
                        yield common.batch_of(_NODES, [name] * len(starts), [k] * len(starts), range(lo, lo + len(starts)), starts, ends, hashes)

    path = common.new_folder(index.sparkSession, "trees")
    _files(index).mapInArrow(common.lean(work), "file string, level int, node long, start long, end long, hash binary").write.partitionBy("level").parquet(path)
    return index.sparkSession.read.schema("file string, node long, start long, end long, hash binary, level int").parquet(path)


def differing_ranges(index: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The leaves in which two replicas differ: file, ordinal, start, end (of the left). Trees are compared from the
    roots down; of a level, only children of nodes that differ are joined."""
    most = index.agg(F.max("n_records")).first()[0]
    height = 0
    while most and FAN**height < most + 1:
        height += 1
    pick = lambda nodes, k: nodes.where(F.col("level") == k).select("file", "node", "start", "end", "hash")
    # a file of few records has its root on a lower level: each file's search begins there
    tops = index.select("file", "n_records").distinct().withColumn("top", F.lit(0).cast("int"))
    for k in range(height):
        tops = tops.withColumn("top", F.when(F.col("n_records") + 1 > FAN**k, k + 1).otherwise(F.col("top")))
    found = None
    for k in range(height, -1, -1):
        roots = tops.where(F.col("top") == k).select("file", F.lit(0).cast("long").alias("node"))
        ask = roots if found is None else roots.unionByName(found.select("file", F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1)).alias("node")))
        a, b = pick(left, k), pick(right, k).select("file", "node", F.col("hash").alias("other"), F.col("end").alias("other_end"))
        found = ask.join(a, ["file", "node"]).join(b, ["file", "node"], "left").where("other is null or hash <> other")
    return found.select("file", F.col("node").alias("ordinal"), "start", F.greatest("end", "other_end").alias("end"))


def strays(index: DataFrame, folder: str) -> DataFrame:
    """file and n_bytes of the files in folder that an index doesn't know."""

    def work(batches):
        from . import files

        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = files.names(at)
                for lo in range(0, len(found), 10_000):
                    name, size = zip(*found[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(size, pa.int64())], ["file", "n_bytes"])

    listed = index.sparkSession.createDataFrame([(folder,)], "folder string").mapInArrow(work, "file string, n_bytes long")
    return listed.join(index.select("file").distinct(), "file", "left_anti").where("not startswith(file, '.') and not startswith(file, '_')")


def audit(index: DataFrame, left_folder: str, right_folder: str) -> DataFrame:
    """Every record of an index with whether two replicas of it differ: page_id, file, ordinal, offset, length, damaged.
    Damaged rows without a page id tell what only one replica has: what follows the last record of a file (its ordinal is
    the number of records), and whole files (without an ordinal)."""
    found = differing_ranges(index, replica_trees(index, left_folder), replica_trees(index, right_folder))
    hurt = found.select("file", "ordinal", F.lit(True).alias("damaged"), "start", "end")
    records = index.select("file", "ordinal", "page_id", "offset", "length").join(hurt, ["file", "ordinal"], "full")
    told = records.select("page_id", "file", "ordinal", F.coalesce("offset", "start").alias("offset"), F.coalesce("length", F.col("end") - F.col("start")).alias("length"), F.coalesce("damaged", F.lit(False)).alias("damaged"))
    extra = strays(index, left_folder).unionAll(strays(index, right_folder)).groupBy("file").agg(F.max("n_bytes").alias("n"))
    null = F.lit(None).cast("long")
    return told.unionByName(extra.select(null.alias("page_id"), "file", null.alias("ordinal"), F.lit(0).cast("long").alias("offset"), F.col("n").alias("length"), F.lit(True).alias("damaged")))
