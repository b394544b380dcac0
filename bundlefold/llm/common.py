"""What the operators share: table loading, the shared folder, Arrow batch sizes, column bytes, what workers keep."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 1 << 18
#: What tasks keep in this process for the next tasks of the same work, and which work that is.
_held: dict = {}
_work = ""


prepare = tables.bound_batches
shared_folder = tables.shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package has written, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: what follows survives lost executors without
    computing df anew, and two uses of it see the same rows."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__{n}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of an id's decimal text, modulo parts."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % parts


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and n + 1 offsets into it. Nulls are empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    n, kind = len(arr), np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, kind, n + 1, arr.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def byte_slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges (lo, hi) of rows of about `most` bytes; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Slices of a batch with the bytes and offsets of their texts."""
    data, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
    for lo, hi in byte_slices(offs, most):
        yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of an array, in order. np.unique hashes where nothing else is asked of it, which takes many
    times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def held(key, make: Callable):
    """make(), made once and kept in this process until a task of other work begins in it (see lean)."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def begin(work: str) -> None:
    """A task of some work begins: what other work has held goes, as a worker serves all steps of a job in turn and would
    else keep the tables of each of them beside those of the next."""
    global _work
    if work != _work:
        _work = work
        _held.clear()
        give_back()


def lean(work: Callable, name: str = "") -> Callable:
    """work, which goes through the batches of a task, and then gives the memory it has freed back to the system, as
    workers wait for later tasks beside the busy ones. What it holds (held) stays for its own later tasks
    alone, or for those of all work of the same name."""
    own = name or uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        begin(own)
        yield from work(batches)
        give_back()

    return run


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_kept(docs: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows of docs for which judge(rows, bytes, offsets), called with slices of whole texts, says true."""
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            data, offs = column_bytes(batch.column(at))
            for lo, hi in byte_slices(offs):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(judge(part, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), pa.bool_()))

    return docs.mapInArrow(lean(work), docs.schema)


def ragged(values: np.ndarray, firsts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32), pa.int32()), pa.array(values, kind))
