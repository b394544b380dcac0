"""Files of our own formats in the shared folder: written whole under another name, then renamed."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write(folder: str, name: str, parts) -> str:
    """Writes byte strings as one file and returns its path. The name is unique to this attempt, so a repeated task
    leaves a file that nothing refers to."""
    store, at = _at(folder)
    store.create_dir(at, recursive=True)
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}.tmp") as out:
        for p in parts:
            out.write(p)
    store.move(f"{path}.tmp", path)
    return f"{folder}/{path.rpartition('/')[2]}"


def rename(path: str, to: str) -> None:
    store, at = _at(path)
    store.move(at, _at(to)[1])


def opened(path: str):
    store, at = _at(path)
    return store.open_input_file(at)


def read(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def names(folder: str) -> list[tuple[str, int]]:
    """Names and sizes of the files that lie in a folder itself; none where there is no such folder."""
    store, at = _at(folder)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File)


def parquet_rows(folder: str, columns: list[str]):
    """Rows of the Parquet files that a Spark job has written into a folder; none where there is no such folder."""
    import pyarrow.parquet as pq

    store, at = _at(folder)
    for name, _ in names(folder):
        if name.endswith(".parquet"):
            for batch in pq.ParquetFile(store.open_input_file(f"{at}/{name}")).iter_batches(columns=columns):
                yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
