"""Benchmark decontamination (operator 3): one Aho-Corasick automaton over the windows of all test items.

Texts are lower-cased (A-Z) and read as words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is a run of `width` words
of an item; an item of fewer words, but not none, is one window. The automaton holds each distinct window once, words
parted by single spaces, and runs once over each document's words; matches lead back to word numbers and from there
to byte offsets of the original text. Above MOST bytes of windows the items are dealt to several automata, so that a
worker's memory stays bounded: a worker then gathers GATHER bytes of texts and scans them with one after the other.
The items of each group lie in the shared folder as Parquet, written by tasks; workers read them, the driver doesn't.

Null and empty texts have no words. Items that are null, empty or without words have no windows; an item with a null id
hits like any other, but isn't counted or listed; rows that repeat an item, id and text, are one, and texts of one id are
one item. An empty benchmark hits nothing, an empty table gives an empty result. Very long texts are scanned whole. Each
row of docs is judged for itself, so repeated rows are alike. Of docs only the id and the text are read; where rows are
filtered all columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 13
#: Bytes of windows in one automaton: about 40 times as much memory in a worker.
MOST = 4 << 20
#: Bytes of texts that are scanned by one automaton before the next is built, where there are several.
GATHER = 32 << 20

_LOW = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_LOW).split()


def windows(item_words: list[bytes], width: int = WIDTH) -> list[list[bytes]]:
    return [item_words[k : k + width] for k in range(max(1, len(item_words) - width + 1))] if item_words else []


def automaton(items: list[tuple[str | None, list[bytes]]], width: int):
    """An automaton whose values are (words of the window, numbers of its items), and None if there is no window."""
    import ahocorasick

    found: dict[str, tuple[int, set[int]]] = {}
    for k, (_, item_words) in enumerate(items):
        for w in windows(item_words, width):
            found.setdefault(" " + b" ".join(w).decode("latin-1") + " ", (len(w), set()))[1].add(k)
    if not found:
        return None
    out = ahocorasick.Automaton()
    for k, v in found.items():
        out.add_word(k, v)
    out.make_automaton()
    return out


def scan(machine, raw: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of a text, the runs of words [lo, hi) inside occurring windows, and the items these are from."""
    ws = raw.translate(_LOW).split()
    if not ws or machine is None:
        return len(ws), [], set()
    plain = b" " + b" ".join(ws) + b" "
    hits = list(machine.iter(plain.decode("latin-1")))
    if not hits:
        return len(ws), [], set()
    gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
    last = np.searchsorted(gaps, np.array([e for e, _ in hits]))
    step, items = np.zeros(len(ws) + 1, np.int64), set()
    for hi, (_, (n, who)) in zip(last.tolist(), hits, strict=True):
        step[hi - n] += 1
        step[hi] -= 1
        items |= who
    return len(ws), runs(np.cumsum(step[:-1]) > 0), items


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def byte_spans(raw: bytes, word_runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte offsets in the original text of runs of words."""
    w = np.frombuffer(raw.translate(_LOW), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], w.view(np.int8), [0]])))
    return [{"start": int(edge[2 * lo]), "end": int(edge[2 * hi - 1])} for lo, hi in word_runs]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Benchmark:
    """The items of a benchmark in the shared folder, dealt to groups whose windows take about MOST bytes each."""

    def __init__(self, path: str, groups: int, width: int):
        self.path, self.groups, self.width = path, groups, width

    def machine(self, group: int) -> tuple:
        """A group's automaton and the ids of its items. A lone group's is built once in a worker; of several one at a time
        is in memory."""
        return common.held(("benchmark", self.path), lambda: self._built(group)) if self.groups == 1 else self._built(group)

    def _built(self, group: int) -> tuple:
        from . import files

        items = sorted(((i, words(t)) for i, t in files.parquet_rows(f"{self.path}/group={group}", ["i", "t"])), key=lambda x: (x[0] or "", x[0] is None, x[1]))
        return automaton(items, self.width), [i for i, _ in items]

    def scans(self, raws: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text the number of words, the hit runs of words, and the ids of items hit, sorted."""
        out: list[tuple[int, list[tuple[int, int]], set]] = [(0, [], set()) for _ in raws]
        for group in range(self.groups):
            machine, names = self.machine(group)
            for k, raw in enumerate(raws):
                n, found, items = scan(machine, raw)
                if found and out[k][1]:
                    hit = np.zeros(n, bool)
                    for lo, hi in [*found, *out[k][1]]:
                        hit[lo:hi] = True
                    found = runs(hit)
                out[k] = n, found or out[k][1], out[k][2] | {names[i] for i in items if names[i] is not None}
            machine = names = None  # before the next group's is built
        return [(n, found, sorted(items)) for n, found, items in out]


def load(benchmark: DataFrame, width: int, item_col: str, item_text: str) -> Benchmark:
    spark = benchmark.sparkSession
    common.prepare(spark)
    texts = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    # a word of an item stands in `width` windows at most
    groups = -(-(texts.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()[0] * width) // MOST) or 1
    path = common.new_folder(spark, "benchmark")
    texts.withColumn("group", F.pmod(F.xxhash64("i", "t"), F.lit(groups)).cast("int")).repartition(groups, "group").write.partitionBy("group").parquet(path)
    return Benchmark(path, groups, width)


def gathered(batches, bench: Benchmark, at: int):
    """Batches, each with its texts as bytes and what bench finds in them; several together where it has several groups."""
    held, texts, size = [], [], 0

    def flush():
        found = iter(bench.scans([r for raws in texts for r in raws]))
        for batch, raws in zip(held, texts, strict=True):
            yield batch, raws, [next(found) for _ in raws]

    for batch in batches:
        data, offs = common.column_bytes(batch.column(at))
        held.append(batch)
        texts.append([data[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
        size += len(data)
        if bench.groups == 1 or size >= GATHER:
            yield from flush()
            held, texts, size = [], [], 0
    yield from flush()


_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS), ("contaminated", pa.bool_())])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), spans (byte offsets of the hit runs)
    and contaminated (n_hit > 0 and share * n_hit >= n_words). Every row of docs gives one row."""
    bench = load(benchmark, width, item_col, item_text)

    def work(batches):
        for batch, raws, found in gathered(batches, bench, 1):
            out = []
            for d, raw, (n, hit, items) in zip(batch.column(0).to_pylist(), raws, found, strict=True):
                n_hit = sum(hi - lo for lo, hi in hit)
                out.append((d, n, n_hit, len(items), items, byte_spans(raw, hit) if hit else [], bool(n_hit and share * n_hit >= n)))
            if out:
                yield common.batch_of(_HITS, *zip(*out, strict=True))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(common.lean(work), "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,end:long>>, contaminated boolean")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that benchmark_hits wouldn't call contaminated, all columns as they are; no row is shuffled."""
    bench = load(benchmark, width, item_col, item_text)
    at = docs.columns.index(text_col)

    def work(batches):
        for batch, _, found in gathered(batches, bench, at):
            n_hit = [sum(hi - lo for lo, hi in hit) for _, hit, _ in found]
            yield batch.filter(pa.array([not (h and share * h >= n) for h, (n, *_) in zip(n_hit, found, strict=True)], pa.bool_()))

    return docs.mapInArrow(common.lean(work), docs.schema)
