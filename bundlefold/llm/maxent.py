"""Language-model scores (operator 7): a hashed maximum-entropy model with a class-factored softmax.

Texts are lower-cased (A-Z) and read as words [^\\x20\\x09-\\x0D]+ and one end token. Words are counted over all training
texts by their 64-bit hash. The HEAD most frequent words have ids of their own; any other word has the id of its last
three bytes' bucket. Ids are clustered by the tokens before them (k-means on counts over all training texts) into
CLASSES classes, so every token, known or not, has a class.

    P(token | history) = P(class | history) * P(token | class)

P(class | history) is a softmax over hashed features of the history: the token before (bigram), the two before
(trigram), and the one before the last alone (skip). Its weights are trained by distributed gradient updates: tasks run
Adagrad over their training texts and return weights, which are averaged feature by feature by how often each task met
the feature; two rounds cover every training text once. P(token | class) is a softmax of one weight a token whose
optimum is known: (count + 0.1) / (class tokens + 0.1 * (class types + 1)), the last for tokens never seen.

What goes to the driver or to every task has a fixed size (HEAD, CLASSES, FEATURES); the counts themselves stay in a
table that grows with the corpus, and rarer words meet their counts in a join. So the histories' weights have a fixed
capacity at every size (the README gives held-out figures at growing sizes), and no feature of the history reaches below
the class. Classes are fitted on the 8,192 most frequent ids; any other id is put into the nearest.

Null and empty texts have the end token only. Very long texts are read whole, a slice of their own. Repeated rows count and
are scored each. Rows with a null id count as held out, as they have no remainder and must not be learned from. Words that
tie for the last place among the HEAD stay out together. An empty table gives an empty result; without training texts
every token is unknown. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textscan import U, Words, mix

FOLDS, SMOOTH = 10, 0.1
HEAD, TAILS, CLASSES, CONTEXTS = 57344, 8191, 24, 32
IDS = HEAD + TAILS + 1  # 65,536: ids fit in two bytes; the last stands before a text
START = IDS - 1
FEATURES, PARTS = 1 << 16, 64
#: The end token's hash: no word's, as words are hashed with their lengths (and if one had it, it would count as the end).
END = U(0x5DEECE66D1234567)
_FLUSH = 1 << 21
#: Tasks whose blobs are added up in a step.
FAN_IN = 32
#: Counts below which a word's rank is told exactly; above, in 64 steps to each doubling.
EXACT = 4096
_COUNTS = pa.schema([("h", pa.int64()), ("tail", pa.int32()), ("n", pa.int64())])
_IDS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("head_log", pa.float64()), ("known", pa.int64()), ("ids", pa.binary()), ("tail", pa.list_(pa.int64()))])
_BLOB = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def _tail_bucket(words: Words) -> np.ndarray:
    return (mix(words.tails(3)) % U(TAILS)).astype(np.int32)


def word_counts(texts: DataFrame) -> DataFrame:
    """h, tail, n: the tokens of a column text, counted in each task before the shuffle."""

    def work(batches):
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, ends = 0, 0

        def merged():
            h, t, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(h, kind="stable")
            h, t, n = h[order], t[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[at], t[at], np.add.reduceat(n, at)

        for batch in batches:
            for part, data, offs in common.text_slices(batch, "text"):
                ends += part.num_rows
                words = Words(data, offs, "space")
                if not len(words):
                    continue
                h, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                kept.append((h, _tail_bucket(words)[at], n))
                held += len(h)
                if held > _FLUSH:
                    kept[:] = [merged()]
                    held = len(kept[0][0])
                    if held > _FLUSH // 2:
                        yield from _count_batches(*kept[0])
                        kept.clear()
                        held = 0
        if kept:
            yield from _count_batches(*merged())
        if ends:
            yield common.batch_of(_COUNTS, [int(END.astype(np.int64))], [0], [ends])

    return texts.mapInArrow(common.lean(work), "h long, tail int, n long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _count_batches(h, t, n):
    for k in range(0, len(h), 1 << 16):
        yield common.batch_of(_COUNTS, h[k : k + (1 << 16)].view(np.int64), t[k : k + (1 << 16)], n[k : k + (1 << 16)].astype(np.int64))


class Head:
    """The most frequent words: hashes in order, their ids (0: the most frequent) and log10(count + 0.1)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.ids, self.log = hashes[order], order.astype(np.uint16), np.log10(counts[order] + SMOOTH)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the head's hashes, and whether each hash is there."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


def id_table(docs: DataFrame, head) -> DataFrame:
    """Each text's ids (two bytes each), the sum of log10(count + 0.1) over its head words, and its other words."""

    def work(batches):
        table = head.value
        end_at, end_in = table.find(np.array([END], U))
        for batch in batches:
            for part, data, offs in common.text_slices(batch, "text"):
                words = Words(data, offs, "space")
                h = words.hashes()
                at, known = table.find(h)
                ids = np.where(known, table.ids[at] if len(table.ids) else 0, HEAD + _tail_bucket(words)).astype("<u2")
                log = np.where(known, table.log[at] if len(table.log) else 0.0, 0.0)
                first = words.first + np.arange(len(words.first))
                out = np.empty(first[-1], "<u2")
                inside = np.ones(len(out), bool)
                inside[first[1:] - 1] = False
                out[inside] = ids
                out[~inside] = table.ids[end_at[0]] if end_in[0] else HEAD
                sums = np.concatenate([[0.0], np.cumsum(log)])
                kn = np.concatenate([[0], np.cumsum(known)])
                rest = np.concatenate([[0], np.cumsum(~known)])[words.first]
                blob = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * 2).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
                yield common.batch_of(
                    _IDS, part.column(0), part.column(2), np.diff(first),
                    sums[words.first[1:]] - sums[words.first[:-1]] + (table.log[end_at[0]] if end_in[0] else np.log10(SMOOTH)),
                    kn[words.first[1:]] - kn[words.first[:-1]] + int(end_in[0]), blob, common.ragged(h[~known].view(np.int64), rest, pa.int64()),
                )

    return docs.mapInArrow(common.lean(work), "doc_id long, held_out boolean, n_tokens long, head_log double, known long, ids binary, tail array<long>")


def histories(batch: pa.RecordBatch, column: str, most: int):
    """Runs of whole texts of about `most` tokens: first row, offsets, ids, the id before each and the one before that."""
    data, offs = common.column_bytes(batch.column(batch.schema.get_field_index(column)))
    for lo, hi in common.byte_slices(offs, 2 * most):
        ids = data[offs[lo] : offs[hi]].view("<u2").astype(np.int64)
        first = (offs[lo : hi + 1] - offs[lo]) // 2
        before = np.full(len(ids), START)
        before[1:] = ids[:-1]
        at = first[:-1][first[:-1] < len(ids)]
        before[at] = START
        earlier = np.full(len(ids), START)
        earlier[1:] = before[:-1]
        earlier[at] = START
        yield lo, first, ids, before, earlier


def hashed(before: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    """The features of each token's history: bigram, trigram and skip."""
    a, b = before.astype(U), earlier.astype(U)
    return [(mix(x) % U(FEATURES)).astype(np.int64) for x in (a | U(1 << 40), (a << U(16)) | b | U(2 << 40), b | U(3 << 40))]


def frequent(counts: DataFrame, most: int) -> list:
    """The most frequent words, `most` at most, the end token first: h and n by falling n and rising h. Words that tie (or,
    above EXACT, are nearly as frequent) stay out together where they don't all fit. The driver is sent a histogram of
    bounded size and the words themselves, never `most` words of each task."""
    level = F.when(F.col("n") < EXACT, F.col("n")).otherwise(EXACT + F.floor(F.log2(F.col("n") / EXACT) * 64)).cast("long")
    end = F.col("h") == int(END.astype(np.int64))
    at, left = 0, most - 1
    for r in counts.where(~end).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # EXACT + 64 * 64 rows at most
        left -= r["count"]
        if left < 0:
            at = r["level"]
            break
    chosen = counts.where(end | (level > at)).select("h", "n").collect()
    return sorted(chosen, key=lambda r: (r["h"] != int(END.astype(np.int64)), -r["n"], r["h"]))


def sum_blobs(rows: DataFrame, kind: str, tasks: int) -> dict[int, np.ndarray]:
    """Adds up the blobs of some tasks part by part, in a tree whose steps add up FAN_IN tasks each; every step keeps one
    running sum a part. The result has a fixed size."""

    def work(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(b.as_buffer(), kind)
                total[p] = total[p] + x if p in total else x.copy()
        for p, x in total.items():
            yield common.batch_of(_BLOB, [p], [x.tobytes()])

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        group = F.pmod(F.spark_partition_id(), F.lit(tasks))
        rows = rows.withColumn("group", group).repartition(PARTS * tasks, "part", "group").drop("group").mapInArrow(common.lean(work), "part int, blob binary")
    got = rows.repartition(PARTS, "part").mapInArrow(common.lean(work), "part int, blob binary").collect()
    return {r["part"]: np.frombuffer(r["blob"], kind) for r in got}


def _blobs(x: np.ndarray):
    size = -(-len(x) // PARTS)
    for p in range(PARTS):
        if x[p * size : (p + 1) * size].any():
            yield common.batch_of(_BLOB, [p], [np.ascontiguousarray(x[p * size : (p + 1) * size]).tobytes()])


def _joined(parts: dict[int, np.ndarray], rows: int, width: int) -> np.ndarray:
    size = -(-rows // PARTS)
    kind = next(iter(parts.values())).dtype if parts else np.float32
    out = np.zeros((size * PARTS, width), kind)
    for p, x in parts.items():
        out[p * size : p * size + len(x) // width] = x.reshape(-1, width)
    return out[:rows]


def neighbour_counts(ids: DataFrame, tasks: int = 1) -> np.ndarray:
    """How often each id follows an id of each of CONTEXTS hashed contexts."""

    def work(batches):
        total = np.zeros(IDS * CONTEXTS, np.float32)
        for batch in batches:
            for _, _, token, before, _ in histories(batch, "ids", 1 << 18):
                bucket = (mix(before.astype(U) + U(99)) % U(CONTEXTS)).astype(np.int64)
                at, n = np.unique(token * CONTEXTS + bucket, return_counts=True)
                total[at] += n
        yield from _blobs(total.reshape(IDS, CONTEXTS))

    return _joined(sum_blobs(ids.select("ids").mapInArrow(common.lean(work), "part int, blob binary"), "<f4", tasks), IDS, CONTEXTS)


def cluster(counts: np.ndarray, classes: int = CLASSES, rounds: int = 20) -> np.ndarray:
    """A class for each id: weighted k-means on square roots of the contexts' shares. Ids never met are in class 0."""
    weight = counts.sum(axis=1).astype(np.float64)
    x = np.sqrt(counts / np.maximum(weight, 1)[:, None]).astype(np.float32)
    often = np.argsort(-weight, kind="stable")[:8192]
    often = often[weight[often] > 0]
    out = np.zeros(len(counts), np.int64)
    if not len(often):
        return out
    rng = np.random.default_rng(3)
    near = np.full(len(often), np.inf)
    centres = [x[often[0]]]
    for _ in range(min(classes, len(often)) - 1):
        near = np.minimum(near, ((x[often] - centres[-1]) ** 2).sum(axis=1))
        p = near * np.sqrt(weight[often])
        if p.sum() <= 0:
            break
        centres.append(x[often[rng.choice(len(often), p=p / p.sum())]])
    c = np.array(centres)
    for _ in range(rounds):
        label = np.argmin((c**2).sum(axis=1) - 2 * x[often] @ c.T, axis=1)
        for k in range(len(c)):
            if (m := label == k).any():
                c[k] = np.average(x[often[m]], axis=0, weights=weight[often[m]])
    label = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
    out[weight > 0] = label[weight > 0]
    return out


def log_softmax(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    z = weights[features[0]]
    for f in features[1:]:
        z += weights[f]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def gradient_round(ids: DataFrame, shared, step: int, rate: float = 0.7, tasks: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights after each task's Adagrad over its texts, averaged by how often tasks met each feature."""

    def work(batches):
        weights, squares, of = (x.copy() for x in shared.value)
        met = np.zeros(FEATURES, np.float32)
        lane, any_row = np.arange(CLASSES), False
        for batch in batches:
            for _, _, token, before, earlier in histories(batch, "ids", step):
                for k in range(0, len(token), 2 * step):
                    fs = hashed(before[k : k + 2 * step], earlier[k : k + 2 * step])
                    y = of[token[k : k + 2 * step]]
                    p = np.exp(log_softmax(weights, fs))
                    p[np.arange(len(y)), y] -= 1
                    flat = p.ravel()
                    grad = np.zeros(FEATURES * CLASSES, np.float64)
                    for f in fs:
                        grad += np.bincount((f[:, None] * CLASSES + lane).ravel(), flat, FEATURES * CLASSES)
                        met += np.bincount(f, minlength=FEATURES)
                    grad = grad.reshape(FEATURES, CLASSES).astype(np.float32)
                    squares += grad * grad
                    weights -= rate * grad / np.sqrt(squares + 1e-2)
                    any_row = True
        if any_row:
            yield from _blobs(np.concatenate([weights * met[:, None], squares * (met > 0)[:, None], met[:, None]], axis=1))

    width = 2 * CLASSES + 1
    total = _joined(sum_blobs(ids.select("ids").mapInArrow(common.lean(work), "part int, blob binary"), "<f4", tasks), FEATURES, width)
    met = total[:, -1:]
    old = shared.value
    weights = np.where(met > 0, total[:, :CLASSES] / np.maximum(met, 1), old[0]).astype(np.float32)
    return weights, np.where(met > 0, total[:, CLASSES:-1], old[1]).astype(np.float32)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs. head_size: how many
    words have ids of their own, HEAD at most."""
    spark = docs.sparkSession
    common.prepare(spark)
    sc = spark.sparkContext
    held = F.coalesce(common.fold(id_col, FOLDS) == 0, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held_out"))
    counts = common.cut(word_counts(rows.where(~F.col("held_out")).select("text")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(END.astype(np.int64))
    top = frequent(counts, head_size)
    head = Head(np.array([r["h"] for r in top], np.int64).view(U), np.array([r["n"] for r in top], np.float64))
    least = min((r["n"] for r in top if r["h"] != end), default=None)
    rare = counts.where((F.col("h") != end) & (F.lit(True) if least is None else F.col("n") < least))

    table = common.cut(id_table(rows, sc.broadcast(head)).withColumn("row", F.monotonically_increasing_id()), "ids")
    # tasks of two million tokens or more learn better than many small ones
    tasks = max(1, n // 2_000_000)
    train = table.where("not held_out").select("doc_id", "ids").coalesce(tasks)
    of = cluster(neighbour_counts(train, tasks)) if n else np.zeros(IDS, np.int64)

    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, r in enumerate(top):
        class_n[of[k]] += r["n"]
        class_v[of[k]] += 1
    for r in rare.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # TAILS rows at most
        class_n[of[HEAD + r["tail"]]] += r["n"]
        class_v[of[HEAD + r["tail"]]] += r["v"]
    inside = np.log10(class_n + SMOOTH * (class_v + 1))

    state = (np.zeros((FEATURES, CLASSES), np.float32), np.zeros((FEATURES, CLASSES), np.float32))
    step = int(np.clip(n // 400, 512, 1 << 15))
    first = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    for part in (train.where(first), train.where(~first)) if n else ():
        state = gradient_round(part, sc.broadcast((*state, of)), step, tasks=tasks)
    model = sc.broadcast((state[0], of, inside))
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("head_log", pa.float64()), ("known", pa.int64()), ("in_class", pa.float64())])

    def score(batches):
        weights, of, inside = model.value
        for batch in batches:
            col = lambda name: batch.column(batch.schema.get_field_index(name))
            sums = np.zeros(batch.num_rows)
            for lo, first, token, before, earlier in histories(batch, "ids", 1 << 15):
                each = np.empty(len(token))
                for k in range(0, len(token), 1 << 16):
                    y = of[token[k : k + (1 << 16)]]
                    z = log_softmax(weights, hashed(before[k : k + (1 << 16)], earlier[k : k + (1 << 16)]))
                    each[k : k + (1 << 16)] = z[np.arange(len(y)), y] / np.log(10) - inside[y]
                total = np.concatenate([[0.0], np.cumsum(each)])
                sums[lo : lo + len(first) - 1] = total[first[1:]] - total[first[:-1]]
            yield common.batch_of(out, *(col(c) for c in ("row", "doc_id", "held_out", "n_tokens", "head_log", "known")), sums)

    scored = table.drop("tail").mapInArrow(common.lean(score), "row long, doc_id long, held_out boolean, n_tokens long, head_log double, known long, in_class double")
    met = table.select("row", F.explode("tail").alias("h")).join(rare.select("h", "n"), "h", "left")
    met = met.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("tail_log"), F.count("n").alias("tail_known"))
    whole = scored.join(met, "row", "left").withColumn("log", F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log") - F.col("n_tokens") * float(np.log10(n + SMOOTH * (v + 1)))).alias("base_score"),
        (F.col("log") + F.col("in_class")).alias("score"),
    )
