"""Quality classifier (operator 1): supervised subword embeddings.

A text's features are hashed words, pairs of neighbouring words (a word that follows itself is one shared feature,
whatever the word) and character 3- and 4-grams of the text's bytes with runs of white space as one space. Each
feature is a learned vector; a text is the mean of its features' vectors; a softmax over two classes follows. Training
is numpy stochastic gradient descent on a bounded sample of labelled rows: at most `most_rows` documents and
`most_bytes` of text, chosen by the hash of the id. Scoring reads every whole text. As the mean and the linear layer
commute, each feature's vector is folded into one number before scoring, and a text needs a sum of table look-ups.

Null and empty texts have no features and get the prior of the training labels. Very long texts are scored whole, a slice of
their own. Repeated rows are scored each, and alike; scores that tie need no order. A row with a null id is scored like any
other; it counts as not held out, as no remainder is 0, but no label can belong to it, so it is never learned from. An empty
table gives an empty result; without labels every score is 0.5. Of documents and labels only the id, the text and the label
are read; where rows are filtered all columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textscan import U, Words, mix

BITS, DIM, FOLDS, THRESHOLD = 18, 12, 5, 0.3
MOST_ROWS, MOST_BYTES = 4000, 24 << 20
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_REPEAT = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Groups of features of a batch's texts: for each group, the features and the n + 1 offsets of each text's."""
    shift, values, firsts = U(64 - bits), [], []
    words = Words(data, offsets, "space")
    hashes = words.hashes()
    with np.errstate(over="ignore"):
        values.append(mix(hashes ^ U(11)) >> shift)
        firsts.append(words.first)
        pair = np.zeros(len(hashes), U)
        if len(hashes) > 1:
            pair[1:] = np.where(hashes[1:] == hashes[:-1], U(_REPEAT), mix(hashes[1:] * U(3) + hashes[:-1]) >> shift)
        first_word = words.first[:-1][np.diff(words.first) > 0]
        pair[first_word] = 2  # a text's beginning
        values.append(pair)
        firsts.append(words.first)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        keep = ~space
        keep[1:] |= ~space[:-1]  # the first of a run of white space
        if len(keep):
            keep[0] = True
        at = np.flatnonzero(keep)
        low = np.where(space, 32, data)[at].astype(U)
        begin = np.searchsorted(at, offsets)
        for n in (3, 4):
            if len(low) < n:
                continue
            h = np.full(len(low) - n + 1, n, U)
            for k in range(n):
                h = (h << U(8)) | low[k : k + len(h)]
            h = (h * U(0x9E3779B97F4A7C15)) >> shift
            # n-grams that would run into the next text are counted with none
            first = np.minimum(begin, len(h))
            last = np.minimum(np.maximum(begin[1:] - n + 1, begin[:-1]), len(h))
            inside = np.zeros(len(h) + 1, np.int64)
            np.add.at(inside, first[:-1], 1)
            np.add.at(inside, last, -1)
            keep_h = np.cumsum(inside[:-1]) > 0
            values.append(h[keep_h])
            firsts.append(np.concatenate([[0], np.cumsum(last - first[:-1])]))
    return values, firsts


def _sums(table: np.ndarray, values: list[np.ndarray], firsts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of its features' numbers, and how many features it has."""
    total, n = np.zeros(len(firsts[0]) - 1), np.zeros(len(firsts[0]) - 1)
    for v, f in zip(values, firsts, strict=True):
        c = np.concatenate([[0.0], np.cumsum(table[v], dtype=np.float64)])
        total += c[f[1:]] - c[f[:-1]]
        n += np.diff(f)
    return total, n


class Model:
    """One number for each hashed feature, and the logit of a text without features."""

    def __init__(self, table: np.ndarray, prior: float):
        self.table, self.prior = table, prior

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, n = _sums(self.table, *features(data, offsets))
        logit = np.where(n > 0, total / np.maximum(n, 1) + self.prior, self.prior)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(texts: list[bytes], labels: np.ndarray, **how) -> Model:
    """The model of some labelled texts, its vectors folded."""
    if not len(labels):
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    vectors, out, bias = fit(texts, labels, **how)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 6, rate: float = 3.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent, a text a step, its features' counts as weights, the rate falling to 0. Returns the
    features' vectors, the classes' and their biases."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    rows = []
    for t in texts:
        values, _ = features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        f, c = np.unique(np.concatenate(values), return_counts=True)
        rows.append((f.astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.array([0.0, prior], np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, w = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(f):
                continue
            x = vectors[f]
            mean = w @ x
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # the gradient of the softmax's input
            back = p @ out
            out -= lr * 0.2 * np.outer(p, mean)
            vectors[f] -= (lr * w * min(len(f), 300))[:, None] * back
    return vectors, out, bias


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], list[int]]:
    """Texts and labels of the sample: ids in the order of their hash; a text that would pass most_bytes is skipped and
    those after it are still taken. Rows that repeat an id and text count once. Null labels, ids and texts, rows held
    out, and ids with two labels are left out."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2").where(common.fold("doc_id", FOLDS) != 0)
    chosen = marked.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id")  # most_rows rows at most
    rows = rows.distinct().select("h", "doc_id", "y", F.col("text").cast("binary").alias("t"), F.octet_length("text").cast("long").alias("n"))
    sized = common.cut(rows.withColumn("row", F.monotonically_increasing_id()), "training")
    total, fit = 0, []
    for r in sized.select("h", "doc_id", "n", "row").orderBy("h", "doc_id", "n", "row").toLocalIterator():
        if total + r["n"] <= most_bytes:
            total += r["n"]
            fit.append((r["row"],))
    picked = docs.sparkSession.createDataFrame(fit, "row long")
    got = sized.join(F.broadcast(picked), "row").select("h", "doc_id", "y", "t").collect()
    got.sort(key=lambda r: (r["h"], r["doc_id"], r["t"]))
    return [bytes(r["t"]) for r in got], [r["y"] for r in got]


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, training: dict):
    """The model of some labels, for the tasks: 2**BITS numbers, whatever the corpus."""
    common.prepare(docs.sparkSession)
    model = train(*training_rows(docs, labels, id_col=id_col, text_col=text_col, **training))
    return docs.sparkSession.sparkContext.broadcast((model.table, model.prior))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, by a model trained on labels."""
    shared = _fitted(docs, labels, id_col, text_col, training)

    def work(batches):
        m = Model(*shared.value)
        for batch in batches:
            for part, data, offs in common.text_slices(batch, "text"):
                s = m.scores(data, offs)
                yield common.batch_of(_OUT, part.column(0), part.column(2), s, (s >= threshold).astype(np.int32))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(common.fold(id_col, FOLDS) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(common.lean(work), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns as they are; no row is shuffled."""
    shared = _fitted(docs, labels, id_col, text_col, training)

    def judge(part, data, offs):
        return Model(*shared.value).scores(data, offs) >= threshold

    return common.rows_kept(docs, text_col, judge)
