"""Operator 7's training rounds and scores against loops over tokens."""

import math
import random
import zlib

import numpy as np
from bundlefold.llm import maxent as M


def by_hand(rows, state, of, rate=0.7):
    """One Adagrad step over all tokens of some texts: weights and squares."""
    weights, squares = (x.astype(np.float64) for x in state)
    grad, met = {}, set()
    for ids in rows:
        tokens = np.frombuffer(ids, "<u2").tolist()
        before = earlier = M.START
        for t in tokens:
            fs = [int(f[0]) for f in M.hashed(np.array([before]), np.array([earlier]))]
            z = sum(weights[f] for f in fs)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[of[t]] -= 1
            for f in fs:
                grad[f] = grad.get(f, 0) + p
            met |= set(fs)
            before, earlier = t, before
    for f, g in grad.items():
        squares[f] += g * g
        weights[f] -= rate * g / np.sqrt(squares[f] + 1e-2)
    return weights, squares


def test_rounds_and_scores(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice("the cat sat on a mat AND dog ran".split()) for _ in range(rng.randrange(12)))) for k in range(60)] + [(1000, None)]
    seen, first = [], M.gradient_round

    def spy(ids, shared, *args, **kw):
        out = first(ids, shared, *args, **kw)
        seen.append((ids.collect(), shared.value, out))
        return out

    monkeypatch.setattr(M, "gradient_round", spy)
    got = {r.doc_id: r for r in M.lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(1)).collect()}
    assert len(got) == len(docs) and len(seen) == 2
    for rows, (weights, squares, of), out in seen:  # few enough tokens for one step
        want = by_hand([r.ids for r in rows], (weights, squares), of)
        assert np.allclose(out[0], want[0], atol=1e-4) and np.allclose(out[1], want[1], atol=1e-4)
    weights, of = seen[-1][2][0].astype(np.float64), seen[0][1][2]
    learned = {i: t for i, t in docs if zlib.crc32(str(i).encode()) % 10}
    count = {}
    for t in learned.values():
        for w in [*(t or "").lower().split(), None]:
            count[w] = count.get(w, 0) + 1
    classes, ids = {}, {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for rows, *_ in seen for r in rows}
    for i, t in learned.items():
        classes |= {w: int(of[k]) for w, k in zip([*(t or "").lower().split(), None], ids[i], strict=True)}
    inside = {}
    for w, c in classes.items():
        n, v = inside.get(c, (0, 0))
        inside[c] = n + count[w], v + 1
    # in every class the known words and the unknown one share all of its chance
    for c, (n, v) in inside.items():
        assert abs(sum((count[w] + 0.1) / (n + 0.1 * (v + 1)) for w, k in classes.items() if k == c) + 0.1 / (n + 0.1 * (v + 1)) - 1) < 1e-12
    for i, t in learned.items():
        total, before, earlier = 0.0, M.START, M.START
        for w, k in zip([*(t or "").lower().split(), None], ids[i], strict=True):
            z = sum(weights[int(f[0])] for f in M.hashed(np.array([before]), np.array([earlier])))
            c = classes[w]
            n, v = inside[c]
            total += (z[c] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10) + math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
            before, earlier = k, before
        assert abs(got[i].score - total) < 1e-3


def test_most_frequent_words(spark):
    end = int(M.END.astype(np.int64))
    rows = [(end, 1), *((k, 1 + k % 7) for k in range(100)), (500, 10**9), (501, 10**6), (502, 5000)]
    df = spark.createDataFrame(rows, "h long, n long")
    for most in (1, 2, 4, 18, 40, 1000):
        got = [(r.h, r.n) for r in M.frequent(df, most)]
        ranked = sorted((r for r in rows if r[0] != end), key=lambda r: (-r[1], r[0]))
        fits = [r for r in ranked if sum(x[1] >= r[1] for x in ranked) <= most - 1]
        assert got == [(end, 1), *fits]


def test_blobs_are_added_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN_IN", 3)
    rows = [(k % 5, np.array([k, 1.0], "<f4").tobytes()) for k in range(200)]
    df = spark.createDataFrame(rows, "part int, blob binary").repartition(20)
    got = {p: x.tolist() for p, x in M.sum_blobs(df, "<f4", 20).items()}
    assert got == {p: [float(sum(range(p, 200, 5))), 40.0] for p in range(5)}
