"""Nearest neighbours over more than one shard, and of vectors of several lengths."""

import numpy as np
from bundlefold.llm import ann


def test_clusters_in_several_shards(spark):
    """20,000 vectors: recall, and how small a share of them a search is compared with."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(500, 32))
    x = np.repeat(centre, 40, axis=0) + 0.1 * rng.normal(size=(20000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = ann.build(df, 10, shard_size=5000, rounds=3)
    part = index.parts[0]
    assert len(part.shards) == 4 and part.probes < 4
    got: dict[int, set] = {}
    for r in ann.neighbours(index, df.where("vec_id % 40 = 0"), 10, beam=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 20000, 40):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:10].tolist()))
    assert hits >= 0.97 * 5000
    nodes, graph = part.nodes.where("shard = 0").orderBy("node").collect(), part.graph.where("shard = 0").orderBy("node").collect()
    mine = np.array([np.frombuffer(r.w, np.float32) for r in nodes])
    near, first = ann.both_ways(len(mine), np.concatenate([r.near for r in graph]).astype(np.int32), np.array([len(r.near) for r in graph]))
    asked = x[np.arange(0, 20000, 80)]
    compared = [n for *_, n in ann.search(asked, ann.starts(asked, np.full(len(asked), -1), mine), mine, near, first, 64, ann.OPEN)]
    assert part.probes * np.mean(compared) < 0.05 * 20000


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(9)
    long, short = rng.normal(size=(600, 8)), rng.normal(size=(50, 3))
    rows = [(i, v.tolist()) for i, v in enumerate([*long, *short])] + [(700, [1e200] * 5), (701, [2e200] * 5), (702, [-1e200] * 5), (720, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for small in (10, 5000):  # by graphs, and exactly
        got: dict[int, list] = {}
        for r in sorted(ann.neighbours(ann.build(df, 5, small=small), df.where("vec_id % 20 = 0"), 5).collect()):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert 720 not in got and got[700] == [701, 702]
        for q in [x for x in range(0, 650, 20)]:
            v = long if q < 600 else short
            s = v @ v[q % 600]
            s[q % 600] = -np.inf
            want = (np.argsort(-s, kind="stable")[:5] + (0 if q < 600 else 600)).tolist()
            assert len(set(got[q]) & set(want)) >= 4, (q, got[q], want)
    assert ann.neighbours(ann.build(df.limit(0), 5), df, 5).count() == 0
    assert ann.neighbours(ann.build(df, 5), df.limit(0), 5).count() == 0
