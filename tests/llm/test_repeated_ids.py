"""Operator 10 where ids repeat: links and groups against all pairs, and which rows stay."""

import random

import pytest
from bundlefold.llm import components, ngramjoin
from tests.llm.test_scan import grams


def near(a, b):
    return a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(10):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 40, 150]))]
        for _ in range(rng.choice([1, 3, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((rng.randrange(25), " ".join(w)))  # few ids, so most have several texts
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    return rows + [(100, a), (100, b), (101, a + " x"), (3, None), (3, "..."), (200, ""), (200, "!"), rows[0], rows[0]]


def brute(rows):
    """Units (id, words) and their links, groups of ids."""
    units = {}
    for i, t in rows:
        words = tuple((t or "").lower().replace(".", " ").replace("!", " ").split())
        units[i, words] = grams(t or "")
    parent = {i: i for i, _ in units}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for u, s in units.items():
        for v, t in units.items():
            if u != v and near(s, t):
                links[u[0]] += 1
                x, y = sorted((root(u[0]), root(v[0])))
                parent[y] = x
    return {i: (root(i), links[i]) for i in parent}


@pytest.mark.parametrize("block", [512, 2])
def test_links_of_every_text(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rows = rows_of(block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)
    assert got[101] == (100, 1)


def test_one_of_each_group_stays(spark):
    rows = rows_of(7)
    cols = "doc_id long, text string, m map<string,int>, `__one` string, `__k1` int, `a b` int"
    df = spark.createDataFrame([(*r, {"k": 1}, "e", 1, 2) for r in [*rows, (None, rows[0][1]), (None, rows[0][1])]], cols).repartition(3)
    kept = ngramjoin.one_of_each(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(i is None for i, _ in got) == 2
    got = [g for g in got if g[0] is not None]
    assert len(got) == len(set(got))
    sets = {r: grams(r[1] or "") for r in rows}
    bare = {r for r in rows if not sets[r]}
    assert bare <= set(got)  # texts without words, null ones too
    # every text that went is linked, by a chain, to one that stays, and no two that stay are near
    left = [r for r in got if sets[r]]
    assert not [(a, b) for a in left for b in left if a < b and near(sets[a], sets[b])]
    reached, todo = set(left), list(left)
    while todo:
        a = todo.pop()
        for b in sets:
            if b not in reached and near(sets[a], sets[b]):
                reached.add(b)
                todo.append(b)
    assert reached == {r for r in rows if sets[r]}
    assert ngramjoin.one_of_each(df.limit(0)).count() == 0


def test_unique_ids(spark):
    """The same rows as the classes say, where no id repeats."""
    rows = [(k, t) for k, (_, t) in enumerate(rows_of(9))]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = sorted(r.doc_id for r in ngramjoin.near_duplicates(df).collect() if r.doc_id == r.class_id)
    assert sorted(r.doc_id for r in ngramjoin.one_of_each(df).collect()) == want


def test_components_of_any_labels(spark):
    rng = random.Random(1)
    path = list(range(60))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, k) for k in range(1001, 1300)] + [(5000, 4999), (4999, 5000), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(1000, 1300), 1000), 5000: 4999, 4999: 4999}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
