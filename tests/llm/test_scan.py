"""Operators 3 and 10 against brute force, and the words both read."""

import random
import re

import numpy as np
import pytest
from bundlefold.llm import decontam, ngramjoin
from bundlefold.llm.textscan import Words, shingle_hashes, word_hash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", " ", "a", "A b", "é ñ—ß", "x\0y", "İx ſ", "1,2.3", "日本 語", "\x7f\x80z", "a" * 5000, "w " * 9000]


def words(t):
    return WORD.findall((t or "").translate(LOW))


def batch(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])


@pytest.mark.parametrize("kind", ["alnum", "space"])
def test_words(kind):
    data, offs = batch(ODD)
    w = Words(data, offs, kind)
    h = w.hashes()
    find = words if kind == "alnum" else lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
    for k, t in enumerate(ODD):
        want = find(t)
        got = slice(w.first[k], w.first[k + 1])
        assert [data[a:b].tobytes().decode().translate(LOW) for a, b in zip(w.starts[got], w.ends[got], strict=True)] == want
        assert h[got].tolist() == [word_hash(x.encode()) for x in want]


def test_shingles():
    data, offs = batch(["a b c", "a b c d", "", "b c d", "a b c"])
    w = Words(data, offs, "alnum")
    s, first = shingle_hashes(w.hashes(), w.first, 3)
    sets = [s[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(x) for x in sets] == [1, 2, 0, 1, 1]
    assert sets[0] == sets[4] == sets[1][:1] and sets[3] == sets[1][1:]


def brute(docs, items, width=13):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + width]), set()).update([] if i is None else [str(i)])
    sizes = {len(k) for k in wins}
    for d, t in docs:
        w, hit, who = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                x = wins.get(tuple(w[k : k + n]))
                if x is not None:
                    hit |= set(range(k, k + n))
                    who |= x
        yield d, len(w), len(hit), len(who), sorted(who), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [4 << 20, 60])
def test_benchmark_hits(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "MOST", most)
    monkeypatch.setattr(decontam, "GATHER", most)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("ab Cd é f1 g".split()) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 5, 13, 14, 30]))) for k in range(12)] + [(3, "repeated item"), (None, "x"), (None, text(15)), (77, None), (9, "...")]
    docs = [(k, text(rng.randrange(60)) + " " + (rng.choice(items)[1] or "")) for k in range(80)] + [(500, None), (None, "ab cd"), (7, "ab"), (7, "ab"), *((600 + k, t) for k, t in enumerate(ODD))]
    got = decontam.benchmark_hits(
        spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_hit string").repartition(3), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, spans int")
    ).collect()
    want = list(brute(docs, [i for i in items if i[1] is not None]))
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items, r.contaminated) for r in got))) == sorted(map(str, want))
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_hit string").repartition(3)
    left = decontam.uncontaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == frame.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(str(d) for d, w in zip(docs, want, strict=True) if not w[-1])
    by_id = dict(docs)
    for r in got:  # spans lead to the original's bytes
        if r.doc_id not in (None, 7) and r.n_hit:
            raw = (by_id[r.doc_id] or "").encode()
            assert sum(len(words(raw[s.start : s.end].decode())) for s in r.spans) == r.n_hit


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontam.benchmark_hits(docs, none).first()
    assert (r.n_words, r.n_hit, r.contaminated) == (2, 0, False)
    assert decontam.benchmark_hits(docs.limit(0), none).count() == 0


def grams(t, n=5):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_bands():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngramjoin.bands_for(threshold, 0.9995, 400)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9995 and bands * rows <= 400
    with pytest.raises(ValueError):
        ngramjoin.bands_for(0.1, 0.999999, 3)


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rng = random.Random(6)
    rows, k = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((k, rng.choice([" ", ", "]).join(w).title()))
            k += 1
    rows += [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "ONE, two"), (5, rows[5][1])]
    sets = {i: grams(t) for i, t in rows}
    parent, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    df = spark.createDataFrame([(*r, 0) for r in [*rows, (None, "one two")]], "doc_id long, text string, class_id int").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.near_duplicates(df).collect()}
    assert got == {i: (root(i), links[i]) for i in ids}
    assert ngramjoin.near_duplicates(df.limit(0)).count() == 0
