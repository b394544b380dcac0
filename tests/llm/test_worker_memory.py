"""What a Python worker keeps from task to task: the tables of the work it does now, not those of earlier steps."""

import gc
import weakref

import numpy as np
from bundlefold.llm import common, decontam
from bundlefold.llm.encoder import Table, encoder
from bundlefold.llm.queries import tokenizer_path


def test_tables_go_with_their_work(monkeypatch):
    class Machine:
        pass

    monkeypatch.setattr(decontam, "automaton", lambda items, width: Machine())
    bench, path = decontam.Benchmark("/nowhere", 1, 13), tokenizer_path("word_bpe_49k.json")
    used = {"decontamination": [], "packing": []}
    scanning = common.lean(lambda batches: (used["decontamination"].append(weakref.ref(bench.machine(0)[0])) for _ in batches))
    packing = common.lean(lambda batches: (used["packing"].append(weakref.ref(encoder(path))) for _ in batches))
    plain = common.lean(lambda batches: (None for _ in batches))

    def alive(name):
        gc.collect()
        return [x() is not None for x in used[name]]

    for step, tasks in ((scanning, 2), (packing, 2)):
        for _ in range(tasks):
            list(step(iter([None])))
    assert alive("decontamination") == [False, False] and alive("packing") == [True, True]
    assert len({id(x()) for x in used["packing"]}) == 1  # made once for all tasks of its work
    list(plain(iter([None])))
    assert alive("packing") == [False, False]
    named = [common.lean(lambda batches: (used["packing"].append(weakref.ref(encoder(path))) for _ in batches), path) for _ in range(2)]
    for step in named:
        list(step(iter([None])))
    assert len({id(x()) for x in used["packing"][2:]}) == 1 and alive("packing")[2:] == [True, True]


def test_one_group_at_a_time(monkeypatch):
    alive, most = weakref.WeakSet(), []

    class Machine:
        pass

    def built(items, width):
        gc.collect()
        most.append(len(alive))
        alive.add(machine := Machine())
        return machine

    monkeypatch.setattr(decontam, "automaton", built)
    monkeypatch.setattr(decontam, "scan", lambda machine, raw: (0, [], set()))
    decontam.Benchmark("/nowhere", 4, 13).scans([b"a text"])
    assert most == [0, 0, 0, 0]


def test_table_grows_with_its_pieces():
    table, h = Table(1 << 21), np.random.default_rng(1).permutation(300_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert table.key.nbytes + table.entry.nbytes < 1 << 21
    for lo in range(0, len(h), 7_000):
        part = h[lo : lo + 7_000]
        table.keep(part, table.add(part, [int(x).to_bytes(4, "little") for x in range(lo, lo + len(part))]))
    found = table.find(h, h)
    assert (table.pool[table.at[found]] == np.arange(len(h))).all() and (table.find(h + np.uint64(1), h) == -1).all()
    assert 2 * len(h) <= table.mask + 1 < 4 * len(h)
