"""Approximate nearest neighbours (operator 2): an NN-descent graph and greedy search in it, by largest inner product.

Equal vectors are one node: its least id goes into the index, and the least ids of each node, as many as an answer can
need, come back in when answers are ranked, so copies cost nothing and lose nothing.

Nodes are dealt to shards of about SHARD nodes that lie near each other: a tree of halving planes is fitted on a bounded
sample (FIT_BYTES of vectors), every node falls into one of its leaves, and a leaf of more nodes than SHARD, as leaves of
very large tables are, is dealt to several shards by hash. The graph of a shard begins with the best neighbours inside
the leaves of random-hyperplane trees. In each round Spark joins the edges with themselves on the node in the middle, of
which at least one is new, and adds the reversed edges; the best `degree` of all stay. Rounds end when less than SETTLED
of the edges are new. A round's joins carry ids only; nodes are compared in blocks, which get their shard's vectors.

A query is sent to the shards of the `probes` leaves whose means it has the largest products with. How many, is
measured: for at most TUNE nodes the true neighbours are found by one pass over all nodes, and the fewest leaves that
hold COVER of them are probed. Where vectors have no structure, that can be all leaves. All queries of a shard share one
load of its graph, up to QUERIES of them. Of the best `beam` nodes seen, those not yet opened are opened, best first,
until all are; edges are followed both ways. A search begins at nodes chosen for the query: the best of every SPREAD-th
node, those of its leaves in small random trees and, where it is a node, itself. Shards' answers are merged. Graph work
uses 32-bit floats, the scores returned are 64-bit inner products of the original vectors.

An inner product is defined between vectors of one length: each length has an index of its own, and lengths of at most
SMALL different vectors are searched exactly. Vectors that are null, all zero, or hold nulls or non-finite numbers take
no part; rows with null ids neither. Numbers beyond the 32-bit range count as its largest in the graph, not in scores.
Rows that repeat an id and vector count once. Ties go to the smaller id. Empty tables give empty results. Only the id and
the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD, DEGREE, ROUNDS, TREES, LEAF = 1 << 14, 24, 6, 4, 256
#: Share of new edges at which a graph is taken for settled.
SETTLED = 0.05
BEAM, OPEN, ENTRIES = 160, 8, 16
#: One node in SPREAD is compared with each query to find where it begins; nodes of a leaf that it begins in.
SPREAD, BEGIN = 64, 64
#: Nodes in a block of a round, and queries in a block of a search.
BLOCK, QUERIES = 1 << 12, 1 << 11
#: Bytes of sampled vectors that the routing tree is fitted on, and sampled vectors in a leaf.
FIT_BYTES, FIT_LEAF = 16 << 20, 16
#: Nodes that the number of leaves probed is measured with, and the share of their neighbours that has to lie there.
TUNE, COVER = 256, 0.98
#: Different vectors of a length up to which it is searched exactly.
SMALL = 2048
_GRAPH = pa.schema([("shard", pa.int32()), ("node", pa.int32()), ("near", pa.list_(pa.int32())), ("fresh", pa.list_(pa.int32()))])
_GRAPH_SQL = "shard int, node int, near array<int>, fresh array<int>"
_FOUND = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def usable(vector: str) -> Column:
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind) -> np.ndarray:
    """Vectors kept as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def best(near: np.ndarray, score: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """In each row the `degree` best different nodes; -1 stands for none. Ties go to the smaller node."""
    order = np.argsort(near, axis=1, kind="stable")
    near, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
    again = np.zeros(near.shape, bool)
    again[:, 1:] = near[:, 1:] == near[:, :-1]
    score = np.where(again | (near < 0), -np.inf, score)
    order = np.argsort(-score, axis=1, kind="stable")[:, :degree]
    score = np.take_along_axis(score, order, 1)
    return np.where(np.isneginf(score), -1, np.take_along_axis(near, order, 1)), score


def grow_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """A random tree over x: planes, cuts, kids (-1 - k: the leaf k) and leaves. Each split is by the difference of two
    vectors, halved at the median, so every leaf has at most `leaf` nodes whatever the vectors are."""
    planes, cuts, kids, leaves = [], [], [], []
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, above, side = todo.pop()
        if len(rows) > leaf:
            me = len(planes)
            a, b = rng.choice(len(rows), 2, replace=False)
            at = x[rows] @ (x[rows[a]] - x[rows[b]])
            order, half = np.argsort(at, kind="stable"), len(rows) // 2
            planes.append(x[rows[a]] - x[rows[b]])
            cuts.append(at[order[half]])
            kids.append([0, 0])
            rows = rows[order]
            todo += [(rows[:half], me, 0), (rows[half:], me, 1)]
        else:
            me = -1 - len(leaves)
            leaves.append(rows)
        if above >= 0:
            kids[above][side] = me
    return np.array(planes, np.float32).reshape(-1, x.shape[1]), np.array(cuts, np.float32), np.array(kids, np.int64).reshape(-1, 2), leaves


def leaf_of(queries: np.ndarray, tree) -> np.ndarray:
    """The number of the leaf that each query falls in."""
    planes, cuts, kids, _ = tree
    at = np.full(len(queries), 0 if len(planes) else -1, np.int64)
    while len(go := np.flatnonzero(at >= 0)):
        here = at[go]
        right = (queries[go] * planes[here]).sum(axis=1) >= cuts[here]
        at[go] = kids[here, right.astype(np.int64)]
    return -1 - at


def narrow(x: np.ndarray) -> np.ndarray:
    """32-bit floats; what lies beyond their range becomes the largest whose products and sums don't overflow."""
    most = 1e18 / np.sqrt(max(1, x.shape[-1]))
    return np.clip(x, -most, most).astype(np.float32)


def first_graph(x: np.ndarray, degree: int, trees: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The best neighbours inside the leaves of random trees."""
    rng, n = np.random.default_rng(seed), len(x)
    near, score = np.full((n, degree), -1, np.int32), np.full((n, degree), -np.inf, np.float32)
    for _ in range(trees):
        for rows in grow_tree(x, leaf, rng)[3]:
            s = x[rows] @ x[rows].T
            np.fill_diagonal(s, -np.inf)
            mine = np.broadcast_to(rows.astype(np.int32), s.shape)
            near[rows], score[rows] = best(np.concatenate([near[rows], np.where(np.isneginf(s), -1, mine)], 1), np.concatenate([score[rows], s], 1), degree)
    return near, score


def both_ways(n: int, lists: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges and reversed edges of n nodes, and the n + 1 offsets of each node's; lists: the nodes' neighbours in a row."""
    source = np.repeat(np.arange(n, dtype=np.int64), size)
    pair = common.distinct(np.concatenate([source * n + lists, lists.astype(np.int64) * n + source]))
    return (pair % n).astype(np.int32), np.searchsorted(pair, np.arange(n + 1, dtype=np.int64) * n)


def starts(queries: np.ndarray, own: np.ndarray, x: np.ndarray):
    """For each query the nodes that its search begins at: its own, the best of nodes all over the shard, and those of
    its leaves in the random trees."""
    rng = np.random.default_rng(17)
    trees = [grow_tree(x, BEGIN, rng) for _ in range(2)]
    leaf = [leaf_of(queries, t) for t in trees]
    over = np.random.default_rng(23).choice(len(x), max(min(LEAF, len(x)), len(x) // SPREAD), replace=False)
    for lo in range(0, len(queries), LEAF):
        s = queries[lo : lo + LEAF] @ x[over].T
        top = np.argpartition(-s, ENTRIES - 1, axis=1)[:, :ENTRIES] if len(over) > ENTRIES else np.broadcast_to(np.arange(len(over)), s.shape)
        for k, t in enumerate(top, lo):
            yield np.concatenate([over[t], own[k : k + 1][own[k : k + 1] >= 0], *(tree[3][at[k]] for tree, at in zip(trees, leaf, strict=True))])


def search(queries: np.ndarray, begin, x: np.ndarray, near: np.ndarray, first: np.ndarray, beam: int, opened: int):
    """For each query the best nodes met and their scores, by greedy search from its nodes in begin, and how many nodes it
    was compared with; near and first: see both_ways."""
    seen = np.zeros(len(x), bool)
    for q, nodes in zip(queries, begin, strict=True):
        nodes = common.distinct(nodes)
        met = [nodes]
        seen[nodes] = True
        score, done = x[nodes] @ q, np.zeros(len(nodes), bool)
        while True:
            if len(nodes) > beam:
                keep = np.argpartition(-score, beam - 1)[:beam]
                nodes, score, done = nodes[keep], score[keep], done[keep]
            rest = np.flatnonzero(~done)
            if not len(rest):
                break
            pick = rest if len(rest) <= opened else rest[np.argpartition(-score[rest], opened - 1)[:opened]]
            done[pick] = True
            new = np.concatenate([near[first[m] : first[m + 1]] for m in nodes[pick].tolist()])
            new = common.distinct(new[~seen[new]])
            if len(new):
                seen[new] = True
                met.append(new)
                nodes, score, done = np.concatenate([nodes, new]), np.concatenate([score, x[new] @ q]), np.concatenate([done, np.zeros(len(new), bool)])
        for m in met:
            seen[m] = False
        yield nodes, score, sum(map(len, met))


class Index:
    """What is searched: for each vector length a Part, and the ids that each node stands for (rep, id, place)."""

    def __init__(self, parts: list[Part | Exact], members: DataFrame):
        self.parts, self.members = parts, members


class Exact:
    """The different vectors (rep, v) of the lengths that have few."""

    def __init__(self, reps: DataFrame):
        self.reps = reps


class Part:
    """Nodes of one length (shard, node, rep, v and w: the vector as bytes of 64- and 32-bit floats), their graph, the tree
    and the leaves' means that route queries, the shards of each leaf (first and number), and how many leaves to probe."""

    def __init__(self, nodes: DataFrame, graph: DataFrame, dim: int, means: np.ndarray, shards: list[tuple[int, int]], probes: int):
        self.nodes, self.graph, self.dim, self.means, self.shards, self.probes = nodes, graph, dim, means, shards, probes


def _numbers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part, whatever their vectors' lengths."""
    v = F.col(vector_col).cast("array<double>")
    out = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(usable("v"))
    return out.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero


def build(rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int = SHARD, degree: int = DEGREE, rounds: int = ROUNDS, small: int = SMALL) -> Index:
    """Fits the graph over all rows, for searches of up to k neighbours."""
    common.prepare(rows.sparkSession)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    # of a vector's ids an answer can hold k, and the query's own: the window's limit is applied before its shuffle too
    few = _numbers(rows, id_col, vector_col).distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    few = common.cut(few, "members")
    first = few.where("place = 1").select(F.col("id").alias("rep"), "v")
    members = common.cut(few.join(first, "v").select("rep", "id", "place"), "ids")
    lengths = first.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).where(F.col("c") > small).collect()  # fewer than rows / small
    parts: list[Part | Exact] = [_part(first.where(F.size("v") == r["n"]), r["n"], r["c"], k, shard_size, degree, rounds) for r in sorted(lengths)]
    return Index([*parts, Exact(first.where(~F.size("v").isin([r["n"] for r in lengths])))], members)


def _part(reps: DataFrame, dim: int, n: int, k: int, shard_size: int, degree: int, rounds: int) -> Part:
    spark = reps.sparkSession
    most = max(FIT_LEAF, FIT_BYTES // (4 * dim))
    wanted = -(-n // shard_size)
    share = F.pmod(F.xxhash64(F.col("rep"), F.lit(5)), F.lit(1 << 30)) < int(min(1.0, 0.9 * most / n) * (1 << 30))
    sample = (reps if n <= most else reps.where(share)).limit(most).collect() if wanted > 1 else []  # FIT_BYTES at most
    fit = narrow(np.array([r["v"] for r in sorted(sample, key=lambda r: r["rep"])], np.float64).reshape(-1, dim))
    tree = grow_tree(fit, max(FIT_LEAF, -(-len(fit) // wanted)), np.random.default_rng(29))
    leaves = len(tree[3])
    shared = spark.sparkContext.broadcast(tree[:3])

    def pack(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            w = narrow(flat)
            leaf = leaf_of(w, (*shared.value, None))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), b.column(0), pa.array([r.tobytes() for r in flat], pa.binary()), pa.array([r.tobytes() for r in w], pa.binary())], ["leaf", "rep", "v", "w"])

    packed = common.cut(reps.select("rep", "v").mapInArrow(common.lean(pack), "leaf int, rep long, v binary, w binary"), "vectors")
    counts = {r["leaf"]: r["n"] for r in packed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    shards, at = [], 0
    for leaf in range(leaves):
        size = max(1, -(-counts.get(leaf, 0) // (shard_size + shard_size // 4)))  # leaves are about shard_size by themselves
        shards.append((at, size))
        at += size
    dealt = spark.createDataFrame([(k, a, m) for k, (a, m) in enumerate(shards)], "leaf int, first int, many int")
    shard = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("many"))).cast("int").alias("shard")
    inside = (F.row_number().over(Window.partitionBy("shard").orderBy("rep")) - 1).cast("int").alias("node")
    nodes = common.cut(packed.join(F.broadcast(dealt), "leaf").select("leaf", shard, "rep", "v", "w").select("leaf", "shard", inside, "rep", "v", "w"), "nodes")
    means = _means(nodes, leaves, dim)
    graph = common.cut(nodes.select("shard", "node", "w").groupBy("shard").applyInArrow(_begin(dim, degree), _GRAPH_SQL), "graph")
    largest = max((-(-counts.get(k, 0) // m) for k, (_, m) in enumerate(shards)), default=1)
    blocks = max(1, -(-largest // BLOCK))
    for _ in range(rounds):
        graph = common.cut(_round(nodes, graph, dim, degree, blocks), "graph")
        if graph.agg(F.coalesce(F.sum(F.size("fresh")), F.lit(0))).first()[0] <= SETTLED * n * degree:
            break
    return Part(nodes, graph, dim, means, shards, _probes(nodes, means, dim, k, n) if leaves > 1 else 1)


def _means(nodes: DataFrame, leaves: int, dim: int) -> np.ndarray:
    """The leaves' mean vectors: sums are made in the tasks."""

    def work(batches):
        total, n = np.zeros((leaves, dim)), np.zeros(leaves, np.int64)
        for b in batches:
            leaf = b.column(0).to_numpy()
            np.add.at(total, leaf, _matrix(b.column(1), dim, np.float32).astype(np.float64))
            n += np.bincount(leaf, minlength=leaves)
        for k in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k]], pa.int64()), pa.array([total[k].tolist()], pa.list_(pa.float64()))], ["leaf", "n", "total"])

    sums = nodes.select("leaf", "w").mapInArrow(common.lean(work), "leaf int, n long, total array<double>")
    each = sums.select("leaf", "n", F.posexplode("total").alias("d", "x")).groupBy("leaf", "d").agg((F.sum("x") / F.sum("n")).alias("x"))
    out = np.zeros((leaves, dim))
    for r in each.collect():  # FIT_BYTES / FIT_LEAF at most
        out[r["leaf"], r["d"]] = r["x"]
    return out


def _probes(nodes: DataFrame, means: np.ndarray, dim: int, k: int, n: int) -> int:
    """The fewest leaves, in the order that queries are routed in, that hold COVER of the true neighbours of a sample."""
    spark = nodes.sparkSession
    some = nodes.where(F.pmod(F.xxhash64(F.col("rep"), F.lit(7)), F.lit(1 << 30)) < int(min(1.0, TUNE / n) * (1 << 30))).select("rep", "w").limit(2 * TUNE).collect()
    names = np.array([r["rep"] for r in some], np.int64)
    asked = np.frombuffer(b"".join(bytes(r["w"]) for r in some), np.float32).reshape(-1, dim)
    if not len(names):
        return len(means)
    shared = spark.sparkContext.broadcast((names, asked))

    def work(batches):
        who, q = shared.value
        score, at = np.full((len(q), k), -np.inf, np.float32), np.zeros((len(q), k), np.int32)
        for b in batches:
            rep, leaf, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dim, np.float32)
            s = q @ x.T
            s[who[:, None] == rep[None, :]] = -np.inf
            s = np.concatenate([score, s], 1)
            every = np.concatenate([at, np.broadcast_to(leaf, (len(q), len(leaf)))], 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            score, at = np.take_along_axis(s, top, 1), np.take_along_axis(every, top, 1)
        ok = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), ok.sum(axis=1))), pa.array(at[ok].astype(np.int32)), pa.array(score[ok])], ["q", "leaf", "s"])

    best_k = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
    true = nodes.select("rep", "leaf", "w").mapInArrow(common.lean(work), "q int, leaf int, s float").withColumn("at", best_k).where(F.col("at") <= k).select("q", "leaf").collect()
    order = np.argsort(-(asked @ means.T.astype(np.float32)), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(means)), order.shape), 1)
    needed = np.sort([place[r["q"], r["leaf"]] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(COVER * len(needed))) - 1)]) + 1 if len(needed) else len(means)


def _begin(dim: int, degree: int):
    def work(table):
        node = table.column("node").to_numpy()
        x = np.empty((len(node), dim), np.float32)
        x[node] = _matrix(table.column("w"), dim, np.float32)
        near, _ = first_graph(x, degree, TREES, LEAF, 17)
        return _graph_rows(table.column("shard")[0].as_py(), np.arange(len(x)), near, near >= 0)

    return work


def _graph_rows(shard: int, node: np.ndarray, near: np.ndarray, fresh: np.ndarray) -> pa.Table:
    lists = []
    for ok in (near >= 0, fresh):
        lists.append(common.ragged(near[ok], np.concatenate([[0], np.cumsum(ok.sum(axis=1))]), pa.int32()))
    return pa.Table.from_batches([common.batch_of(_GRAPH, [shard] * len(node), node, *lists)])


def _round(nodes: DataFrame, graph: DataFrame, dim: int, degree: int, blocks: int) -> DataFrame:
    """One round of NN-descent: each node keeps the best of its neighbours, theirs, and the nodes it is a neighbour of. Only
    ways with a new edge are followed: others were in the round before."""
    onward = graph.select("shard", F.col("node").alias("mid"), "near", "fresh")
    edges = graph.select("shard", "node", "fresh", F.explode("near").alias("mid")).withColumn("new", F.array_contains("fresh", F.col("mid"))).drop("fresh")
    ways = edges.join(onward, ["shard", "mid"]).select("shard", "node", F.when(F.col("new"), F.col("near")).otherwise(F.col("fresh")).alias("found"), F.lit(False).alias("mine")).where("size(found) > 0")
    back = edges.where("new").select("shard", F.col("mid").alias("node"), F.array("node").alias("found"), F.lit(False).alias("mine"))
    own = graph.select("shard", "node", F.col("near").alias("found"), F.lit(True).alias("mine"))
    block = F.pmod("node", F.lit(blocks))
    offers = ways.unionAll(back).unionAll(own).select("shard", block.alias("block"), "node", "found", "mine")
    vectors = nodes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "node", "w")

    def work(key, offered, held):
        shard, node = key[0].as_py(), held.column("node").to_numpy()
        if not offered.num_rows:
            return pa.Table.from_batches([], _GRAPH)
        x = np.empty((len(node), dim), np.float32)
        x[node] = _matrix(held.column("w"), dim, np.float32)
        lists = offered.column("found").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        pair = np.repeat(offered.column("node").to_numpy(), size).astype(np.int64) * len(x) + lists.flatten().to_numpy()
        old = common.distinct(pair[np.repeat(offered.column("mine").to_numpy(zero_copy_only=False).astype(bool), size)])
        pair = common.distinct(pair)
        who, to = pair // len(x), pair % len(x)
        keep = who != to
        who, to = who[keep], to[keep]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])[: len(who)])
        mine, many = who[first], np.diff(np.append(first, len(who)))
        near = np.full((len(mine), degree), -1, np.int32)
        for k, (me, a, m) in enumerate(zip(mine.tolist(), first.tolist(), many.tolist(), strict=True)):
            cand = to[a : a + m]
            s = x[cand] @ x[me]
            top = np.argpartition(-s, degree - 1)[:degree] if m > degree else np.arange(m)
            near[k, : len(top)] = cand[top[np.lexsort((cand[top], -s[top]))]]
        fresh = (near >= 0) & ~np.isin(mine[:, None] * len(x) + near, old)
        return _graph_rows(shard, mine, near, fresh)

    return offers.groupBy("shard", "block").cogroup(vectors.groupBy("shard", "block")).applyInArrow(work, _GRAPH_SQL)


def neighbours(index: Index, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, own: bool = False) -> DataFrame:
    """Each query's k nearest ids found: query_id, rank (from 1), vec_id, score. own: whether a query may find its id."""
    asked = _numbers(queries, id_col, vector_col).distinct()
    # equal queries of different ids are searched once: the least id stands for them
    lead = common.cut(asked.groupBy("v").agg(F.min("id").alias("query")), "asked")
    found = None
    for part in index.parts:
        some = _exact(part, lead, k) if isinstance(part, Exact) else _asked(part, lead.where(F.size("v") == part.dim), k, beam)
        found = some if found is None else found.unionAll(some)
    best_reps = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    found = common.cut(found.withColumn("at", best_reps).where(F.col("at") <= k + 1).drop("at"), "found")
    # back to every id: of each query, and of each node found
    per_query = asked.join(lead, "v").select(F.col("id").alias("query_id"), "query")
    wide = per_query.join(found, "query").join(index.members.select("rep", F.col("id").alias("vec_id")), "rep")
    if not own:
        wide = wide.where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return wide.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answers(names, vectors: np.ndarray, picks, rep: np.ndarray, exact: np.ndarray, k: int) -> pa.Table:
    """The best k + 1 of the nodes picked for each query, by exact products."""
    out_q, out_r, out_s = [], [], []
    for name, v, top in zip(names, vectors, picks, strict=True):
        s = (exact[top] * v).sum(axis=1)
        best_k = np.lexsort((rep[top], -s))[: k + 1]
        out_q.append(np.full(len(best_k), name))
        out_r.append(rep[top[best_k]])
        out_s.append(s[best_k])
    return pa.table([np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)], schema=_FOUND)


def _exact(part: Exact, lead: DataFrame, k: int) -> DataFrame:
    """All products of the lengths that have SMALL different vectors at most; queries in blocks."""
    few = F.col("dim").isin([r["dim"] for r in part.reps.select(F.size("v").alias("dim")).distinct().collect()])
    block = F.pmod(F.xxhash64("query"), F.lit(64)).alias("block")
    ask = lead.withColumn("dim", F.size("v")).where(few).select("dim", block, "query", F.col("v").alias("q"))
    ask = common.cut(ask, "asked-exactly")
    if ask.isEmpty():  # as a rule
        return ask.select("query", F.lit(0).cast("long").alias("rep"), F.lit(0.0).alias("score"))
    sizes = ask.select(F.col("dim").alias("n"), F.col("block").alias("to")).distinct()
    held = part.reps.select(F.size("v").alias("n"), "rep", "v").join(sizes, "n").select(F.col("n").alias("dim"), F.col("to").alias("block"), "rep", "v")

    def work(key, asking, have):
        if not asking.num_rows or not have.num_rows:
            return pa.Table.from_batches([], _FOUND)
        dim = key[0].as_py()
        q, x = (t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, dim) for t, c in ((asking, "q"), (have, "v")))
        picks = (np.arange(len(x)) for _ in range(len(q)))
        return _answers(asking.column("query").to_numpy(), q, picks, have.column("rep").to_numpy(), x, k)

    return ask.groupBy("dim", "block").cogroup(held.groupBy("dim", "block")).applyInArrow(work, "query long, rep long, score double")


def _asked(part: Part, lead: DataFrame, k: int, beam: int) -> DataFrame:
    """query, rep and score of what is found in the shards that each query is sent to."""
    spark, dim, probes = lead.sparkSession, part.dim, part.probes
    shared = spark.sparkContext.broadcast((part.means.astype(np.float32), part.shards))  # FIT_BYTES / FIT_LEAF at most

    def route(batches):
        means, shards = shared.value
        for b in batches:
            q = narrow(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            order = np.argsort(-(q @ means.T), axis=1, kind="stable")[:, :probes]
            to = [[a + j for leaf in row for a, m in [shards[leaf]] for j in range(m)] for row in order.tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.list_(pa.int32()))], ["query", "v", "to"])

    sent = lead.select("query", "v").mapInArrow(common.lean(route), "query long, v array<double>, to array<int>").select("query", F.col("v").alias("q"), F.explode("to").alias("shard"))
    sent = common.cut(sent, "sent")
    # a shard that many queries go to is loaded for every QUERIES of them
    loads = sent.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("loads"))
    ask = sent.join(loads, "shard").withColumn("block", F.pmod(F.xxhash64("query"), F.col("loads")).cast("int")).select("shard", "block", "query", "q")
    graph = part.nodes.select("shard", "node", "rep", "v").join(part.graph.select("shard", "node", "near"), ["shard", "node"], "left")
    held = graph.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("loads") - 1)).alias("block"), "node", "rep", "v", "near")

    def work(_, asking, have):
        if not asking.num_rows or not have.num_rows:
            return pa.Table.from_batches([], _FOUND)
        have = have.take(np.argsort(have.column("node").to_numpy()))
        exact = _matrix(have.column("v"), dim, np.float64)
        x = narrow(exact)
        rep = have.column("rep").to_numpy()
        lists = have.column("near").combine_chunks().fill_null([])
        near, first = both_ways(len(x), lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
        q64 = asking.column("q").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        same = {v.tobytes(): k for k, v in enumerate(exact)}
        me = np.array([same.get(v.tobytes(), -1) for v in q64])
        q32 = narrow(q64)
        met = search(q32, starts(q32, me, x), x, near, first, max(beam, 2 * k), OPEN)
        picks = (nodes if len(nodes) <= 4 * k else nodes[np.argpartition(-score, 4 * k - 1)[: 4 * k]] for nodes, score, _ in met)
        return _answers(asking.column("query").to_numpy(), q64, picks, rep, exact, k)

    return ask.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(work, "query long, rep long, score double")
