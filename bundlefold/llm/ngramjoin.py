"""N-gram Jaccard self-join (operator 10) by MinHash banding.

1. One scan hashes each text's words (those of the decontamination operator), its whole word sequence and its MinHash
   signature over runs of `size` words (one run of all words in a shorter text), folded into `bands` band hashes.
2. Texts with equal word sequences form a class; one row of each goes on. Copies are counted, never paired.
3. Band hashes are shuffled; classes that share one with another are candidates. Each goes to the block of the least
   class met in its buckets (its home); a home of more than BLOCK classes is dealt to several blocks by hash. Two blocks
   meet only where they share a bucket, and a class goes only where one of its buckets has another class: work follows
   the buckets, never the pairs of a chain of buckets.
4. Candidates' full n-gram sets are sent to the meetings of their block. There, classes that share a band are verified
   on full sets: links are counted for each, and a spanning forest of the links is kept, not the links.
5. Components of the forests are the groups.

Bands and rows are chosen by `bands_for` so that a pair at the threshold is found with the wanted chance.

What stands in the table once or more with the same id and the same words counts once. An id with several different
texts keeps all of them: each is compared, the id has the links of all, and it belongs to one group with whatever any of
them is linked to. Null and empty texts and those without words have no n-grams and so no links; an id that has no other
text is a group of its own. Rows with a null id are left out. Very long texts are hashed whole, as one slice; a group of
copies or near copies, however large, is spread over blocks. Ties go to the least id. An empty table gives an empty
result. Only the id and the text are read: other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common
from .textscan import U, Words, mix, sequence_keys, shingle_hashes

#: Classes that are compared in one block.
BLOCK = 512
_KEYS = pa.schema([("k1", pa.int64()), ("k2", pa.int64())])
_SIGNATURES = pa.schema([("doc_id", pa.int64()), *_KEYS, ("bands", pa.list_(pa.int64()))])
_SETS = _SIGNATURES.append(pa.field("grams", pa.list_(pa.int64())))
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def bands_for(threshold: float, recall: float = 0.9995, hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, so the fewest chance candidates, with which a pair at the threshold
    shares a band with at least the wanted chance and no more than `hashes` are computed."""
    for rows in range(32, 0, -1):
        miss = 1 - threshold**rows
        bands = 1
        while miss**bands > 1 - recall and bands * rows <= hashes:
            bands += 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no bands reach that recall with so few hashes")


def _signature(grams: np.ndarray, firsts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts, bands) of texts that have grams; firsts: where each text's begin."""
    rng = np.random.default_rng(20260101)
    odd, add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(firsts), bands), U)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(firsts), b + 1, U)
            for r in range(rows):
                k = b * rows + r
                least = np.minimum.reduceat((grams * odd[k] + add[k]) >> U(20), firsts)
                h = mix(h * U(0x9E3779B97F4A7C15) + least)
            out[:, b] = h
    return out


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, the two keys of the word sequence (0, 0: no words) and the band hashes of each text."""

    def work(batches):
        for batch in batches:
            for part, data, offs in common.text_slices(batch, "text"):
                words = Words(data, offs, "alnum")
                hashes = words.hashes()
                grams, first = shingle_hashes(hashes, words.first, size)
                has = np.diff(first) > 0
                k1, k2 = (np.where(has, k, U(0)).view(np.int64) for k in sequence_keys(hashes, words.first))
                out = _signature(grams, first[:-1][has], bands, rows) if has.any() else np.zeros((0, bands), U)
                lists = np.concatenate([[0], np.cumsum(has * bands)])
                yield common.batch_of(_SIGNATURES, part.column(0), k1, k2, common.ragged(out.ravel().view(np.int64), lists, pa.int64()))

    return docs.mapInArrow(common.lean(work), "doc_id long, k1 long, k2 long, bands array<long>")


def gram_sets(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, the two keys, band hashes and the sorted set of n-gram hashes of each text that has words."""

    def work(batches):
        for batch in batches:
            for part, data, offs in common.text_slices(batch, "text"):
                words = Words(data, offs, "alnum")
                hashes = words.hashes()
                grams, first = shingle_hashes(hashes, words.first, size)
                has = np.flatnonzero(np.diff(first) > 0)
                if not len(has):
                    continue
                k1, k2 = (k.view(np.int64)[has] for k in sequence_keys(hashes, words.first))
                sig = _signature(grams, first[:-1][has], bands, rows)
                sets = [common.distinct(grams[first[i] : first[i + 1]]).view(np.int64) for i in has]
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                yield common.batch_of(_SETS, part.column(0).take(pa.array(has)), k1, k2, common.ragged(sig.ravel().view(np.int64), np.arange(len(has) + 1) * bands, pa.int64()), common.ragged(np.concatenate(sets), cuts, pa.int64()))

    return docs.mapInArrow(common.lean(work), "doc_id long, k1 long, k2 long, bands array<long>, grams array<long>")


def _overlaps(sets: list[np.ndarray], chunk: int = 1 << 13) -> np.ndarray:
    """How many n-grams each two sets share."""
    n = len(sets)
    shared = np.zeros((n, n), np.float32)
    sizes = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    column = np.cumsum(often) - 1
    who, keep = np.repeat(np.arange(n), sizes), often[place]
    who, at = who[keep], column[place[keep]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    for lo in range(0, int(often.sum()), chunk):
        a, b = np.searchsorted(at, [lo, lo + chunk])
        m = np.zeros((n, min(chunk, int(often.sum()) - lo)), np.float32)
        m[who[a:b], at[a:b] - lo] = 1
        shared += m @ m.T
    return shared


def _forest(n: int, left: np.ndarray, right: np.ndarray):
    """A spanning forest of some edges."""
    parent = list(range(n))
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def links_in_block(ids: np.ndarray, weights: np.ndarray, side: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool):
    """Links of each text (weighted by the other's copies) and forest edges, among the texts of a block or, across,
    between sides 0 and 1. Only texts that share a band are held to be candidates."""
    n = len(ids)
    shared = _overlaps(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    ok = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
    np.fill_diagonal(ok, False)
    if across:
        ok &= side[:, None] != side[None, :]
    left, right = np.nonzero(np.triu(ok))
    near = np.zeros(len(left), bool)
    for lo in range(0, len(left), 1 << 16):
        near[lo : lo + (1 << 16)] = (bands[left[lo : lo + (1 << 16)]] == bands[right[lo : lo + (1 << 16)]]).any(axis=1)
    left, right = left[near], right[near]
    count = np.bincount(left, weights[right], n) + np.bincount(right, weights[left], n)
    return count.astype(np.int64), list(_forest(n, left, right))


def word_keys(docs: DataFrame, text_col: str, names: tuple[str, str]) -> DataFrame:
    """docs with the two keys of each text's word sequence as columns of these names before the others (0, 0: no words)."""
    at = docs.columns.index(text_col)
    first = [pa.field(n, pa.int64()) for n in names]

    def work(batches):
        for batch in batches:
            data, offs = common.column_bytes(batch.column(at))
            for lo, hi in common.byte_slices(offs):
                part = batch.slice(lo, hi - lo)
                words = Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], "alnum")
                has = words.counts() > 0
                keys = (pa.array(np.where(has, k, U(0)).view(np.int64)) for k in sequence_keys(words.hashes(), words.first))
                yield pa.RecordBatch.from_arrays([*keys, *part.columns], schema=pa.schema([*first, *part.schema]))

    return docs.mapInArrow(common.lean(work), StructType([*(StructField(n, LongType()) for n in names), *docs.schema.fields]))


def _meetings(banded: DataFrame) -> DataFrame:
    """node, x, y and side of every meeting of two blocks (x = y: of one with itself) that a class goes to, from rows of
    node and h, its bands' hashes."""
    least = banded.groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("h", "least")
    shared = common.cut(banded.join(least, "h"), "buckets")
    home = shared.groupBy("node").agg(F.min("least").alias("home"))
    sizes = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # blocks that share a number by chance are one larger block
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks")))
    blocks = common.cut(home.join(sizes, "home").select("node", block.alias("block")), "blocks")
    placed = shared.select("node", "h").join(blocks, "node")
    # a bucket's blocks; buckets of the same blocks, as those of near copies are, count as one
    lists = placed.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("all"), F.count("*").alias("n"))  # no more than members / BLOCK and some
    lists = common.cut(lists.withColumn("g", F.xxhash64("all")), "lists")
    sent = placed.join(lists.select("h", "g"), "h").select("node", "block", "g").distinct()
    others = lists.select("g", F.explode("all").alias("other")).distinct()
    to = sent.join(others, "g").select("node", "block", "other").distinct()
    return to.select("node", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def _linked(texts: DataFrame, size: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units (doc_id, k1, k2: an id and one of its word sequences), classes (node, k1, k2, rep: its least id, copies: how
    many units, links: units of other classes at the threshold or above) and forest edges (a, b) between nodes."""
    common.prepare(texts.sparkSession)
    bands, rows = bands_for(threshold, recall)
    signed = common.cut(signatures(texts, size, bands, rows), "signatures")
    units = common.cut(signed.select("doc_id", "k1", "k2").distinct(), "units")
    classes = units.where("k1 <> 0 or k2 <> 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = common.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2", "node"), ["doc_id", "k1", "k2"])
    meetings = _meetings(reps.select("node", F.explode("bands").alias("h")))  # a band's number is part of its hash
    going = meetings.groupBy("node").agg(F.collect_list(F.struct("x", "y", "side")).alias("to"))  # blocks of its buckets
    members = going.join(classes, "node").select("node", F.col("rep").alias("doc_id"), "k1", "k2", "copies", "to")
    members = common.cut(members, "members")
    # a table of ids alone, by whose size Spark sees whether it can be sent to every task, so that no text is shuffled
    named = common.cut(members.select("doc_id").distinct(), "candidates")
    grams = gram_sets(texts.join(named, "doc_id", "left_semi"), size, bands, rows)
    dealt = grams.join(members, ["doc_id", "k1", "k2"]).select("node", "copies", "bands", "grams", F.explode("to").alias("to")).select("node", "copies", "bands", "grams", "to.*")

    def verify(key, block):
        block = block.combine_chunks()
        block = block.take(np.unique(block.column("node").to_numpy(), return_index=True)[1])  # rows may repeat
        nodes, weights, side = (block.column(c).to_numpy().astype(np.int64) for c in ("node", "copies", "side"))
        across = key[0].as_py() != key[1].as_py()
        if len(nodes) < 2 or across and len(set(side.tolist())) < 2:
            return pa.Table.from_batches([], _FOUND)
        flat = block.column("grams").combine_chunks()
        cuts, values = flat.offsets.to_numpy(), flat.values.to_numpy()
        sets = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        hashes = np.array(block.column("bands").combine_chunks().flatten().to_numpy()).reshape(len(nodes), -1)
        count, edges = links_in_block(nodes, weights, side, hashes, sets, threshold, across)
        some = np.flatnonzero(count)
        a = np.concatenate([nodes[some], nodes[[x for x, _ in edges]]]).astype(np.int64)
        b = np.concatenate([np.full(len(some), -1), nodes[[y for _, y in edges]]]).astype(np.int64)
        return pa.table([a, b, np.concatenate([count[some], np.full(len(edges), -1)])], schema=_FOUND)

    found = common.cut(dealt.groupBy("x", "y").applyInArrow(verify, "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    classes = classes.join(counts, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("long"))
    return units, common.cut(classes, "linked"), found.where("n < 0").select("a", "b")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id: doc_id, class_id (least id of its group), copy_of (least id with the same words as one of
    its texts) and n_links (other documents at the threshold or above, copies included; where ids have several texts,
    pairs of an own text and another id or text)."""
    from .components import components

    units, classes, forest = _linked(_texts(docs, id_col, text_col), size, threshold, recall)
    known = units.join(classes.select("k1", "k2", "node", "rep", "copies", "links"), ["k1", "k2"], "left")
    # texts of one id belong together
    again = known.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("doc_id", "least")
    same = known.join(again, "doc_id").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    groups = components(forest.unionAll(same))
    named = groups.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    groups = groups.join(named, "component").select("node", "class_id")
    out = known.join(groups, "node", "left").groupBy("doc_id").agg(
        F.coalesce(F.min("class_id"), F.min("rep"), F.col("doc_id")).alias("class_id"),
        F.coalesce(F.min("rep"), F.col("doc_id")).alias("copy_of"),
        F.coalesce(F.sum(F.col("links") + F.col("copies") - 1), F.lit(0)).cast("long").alias("n_links"),
    )
    return out.select("doc_id", "class_id", "copy_of", "n_links")


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one of each group of near duplicates stays: that of the least id. All columns as they are.

    Groups are of texts, not of ids: where an id has several different texts, each is judged for itself and none goes
    because it shares an id. Of rows that repeat an id and a text's words, the least in text and then in the other columns
    (as JSON) stays. Rows without words, of an id and text of their own, stay, as rows with a null id do."""
    from .components import components

    units, classes, forest = _linked(_texts(docs, id_col, text_col), size, threshold, recall)
    groups = components(forest)
    ranked = groups.join(classes, "node").groupBy("component").agg(F.min(F.struct("rep", "k1", "k2", "node")).alias("first")).select("component", F.col("first.node").alias("lead"))
    followers = groups.join(ranked, "component").where("node <> lead").select("node", F.lit(True).alias("follows"))
    told = classes.join(followers, "node", "left").select("k1", "k2", "rep", "follows")
    # an id and its words go if another class leads the group, or a smaller id has the same words
    judged = units.join(told, ["k1", "k2"], "left").withColumn("goes", F.coalesce("follows", F.lit(False)) | F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)))
    judged = common.cut(judged.select("doc_id", "k1", "k2", "goes"), "judged")
    # ids that stand on several rows are told apart from the rest
    k1, k2, j1, j2, the, again_id, gone_id, bare, one = common.unused(docs, "k1", "k2", "j1", "j2", "id", "again", "gone", "bare", "one")
    number, own = F.col(common.quoted(id_col)).cast("long"), F.col(common.quoted(text_col)).cast("string")
    again = docs.select(number.alias(again_id)).where(F.col(again_id).isNotNull()).groupBy(again_id).count().where("count > 1").select(again_id)
    again = common.cut(again, "again")
    gone = judged.where("goes").select(F.col("doc_id").alias(gone_id)).distinct()
    if again.isEmpty():  # as a rule
        return docs.join(common.cut(gone, "gone"), number == F.col(gone_id), "left_anti")
    repeats = number == F.col(again_id)
    gone = common.cut(gone.join(again, F.col(gone_id) == F.col(again_id), "left_anti"), "gone")
    single = docs.join(again, repeats, "left_anti").join(gone, number == F.col(gone_id), "left_anti")
    keyed = word_keys(docs.join(again, repeats, "left_semi"), text_col, (k1, k2))
    stay = judged.where("not goes").select(F.col("doc_id").alias(the), F.col("k1").alias(j1), F.col("k2").alias(j2))
    stays = keyed.join(stay, (number == F.col(the)) & (F.col(k1) == F.col(j1)) & (F.col(k2) == F.col(j2)))
    # texts without words are told apart by the text itself
    wordless = F.when((F.col(k1) == 0) & (F.col(k2) == 0), own).alias(bare)
    row = F.struct(*[F.col(common.quoted(c)) for c in docs.columns])
    best = stays.groupBy(the, k1, k2, wordless).agg(F.min_by(row, F.struct(own, F.to_json(row))).alias(one))
    return single.unionByName(best.select(*[F.col(f"{one}.{common.quoted(c)}").alias(c) for c in docs.columns]))
