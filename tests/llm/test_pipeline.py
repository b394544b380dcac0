"""The pipeline: each stage against what its operator says, on the driver's tables and on odd rows."""

import corpus_pipeline as P
from bundlefold.llm import common
from bundlefold.llm.decontam import benchmark_hits
from bundlefold.llm.ngramjoin import near_duplicates
from bundlefold.llm.quality import quality_scores

SF = "/root/testdata/sf0.01"


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    kept = common.cut(P.quality(spark, docs, SF), "t")
    assert kept.columns == docs.columns
    assert ids(kept) == {r.doc_id for r in quality_scores(docs, common.table(spark, SF, "labels")).collect() if r.predicted}
    single = common.cut(P.near_duplicate_stage(spark, kept, SF), "t")
    classes = {r.doc_id: r.class_id for r in near_duplicates(kept).collect()}
    assert ids(single) == {i for i, c in classes.items() if i == c} and single.columns == docs.columns and single.count() == len(ids(single))
    clean = common.cut(P.decontamination(spark, single, SF), "t")
    assert ids(clean) == {r.doc_id for r in benchmark_hits(single, common.table(spark, SF, "benchmark")).collect() if not r.contaminated}
    told = common.cut(P.secrets(spark, clean, SF), "t")
    assert ids(told) == ids(clean) and told.columns == docs.columns and told.where("text rlike '(?i)token = \"[0-9a-f]{40}\"'").count() == 0
    assert told.where("n_chars <> char_length(text)").count() == 0
    pieces = P.packing(spark, told, SF)
    assert ids(pieces) == ids(told)
    whole = P.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, pieces.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_odd_rows(spark):
    rows = [(1, "some words that are fine here", "en", "a", 5), (1, "some words that are fine here", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "some words that are fine here", "en", "b", 3), (4, "x" * 200_000, "en", "b", 1)]
    rows += [(5, "one of two texts of an id that have no words in common", "en", "b", 9), (5, "quite another one here, which stays too", "en", "b", 9)]
    docs = spark.createDataFrame([(*r, "extra", {"a": 1}, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `__one` string, m map<string,int>, score double")
    kept = P.quality(spark, docs, SF)
    good = sorted(str(r.doc_id) for r in quality_scores(docs, common.table(spark, SF, "labels")).collect() if r.predicted)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == good
    for name, stage in P.STAGES[1:-1]:
        docs = common.cut(stage(spark, docs, SF), "odd")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__one", "m", "score"], name
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "4", "5", "5", "None"]
    assert P.packing(spark, docs, SF).select("doc_id").distinct().count() == 6
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
