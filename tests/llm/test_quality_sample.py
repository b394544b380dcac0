"""The training sample of the quality classifier."""

import zlib

from bundlefold.llm import quality


def test_quality_sample_goes_on_after_a_long_text(spark):
    docs = spark.createDataFrame([(i, "some good words" if i % 2 else "bad bad bad") for i in range(60)] + [(7, "x" * 5000)] * 3 + [(i, "long " * 2000) for i in range(100, 140)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), *range(100, 140)]], "doc_id long, quality int")
    texts, ys = quality.training_rows(docs, labels, most_bytes=4000)
    assert len(texts) == len(ys) == sum(not held_out(i) for i in range(60))
    assert sum(map(len, texts)) <= 4000 and set(ys) == {0, 1}


def held_out(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % quality.FOLDS == 0
