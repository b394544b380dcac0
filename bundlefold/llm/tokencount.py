"""Token counts (operator 8): texts are encoded in Arrow functions that return lengths only.

Batches are balanced by bytes, long texts are split where no token can span, and each distinct stretch of text is
encoded once in a worker (see encoder). Null texts are empty; empty texts have 0 tokens; repeated rows are counted
each, rows with a null id too; there are no ties to break. An empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _piece_lengths(path: str, texts: list[str]) -> list[int]:
    return [len(x) for x in common.held(("sentencepiece", path), lambda: _processor(path)).encode(texts, num_threads=1)]


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row. tokenizer: a file of the tokenizers library
    (.json) or of sentencepiece (.model)."""
    common.prepare(docs.sparkSession)

    def count(batches):
        from .encoder import encoder

        for batch in batches:
            for rows, data, offs in common.text_slices(batch, "text"):
                if tokenizer.endswith(".model"):
                    n = np.array(_piece_lengths(tokenizer, rows.column(1).fill_null("").to_pylist()), np.int64)
                else:
                    n = np.diff(encoder(tokenizer).encode(data, offs)[1])
                yield common.batch_of(_OUT, rows.column(0).cast(pa.int64()), np.diff(offs), n, n > limit)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(common.lean(count, tokenizer), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
