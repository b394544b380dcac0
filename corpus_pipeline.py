"""A training-data pipeline over documents: STAGES, each written as Parquet and read again for the next.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and, but for the last, returns the columns of
docs: quality (documents that the classifier rejects go), near duplicates (of each group the document of least id
stays), decontamination (contaminated documents go), secrets (found ones are replaced in the text), packing (pieces).

Each stage takes nulls in any column, texts of any length, repeated rows and ids, ties (the least id, then the least row),
tables without rows and other columns of any name and type; its docstring says what becomes of them."""

from __future__ import annotations

from bundlefold.llm import common
from bundlefold.llm.decontam import uncontaminated
from bundlefold.llm.ngramjoin import one_of_each
from bundlefold.llm.packing import pack
from bundlefold.llm.quality import accepted
from bundlefold.llm.queries import tokenizer_path
from bundlefold.llm.secretscan import redacted
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A stage of learned models cannot be told in SQL; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores below the threshold go. Null and empty texts have the score of the labels' shares and go
    or stay together; rows that repeat a text get the same score; without labels every score is 0.5 and every row stays."""
    return accepted(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicate texts the row of the least id stays. Different texts of one id are judged each for
    itself; rows that repeat an id and its words go but one. Null, empty and wordless texts and rows without an id stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text is contaminated go, each row for itself, so repeated rows go or stay together; null, empty and
    wordless texts stay, as do all rows where the benchmark is empty."""
    return uncontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text become <kind>; n_chars, where there is one, follows the text. No row goes; null texts stay null, and
    rows that repeat are redacted each. A null source counts as an empty path."""
    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row, with their sequences. Null and empty texts have the end id only; repeated rows are packed
    each; a long text is cut into several pieces."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), 2)


STAGES = [("quality", quality), ("near duplicates", near_duplicate_stage), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
