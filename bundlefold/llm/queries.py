"""The registered queries opN_<name> of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import build, neighbours

    rows = common.table(spark, sf_dir, "embeddings")
    return neighbours(build(rows, 20), rows.where("vec_id % 20 = 0"), 20)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import benchmark_hits

    out = benchmark_hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import read_token_files, shard_count, write_token_files

    docs = common.table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), 0, common.new_folder(spark, "token-files"), shard_count(docs))
    return read_token_files(manifest)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import secret_findings

    return secret_findings(common.table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent import lm_scores

    return lm_scores(common.table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill: pages are written as WARC files, a replica is made in which a byte of one record in 97 is changed, and
    the audit of the two has to find just these."""
    from .fixity import audit, copy_replica, read_warc, write_warc
    from .tokenfile import shard_count

    pages = common.table(spark, sf_dir, "pages")
    one, two = common.new_folder(spark, "warc"), common.new_folder(spark, "warc-replica")
    index = write_warc(pages, one, shard_count(pages))
    copy_replica(index, one, two, "page_id % 97 = 13")
    payloads = read_warc(index, one).select("file", "ordinal", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "intact")
    # Spark takes what a few files' names lead to for as small as the names, and would send it to every task
    return audit(index, one, two).join(payloads.hint("merge"), ["file", "ordinal"]).select("page_id", "n_bytes", "payload_sha256", "intact", "damaged")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


_OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) AS s FROM iw WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win
), dwin AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS s FROM dw, sizes WHERE len(w) >= n
), hit AS (SELECT doc_id, i, dwin.n, item_id FROM dwin JOIN win USING (n, s)
), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP9_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS payload_sha256, true AS intact, page_id % 97 = 13 AS damaged FROM pages
"""

ORACLE_SQL = {"op9_warc_fixity": _OP9_SQL, "op3_benchmark_decontamination": _OP3_SQL}
