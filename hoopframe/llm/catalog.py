"""The registered queries of this subpackage, their SQL where there is one, and the contract columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, line_dedup, lm, minhash, mixing, newer_queries, quality, suffixes, token_counts, windows  # noqa: F401
from .common import documents
from .registry import ORACLES, QUERIES, query  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(docs: DataFrame) -> DataFrame:
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN)


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.decode(encoded(documents(spark, sf_dir)), RANKS)
    return tokens.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_lm_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), RANKS)


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY t) AS group_size
           FROM n WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(t) AS text_sha256 FROM g"""


@query("op6_exact_dedup", EXACT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     w AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3),
     p AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS part FROM w),
     f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp, row_number() OVER o AS r
           FROM p WHERE regexp_matches(part, '[^\x20\x09-\x0D]')
           WINDOW o AS (PARTITION BY part ORDER BY doc_id, pos)),
     c AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN fd = doc_id THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS line
           FROM f WHERE r > 1),
     k AS (SELECT doc_id, list(line ORDER BY line) AS removed FROM c GROUP BY doc_id),
     s AS (SELECT d.doc_id, lines, coalesce(removed, []) AS removed FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(removed) AS BIGINT) AS n_removed,
       array_to_string(removed, ',') AS removed_lines,
       sha256(array_to_string([lines[i + 1] FOR i IN range(0, len(lines)) IF NOT list_contains(removed, i)], chr(10))) AS text_sha256
FROM s"""


@query("op7_line_dedup", LINES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                        F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"),
                        F.sha2("text", 256).alias("text_sha256"))


@query("op8_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir), k=4, percent=80)


@query("op5_compact_windows")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.near_passages(documents(spark, sf_dir))


@query("op9_suffix_arrays")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir))


@query("op10_mix_sources")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = mixing.mix_by_source(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
