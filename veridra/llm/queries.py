"""Thin queries over the operators: whole tables, production parameters, digest columns of the contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridra.llm import bpe, chat, decontam, linededup, ppm, quality, secrets, simhash, tokencount, urls
from veridra.llm.common import table

WORD_VOCAB, BYTE_VOCAB = "word_bpe_49k.json", "byte_bpe_50k.json"


def vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocab(WORD_VOCAB))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.classify(table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocab(BYTE_VOCAB))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_decontamination, op3_simhash, op4_bpe, op5_quality, op6_ppm, op7_url_filter, op8_chat, op9_line_dedup, op10_token_counts)
}

#: Queries that plain SQL expresses.
ORACLES: dict[str, str] = {
    "op8_chat": """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
         list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE k = n GROUP BY prefix),
kept AS (SELECT conv_id, copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n))
SELECT t.conv_id, count(*) AS n_turns, any_value(copies) AS copies,
       string_agg('<|im_start|>' || role || chr(10) || regexp_replace(text, '<\\|(im_start|im_end)\\|>', '<| \\1 |>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY t.conv_id
""",
}
