"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from vellum.llm import bpe, chat, exact, fingerprint, langid, lines, merkle, neardup, negatives, packing, quality, simhash, toxicity
from vellum.llm.shared import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chats_of(table(spark, sf_dir, "conversations"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_of(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_of(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_chat, op3_lines, op4_toxicity, op5_exact, op6_bpe, op7_near, op8_packing, op9_fingerprint, op10_language, op11_simhash, op12_negatives, op13_merkle)
} | {"pipeline": corpus_pipeline.run}

SAID = "<|im_end|><|im_start|>assistant ok"

#: ``formatted_chars`` follows from the template: markers around each block and between its turns, and one more character for each escape.
CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{SAID}'), (-1, 1, 'assistant', '{SAID}')
), marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '<(\\\\*)\\|', '<x\\1|', 'g'))
    + CASE WHEN opens THEN {len(chat.START)} + length(regexp_replace(role, '<(\\\\*)\\|', '<x\\1|', 'g')) + 1 + {len(chat.END)}
        + (length(role) - length(replace(role, chr(10), ''))) * {len(chat.ROLE_BREAK) - 1} ELSE {len(chat.TURN)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

ORACLE_SQL = {"op2_chat": CHAT_SQL, "op3_lines": lines.SQL, "op5_exact": EXACT_SQL, "op12_negatives": negatives.SQL, "op13_merkle": merkle.SQL}
