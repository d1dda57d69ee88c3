"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from millrace.llm import decontamination, exact_dedup, html_text, jaccard_join, lm_score, mixing, quality, secrets, substring_dedup, token_output
from millrace.llm.common import Query, read

EXACT_DEDUP = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""


def op1_html_text(spark, sf_dir):
    return html_text.html_text(read(spark, sf_dir, "pages"))


def op2_lm_score(spark, sf_dir):
    return lm_score.lm_score(read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(read(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_token_output(spark, sf_dir):
    return token_output.token_output(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_secrets(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard_join.ORACLE, "op4_substring_dedup": substring_dedup.ORACLE, "op5_mixing": mixing.ORACLE, "op6_decontamination": decontamination.ORACLE, "op9_exact_dedup": EXACT_DEDUP}
