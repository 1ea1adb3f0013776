"""The operators of this package applied to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bloom_lm, cube_mix, decontaminate, lang_id, line_dedup, merkle, pii, simhash, span_dedup, token_rollup
from tidemark.llm.common import scratch_root, table, written


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents")).drop("row_key")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load with estimated counts, their revision, a second tokenizer version and a deletion.

    Every batch is committed twice, as after a retry.
    """
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    words = cube_mix.word_count(F.col("text"))
    letters = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long"), F.lit(0).cast("long"))
    counted = written(docs.select("doc_id", "source", "lang", F.floor(F.coalesce("n_chars", F.lit(0)) / 6).alias("estimate"), words.alias("words"), letters.alias("letters")))
    gone = counted.join(toxic, "doc_id", "left_semi")
    rollup = token_rollup.TokenRollup(spark, f"{scratch_root(spark)}/rollup-{uuid.uuid4().hex}")
    batches = {
        "load-blank-v1": token_rollup.inserts(counted, "blank-v1", F.col("estimate")),
        "recount-blank-v1": token_rollup.revisions(counted, "blank-v1", F.col("words"), F.col("estimate")),
        "load-letters-v1": token_rollup.inserts(counted, "letters-v1", F.col("letters")),
        "delete-toxic": token_rollup.deletes(gone, "blank-v1", F.col("words")).unionByName(token_rollup.deletes(gone, "letters-v1", F.col("letters"))),
    }
    for _ in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes)
    return rollup.totals()


OP7_ORACLE = r"""
WITH d AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
c AS (SELECT source, lang, 'blank-v1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS n FROM d
      UNION ALL SELECT source, lang, 'letters-v1', len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM d)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY ALL
"""


def op8_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_span_dedup": op3_span_dedup,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_bloom_lm": op6_bloom_lm,
    "op7_token_rollup": op7_token_rollup,
    "op8_cube_mix": op8_cube_mix,
    "op9_language_id": op9_language_id,
    "op10_merkle_fingerprints": op10_merkle_fingerprints,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_span_dedup": span_dedup.ORACLE,
    "op7_token_rollup": OP7_ORACLE,
}
