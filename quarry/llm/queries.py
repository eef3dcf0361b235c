"""The operators as queries over the tables, with their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bottomk, chat_format, cotrain, decontaminate, gru_lm, hard_negatives, line_dedup, manifest, mixture, packing, quality_rules, secret_scan, warc
from quarry.llm.common import table

#: The one conversation beside the table's: its texts are control strings of templates.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_format.digest_conversations(rows.unionByName(probe))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as JSON records of every layout, mapped back to canonical turns."""
    return chat_format.digest_layouts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_secrets(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_dropped")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.digest_components(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest_manifest(table(spark, sf_dir, "documents"))


def op13_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.digest_mixture(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_score": op4_lm_score,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_warc": op8_warc,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_near_dedup": op10_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mixture": op13_source_mixture,
    "chat_layouts": chat_layouts,
}

SQL: dict[str, str] = {
    "op1_chat_format": chat_format.SQL,
    "chat_layouts": chat_format.LAYOUTS_SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_warc": warc.SQL,
    "op10_near_dedup": bottomk.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_source_mixture": mixture.SQL,
}
