"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes all documents that its predecessor kept, and its decisions take
effect: bad documents go, boilerplate lines go, one document of each group of
near duplicates stays, benchmark passages are cut, and the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bottomk, cotrain, decontaminate, line_dedup, packing
from quarry.llm.common import remove_folders, settle, swept, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def _measured(docs: DataFrame) -> DataFrame:
    """With n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def line_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(line_dedup.drop_boilerplate_lines(docs, counts=False))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bottomk.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_removal", line_removal),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Trained and heuristic stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        with swept() as folders:
            docs = settle(stage(spark, docs, sf_dir))
            used, folders[:] = folders[:-1], folders[-1:]  # the last one holds the stage's result
        remove_folders(used + before)
        before = folders[:]
    return STAGES[-1][1](spark, docs, sf_dir)
