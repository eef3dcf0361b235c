"""Clusters of mentions: edges inside blocks, connected components, canonical values."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def star_edges(rows: DataFrame, row_id: str, block: Sequence[str], links: Sequence[Sequence[str]]) -> DataFrame:
    """(a, b): rows of a block that agree in all columns of one of the ``links``.

    Rows that agree in one link are joined to the smallest of them, which connects
    them as all their pairs would, with one edge a row. Each link is a grouping of
    its own, so no disjunctive join arises. Null or empty values don't link.
    """
    out = None
    for link in links:
        keys = [*block, *link]
        some = rows
        for k in link:
            some = some.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
        some = some.select(*keys, F.col(row_id).alias("b"))
        least = some.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("b").alias("a"))
        edges = some.join(least, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select("a", "b").where("a <> b")
        out = edges if out is None else out.unionByName(edges)
    return out.distinct()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a local session without one gets its own."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(held or tempfile.mkdtemp(prefix="quarry-"))
    return (held or spark.sparkContext.getCheckpointDir()).rstrip("/")


def met_by_sort(*tables: DataFrame) -> list[DataFrame]:
    """Tables that grow with the input, however few bytes their files are: joins with them are never broadcast through the driver."""
    return [t.hint("merge") for t in tables]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all shuffle partitions, however few bytes they are: for what is small to read and long to work out."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def connected_components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach; nodes without edges are their own.

    Large and small stars alternate until the edges stay the same; each round is
    cut by a checkpoint, which survives the loss of executors.
    """
    shared_folder(nodes.sparkSession)
    now, before = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().checkpoint(), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        met = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        now = met.select("a", F.col("m").alias("b")).unionByName(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct().checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("a").alias("_n"), F.col("b").alias("_r"))
    return nodes.select(node).join(roots, F.col(node) == F.col("_n"), "left").select(node, F.coalesce("_r", node).alias("component"))


def longest(value: Column, order: Column) -> Column:
    """The longest non-empty value of a group, the first in order on ties."""
    text = F.nullif(value, F.lit(""))
    return F.min_by(text, F.when(text.isNotNull(), F.struct(-F.length(text), order)))


def canonical_values(rows: DataFrame, cluster: str, order: str, texts: Sequence[str], firsts: Sequence[str] = ()) -> DataFrame:
    """A row for each cluster: the longest value of ``texts``, the first non-null of ``firsts``, and entry_count."""
    return rows.groupBy(cluster).agg(
        *[longest(F.col(t), F.col(order)).alias(t) for t in texts],
        *[F.min_by(f, F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull(), F.col(order))).alias(f) for f in firsts],
        F.count("*").alias("entry_count"),
    )
