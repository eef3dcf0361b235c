"""Long-running jobs as tables: cached lookups, pending work, status and usage logs, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(work: DataFrame, done: DataFrame, key: str, again: Column | None = None) -> DataFrame:
    """Work whose key isn't done; results for which ``again`` holds don't count as done."""
    kept = done if again is None else done.where(~F.coalesce(again, F.lit(False)))
    return work.join(kept.select(key).distinct(), key, "left_anti")


def with_cache(work: DataFrame, cache: DataFrame, key: str, lookup: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], least: Column) -> tuple[DataFrame, DataFrame]:
    """(results, news): cached results of the work, and what ``lookup`` tells of distinct keys that the cache lacks.

    Keys for which ``least`` doesn't hold (an address without a number) aren't asked
    and get the status no_number.
    """
    keys = pending(work.select(key).where(F.col(key).isNotNull()).distinct(), cache, key)
    asked = keys.where(F.coalesce(least, F.lit(False))).mapInPandas(lookup, cache.schema)
    skipped = keys.where(~F.coalesce(least, F.lit(False))).withColumn("status", F.lit("no_number"))
    news = asked.unionByName(skipped, allowMissingColumns=True)
    return work.join(cache, key, "left"), news


def latest(log: DataFrame, key: Sequence[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; of equal times the largest ``tie``. Combined before the shuffle."""
    others = [c for c in log.columns if c not in key]
    best = F.max_by(F.struct(*others), F.struct(F.col(at), F.col(tie)))
    return log.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def resume(pages: DataFrame, status: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Pages whose newest status isn't completed."""
    done = latest(status, [key], at, tie).where("status = 'completed'")
    return pages.join(done.select(key), key, "left_anti")


def open_failures(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """(key, failures, error): pages whose newest row is a failure, with how often they failed."""
    counts = log.groupBy(key).agg(F.count_if(F.col("status") == "failed").alias("failures"))
    return latest(log, [key], at, tie).where("status = 'failed'").select(key, "error").join(counts, key)


def invalidated(status: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The status table without the rows of pages that are to run again."""
    return status.join(ids.select(key).distinct(), key, "left_anti")


def projection(usage: DataFrame, by: str, units: str, pages: int) -> DataFrame:
    """(by, n, mean, projected): mean units of a page and what ``pages`` pages would take."""
    return usage.groupBy(by).agg(F.count("*").alias("n"), F.avg(units).alias("mean"), (F.avg(units) * pages).alias("projected"))


def index_report(ours: DataFrame, theirs: DataFrame, key: str, most: int) -> DataFrame:
    """(side, n, sample): how many keys only one side has, and the first ``most`` of them."""

    def told(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        only = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")
        sample = only.orderBy(key).limit(most).agg(F.array_sort(F.collect_list(key)).alias("s"))  # at most that many
        text = F.array_join(F.transform("s", lambda x: x.cast("string")), ",")
        return only.agg(F.count("*").alias("n")).join(sample, F.lit(True), "left").select(F.lit(side).alias("side"), "n", text.alias("sample"))

    return told(ours, theirs, "missing").unionByName(told(theirs, ours, "unknown"))


def top_slices(rows: DataFrame, by: str, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    from pyspark.sql import Window

    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def match_summary(matches: DataFrame) -> DataFrame:
    """One row: places, addresses and entries of a match table, and how many entries are approximate."""
    return matches.agg(F.count_distinct("pand_id").alias("places"), F.count_distinct("pand_id", "address").alias("addresses"), F.count_distinct("stable_id").alias("entries"), F.count_if("approx").alias("approx"))


def link_payload(matches: DataFrame, buildings: DataFrame) -> DataFrame:
    """(pand_id, payload): links and building of each matched place as JSON, for a live store."""
    links = matches.groupBy("pand_id").agg(F.array_sort(F.collect_list("stable_id")).alias("entries"))
    return links.join(buildings, "pand_id").select("pand_id", F.to_json(F.struct("entries", *[c for c in buildings.columns if c != "pand_id"]), {"ignoreNullFields": "false"}).alias("payload"))
