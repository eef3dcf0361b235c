"""Sums over the rows before a row, in the order of its group, where one group may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import settle, small

#: Rows that one range holds, about; more rows make more ranges.
ROWS_A_RANGE = 1_000_000


def running(df: DataFrame, group: str, order: list[str], amount: str, modulo: int | None = None, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """A settled ``df`` with _before (long): the sum of ``amount`` over the rows before it in its group, taken modulo ``modulo`` where given.

    Rows are dealt by ranges of (group, order), so that a large group spans many
    ranges and rows that tie in everything are split as well. Sums of a (range,
    group), of which there are at most as many as ranges and groups together, are
    added up by group; rows are added up within their range alone.
    """
    wrapped = (lambda c: F.pmod(c, F.lit(modulo))) if modulo else (lambda c: c)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_a_range))
    keys = [group, *order, "_tie"]
    dealt = settle(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(wrapped(F.sum(amount)).alias("_sum"))
    earlier = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(settle(sums.select("_r", "_g", wrapped(F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).alias("_offset"))), 100)
    within = Window.partitionBy("_range", group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_before", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = rows.join(offsets, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("_before", wrapped(F.col("_before") + F.col("_offset")).cast("long")).drop("_r", "_g", "_offset", "_range", "_tie")
