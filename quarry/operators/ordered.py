"""Operators over ordered rows, as windows with explicit frames and tiebreaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.cluster import spread


def nearest_anchor(rows: DataFrame, by: str, order: Sequence[str], anchor: Column, reach: int = 60, ahead: int = 5, own: Column | None = None) -> DataFrame:
    """Adds inferred: the nearest anchor before if the one after agrees (without case) or is missing; one after alone only within ``ahead`` rows.

    What is the row's ``own`` name, but for case and space, is never inferred.
    """
    w = Window.partitionBy(by).orderBy(*order)
    told = rows.withColumns({"_a": anchor, "_i": F.row_number().over(w)})
    back, forth = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)
    told = told.withColumns(
        {
            "_b": F.last("_a", ignorenulls=True).over(back),
            "_f": F.first("_a", ignorenulls=True).over(forth),
            "_d": F.first(F.when(F.col("_a").isNotNull(), F.col("_i")), ignorenulls=True).over(forth) - F.col("_i"),
        }
    )
    agreed = F.col("_b").isNotNull() & F.col("_f").isNotNull() & (F.lower("_b") == F.lower("_f"))
    inferred = F.when(agreed | (F.col("_b").isNotNull() & F.col("_f").isNull()), F.col("_b")).when(F.col("_b").isNull() & (F.col("_d") <= ahead), F.col("_f"))
    if own is not None:
        plain = lambda c: F.lower(F.btrim(c))
        inferred = F.when(~F.coalesce(plain(inferred) == plain(own), F.lit(False)), inferred)
    return told.withColumn("inferred", inferred).drop("_a", "_i", "_b", "_f", "_d")


def neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Adds prev and next of the value."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"prev": F.lag(value).over(w), "next": F.lead(value).over(w)})


def column_gap(rows: DataFrame, by: str, value: str, width: Column, order: str, least_rows: int = 6, least_gap: float = 0.08, middle: tuple[float, float] = (0.3, 0.7), least_side: int = 3, share: float = 0.15) -> DataFrame:
    """(by, mid): the middle of the widest gap between sorted values, where it is wide and central enough and both sides are filled."""
    w = Window.partitionBy(by).orderBy(value, order)
    gaps = rows.withColumns({"_w": width, "_next": F.lead(value).over(w)}).withColumn("_gap", F.col("_next") - F.col(value))
    best = gaps.groupBy(by).agg(F.count("*").alias("_n"), F.first("_w").alias("_w"), F.max("_gap").alias("_g"), F.max_by((F.col(value) + F.col("_next")) / 2, F.struct("_gap", -F.col(value))).alias("mid"))
    best = best.where((F.col("_n") >= least_rows) & (F.col("_g") >= least_gap * F.col("_w")) & F.col("mid").between(F.col("_w") * middle[0], F.col("_w") * middle[1]))
    sides = rows.select(by, value).join(best, by).groupBy(by, "mid", "_n").agg(F.count_if(F.col(value) < F.col("mid")).alias("l"), F.count_if(F.col(value) >= F.col("mid")).alias("r"))
    return sides.where(F.least("l", "r") >= F.greatest(F.lit(least_side), share * F.col("_n"))).select(by, "mid")


def prefix_share(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: Column) -> DataFrame:
    """Adds start and end: each row's share of its group's total size, laid end to end with one between rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    told = rows.withColumn("_s", F.greatest(F.lit(1), size))
    before = F.coalesce(F.sum(F.col("_s") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col("_s") + 1).over(Window.partitionBy(*by)) - 1
    return told.withColumns({"start": before / total, "end": (before + F.col("_s")) / total}).drop("_s")


def chunk(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int = 50) -> DataFrame:
    """Adds chunk: 0 for the first ``size`` rows of a group, and so on."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long"))


def systematic_sample(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Rows i * len // n of each ordered group."""
    w = Window.partitionBy(*by)
    told = rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    k = F.ceil(F.col("_r") * n / F.col("_n"))
    return told.where((F.col("_n") <= n) | ((k < n) & (F.floor(k * F.col("_n") / n) == F.col("_r")))).drop("_r", "_n")


def interpolate(rows: DataFrame, by: Sequence[str], at: str, value: str, tie: Sequence[str], gap: int) -> DataFrame:
    """Adds filled: the value itself, or between the nearest known ones before and after within ``gap`` of ``at``."""
    w = Window.partitionBy(*by).orderBy(at, *tie)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    told = rows.withColumn("_k", known).withColumns({"_p": F.last("_k", ignorenulls=True).over(before), "_q": F.first("_k", ignorenulls=True).over(after)})
    span, near = F.col("_q.at") - F.col("_p.at"), (F.col(at) - F.col("_p.at") <= gap) & (F.col("_q.at") - F.col(at) <= gap)
    line = F.when(span == 0, F.col("_p.v")).otherwise(F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col(at) - F.col("_p.at")) / span)
    return told.withColumn("filled", F.coalesce(F.col(value), F.when(near, line))).drop("_k", "_p", "_q")


def first_hit(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, cell: float, last: bool = False) -> DataFrame:
    """(point_id, box_id): the first (or last) box in order that holds the point; they meet in grid cells of ``cell``.

    Of boxes in one place only the first (last) can be hit, and points in one place are asked for once, so neither multiplies the other.
    """
    best = F.max if last else F.min
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    corners, at = ["x1", "y1", "x2", "y2"], [F.floor(F.col(c) / cell) for c in "xy"]
    places = spread(boxes.groupBy(*corners).agg(best(box_id).alias(box_id)), *corners)
    held = places.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    spots = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    asked = spread(spots.select("x", "y").distinct(), "x", "y").withColumns({"cx": at[0], "cy": at[1]})
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    hit = asked.join(held.hint("merge"), ["cx", "cy"]).where(inside).groupBy("x", "y").agg(best(box_id).alias(box_id))
    return spots.select(point_id, "x", "y").join(hit, ["x", "y"]).groupBy(point_id).agg(best(box_id).alias(box_id))
