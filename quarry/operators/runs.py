"""Placement of unlinked numbers from the linked ones around them, and the hold-out of any such rule.

A rule is a function (rows, exact) -> (row_id, place_id). ``rows`` has row_id, ward, number
and street (as printed), ``exact`` the linked numbers, one row a (ward, number): place_id
and streets (array, as printed for them). A rule looks no further than some reach along
the numbers of a ward, so numbers meet in bins of that reach: a ward of any size is as
many keys as it has bins, and what a number can see is bounded by twice the reach.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.streets import same_street
from quarry.operators.cluster import met_by_sort
from quarry.operators.spatial import pair_distances

Rule = Callable[[DataFrame, DataFrame], DataFrame]


def around(numbers: DataFrame, held: DataFrame, reach: int) -> DataFrame:
    """``numbers`` (ward, number) beside the rows of ``held`` (ward, at, ...) with a number at most ``reach`` away.

    Both meet in bins of ``reach`` numbers; a held row enters its own, a number the three around it.
    """
    bin_ = lambda c: F.floor(F.col(c) / F.lit(reach))
    asked = numbers.withColumn("_bin", F.explode(F.array(*[bin_("number") + d for d in (-1, 0, 1)])))
    met = asked.join(held.withColumn("_bin", bin_("at")).hint("merge"), ["ward", "_bin"])
    return met.where(F.abs(F.col("at") - F.col("number")) <= reach).drop("_bin")


def _asked(rows: DataFrame) -> DataFrame:
    """The distinct numbers that rows ask for, so a number that many rows share is worked out once."""
    return rows.where(F.col("ward").isNotNull() & F.col("number").isNotNull()).select("ward", "number").distinct()


def parcel_run(parcels: DataFrame, yards: DataFrame, width: int = 6, least: int = 3, share: float = 0.6) -> Rule:
    """Where parcel numbers run along with a ward's numbers, up or down, a number between two that agree goes to its parcel.

    ``parcels`` (place_id, section, parcel) are those of linked places, ``yards``
    (section, parcel, place_id) those that can be gone to; of several places the
    least counts. Each linked number within ``width`` votes for the constant difference and the
    constant sum of its parcel number; the winner needs ``least`` votes and ``share`` of
    the linked numbers. Ties go to the least section, then upward runs, then the least
    constant. A number that is linked itself isn't placed.
    """

    def rule(rows: DataFrame, exact: DataFrame) -> DataFrame:
        rows, exact = met_by_sort(rows, exact)
        lots = parcels.groupBy("place_id").agg(F.min(F.struct("section", "parcel")).alias("lot")).hint("merge")
        linked = exact.select("ward", F.col("number").alias("at"), "place_id").join(lots, "place_id").select("ward", "at", "lot.section", "lot.parcel")
        ballots = around(_asked(rows), linked, width).withColumn("down", F.explode(F.array(F.lit(-1), F.lit(1))))  # down is less the sign of ``at``
        told = ballots.groupBy("ward", "number", "section", "down", (F.col("parcel") + F.col("down") * F.col("at")).alias("c"))
        counted = told.agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
        best = F.min(F.when(F.col("section").isNotNull() & F.col("c").isNotNull(), F.struct((-F.col("votes")).alias("votes"), "section", "down", "c", "low", "high")))
        won = counted.groupBy("ward", "number").agg((F.sum("votes") / 2).alias("n"), best.alias("w"))
        votes, n = -F.col("w.votes"), F.col("number")
        fit = won.where((votes >= least) & (votes >= share * F.col("n")) & (F.col("w.low") < n) & (n < F.col("w.high")))
        goal = fit.select("ward", "number", F.col("w.section").alias("section"), (F.col("w.c") - F.col("w.down") * n).alias("parcel"))
        free = goal.join(exact.select("ward", "number"), ["ward", "number"], "left_anti")
        found = free.join(yards.groupBy("section", "parcel").agg(F.min("place_id").alias("place_id")).hint("merge"), ["section", "parcel"])
        return rows.join(found.select("ward", "number", "place_id"), ["ward", "number"]).select("row_id", "place_id")

    return rule


def _same_as_any(street: Column, rows: DataFrame) -> DataFrame:
    """Rows (row_id, place_id, streets, ...) where the book's ``street`` is the same as one of ``streets``."""
    each = rows.withColumn("_s", F.explode(F.array_distinct("streets")))
    return each.where(same_street(street, F.col("_s"))).select("row_id", "place_id").distinct()


def interpolate(polygons: DataFrame, gap: int = 3, near: float = 15.0) -> Rule:
    """A number stands where the same number is linked, or on the nearer of the two linked ones around it.

    These must lie within ``gap`` on either side; unless they are on one place, one must be next
    to the number and their places (``polygons`` with place_id and edges) within ``near``. The
    street must be the same as one printed for the linked numbers used.
    """

    def rule(rows: DataFrame, exact: DataFrame) -> DataFrame:
        rows, exact = met_by_sort(rows, exact)
        held = exact.select("ward", F.col("number").alias("at"), "place_id", "streets")
        value = F.struct("at", "place_id", "streets")
        step = F.col("at") - F.col("number")
        nearest = lambda cond, way: F.min(F.when(cond, F.struct((way * step).alias("far"), value.alias("v"))))["v"]
        sides = around(_asked(rows), held, gap).groupBy("ward", "number").agg(nearest(step == 0, 1).alias("same"), nearest(step < 0, -1).alias("lo"), nearest(step > 0, 1).alias("hi"))
        same = sides.where("same is not null").select("ward", "number", "same.place_id", "same.streets")
        two = sides.where("same is null and lo is not null and hi is not null").withColumns({"a": F.col("lo.place_id"), "b": F.col("hi.place_id")})
        below, above = F.col("number") - F.col("lo.at"), F.col("hi.at") - F.col("number")
        close = pair_distances(two, polygons, "a", "b", "place_id").where((F.col("a") == F.col("b")) | ((F.least(below, above) <= 1) & (F.col("metres") <= near)))
        beside = close.select("ward", "number", F.when(below <= above, F.col("a")).otherwise(F.col("b")).alias("place_id"), F.concat("lo.streets", "hi.streets").alias("streets"))
        return _same_as_any(F.col("street"), rows.join(same.unionByName(beside), ["ward", "number"]))

    return rule


def between_anchors(anchors: DataFrame, polygons: DataFrame, gap: int = 3, near: float = 15.0) -> Rule:
    """As ``interpolate``, between numbers that another source places: ``anchors`` (ward, number, place_id, streets), one row a number.

    A linked number within ``gap`` is needed on both sides, never the number itself, and
    their places are the same or within ``near``; what is linked exactly plays no part.
    """

    def rule(rows: DataFrame, exact: DataFrame) -> DataFrame:
        rows, exact = met_by_sort(rows, exact)
        held = anchors.select(F.col("ward").alias("ward"), F.col("number").alias("at"), "place_id", "streets")
        asked = _asked(rows.withColumn("ward", F.col("source_ward"))) if "source_ward" in rows.columns else _asked(rows)
        ward = "source_ward" if "source_ward" in rows.columns else "ward"
        step = F.col("at") - F.col("number")
        nearest = lambda cond, way: F.min(F.when(cond, F.struct((way * step).alias("far"), F.struct("at", "place_id", "streets").alias("v"))))["v"]
        two = around(asked, held, gap).groupBy("ward", "number").agg(nearest(step < 0, -1).alias("lo"), nearest(step > 0, 1).alias("hi")).where("lo is not null and hi is not null")
        close = pair_distances(two.withColumns({"a": F.col("lo.place_id"), "b": F.col("hi.place_id")}), polygons, "a", "b", "place_id").where(F.col("metres") <= near)
        below, above = F.col("number") - F.col("lo.at"), F.col("hi.at") - F.col("number")
        beside = close.select(F.col("ward").alias("_w"), F.col("number").alias("_n"), F.when(below <= above, F.col("a")).otherwise(F.col("b")).alias("place_id"), F.concat("lo.streets", "hi.streets").alias("streets"))
        return _same_as_any(F.col("street"), rows.join(beside, (F.col(ward) == F.col("_w")) & (F.col("number") == F.col("_n"))))

    return rule


BUCKETS = ("same", "adjoining", "near", "further")


def bucket(metres: Column, same: Column, touch: float = 1.0, near: float = 10.0) -> Column:
    return F.when(same, BUCKETS[0]).when(metres < touch, BUCKETS[1]).when(metres <= near, BUCKETS[2]).otherwise(BUCKETS[3])


def holdout(rule: Rule, exact: DataFrame, polygons: DataFrame, reach: int) -> DataFrame:
    """(ward, number, place_id, predicted, metres, bucket): what ``rule`` says of each linked number from the others.

    All numbers are held out at once: each gets a ward of its own, which holds copies of the linked
    numbers within ``reach`` of it but not of itself, and the rule runs once over all
    of these. So a rule that looks ``reach`` numbers far gives what it would give for one number after
    the other; the copies are at most ``2 * reach`` a number, whatever the size of a ward.
    The street asked for is the least of those printed; numbers that the rule is silent about are absent.
    """
    fold = F.to_json(F.struct("ward", "number"))
    rows = exact.select(fold.alias("row_id"), fold.alias("ward"), F.col("ward").alias("source_ward"), "number", F.array_min("streets").alias("street"))
    seen = around(exact.select("ward", "number"), exact.select("ward", F.col("number").alias("at"), "place_id", "streets"), reach)
    masked = seen.where(F.col("at") != F.col("number")).select(fold.alias("ward"), F.col("at").alias("number"), "place_id", "streets")
    said = rule(rows, masked).withColumnRenamed("place_id", "predicted").hint("merge")
    met = exact.withColumn("row_id", fold).join(said, "row_id").select("ward", "number", "place_id", "predicted")
    told = pair_distances(met, polygons, "place_id", "predicted", "place_id")
    return told.withColumn("bucket", bucket(F.col("metres"), F.col("place_id") == F.col("predicted")))
