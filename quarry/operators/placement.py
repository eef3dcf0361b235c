"""Placement of entries on places: nearest places, unique owners, the same person elsewhere, votes, and ward addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.streets import same_street
from quarry.operators.linkage import next_number
from quarry.operators.quality import middles


def places_within(points: DataFrame, places: DataFrame, point_id: str, place_id: str, reach: float) -> DataFrame:
    """(point_id, place_id, metres) of all places within ``reach``; they meet in grid cells of that size."""
    cell = lambda c: F.floor(F.col(c) / reach)
    held = places.select(place_id, F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = points.select(point_id, "x", "y", around.alias("c")).select(point_id, "x", "y", "c.cx", "c.cy")
    far = F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y"))
    return asked.join(held, ["cx", "cy"]).select(point_id, place_id, far.alias("metres")).where(F.col("metres") <= reach)


def snap(points: DataFrame, places: DataFrame, point_id: str, place_id: str, reach: float = 8.0) -> DataFrame:
    """The nearest place within ``reach``, ties by place."""
    best = places_within(points, places, point_id, place_id, reach).groupBy(point_id).agg(F.min(F.struct("metres", place_id)).alias("b"))
    return best.select(point_id, f"b.{place_id}", "b.metres")


def premises(rows: DataFrame, use: str, none: str) -> DataFrame:
    """Places whose use isn't one without premises (a regular expression); unknown uses stay."""
    return rows.where(~F.coalesce(F.col(use).rlike(none), F.lit(False)))


def unique_owner(rows: DataFrame, owners: DataFrame, by: Sequence[str], place: str, row_id: str, rare: int = 3) -> DataFrame:
    """(row_id, place_id) of rows whose owner (``by``) holds exactly one place in the street, and at most ``rare`` anywhere.

    ``owners`` has by, street and ``place``; readings that name the same place count once.
    """
    held = owners.select(*by, "street", F.col(place).alias("place_id")).distinct()
    few = held.groupBy(*by).agg(F.count_distinct("place_id").alias("n")).where(F.col("n") <= rare).select(*by)
    one = held.join(few, list(by), "left_semi").groupBy(*by, "street").agg(F.count("*").alias("n"), F.min("place_id").alias("place_id")).where("n = 1")
    return rows.join(one, [*by, "street"]).select(row_id, "place_id")


def same_person_elsewhere(rows: DataFrame, placed: DataFrame, row_id: str, who: Sequence[str], street: str) -> DataFrame:
    """(row_id, place_id) of unplaced rows whose person is placed elsewhere in the same street, on exactly one place.

    Places are one where the least is the greatest, so a person's distinct streets meet with these two of
    each, however many rows and places the person has.
    """
    ends = lambda low, high: (F.min(low).alias("_low"), F.max(high).alias("_high"))
    known = rows.join(placed.hint("merge"), row_id).groupBy(*who, F.col(street).alias("_street")).agg(*ends("place_id", "place_id"))
    left = rows.join(placed.select(row_id).hint("merge"), row_id, "left_anti").dropna(subset=list(who))
    for w in who:
        left = left.where(F.col(w).cast("string") != "")
    met = left.select(*who, street).distinct().join(known.hint("merge"), list(who)).where(same_street(F.col(street), F.col("_street")))
    told = met.groupBy(*who, street).agg(*ends("_low", "_high"))
    found = left.join(told.hint("merge"), [*who, street]).groupBy(row_id).agg(*ends("_low", "_high"))
    return found.where("_low = _high").select(row_id, F.col("_low").alias("place_id"))


def renumbered_streets(rows: DataFrame, ward: str, number: str, least: int = 2, near: float = 30.0) -> DataFrame:
    """(street, median): streets whose neighbouring ward numbers with house numbers one apart lie further apart than neighbours do.

    ``rows`` has ward, number, street, house, x and y; a street needs ``least`` such pairs.
    """
    told = rows.groupBy(ward, number).agg(F.min(F.struct("street", "house", "x", "y")).alias("v"))
    pairs = next_number(told.withColumn("v", F.struct("v.street", "v.house", "v.x", "v.y")), [ward], number, "v")
    same = pairs.where((F.col("v.street") == F.col("next_v.street")) & (F.abs(F.col("v.house") - F.col("next_v.house")) == 1))
    gaps = same.select("v.street", F.hypot(F.col("v.x") - F.col("next_v.x"), F.col("v.y") - F.col("next_v.y")).alias("gap"))
    many = gaps.groupBy("street").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return middles(gaps, "street", "gap").join(many, "street").where(F.col("high") > near).select("street", F.col("high").alias("median"))


def neighbours_agree(rows: DataFrame, by: Sequence[str], order: Sequence[str], street: str, place: str, reach: float) -> DataFrame:
    """Adds found and rule: an unplaced row between placed ones of its street.

    The same number as a neighbour takes its place; else neighbours before and after of the
    same street within ``reach`` of each other in x and y give their middle.
    """
    w = Window.partitionBy(*by, street).orderBy(*order)
    known = F.when(F.col(place).isNotNull(), F.struct(F.col("number").alias("n"), F.col(place).alias("p"), F.col("x").alias("x"), F.col("y").alias("y")))
    told = rows.withColumn("_k", known)
    told = told.withColumns({"_p": F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_q": F.first("_k", True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    same = F.when(F.col("_p.n") == F.col("number"), F.col("_p")).when(F.col("_q.n") == F.col("number"), F.col("_q"))
    close = F.hypot(F.col("_p.x") - F.col("_q.x"), F.col("_p.y") - F.col("_q.y")) <= reach
    between = F.when(close, F.struct(((F.col("_p.x") + F.col("_q.x")) / 2).alias("x"), ((F.col("_p.y") + F.col("_q.y")) / 2).alias("y")))
    free = F.col(place).isNull()
    out = {
        "rule": F.when(free & same.isNotNull(), "same_number").when(free & between.isNotNull(), "between"),
        "fx": F.when(free, F.coalesce(same["x"], between["x"])),
        "fy": F.when(free, F.coalesce(same["y"], between["y"])),
    }
    return told.withColumns(out).drop("_k", "_p", "_q")


def vote_inside(rows: DataFrame, by: Sequence[str], ballot: str, at: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """(by, ballot, votes, cast, low, high): the winning ballot of each group and the range of ``at`` strictly inside which its voters agree.

    Ties go by ballot, of any type.
    """
    counts = rows.groupBy(*by, ballot).agg(F.count("*").alias("votes"), F.min(at).alias("low"), F.max(at).alias("high"))
    w = Window.partitionBy(*by)
    told = counts.withColumns({"cast": F.sum("votes").over(w), "_r": F.row_number().over(w.orderBy(F.desc("votes"), ballot))})
    return told.where((F.col("_r") == 1) & (F.col("votes") >= least) & (F.col("votes") >= share * F.col("cast"))).drop("_r")


def inside_range(rows: DataFrame, winners: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Rows with the ballot of their group whose ``at`` lies strictly inside the range of the agreeing ones."""
    return rows.join(winners, list(by)).where((F.col(at) > F.col("low")) & (F.col(at) < F.col("high")))


def placed_status(hits: DataFrame, by: str, street: str, number: str, year: Column, low: str = "from", high: str = "until") -> DataFrame:
    """(by, status, streets, numbers): house for one number valid in the year, ambiguous for more, street_only for none; distinct values joined."""
    some = hits.where((F.coalesce(F.col(low), F.lit(0)) <= year) & (year < F.coalesce(F.col(high), F.lit(9999))) & F.col(street).isNotNull())
    told = some.groupBy(by).agg(F.array_sort(F.collect_set(street)).alias("s"), F.array_sort(F.collect_set(F.nullif(F.col(number).cast("string"), F.lit("")))).alias("n"))
    status = F.when(F.size("n") == 1, "house").when(F.size("n") > 1, "ambiguous").otherwise("street_only")
    return told.select(by, status.alias("status"), F.array_join("s", " / ").alias("streets"), F.array_join("n", " / ").alias("numbers"))


def exact_letter_first(found: DataFrame, by: str, letter: str, wanted: str, value: str) -> DataFrame:
    """(by, letter, value): the result with the wanted letter, else the one with the first letter, nulls as empty."""
    told = F.coalesce(F.col(letter), F.lit(""))
    best = F.min(F.struct((told != F.coalesce(F.col(wanted), F.lit(""))).alias("other"), told.alias("letter"), F.col(value).alias("value")))
    return found.groupBy(by).agg(best.alias("b")).select(by, "b.letter", F.col("b.value").alias(value))


def geocode_kind(kind: Column, found: Column, approx: Column) -> Column:
    """The geocoder's type, else approx for placements by neighbours alone, else null."""
    return F.when(found, kind).when(F.coalesce(approx, F.lit(False)), "approx")


def place_groups(matches: DataFrame) -> DataFrame:
    """(pand_id, address, lat, lng, entries): ids of each address of a place, with the first entry's coordinates."""
    return matches.groupBy("pand_id", "address").agg(F.min_by("lat", "stable_id").alias("lat"), F.min_by("lng", "stable_id").alias("lng"), F.array_sort(F.collect_list("stable_id")).alias("entries"))


def with_entries(buildings: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Buildings that entries link to, with their number."""
    return buildings.join(entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("entry_count")), key)


def building_detail(buildings: DataFrame, entries: DataFrame, key: str, cluster: str, name: str, canonical: str, row_id: str, mention: Sequence[str]) -> DataFrame:
    """Buildings with their persons: clusters with nested mentions by row, persons by canonical name (missing first), then least name."""
    told = entries.where(F.col(key).isNotNull()).groupBy(key, cluster).agg(
        F.first(canonical, True).alias("canonical_name"), F.min(name).alias("_name"), F.array_sort(F.collect_list(F.struct(row_id, *[m for m in mention if m != row_id]))).alias("mentions")
    )
    order = F.struct(F.col("canonical_name").isNotNull().alias("named"), "canonical_name", "_name", F.col(cluster).cast("string").alias("cluster"), "mentions")
    persons = told.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("persons"))
    return buildings.join(persons, key)
