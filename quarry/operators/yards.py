"""Placement of a directory's entries on the yards of a cadastre: twelve rules in order, each for what is still open.

``rows`` has row_id, ward, number, street (as printed), name, initial, along (today's street),
quay (numbered anew since, so that a point tells only the yard or the next), settled
(sources agree on the street) and x, y (today's point, or null). ``yards`` has
place_id, edges and box (``spatial.with_edges``), premises, section and parcel; ``owners``
place_id, name and initial; ``streets`` along and place_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import linkage, placement, runs, spatial
from quarry.operators.cluster import met_by_sort, shared_folder


def readings(rows: DataFrame, by: str, *pairs: tuple[str, str]) -> DataFrame:
    """(place_id, name, initial): every reading (name, initial) of an owner, each once; those without a name go."""
    told = F.explode(F.array(*[F.struct(F.col(n).alias("name"), F.coalesce(F.col(i), F.lit("")).alias("initial")) for n, i in pairs]))
    return rows.select(F.col(by).alias("place_id"), told.alias("r")).select("place_id", "r.name", "r.initial").where(F.coalesce("name", F.lit("")) != "").distinct()


def namesake_yards(rows: DataFrame, owners: DataFrame, streets: DataFrame) -> DataFrame:
    """(row_id, yard): the yards along a row's street of today that an owner of the same name holds."""
    held = streets.join(owners, "place_id").select("along", F.col("place_id").alias("yard"), F.col("name").alias("owner")).distinct()
    # a name that many rows of a street share meets its owners once
    asked = rows.select("along", "name").distinct()
    met = linkage.similar_names(asked, held, "name", "owner", ["along"])
    return rows.join(met.select("along", "name", "yard").distinct().hint("merge"), ["along", "name"]).select("row_id", "yard")


def rare_names(rows: DataFrame, owners: DataFrame, most: int) -> DataFrame:
    """(name, owner): names of rows whose like own at most ``most`` yards, a yard counting once for each name it is owned under, and these like names."""
    spread = owners.select(F.col("name").alias("owner"), "place_id").distinct().groupBy("owner").agg(F.count("*").alias("n"))
    met = linkage.similar_names(rows.select("name").distinct(), spread, "name", "owner").checkpoint()
    few = met.groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") <= most).select("name")
    return met.join(few.hint("merge"), "name", "left_semi").select("name", "owner")


def only_owner(rows: DataFrame, owners: DataFrame, streets: DataFrame, yards: DataFrame, most: int) -> DataFrame:
    """(row_id, place_id): the only yard in the street whose owner has the row's name and initial, for a name that is rare, if it has premises."""
    # rare names first: each has at most ``most`` yards, and no other name is looked for in the streets
    held = owners.withColumnRenamed("name", "owner").join(rare_names(rows, owners, most).hint("merge"), "owner").where(F.col("initial") != "")
    known = streets.join(held.select("place_id", "name", "initial").hint("merge"), "place_id").distinct()
    met = rows.join(known.hint("merge"), ["along", "name", "initial"])
    one = met.groupBy("row_id").agg(F.count("*").alias("n"), F.min("place_id").alias("place_id")).where("n = 1")
    return one.join(yards.where("premises").select("place_id"), "place_id", "left_semi").select("row_id", "place_id")


def placed_by_point(rows: DataFrame, yards: DataFrame, owners: DataFrame, streets: DataFrame, reach: float, pile: int, tree: spatial.Quadtree | None = None) -> DataFrame:
    """(row_id, place_id, how) of the rows whose point lies within ``reach`` of a yard.

    how: off (no premises there), quay, owner_next (moved to the yard that adjoins, the only one in the
    street that a namesake owns), piled (``pile`` or more numbers of wards come together on the yard) or point.
    """
    met = spatial.nearest(rows.where("x is not null and y is not null"), yards, "row_id", "place_id", reach, tree).select("row_id", "place_id")
    at = rows.drop("x", "y").join(met, "row_id").join(yards.select("place_id", "premises"), "place_id").checkpoint().hint("merge")
    tentative = at.where("premises and not quay")
    one = namesake_yards(tentative, owners, streets).groupBy("row_id").agg(F.count("*").alias("n"), F.min("yard").alias("yard")).where("n = 1").select("row_id", "yard")
    other = tentative.select("row_id", "place_id").join(one.hint("merge"), "row_id").where("yard <> place_id").join(yards.where("premises").select(F.col("place_id").alias("yard")), "yard")
    moved = spatial.pair_distances(other, yards, "place_id", "yard", "place_id").where("metres < 1").select("row_id", F.col("yard").alias("_moved"))
    told = at.join(moved.hint("merge"), "row_id", "left")
    counted = told.where("premises and not quay and _moved is null and ward is not null and number is not null")
    piles = counted.groupBy(F.col("place_id").alias("_p")).agg(F.count_distinct("ward", "number").alias("n")).where(F.col("n") >= pile).select("_p")
    told = told.join(piles.hint("merge"), F.col("place_id") == F.col("_p"), "left")
    how = F.when(~F.col("premises"), "off").when(F.col("quay"), "quay").when(F.col("_moved").isNotNull(), "owner_next").when(F.col("_p").isNotNull(), "piled").otherwise("point")
    return told.select("row_id", F.coalesce("_moved", "place_id").alias("place_id"), how.alias("how"))


def exact_numbers(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(ward, number, place_id, streets) of exactly placed rows; of several places of a number the least."""
    held = rows.join(placed, "row_id").where("ward is not null and number is not null")
    return held.groupBy("ward", "number").agg(F.min("place_id").alias("place_id"), F.collect_set("street").alias("streets"))


#: Rules whose placements are exact; all others name the yard or one near it.
EXACT = ("point",)


def place_on_yards(rows: DataFrame, yards: DataFrame, owners: DataFrame, streets: DataFrame, register: DataFrame, anchors: DataFrame, reach: float = 8.0, pile: int = 3, most: int = 8, tree: spatial.Quadtree | None = None) -> DataFrame:
    """(row_id, place_id, rule, exact) by quay, owner_next and point, then for what is left by register, parcel_run,
    owner, piled, premises, interpolate, same_person and anchors, in that order.

    ``register`` has (row_id, place_id) as another source names it, ``anchors`` what ``runs.between_anchors`` takes.
    """
    shared_folder(rows.sparkSession)
    # a yard's edges are read many times and worked out once
    rows, yards, owners, streets, register, anchors = met_by_sort(rows, yards.checkpoint(), owners, streets, register, anchors)
    points = placed_by_point(rows, yards, owners, streets, reach, pile, tree).checkpoint()
    how = lambda *names: points.where(F.col("how").isin(*names)).select("row_id", "place_id")
    exact = exact_numbers(rows, how("point")).checkpoint()
    lots = yards.where("parcel is not null").select("place_id", "section", "parcel")
    built = yards.where("premises")
    open_of = lambda df: lambda left, _: df.join(left.select("row_id").hint("merge"), "row_id", "left_semi")

    def to_premises(left: DataFrame, _: DataFrame) -> DataFrame:
        off = left.join(how("off").select("row_id").hint("merge"), "row_id", "left_semi")
        return spatial.nearest(off, built, "row_id", "place_id", reach, tree).select("row_id", "place_id")

    def person(left: DataFrame, placed: DataFrame) -> DataFrame:
        found = placement.same_person_elsewhere(rows.where("settled"), placed.select("row_id", "place_id"), "row_id", ["name", "initial"], "street")
        return found.join(left.select("row_id").hint("merge"), "row_id", "left_semi")

    between = runs.between_anchors(anchors, yards)
    rules = [
        *((name, open_of(how(name))) for name in ("quay", "owner_next", "point")),
        ("register", open_of(register)),
        ("parcel_run", lambda left, _: runs.parcel_run(lots, lots.join(built.select("place_id"), "place_id", "left_semi"))(left, exact)),
        ("owner", lambda left, _: only_owner(left.where("along is not null"), owners, streets, yards, most)),
        ("piled", open_of(how("piled"))),
        ("premises", to_premises),
        ("interpolate", lambda left, _: runs.interpolate(yards)(left, exact)),
        ("same_person", person),
        ("anchors", lambda left, _: between(left.where("settled"), exact)),
    ]
    return linkage.cascade(rows, "row_id", rules).withColumn("exact", F.col("rule").isin(*EXACT))
