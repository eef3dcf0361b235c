"""Ward numbers of a book and the addresses that they became, from versions that hold from one year until another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.streets import same_street

#: Years that versions and questions meet in together.
YEARS = 25
OPEN_FROM, OPEN_UNTIL = 0, 9999


def versions_at(asked: DataFrame, versions: DataFrame, by: list[str], at: str, low: str = "from", high: str = "until", width: int = YEARS) -> DataFrame:
    """Rows of ``asked`` beside the versions of the same ``by`` whose half-open period holds ``at``.

    A version enters the bins of ``width`` years that its period meets, within the years asked for; a row its own
    bin. So a number with a long history of versions is as many keys as it has bins in use.
    """
    span = asked.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()  # one row
    if span["lo"] is None:
        return asked.join(versions.limit(0), by).where(F.lit(False))
    begin, end = F.coalesce(F.col(low), F.lit(OPEN_FROM)), F.coalesce(F.col(high), F.lit(OPEN_UNTIL))
    bin_ = lambda c: F.floor(c / F.lit(width))
    some = versions.withColumns({"_lo": F.greatest(begin, F.lit(span["lo"])), "_hi": F.least(end - 1, F.lit(span["hi"]))}).where("_lo <= _hi")
    placed = some.withColumn("_bin", F.explode(F.sequence(bin_(F.col("_lo")), bin_(F.col("_hi"))))).drop("_lo", "_hi")
    return asked.withColumn("_bin", bin_(F.col(at))).join(placed, [*by, "_bin"]).where((begin <= F.col(at)) & (F.col(at) < end)).drop("_bin")


def _joined(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""))), " / ")


def modern_addresses(entries: DataFrame, versions: DataFrame, parcels: DataFrame, rejected: DataFrame) -> DataFrame:
    """Entries (row_id, ward, number, street, year) with what their ward number is at their year.

    ``versions`` (ward, number, street, house, side, before, from, until): before is the street before a
    renumbering; ``parcels`` (ward, number, section, parcel, certainty); ``rejected`` (ward, number) are
    those that the source refuses. Adds status (house, ambiguous, street_only or none), modern_street, modern_number and
    side (distinct values in order, joined), street_check (ok where one of the streets, before included, is the same as the
    book's, else differs), parcel and certainty, and notes.
    Each (ward, number, year) is looked up once, however many entries have it.
    """
    ward, number = F.upper(F.btrim("ward")), F.regexp_replace(F.btrim("number"), r"\.+$", "")
    bare = F.regexp_replace(number, F.concat(F.lit("^(?i:(?:\\Q"), ward, F.lit("\\E +)+)")), "")
    told = entries.withColumns({"_w": F.coalesce(ward, F.lit("")), "_n": F.coalesce(F.when(ward == "", number).otherwise(bare), F.lit(""))})
    known = (F.col("_w") != "") & F.col("_n").rlike("^[0-9]")
    asked = told.where(known & F.col("year").isNotNull()).select(F.col("_w").alias("ward"), F.col("_n").alias("number"), "year").distinct()
    some = versions.where(F.coalesce("street", F.lit("")) != "").withColumnsRenamed({"street": "_street"})
    hit = versions_at(asked, some, ["ward", "number"], "year").groupBy("ward", "number", "year").agg(*[F.collect_set(c).alias(f"_{c}s") for c in ("_street", "house", "side", "before")])
    ever = versions.select("ward", "number").distinct().withColumn("_ever", F.lit(True))
    refused = rejected.select("ward", "number").distinct().withColumn("_refused", F.lit(True))
    lots = parcels.where("coalesce(section, '') <> '' and coalesce(parcel, '') <> ''").groupBy("ward", "number").agg(F.min(F.struct("section", "parcel", "certainty")).alias("_lot"))
    looked = asked.join(hit, ["ward", "number", "year"], "left").join(ever, ["ward", "number"], "left").join(refused, ["ward", "number"], "left").join(lots, ["ward", "number"], "left")
    keyed = looked.withColumnsRenamed({"ward": "_w", "number": "_n", "year": "_y"})
    out = told.join(keyed.withColumn("_found", F.lit(True)), (told["_w"] == keyed["_w"]) & (told["_n"] == keyed["_n"]) & (told["year"] == keyed["_y"]), "left").drop(keyed["_w"]).drop(keyed["_n"])
    houses = F.filter("_houses", lambda v: v != "")
    met = F.col("__streets").isNotNull()
    status = F.when(~met, "none").when(F.size(houses) == 1, "house").when(F.size(houses) > 1, "ambiguous").otherwise("street_only")
    # streets are compared once for each that the book and the source pair up
    pairs = out.where(met).select("street", F.explode(F.concat("__streets", F.coalesce("_befores", F.array().cast("array<string>")))).alias("_s")).distinct()
    alike = pairs.where(same_street(F.col("street"), F.col("_s"))).groupBy(F.col("street").alias("_book")).agg(F.collect_set("_s").alias("_alike"))
    out = out.join(alike, F.col("street") == F.col("_book"), "left")
    every = F.concat("__streets", F.coalesce("_befores", F.array().cast("array<string>")))
    check = F.when(met, F.when(F.coalesce(F.arrays_overlap("_alike", every), F.lit(False)), "ok").otherwise("differs")).otherwise("")
    notes = F.when(~F.coalesce(known, F.lit(False)), "no ward number").when(F.coalesce("_refused", F.lit(False)), "refused").when(~met & F.coalesce("_ever", F.lit(False)), "only in another period").otherwise("")
    none = F.lit("")
    return out.select(
        *entries.columns, status.alias("status"), F.coalesce(_joined(F.col("__streets")), none).alias("modern_street"), F.coalesce(_joined(F.col("_houses")), none).alias("modern_number"), F.coalesce(_joined(F.col("_sides")), none).alias("side"),
        check.alias("street_check"), F.coalesce(F.concat_ws(" ", "_lot.section", "_lot.parcel"), none).alias("parcel"), F.coalesce("_lot.certainty", none).alias("certainty"), notes.alias("notes"),
    )
