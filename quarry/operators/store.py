"""Whole pipelines over the operators: the serving store, the linkage of a book, and the placement of its entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import streets
from quarry.functions import text as T
from quarry.operators import cluster, flatten, linkage, placement, quality
from quarry.sources.schemas import ENTRY_FIELDS

PARTS = ("address_street", "address_street_expanded", "address_number")
SEARCHED = ("name", "initials", "occupation", "occupation_expanded", "role", "parent_organization", "address_full", "phone", "notes")
FLAGS = ("verified", "needs_review", "bbox_unreliable")


def apply_corrections(entries: DataFrame, overrides: DataFrame, fields: Sequence[str] = ENTRY_FIELDS) -> DataFrame:
    """Entries after their overrides (stable_id, fields, flags, bbox).

    Fields that an override has overwrite, also with null; its box and the flags it
    gives replace the entry's. The full address follows edited parts unless it is given
    itself, and the search text is rebuilt where an override exists.
    """
    told = overrides.select(F.col("stable_id").alias("_id"), F.col("fields").alias("_f"), F.col("flags").alias("_g"), F.col("bbox.value").alias("_b"))
    out = entries.join(told, F.col("stable_id") == F.col("_id"), "left")
    has = lambda c: F.coalesce(F.map_contains_key("_f", F.lit(c)), F.lit(False))
    edited = has(PARTS[0]) | has(PARTS[1]) | has(PARTS[2])
    whole = has("address_full")
    out = out.withColumns({c: F.when(has(c), F.element_at("_f", c)).otherwise(F.col(c)) for c in fields})
    street = F.coalesce(F.nullif(F.col("address_street_expanded"), F.lit("")), F.col("address_street"))
    out = out.withColumn("address_full", F.when(edited & ~whole, T.build_address(street, F.col("address_number"))).otherwise(F.col("address_full")))
    put: dict[str, Column] = {f"flag_{f}": F.coalesce(F.element_at("_g", f), F.col(f"flag_{f}")) for f in FLAGS}
    put["entry_bbox"] = F.coalesce("_b", "entry_bbox")
    put["searchable_text"] = F.when(F.col("_id").isNotNull(), T.searchable_text(*[F.col(c) for c in SEARCHED])).otherwise(F.col("searchable_text"))
    return out.withColumns(put).select(*entries.columns)


def build_store(pages: DataFrame, overrides: DataFrame, geocodes: DataFrame, matches: DataFrame, names: Mapping[str, str], special: Mapping[str, str], markers: Sequence[str]) -> dict[str, DataFrame]:
    """entries, cross_references and buildings of page documents.

    Flatten, correct, mend addresses, look places up by the full address or by street
    and number, take the links of ``matches`` (stable_id, pand_id, approx), mark
    fingerprints, and cluster entries of one name that share a building.
    """
    flat = flatten.flatten_pages(pages).withColumn("searchable_text", T.searchable_text(*[F.col(c) for c in SEARCHED]))
    flat = flat.withColumns({f"flag_{f}": F.lit(False) for f in FLAGS})
    fixed = streets.correct_addresses(apply_corrections(flat, overrides), names, special, markers)
    street = F.coalesce(F.nullif(F.col("address_street_expanded"), F.lit("")), F.col("address_street"))
    keyed = fixed.withColumns({"_k1": T.normalize_address(F.col("address_full")), "_k2": T.normalize_address(T.build_address(street, F.col("address_number")))})
    placed = linkage.lookup_with_fallback(keyed.withColumnsRenamed({"_k1": "key1", "_k2": "key2"}), geocodes, "key1", "key2", "address", ["status", "lat", "lng", "score", "type"]).drop("key1", "key2")
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    placed = placed.withColumns({"lat": F.when(ok, F.col("lat")), "lng": F.when(ok, F.col("lng"))})
    linked = placed.join(matches.select("stable_id", "pand_id", "approx"), "stable_id", "left")
    kind = placement.geocode_kind(F.col("type"), F.col("hit").isNotNull(), F.col("approx"))
    entries = linked.withColumns({"geocode_type": kind, "fingerprint": T.fingerprint(F.col("name"), F.col("address_full"))}).drop("type", "hit", "approx")
    edges = cluster.star_edges(entries.select("stable_id", "name", "pand_id"), "stable_id", ["name"], [["pand_id"]])
    persons = cluster.connected_components(entries, edges, "stable_id").withColumnRenamed("component", "person_id")
    entries = entries.join(persons, "stable_id")
    xrefs = entries.select("stable_id", F.explode("cross_references").alias("x")).select("stable_id", F.coalesce("x.type", "x.text").alias("text"), F.coalesce("x.page", "x.page_number").alias("page_number"))
    buildings = entries.where("pand_id is not null").groupBy("pand_id").agg(F.count("*").alias("entry_count"))
    return {"entries": entries, "cross_references": xrefs, "buildings": buildings}


def link_book(entries: DataFrame, index: DataFrame, rules: Sequence[tuple[str, str]], spellings: Sequence[tuple[str, str]]) -> dict[str, DataFrame]:
    """matches, groups, summary and unmatched examples of a book's entries (stable_id, address, lat, lng) against an index (street, number, letter, place_id).

    Entries without a place on the map or a readable address take no part. An address is read, and its
    aliases are tried, once, however many entries give it.
    """
    some = entries.where(F.col("lat").isNotNull() & F.col("address").isNotNull())
    # exploded, as the filter would read every entry's address before they are made distinct
    told = cluster.spread(some.select("address").distinct(), "address").withColumn("p", F.explode_outer(F.array(T.parse_address(F.col("address"))))).where("p is not null")
    asked = cluster.spread(told.select("p").distinct(), "p")
    probes = asked.select("p", T.aliases(F.col("p.street"), rules, spellings).alias("aliases"), F.col("p.number").alias("number"), F.col("p.letter").alias("letter"))
    found = told.join(linkage.tiered_match(probes, index, "p"), "p", "left").withColumn("_hit", F.col("place_id").isNotNull())
    rate = some.join(found, "address")
    matched = rate.where("_hit").select("stable_id", F.col("place_id").alias("pand_id"), T.normalize_address(F.col("address")).alias("address"), "lat", "lng", "alias_rank", "tier")
    return {
        "matches": matched,
        "groups": placement.place_groups(matched),
        "summary": quality.match_rate(rate, F.col("_hit")),
        "unmatched": rate.where("not _hit").orderBy("stable_id").limit(10).select("stable_id", "address"),
    }


def place_entries(rows: DataFrame, places: DataFrame, owners: DataFrame, row_id: str, who: Sequence[str], street: str, reach: float = 8.0, rare: int = 3) -> DataFrame:
    """(row_id, place_id, rule): by the nearest place within ``reach``, then by a rare owner's only place in the street, then by where the same person is placed.

    ``rows`` has x, y, ``who`` and ``street``; ``owners`` has ``who``, street and place.
    """
    point = lambda left, _: placement.snap(left, places, row_id, "place_id", reach).select(row_id, "place_id")
    owner = lambda left, _: placement.unique_owner(left, owners, who, "place", row_id, rare)

    def person(left: DataFrame, placed: DataFrame) -> DataFrame:
        found = placement.same_person_elsewhere(rows, placed.select(row_id, "place_id"), row_id, who, street)
        return found.join(left.select(row_id), row_id, "left_semi")

    return linkage.cascade(rows, row_id, [("point", point), ("owner", owner), ("same_person", person)])
