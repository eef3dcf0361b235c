"""Upkeep after edits: clusters that gained or lost an edge, and links and overrides merged in one pass with their counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import searchable_text
from quarry.operators import cluster, linkage, review
from quarry.operators.cluster import shared_folder


def touched_blocks(before: DataFrame, after: DataFrame, changed: DataFrame, row_id: str, block: Sequence[str]) -> DataFrame:
    """The blocks that hold a changed row now or held it before; ``changed`` has ``row_id``."""
    some = lambda rows: rows.join(changed.select(row_id).distinct(), row_id, "left_semi").select(*block)
    return some(before).unionByName(some(after)).distinct()


def _in(rows: DataFrame, blocks: DataFrame, block: Sequence[str]) -> DataFrame:
    held = blocks.toDF(*[f"_b_{b}" for b in block])
    return rows.join(held, [F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in block], "left_semi")


def refreshed_components(before: DataFrame, after: DataFrame, changed: DataFrame, components: DataFrame, row_id: str, block: Sequence[str], links: Sequence[Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Components (row_id, component) of ``after``, and the rows (row_id) that were worked out anew.

    ``components`` are those of ``before``; ``changed`` names all rows that were edited, added or
    removed. Edges are made for the blocks that hold or held such a row; the ends of edges that came or
    went are the frontier. The components of the frontier, as they were, are taken apart and put
    together again with their edges of now, so merges and splits come out alike; all other rows keep what they
    have and no edge of theirs is read.
    """
    shared_folder(before.sparkSession)
    blocks = touched_blocks(before, after, changed, row_id, block).checkpoint()
    edges = lambda rows: cluster.star_edges(_in(rows, blocks, block), row_id, block, links)
    old, new = edges(before).checkpoint(), edges(after).checkpoint()
    moved = old.exceptAll(new).unionByName(new.exceptAll(old))
    ends = moved.select(F.col("a").alias(row_id)).unionByName(moved.select(F.col("b").alias(row_id))).unionByName(changed.select(row_id)).distinct()
    hit = components.join(ends, row_id, "left_semi").select("component").distinct()
    were = components.join(hit, "component", "left_semi").select(row_id)
    frontier = were.unionByName(ends).distinct().join(after.select(row_id), row_id, "left_semi").checkpoint()
    # an edge of now between two rows of the frontier; new edges lie inside it, old ones inside old components
    inside = new.join(frontier.withColumnRenamed(row_id, "a"), "a", "left_semi")
    found = cluster.connected_components(frontier, inside, row_id)
    rest = components.join(were, row_id, "left_anti").join(changed.select(row_id), row_id, "left_anti")
    return rest.select(row_id, "component").unionByName(found), frontier


def save_edits(entries: DataFrame, edits: DataFrame, geocodes: DataFrame, buildings: DataFrame, components: DataFrame, key: str, columns: Sequence[str], search: Sequence[str], block: Sequence[str], links: Sequence[Sequence[str]], texts: Sequence[str], reach: float = 0.001) -> dict[str, DataFrame]:
    """entries, components, clusters and reindex after edits (``review.patch_entries``) and all that follows from them.

    An expanded street that doesn't contain the new street goes; rows that moved get the nearest building
    (pand_id, lat, lng) in reach; components are refreshed from the frontier; clusters has
    canonical values for the components that were worked out anew and no others; reindex has the ids whose
    search text changed, for ``search.refreshed_index``.
    """
    shared_folder(entries.sparkSession)
    told = review.patch_entries(entries, edits, geocodes, key, columns, search)
    stale = F.col("address_street_expanded").isNotNull() & F.col("address_street").isNotNull() & ~F.lower("address_street_expanded").contains(F.lower("address_street"))
    told = told.withColumn("address_street_expanded", F.when(~F.coalesce(stale, F.lit(False)), F.col("address_street_expanded")))
    names = edits.select(key).distinct()
    mine = told.join(names, key, "left_semi")
    points = mine.where("lat is not null and lng is not null").select(key, F.col("lat").alias("x"), F.col("lng").alias("y"))
    near = linkage.nearest_in_box(points, buildings.select("pand_id", F.col("lat").alias("x"), F.col("lng").alias("y")), key, "pand_id", reach)
    linked = told.join(near.select(F.col(key).alias("_k"), F.col("pand_id").alias("_p")), F.col(key) == F.col("_k"), "left").withColumn("pand_id", F.coalesce("_p", "pand_id")).drop("_k", "_p")
    edited = linked.join(names.withColumnRenamed(key, "_e"), F.col(key) == F.col("_e"), "left")
    text = searchable_text(*[F.col(c) for c in search])
    after = edited.withColumn("searchable_text", F.when(F.col("_e").isNotNull(), text).otherwise(F.col("searchable_text"))).drop("_e").checkpoint()
    now, frontier = refreshed_components(entries, after, names, components, key, block, links)
    held = after.join(now, key)
    anew = held.join(frontier, key, "left_semi")
    was = entries.select(F.col(key).alias("_k"), F.col("searchable_text").alias("_t"))
    changed = after.join(names, key, "left_semi").join(was, F.col(key) == F.col("_k")).where(~F.col("searchable_text").eqNullSafe(F.col("_t"))).select(key)
    return {"entries": after, "components": now, "clusters": cluster.canonical_values(anew, "component", key, texts), "reindex": changed}


def merge_links(entries: DataFrame, links: DataFrame, buildings: DataFrame, new_buildings: DataFrame, key: str, place: str, guard: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, buildings (place, ..., entry_count) and one row of counts after links (key, place, guard) and unlinks.

    A link takes effect where the entry has no place and still the same ``guard``; an
    unlink, whose guard is null, where the entry has that very place. Buildings that a link
    reaches are added from ``new_buildings`` where they are missing; those that a link or unlink
    reached are counted anew; those that an unlink emptied go. Counts come from the same pass
    over the entries that settles them: linked, unlinked, skipped, new_buildings, recounted, deleted.
    """
    shared_folder(entries.sparkSession)
    told = links.select(F.col(key).alias("_k"), F.col(place).alias("_p"), F.col(guard).alias("_g")).withColumn("_to", F.col("_g").isNotNull())
    met = entries.join(told, F.col(key) == F.col("_k"), "full")
    puts = F.col("_to") & F.col(place).isNull() & (F.col(guard) == F.col("_g"))
    takes = ~F.col("_to") & (F.col(place) == F.col("_p"))
    does = F.when(F.coalesce(puts, F.lit(False)), "linked").when(F.coalesce(takes, F.lit(False)), "unlinked").when(F.col("_k").isNotNull(), "skipped")
    settled = met.withColumn("_does", does).withColumn(place, F.when(F.col("_does") == "linked", F.col("_p")).when(F.col("_does") == "unlinked", None).otherwise(F.col(place))).checkpoint()
    after = settled.where(F.col(key).isNotNull())
    hit = settled.where("_does in ('linked', 'unlinked')").groupBy("_p").agg(F.bool_or(F.col("_does") == "unlinked").alias("_gone"), F.bool_or(F.col("_does") == "linked").alias("_came"))
    counts = after.join(hit.select(F.col("_p").alias(place)), place, "left_semi").groupBy(F.col(place).alias("_c")).agg(F.count("*").alias("_n"))
    changes = hit.join(counts, F.col("_p") == F.col("_c"), "left").select("_p", "_gone", "_came", F.coalesce("_n", F.lit(0)).alias("_n")).checkpoint()
    held = buildings.withColumn("_there", F.lit(True))
    fresh = new_buildings.join(buildings.select(place), place, "left_anti").join(changes.where("_came").select(F.col("_p").alias(place)), place, "left_semi").withColumn("_there", F.lit(False))
    every = held.unionByName(fresh, allowMissingColumns=True).join(changes, F.col(place) == F.col("_p"), "left")
    counted = every.withColumn("entry_count", F.coalesce("_n", "entry_count")).withColumn("_drop", F.coalesce(F.col("_gone") & (F.col("_n") == 0), F.lit(False))).checkpoint()
    does_count = lambda what: F.count_if(F.col("_does") == what).alias(what)
    told = settled.agg(does_count("linked"), does_count("unlinked"), does_count("skipped"))
    sums = counted.agg(F.count_if(~F.col("_there")).alias("new_buildings"), F.count_if(F.col("_p").isNotNull()).alias("recounted"), F.count_if("_drop").alias("deleted"))
    return after.select(*entries.columns), counted.where("not _drop").select(*buildings.columns), told.crossJoin(sums)  # one row beside one row


def merge_overrides(entries: DataFrame, overrides: DataFrame, key: str, mark: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Entries after overrides (key, mark, fields), and one row: applied, fell_back, missing.

    An override whose key is gone goes to the least entry of the same mark; several that
    come to one entry apply in order of key, what met directly last. Fields that are present overwrite,
    also with null. One full join settles which are which; the marks are asked for the rest alone.
    """
    shared_folder(entries.sparkSession)
    told = overrides.select(F.col(key).alias("_k"), F.col(mark).alias("_m"), F.col("fields").alias("_f"))
    met = told.join(entries.select(F.col(key).alias("_id")), F.col("_k") == F.col("_id"), "left").checkpoint()
    marks = entries.where(F.col(mark).isNotNull()).groupBy(F.col(mark).alias("_mark")).agg(F.min(key).alias("_other"))
    lost = met.where("_id is null").join(marks, F.col("_m") == F.col("_mark"), "left").select("_k", "_f", "_other")
    found = met.where("_id is not null").select("_k", "_f", F.col("_id").alias("_at"), F.lit(1).alias("_direct")).unionByName(lost.where("_other is not null").select("_k", "_f", F.col("_other").alias("_at"), F.lit(0).alias("_direct")))
    put = lambda c: F.max_by(F.struct(F.element_at("_f", c).alias("v")), F.when(F.map_contains_key("_f", F.lit(c)), F.struct("_direct", "_k"))).alias(f"_v_{c}")
    values = found.groupBy("_at").agg(*[put(c) for c in columns])
    out = entries.join(values, F.col(key) == F.col("_at"), "left")
    has = lambda c: F.col(f"_v_{c}").isNotNull()
    after = out.select(*[F.when(has(c), F.col(f"_v_{c}.v")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in entries.columns])
    report = lost.agg(F.count_if(F.col("_other").isNotNull()).alias("fell_back"), F.count_if(F.col("_other").isNull()).alias("missing"))
    return after, met.agg(F.count_if(F.col("_id").isNotNull()).alias("applied")).crossJoin(report)  # one row beside one row
