"""Corrections: present-key overrides, last-writer-wins merges, and conditional updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import searchable_text


def moment(stamp: Column) -> Column:
    """Milliseconds of a timestamp string; 0 where it is missing or unreadable."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(stamp)), F.lit(0))


def apply_overrides(rows: DataFrame, overrides: DataFrame, row_id: str, columns: Sequence[str], fields: str = "fields") -> DataFrame:
    """Overwrite ``columns`` where an override's map has their key, also when the value is null; adds edited."""
    held = overrides.select(F.col(row_id).alias("_id"), F.col(fields).alias("_f"))
    joined = rows.join(held, F.col(row_id) == F.col("_id"), "left")
    put = {c: F.when(F.coalesce(F.map_contains_key("_f", F.lit(c)), F.lit(False)), F.element_at("_f", c).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    edited = F.coalesce(F.size("_f") > 0, F.lit(False))
    return joined.withColumns({**put, "edited": edited}).select(*rows.columns, "edited")


def refresh_searchable(rows: DataFrame, columns: Sequence[str], into: str = "searchable_text") -> DataFrame:
    """Rebuild the search text of edited rows only."""
    return rows.withColumn(into, F.when(F.col("edited"), searchable_text(*[F.col(c) for c in columns])).otherwise(F.col(into)))


def last_writer_wins(edits: DataFrame, key: str, at: Column, source: str) -> DataFrame:
    """The edit of each key with the latest time; the earliest source wins ties. Combined before the shuffle."""
    early = -F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(0))
    best = F.min_by(F.struct(*edits.columns), F.struct(early, F.col(source)))
    return edits.groupBy(F.col(key).alias("_key")).agg(best.alias("_b")).select("_b.*")


def conflicts(edits: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """(key, versions) of keys whose edits differ in content."""
    told = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    return edits.groupBy(key).agg(F.count_distinct(told).alias("versions")).where("versions > 1")


def clear_values(rows: DataFrame, rejected: DataFrame, column: str, notes: str) -> DataFrame:
    """Null the column's rejected values and keep each in the notes."""
    gone = rejected.select(F.col(column).alias("_gone")).distinct()
    out = rows.join(gone, F.col(column) == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    note = F.concat_ws("; ", F.nullif(F.col(notes), F.lit("")), F.concat(F.lit(f"{column}: "), F.col(column)))
    return out.withColumns({"_note": F.when(hit, note).otherwise(F.col(notes)), "_put": F.when(~hit, F.col(column))}).select(*[F.col("_note").alias(c) if c == notes else F.col("_put").alias(c) if c == column else F.col(c) for c in rows.columns])


def link_where_open(rows: DataFrame, links: DataFrame, row_id: str, link: str, guard: str) -> DataFrame:
    """Set the link of rows that have none and whose ``guard`` is still what the link was made for."""
    told = links.select(F.col(row_id).alias("_id"), F.col(link).alias("_link"), F.col(guard).alias("_guard"))
    out = rows.join(told, (F.col(row_id) == F.col("_id")) & F.col(guard).eqNullSafe(F.col("_guard")), "left")
    return out.withColumn("_new", F.coalesce(link, "_link")).select(*[F.col("_new").alias(c) if c == link else F.col(c) for c in rows.columns])


def changed_fields(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, changes): a map of the columns whose values differ, nulls included."""
    both = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns]).join(new.select(key, *columns), key)
    each = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"), F.col(c).eqNullSafe(F.col(f"_o_{c}")).alias("same")) for c in columns])
    diff = F.transform(F.filter(each, lambda e: ~e["same"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return both.select(key, F.map_from_entries(diff).alias("changes")).where(F.size("changes") > 0)
