"""Review and correction of entries: overlays, sanitised edits, classes of doubtful streets, guarded updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import build_address, searchable_text
from quarry.operators.cluster import canonical_values
from quarry.operators.corrections import moment
from quarry.operators.ordered import nearest_anchor


def overlay(rows: DataFrame, held: DataFrame, key: str, stored: Sequence[str], own_first: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Page rows with what the table holds of them: ``stored`` columns from the table, ``own_first`` from the page unless null, ``flags`` true only where the table says so; rows that the table lacks stay as they are."""
    there = held.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_h_{c}") for c in (*stored, *own_first, *flags)])
    out, hit = rows.join(there, F.col(key) == F.col("_k"), "left"), F.col("_k").isNotNull()
    put = {c: F.when(hit, F.col(f"_h_{c}")).otherwise(F.col(c)) for c in stored}
    put |= {c: F.coalesce(c, F.when(hit, F.col(f"_h_{c}"))) for c in own_first}
    put |= {c: F.when(hit, F.coalesce(F.col(f"_h_{c}").cast("int") == 1, F.lit(False))).otherwise(F.col(c)) for c in flags}
    return out.withColumns(put).select(*rows.columns)


def sanitized(fields: Column, allowed: Sequence[str], choices: Mapping[str, Sequence[str]]) -> Column:
    """The allowed fields of an edit; a field with choices only with one of them or empty."""

    def fits(k: Column, v: Column) -> Column:
        ok = k.isin(*allowed)
        for name, some in choices.items():
            ok = ok & ((k != name) | v.isNull() | v.isin("", *some))
        return ok

    return F.map_filter(fields, fits)


def sane_box(box: Column) -> Column:
    """Four finite numbers, none below 0, rounded, with x2 > x1 and y2 > y1; else null."""
    whole = F.transform(box, lambda x: F.floor(x + 0.5).cast("int"))
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")) & (x >= 0))
    return F.when((F.size(box) == 4) & finite & (whole[2] > whole[0]) & (whole[3] > whole[1]), whole)


def page_slice(rows: DataFrame, page: str, told: str | None) -> DataFrame:
    """Pages of a range such as ``3-9``, ``7`` or ``5-``; None means all."""
    if not told:
        return rows
    low, dash, high = told.partition("-")
    out = rows.where(F.col(page) >= int(low)) if low else rows
    top = high if dash else low
    return out.where(F.col(page) <= int(top)) if top else out


def touched(rows: DataFrame, edited_at: str, flags: Sequence[str]) -> DataFrame:
    """Edited or flagged rows."""
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.coalesce(F.col(f).cast("boolean"), F.lit(False))
    return rows.where((F.coalesce(F.col(edited_at).cast("string"), F.lit("")) != "") | any_flag)


def by_status(rows: DataFrame, verified: Column, needs_review: Column, status: str) -> DataFrame:
    """Rows of a review status: all, verified, needs_review, or unreviewed with neither flag."""
    v, n = (F.coalesce(c, F.lit(False)) for c in (verified, needs_review))
    return rows.where({"all": F.lit(True), "verified": v, "needs_review": n, "unreviewed": ~v & ~n}[status])


def suspicious_numbers(rows: DataFrame, number: str, linked: Column, verified: Column, least_digits: int = 2, present: Sequence[str] = ()) -> DataFrame:
    """Unlinked, unverified rows whose number is all digits and longer than ``least_digits``; what is ``present`` (box, street) is neither null nor empty."""
    some = rows.where(~F.coalesce(linked, F.lit(False)) & ~F.coalesce(verified, F.lit(False)) & F.col(number).rlike(r"^[0-9]+$") & (F.length(number) > least_digits))
    for c in present:
        full = F.size(c) > 0 if rows.schema[c].dataType.typeName() == "array" else F.col(c) != ""
        some = some.where(F.coalesce(full, F.lit(False)))
    return some


def number_correction(row_id: Column, number: Column) -> Column:
    """What an accepted house number writes: the field, verified, and no longer in review."""
    fields = F.create_map(F.lit("address_number"), number.cast("string"))
    flags = F.create_map(F.lit("verified"), F.lit(True), F.lit("needs_review"), F.lit(False))
    return F.struct(row_id.alias("stable_id"), fields.alias("fields"), flags.alias("flags"))


def in_code_range(code: Column, low: int, high: int) -> Column:
    """The code's first four digits lie in the range; a missing, short or unreadable code passes."""
    head = F.substring(code, 1, 4).try_cast("int")
    return code.isNull() | (F.length(code) < 4) | head.isNull() | head.between(low, high)


def built_by(year: Column, last: int) -> Column:
    """Built up to a year; unknown years count as later."""
    return F.coalesce(year, F.lit(99999)) <= last


def contains(rows: DataFrame, columns: Sequence[str], part: str) -> DataFrame:
    """Rows with the part, without case, in one of the columns."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(c).contains(part.lower()), F.lit(False))
    return rows.where(test)


def doubtful_class(text: Column, canonical: Column, outside: Sequence[str], markers: Sequence[str], entities: Sequence[str], suffixes: Sequence[str]) -> Column:
    """Why a value is no street: place_outside, multi_address, caps_noise or entity_name, the first that holds; null for streets.

    ``canonical`` tells genuine streets. Lists are parameters.
    """
    low, trimmed = F.lower(text), F.rtrim(F.lower(text), F.lit(". "))
    suffixed = F.lit(False)
    for s in suffixes:
        suffixed = suffixed | trimmed.endswith(s)
    some = lambda t, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(t, p))
    place = text.isin(*outside) | (F.split(F.btrim(text), r"\s+")[0].isin(*outside) & ~suffixed)
    many = (text.contains(",") & ~text.startswith("'t ")) | some(text, markers)
    caps = (F.upper(text) == text) & (F.lower(text) != text) & ~suffixed
    entity = some(F.concat(F.lit(" "), low, F.lit(" ")), entities)
    found = F.when(place, "place_outside").when(many, "multi_address").when(caps, "caps_noise").when(entity, "entity_name")
    return F.when((F.coalesce(text, F.lit("")) != "") & ~F.coalesce(canonical, F.lit(False)), found)


def is_own_name(name: Column, street: Column, blocked: Sequence[str]) -> Column:
    """The street repeats the name, and isn't a blocked value."""
    n, s = (F.lower(F.btrim(c)) for c in (name, street))
    return F.coalesce((n == s) & (n != "") & ~s.isin(*[b.lower() for b in blocked]), F.lit(False))


def mend_own_names(rows: DataFrame, page: str, order: Sequence[str], name: str, street: str, expanded: str, number: str, full: str, search: Sequence[str], blocked: Sequence[str] = (), least: int = 5) -> DataFrame:
    """Rows whose street repeats their name get the street around them on the page, or none; adds mended: fixed, cleared or null.

    A street counts as known where ``least`` rows have it that don't repeat their name; known streets that aren't blocked are the anchors
    (``ordered.nearest_anchor``), and a street that is the row's own name is never taken. Street, expanded street,
    full address and searchable_text of the mended rows follow.
    """
    own = is_own_name(F.col(name), F.col(street), blocked)
    known = rows.where(~own & (F.coalesce(street, F.lit("")) != "")).groupBy(F.col(street).alias("_known")).agg(F.count("*").alias("_times")).where(F.col("_times") >= least).select("_known")
    told = rows.withColumn("_own", own).join(known, F.col(street) == F.col("_known"), "left")
    free = ~F.lower(F.btrim(street)).isin(*[b.lower() for b in blocked]) if blocked else F.lit(True)
    anchored = nearest_anchor(told, page, order, F.when(~F.col("_own") & F.col("_known").isNotNull() & free, F.col(street)), own=F.col(name))
    new = {street: F.col("inferred"), expanded: F.col("inferred"), full: F.when(F.col("inferred").isNotNull(), build_address(F.col("inferred"), F.col(number)))}
    put = {c: F.when(F.col("_own"), v).otherwise(F.col(c)) for c, v in new.items()}
    put["searchable_text"] = F.when(F.col("_own"), searchable_text(*[new.get(c, F.col(c)) for c in search])).otherwise(F.col("searchable_text"))
    mended = F.when(F.col("_own"), F.when(F.col("inferred").isNotNull(), "fixed").otherwise("cleared"))
    return anchored.select(*[put[c].alias(c) if c in put else F.col(c) for c in rows.columns], mended.alias("mended"))


def rejected_streets(rows: DataFrame, verdict: str, stale: str = "stale") -> DataFrame:
    """Reviewed rows whose verdict rejects the street; a verdict that begins with ``stale`` never does."""
    v = F.lower(F.btrim(F.coalesce(F.col(verdict), F.lit(""))))
    return rows.where((v != "") & ~v.startswith(stale) & v.isin("n", "no", "reject"))


def apply_review(rows: DataFrame, decisions: DataFrame, street: str, expanded: str, number: str, full: str, notes: str) -> DataFrame:
    """Clear the streets that a review (value, decision) says no to: both columns null, the number as full address, the old value in the notes."""
    gone = decisions.where(F.lower(F.btrim("decision")).isin("n", "no")).select(F.col("value").alias("_gone")).distinct()
    out = rows.join(gone, F.coalesce(F.nullif(F.col(expanded), F.lit("")), F.col(street)) == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    kept = F.concat_ws("; ", F.nullif(F.col(notes), F.lit("")), F.concat(F.lit("street: "), "_gone"))
    put = {notes: F.when(hit, kept).otherwise(F.col(notes)), full: F.when(hit, F.col(number)).otherwise(F.col(full))}
    put |= {c: F.when(~hit, F.col(c)) for c in (street, expanded)}
    return out.select(*[put[c].alias(c) if c in put else F.col(c) for c in rows.columns])


def patch_entries(rows: DataFrame, edits: DataFrame, geocodes: DataFrame, key: str, columns: Sequence[str], search: Sequence[str]) -> DataFrame:
    """Entries after their edits (key, fields, edited_at, base): fields that are present overwrite, also with null.

    An edit counts only if its ``base`` is the row's edited_at, so a slow one doesn't
    undo a newer. Rows whose street or number changed get their place anew from
    ``geocodes`` (address, lat, lng), or none; the search text of edited rows is rebuilt.
    """
    told = edits.select(F.col(key).alias("_k"), F.col("fields").alias("_f"), F.col("edited_at").alias("_at"), F.col("base").alias("_base"))
    out = rows.join(told, (F.col(key) == F.col("_k")) & F.col("edited_at").eqNullSafe(F.col("_base")), "left")
    has = lambda c: F.coalesce(F.map_contains_key("_f", F.lit(c)), F.lit(False))
    new = {c: F.when(has(c), F.element_at("_f", c)).otherwise(F.col(c)) for c in columns}
    out = out.withColumns({f"_n_{c}": v for c, v in new.items()})
    moved = ~F.col("_n_address_street").eqNullSafe(F.col("address_street")) | ~F.col("_n_address_number").eqNullSafe(F.col("address_number"))
    out = out.withColumn("_moved", moved & F.col("_k").isNotNull()).withColumn("_address", F.lower(F.btrim(F.concat_ws(" ", "_n_address_street", "_n_address_number"))))
    places = geocodes.select(F.col("address").alias("_a"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    out = out.join(places, F.col("_moved") & (F.col("_address") == F.col("_a")), "left")
    put = {c: F.col(f"_n_{c}") for c in columns}
    put |= {c: F.when(F.col("_moved"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lat", "lng")}
    put["edited_at"] = F.coalesce("_at", "edited_at")
    put["searchable_text"] = F.when(F.col("_k").isNotNull(), searchable_text(*[put.get(c, F.col(c)) for c in search])).otherwise(F.col("searchable_text"))
    return out.select(*[put[c].alias(c) if c in put else F.col(c) for c in rows.columns])


def drop_overrides(log: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The log without the deleted keys; entries themselves stay as they are."""
    return log.join(deleted.select(key).distinct(), key, "left_anti")


def override_report(overrides: DataFrame, entries: DataFrame, key: str, mark: str) -> DataFrame:
    """One row: how many overrides meet their row, only a row of the same mark, or none."""
    ids, marks = entries.select(F.col(key).alias("_id")).distinct(), entries.select(F.col(mark).alias("_m")).where("_m is not null").distinct()
    out = overrides.join(ids, F.col(key) == F.col("_id"), "left").join(marks, F.col(mark) == F.col("_m"), "left")
    here, there = F.col("_id").isNotNull(), F.col("_m").isNotNull()
    return out.agg(F.count_if(here).alias("applied"), F.count_if(~here & there).alias("fell_back"), F.count_if(~here & ~there).alias("missing"))


def refresh_clusters(rows: DataFrame, changed: DataFrame, cluster: str, order: str, texts: Sequence[str]) -> DataFrame:
    """Canonical values of the clusters that hold or held a changed row, and of no other; ``changed`` has a column like ``cluster``."""
    return canonical_values(rows.join(changed.select(cluster).distinct(), cluster, "left_semi"), cluster, order, texts)


def candidate_persons(asked: DataFrame, persons: DataFrame, links: Sequence[Sequence[str]]) -> DataFrame:
    """(ask_id, person_id): the smallest person that agrees in all columns of one of the ``links``; a union of equi-joins instead of a disjunction.

    The smallest person of each link's values is found first, so a row meets one person a link.
    """
    out = None
    for link in links:
        some = persons.dropna(subset=list(link)).groupBy(*link).agg(F.min("person_id").alias("person_id"))
        met = asked.join(some, list(link)).select("ask_id", "person_id")
        out = met if out is None else out.unionByName(met)
    return out.groupBy("ask_id").agg(F.min("person_id").alias("person_id"))


def guarded_update(rows: DataFrame, results: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Write late results only where the row's time is still the one that they were asked for."""
    told = results.select(F.col(key).alias("_k"), F.col(at).alias("_at"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = rows.join(told, (F.col(key) == F.col("_k")) & (moment(F.col(at)) == moment(F.col("_at"))), "left")
    return out.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def set_field(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column of the rows that ``values`` (key, column) names."""
    told = values.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    out = rows.join(told, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(F.col(column)).alias(column) if c == column else F.col(c) for c in rows.columns])


def recount_links(buildings: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Buildings with the number of entries that link to them now; those without any go."""
    counts = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("entry_count"))
    return buildings.drop("entry_count").join(counts, key)


def unlink(rows: DataFrame, gone: DataFrame, key: str, link: str) -> DataFrame:
    """Null the link of the named rows."""
    out = rows.join(gone.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    return out.select(*[F.when(F.col("_k").isNull(), F.col(link)).alias(link) if c == link else F.col(c) for c in rows.columns])
