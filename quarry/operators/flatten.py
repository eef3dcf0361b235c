"""Flattening of page documents into one entry relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.streets import entry_name
from quarry.sources.schemas import ENTRY, ENTRY_FIELDS


FIELDS = (*ENTRY_FIELDS, "word_ids", "name_word_ids", "address_word_ids", "entry_bbox", "name_bbox", "address_bbox", "cross_references")


def _entry(put: dict[str, str] | None = None, own: bool = True) -> str:
    """SQL of an entry ``e`` in the common shape, with some fields ``put``."""
    told = {f: f"e.{f}" if own else "NULL" for f in FIELDS} | (put or {})
    return "CAST(struct(" + ", ".join(f"{told[f]} AS {f}" for f in FIELDS) + f") AS {ENTRY})"


def _inherited(field: str, parent: str) -> dict[str, str]:
    """Both columns of a field from the parent where the entry's own is empty."""
    return {f"{field}{x}": f"if(coalesce(e.{field}, '') = '', p.{parent}{x}, e.{field}{x})" for x in ("", "_expanded")}


def _nested(outer: str, put: dict[str, str]) -> str:
    return f"flatten(transform({outer}, p -> transform(coalesce(p.entries, array()), e -> {_entry(put)})))"


FOUND = {
    "name": "coalesce(e.context, 'Unknown')",
    "address_street": "e.address_street",
    "address_street_expanded": "e.address_street_expanded",
    "address_number": "e.address_number",
    "address_full": "nullif(trim(concat_ws(' ', coalesce(e.address_street_expanded, e.address_street, ''), coalesce(e.address_number, ''))), '')",
    "word_ids": "e.address_word_ids",
    "address_word_ids": "e.address_word_ids",
}
#: The entries of each kind of section, in order of emission.
SECTIONS = {
    "name_register": f"transform(entries, e -> {_entry()})",
    "street_register": _nested("streets", _inherited("address_street", "street_name")),
    "occupation_register": _nested("occupations", _inherited("occupation", "occupation_name")),
    "institutional": f"transform(entities, e -> {_entry()})",
    "advertisement": "transform(advertisements, e -> " + _entry({"name": "if(coalesce(e.name, '') = '', e.business_name, e.name)"}) + ")",
    "other": f"transform(addresses_found, e -> {_entry(FOUND, False)})",
}


def flatten_pages(pages: DataFrame) -> DataFrame:
    """One row for each entry in emission order, with entry_index and stable_id; one pass over the pages and no shuffle.

    Entries of a street or an occupation inherit its names, both columns together,
    where their own is empty; advertisements take their business name; found
    addresses make rows of their own. Other sections give no rows.
    """
    every = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SECTIONS.items()) + " END"
    rows = pages.select("stem", "section", "page_number", F.posexplode(F.expr(every)).alias("entry_index", "e"))
    return rows.select("stem", "section", "page_number", "e.*", "entry_index", F.concat_ws(":", "stem", F.col("entry_index").cast("string")).alias("stable_id"))


#: Words that mark a business in a name; fixed values.
BUSINESS = (
    r"(?i)\b(n\.?\s*v\.?|n\.v\.|fa\.|firma|geb(?:r|rs)\.?|maatschappij|vereeniging|vereniging)\b",
    r"(?i)\b(bank|bureau|cafe|fabriek|handels|kantoor|stoomboot|winkel)\b",
    r"(?i)\b(apotheek|drukkerij|garage|hotel|magazijn|slagerij|verzekering)\b",
)
ORGANIZATIONS = ("organization", "facility", "service", "country")


def entry_kind(section: Column, entity_type: Column, role: Column, name: Column) -> Column:
    """person, organization, institutional, advertisement or text."""
    business = F.lit(False)
    for p in BUSINESS:
        business = business | F.coalesce(name, F.lit("")).rlike(p)
    institution = F.coalesce(section, F.lit("")) == "institutional"
    return (
        F.when(section == "advertisement", "advertisement")
        .when(section == "other", "text")
        .when(entity_type.isin(*ORGANIZATIONS), "organization")
        .when(entity_type == "person", F.when(institution, "institutional").otherwise("person"))
        .when(institution, F.when(F.coalesce(role, F.lit("")) != "", "institutional").otherwise("organization"))
        .when(business, "organization")
        .otherwise("person")
    )


def confidence_flags(status: Column, kind: Column, score: Column, least: float = 10.0) -> Column:
    """Flags of a geocoding result: not_found, or uncertain for a place or street as a whole and for low scores."""
    vague = kind.isin("gemeente", "woonplaats", "weg") | (F.coalesce(score, F.lit(0.0)) < least)
    flag = F.when(status.isin("no_match", "error"), "not_found").when((status == "ok") & F.coalesce(vague, F.lit(False)), "uncertain")
    return F.array_compact(F.array(flag))


def presented(rows: DataFrame, kind: Column, now: str, gone: str, gone_label: str) -> DataFrame:
    """Adds kind, title, subtitle, detail, address and on_map, as an entry is shown.

    ``now`` stands before today's address; where that is ``gone``, ``gone_label`` alone is shown.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    occupation, about = first(text("occupation_expanded"), text("occupation")), first(text("description"), text("notes"))
    role, parent, modern = text("role"), text("parent_organization"), text("address_modern")
    today = F.when(modern == gone, gone_label).when(modern != "", F.concat(F.lit(f"{now} "), modern))
    address = F.concat_ws(" · ", F.nullif(text("address_full"), F.lit("")), today)
    told = rows.withColumn("kind", kind)
    k = F.col("kind")
    subtitle = (
        F.when(k == "organization", first(about, occupation, parent))
        .when(k == "institutional", F.concat_ws(" / ", F.nullif(role, F.lit("")), F.nullif(parent, F.lit(""))))
        .when(k.isin("advertisement", "text"), first(about, occupation))
        .otherwise(occupation)
    )
    detail = F.when(k == "organization", first(about, occupation, parent)).when(k == "institutional", first(role, parent, about)).when(k.isin("advertisement", "text"), first(about, occupation)).otherwise(occupation)
    badge = F.when(k == "advertisement", "advertisement").when(k == "text", "text").when((k == "institutional") | ((k == "organization") & (text("section") == "institutional")), "institution").when(k == "organization", "organization")
    shown = {
        "title": entry_name(F.col("name"), F.col("initials"), F.col("name_prefix")),
        "badge": badge,
        "subtitle": subtitle,
        "detail": first(detail, F.lit("-")),
        "address": address,
        "on_map": ~k.isin("institutional", "text") | (address != ""),
    }
    return told.withColumns(shown)
