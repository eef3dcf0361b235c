"""Street names and house numbers: corrections, renamings, comparisons and displays as Column functions.

Rule tables are parameters. Every function gives null for null unless it says otherwise.
"""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import apply_rules, compact_key, street_key, strip_markers


def titled(text: Column) -> Column:
    """Each run of letters with a capital first, also after hyphens and apostrophes."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def combined_keys(parts: Sequence[Sequence[str]], name: str) -> dict[str, str]:
    """Compact keys of all spellings that the parts make up, each with the name they stand for."""
    return {"".join(p): name for p in itertools.product(*parts)}


def looked_up(table: Mapping[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])[key]


def corrected_street(text: Column, names: Mapping[str, str], special: Mapping[str, str], markers: Sequence[str]) -> Column:
    """The special name of its compact key, else the name of its key, else the key without its markers in capitals, else the text trimmed."""
    whole = street_key(text)
    key = strip_markers(whole, markers)
    found = F.coalesce(looked_up(special, compact_key(text)), looked_up(names, key), F.when(key != whole, titled(key)), F.btrim(text))
    return F.when(text == "", text).otherwise(found)


def correct_addresses(rows: DataFrame, names: Mapping[str, str], special: Mapping[str, str], markers: Sequence[str], mentions: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Street columns with their corrected name, and address_full built anew where the correction calls for it.

    A special name of address_street itself comes first. Where one is involved, a
    full address that is there stays. ``mentions`` are rules for all four columns.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    source = F.coalesce(filled("address_street_expanded"), filled("address_street"), F.lit(""))
    corrected, explicit = corrected_street(source, names, special, markers), looked_up(special, compact_key(F.col("address_street")))
    told = rows.withColumns({"_source": source, "_explicit": explicit, "_new": F.coalesce(explicit, corrected)})
    told = told.withColumn("_hit", (corrected != "") & ((corrected != F.col("_source")) | F.col("_explicit").isNotNull()))
    plain = F.col("_explicit").isNull() & looked_up(special, compact_key(F.col("_source"))).isNull()
    put = {
        "address_street": F.when(F.col("_hit") & filled("address_street").isNotNull(), F.col("_new")).otherwise(F.col("address_street")),
        "address_street_expanded": F.when(F.col("_hit") & F.col("address_street_expanded").isNotNull(), F.col("_new")).otherwise(F.col("address_street_expanded")),
        "address_full": F.when(F.col("_hit") & (plain | filled("address_full").isNull()), F.btrim(F.concat_ws(" ", "_new", filled("address_number")))).otherwise(F.col("address_full")),
    }
    out = told.withColumns(put)
    fields = ("address_street", "address_street_expanded", "address_number", "address_full")
    return out.withColumns({c: apply_rules(F.col(c), mentions) for c in fields}).select(*rows.columns)


def geocode_query(text: Column, markers: Sequence[str], literals: Sequence[tuple[str, str]], rules: Sequence[tuple[str, str]] = ()) -> Column:
    """Lower-case query of a geocoder: rules, markers dropped, then literal replacements in order, each of all occurrences."""
    out = strip_markers(apply_rules(F.lower(F.btrim(text)), rules), markers)
    for old, new in literals:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def _named(text: Column, held: Column) -> Column:
    """The name of the longest key that the text equals or begins with, up to a stop, a space or a bracket, with what follows it."""
    cuts = F.filter(F.sequence(F.length(text), F.lit(1), F.lit(-1)), lambda n: (n == F.length(text)) | F.substring(text, n + 1, F.lit(1)).isin(" ", "."))
    known = F.filter(cuts, lambda n: F.map_contains_key(held, F.substring(text, F.lit(1), n)))
    n = F.get(known, 0)
    rest = F.regexp_replace(F.substring(text, n + 1, F.lit(1 << 30)), r"^\.", "")
    return F.when(n.isNotNull(), F.concat(held[F.substring(text, F.lit(1), n)], rest))


def rename_streets(rows: DataFrame, column: str, table: DataFrame, spellings: Sequence[tuple[str, str]], into: str) -> DataFrame:
    """Adds ``into``: the street renamed by ``table`` (old, new), again after spelling rules, or null where nothing changes.

    Words in brackets at the front go to the end first. The table is configuration
    of some hundred rows; it becomes one map that every row sees.
    """
    held = table.agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_held"))  # one row
    text = F.regexp_replace(F.btrim(F.col(column)), r"^\(([^)]*)\)\s*(.+)$", "$2 $1")
    told = rows.join(F.broadcast(held), F.lit(True), "left").withColumn("_text", text).withColumn("_first", F.coalesce(_named(F.col("_text"), F.col("_held")), F.col("_text")))
    spelt = apply_rules(F.concat(F.upper(F.substring("_first", 1, 1)), F.substring("_first", 2, 1 << 30)), spellings)
    out = told.withColumn("_spelt", spelt).withColumn("_last", F.coalesce(_named(F.col("_spelt"), F.col("_held")), F.col("_spelt")))
    return out.withColumn(into, F.when(F.col("_last") != F.col(column), F.col("_last"))).drop("_held", "_text", "_first", "_spelt", "_last")


def similarity(a: Column, b: Column) -> Column:
    """Share of characters in common blocks (gestalt matching), 0 to 1, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype=object)

    return ratio(a, b)


def street_letters(text: Column) -> Column:
    """Lower-case letters alone, as streets of two sources are compared."""
    return F.regexp_replace(street_key(text), "[^a-z]", "")


def same_street(a: Column, b: Column, head: int = 5, least: float = 0.75) -> Column:
    """One holds the other's first letters, or they are similar; empty streets are the same as none.

    Only pairs that this leaves open, and whose lengths allow the similarity, reach Python; the others are sent as nulls.
    """
    p, q = street_letters(a), street_letters(b)
    held = p.contains(F.substring(q, 1, head)) | q.contains(F.substring(p, 1, head))
    open_ = (p != "") & (q != "") & ~held & (2 * F.least(F.length(p), F.length(q)) > least * (F.length(p) + F.length(q)))
    near = held | F.coalesce(similarity(F.when(open_, p), F.when(open_, q)) > least, F.lit(False))
    return F.coalesce((p != "") & (q != "") & near, F.lit(False))


def surname(name: Column) -> Column:
    """Letters of the last word before the first comma."""
    return F.regexp_replace(street_key(F.regexp_extract(F.split(name, ",")[0], r"(\S+)\s*$", 1)), "[^a-z]", "")


def same_name(a: Column, b: Column, long: int = 6) -> Column:
    """Equal, or one edit apart where both have ``long`` letters."""
    near = (F.length(a) >= long) & (F.length(b) >= long) & (F.levenshtein(a, b) <= 1)
    return F.coalesce((a != "") & ((a == b) | near), F.lit(False))


def initial(text: Column) -> Column:
    """First letter in lower case; empty without one."""
    return F.lower(F.regexp_extract(text, "[A-Za-z]", 0))


def ward_number(text: Column) -> Column:
    """Leading digits as a number."""
    return F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("int")


def strip_ward(text: Column, ward: str) -> Column:
    """Without the ward's letter at the front, however often it stands there, so a second pass changes nothing."""
    return F.regexp_replace(text, rf"^(?:{ward} )+", "")


def quay_number(street: Column, side: Column, number: Column, sides: Mapping[tuple[str, str], tuple[int, int, int]]) -> Column:
    """Today's number, twice the old one plus the side's constant, inside the range that it was fitted on; only digits and one letter convert."""
    old = F.regexp_extract(number, r"^(\d+)[a-z]?$", 1).try_cast("int")
    out = F.lit(None).cast("string")
    for (s, d), (constant, first, last) in sides.items():
        out = F.when((street == s) & (side == d) & old.between(first, last), (2 * old + constant).cast("string")).otherwise(out)
    return out


def entry_name(name: Column, initials: Column, prefix: Column) -> Column:
    """Name, initials and prefix as shown; without any of them a dash."""
    told = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (name, initials, prefix)])
    return F.coalesce(F.nullif(told, F.lit("")), F.lit("-"))


def mention_line(occupation: Column, address: Column, modern: Column, sign: str = " · ") -> Column:
    """What a mention shows below its name: occupation, address and today's address."""
    return F.concat_ws(sign, *[F.nullif(F.btrim(c), F.lit("")) for c in (occupation, address, modern)])


def box_points(box: Column) -> Column:
    """Corners of a box clockwise as ``x,y`` pairs."""
    return F.format_string("%d,%d %d,%d %d,%d %d,%d", box[0], box[1], box[2], box[1], box[2], box[3], box[0], box[3])


def box_size(box: Column) -> Column:
    return F.struct((box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height"))


def planar(lng: Column, lat: Column, kx: float, ky: float) -> Column:
    """Metres east and north on a local scale."""
    return F.struct((lng * kx).alias("x"), (lat * ky).alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])
