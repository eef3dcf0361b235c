"""Joins of record linkage: fallbacks, tiers, ranges, as-of, nearest, positional, fuzzy, and ordered placement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.streets import same_name, similarity
from quarry.operators.cluster import shared_folder, spread


def lookup_with_fallback(rows: DataFrame, table: DataFrame, first: str, second: str, key: str, values: Sequence[str]) -> DataFrame:
    """``values`` of the row that ``first`` finds as a whole, else of the one that ``second`` finds; adds hit (1, 2 or null)."""
    told = table.select(F.col(key).alias("_k"), F.struct(*values).alias("_v"))
    a, b = (told.select(F.col("_k").alias(f"_k{n}"), F.col("_v").alias(f"_v{n}")) for n in (1, 2))
    out = rows.join(a, F.col(first) == F.col("_k1"), "left").join(b, F.col(second) == F.col("_k2"), "left")
    found = F.when(F.col("_v1").isNotNull(), F.col("_v1")).otherwise(F.col("_v2"))
    hit = F.when(F.col("_v1").isNotNull(), 1).when(F.col("_v2").isNotNull(), 2)
    return out.select(*rows.columns, *[found[v].alias(v) for v in values], hit.alias("hit"))


#: House number steps to try when the number itself is gone: the same side of the street first.
NEAR_NUMBERS = (2, -2, 4, -4, 1, -1)


def tiered_match(probes: DataFrame, index: DataFrame, probe_id: str, letters: str = "abcdefgh", near: Sequence[int] = NEAR_NUMBERS) -> DataFrame:
    """The first place on a list of alternatives: (probe_id, place_id, alias_rank, tier).

    ``probes`` has (probe_id, aliases array, number, letter), ``index`` (street,
    number, letter, place_id). An alias tries the exact letter, then no letter, then
    each of ``letters``, then near numbers without a letter; all tries of an alias
    come before the next alias. Aliases that are no street of the index are left out first; all tries
    of the others meet the index in one equi-join on (street, number, letter), whose places are made unique first.
    """
    number, letter = F.col("number"), F.coalesce("letter", F.lit(""))
    tries = [F.struct(number.alias("number"), letter.alias("letter"))]
    tries += [F.struct(number.alias("number"), F.lit(x).alias("letter")) for x in ("", *letters)]
    tries += [F.struct((number + d).alias("number"), F.lit("").alias("letter")) for d in near]
    probes = spread(probes, probe_id)  # few bytes each, but many aliases
    # the outer form, as Spark puts a filter that makes the aliases once more before everything else for the inner one
    each = probes.select(probe_id, F.col("number"), letter.alias("letter"), F.posexplode_outer("aliases").alias("alias_rank", "street"))
    each = each.join(index.select("street").distinct(), "street", "left_semi")
    each = each.select(probe_id, "alias_rank", "street", F.posexplode(F.array(*tries)).alias("tier", "t")).select(probe_id, "alias_rank", "tier", "street", F.col("t.number").alias("number"), F.col("t.letter").alias("letter"))
    places = index.groupBy("street", "number", F.coalesce("letter", F.lit("")).alias("letter")).agg(F.min("place_id").alias("place_id"))
    best = each.join(places, ["street", "number", "letter"]).groupBy(probe_id).agg(F.min(F.struct("alias_rank", "tier", "place_id")).alias("b"))
    return best.select(probe_id, "b.place_id", "b.alias_rank", "b.tier")


def nearest_in_box(points: DataFrame, places: DataFrame, point_id: str, place_id: str, reach: float) -> DataFrame:
    """The nearest place within ``reach`` in both directions by squared distance, ties by place: (point_id, place_id, dist2).

    Points meet places in grid cells of ``reach``; a place enters its own cell, a
    point the nine around it, so only neighbours are compared.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    held = places.select(F.col(place_id), F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = points.select(point_id, "x", "y", around.alias("c")).select(point_id, "x", "y", "c.cx", "c.cy")
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    met = asked.join(held, ["cx", "cy"]).where((F.abs(dx) <= reach) & (F.abs(dy) <= reach)).select(point_id, (dx * dx + dy * dy).alias("dist2"), place_id)
    return met.groupBy(point_id).agg(F.min(F.struct("dist2", place_id)).alias("b")).select(point_id, f"b.{place_id}", "b.dist2")


def first_range(rows: DataFrame, ranges: Sequence[tuple[int, int, str]], value: str, default: str) -> DataFrame:
    """Adds label: that of the first (low, high, label) that holds the value, both ends included; else the default.

    The ranges are configuration, so they become one expression; no row moves.
    """
    label = F.lit(default)
    for low, high, name in reversed(ranges):
        label = F.when(F.col(value).between(low, high), name).otherwise(label)
    return rows.withColumn("label", label)


def as_of(rows: DataFrame, marks: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """``value`` of the last mark at or before each row, within ``by``; one sort over rows and marks together."""
    both = rows.withColumns({"_mark": F.lit(1), "_held": F.lit(None).cast(marks.schema[value].dataType)}).unionByName(
        marks.select(*by, at, F.col(value).alias("_held")).withColumn("_mark", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(*by).orderBy(at, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_held", ignorenulls=True).over(order)).where("_mark = 1").drop("_mark", "_held")


def valid_at(rows: DataFrame, year: Column, low: str = "from", high: str = "until") -> DataFrame:
    """Rows whose half-open period holds the year; open ends are 0 and 9999."""
    return rows.where((F.coalesce(F.col(low), F.lit(0)) <= year) & (year < F.coalesce(F.col(high), F.lit(9999))))


def positional_join(left: DataFrame, right: DataFrame, by: str, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Row i of a group on the left with row i of that group on the right; unmatched rows stay with nulls."""
    number = lambda d, order: d.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [by, "pos"], "full")


def fuzzy_anti(left: DataFrame, right: DataFrame, name: str, by: Sequence[str] = (), head: int = 4, limit: int = 2) -> DataFrame:
    """Left rows without an equal name, or one with the same beginning within ``limit`` edits, on the right."""
    begin = lambda c: F.substring(c, 1, head)
    there = right.select(*by, name).distinct().alias("r")
    same = [F.col(f"l.{b}") == F.col(f"r.{b}") for b in by]
    near = [begin(F.col(f"l.{name}")) == begin(F.col(f"r.{name}")), F.levenshtein(F.col(f"l.{name}"), F.col(f"r.{name}")) <= limit]
    return left.alias("l").join(there, [*same, *near], "left_anti")


def _shared_letters(a: Column, b: Column) -> Column:
    """How many letters two words have in common, each as often as both hold it."""
    times = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))


def gestalt_pairs(left: DataFrame, right: DataFrame, name: str, by: Sequence[str], head: int = 4, least: float = 0.8) -> DataFrame:
    """(by, name, other): distinct names on both sides that are equal, or begin alike and whose gestalt ratio exceeds ``least``.

    The ratio is twice the matched letters over both lengths. No more can match than the shorter name has
    letters, nor than both have in common; so a pair above ``least`` lies in the same or the next class of
    lengths, of which each is (2 - least) / least times the one before, and passes both bounds. Only what passes
    is measured. Names meet on (by, beginning, class), so a hot beginning is as many keys as it has classes.
    """
    step = (2 - least) / least
    size = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / F.log(F.lit(step)))
    some = lambda df, into: df.where(F.coalesce(F.col(name), F.lit("")) != "").select(*by, F.col(name).alias(into)).distinct()
    a, b = some(left, "_a"), some(right, "_b")
    begin = lambda c: F.substring(c, 1, head)
    asked = a.withColumns({"_h": begin("_a"), "_c": F.explode(F.array(*[size("_a") + d for d in (-1, 0, 1)]))})
    met = asked.join(b.withColumns({"_h": begin("_b"), "_c": size("_b")}), [*by, "_h", "_c"])
    both = F.length("_a") + F.length("_b")
    close = (F.col("_a") != F.col("_b")) & (2 * F.least(F.length("_a"), F.length("_b")) > least * both)
    close = met.where(close).where(2 * _shared_letters(F.col("_a"), F.col("_b")) > least * both).where(similarity(F.col("_a"), F.col("_b")) > least)
    same = a.join(b.withColumn("_a", F.col("_b")), [*by, "_a"])
    return close.select(*by, "_a", "_b").unionByName(same.select(*by, "_a", "_b")).withColumnsRenamed({"_a": name, "_b": "other"})


def two_sided_anti(left: DataFrame, right: DataFrame, name: str, by: Sequence[str], head: int = 4, least: float = 0.8) -> DataFrame:
    """(side, by, name): distinct names of each side without a like one on the other (``gestalt_pairs``); empty names don't count."""
    pairs = gestalt_pairs(left, right, name, by, head, least)
    some = lambda df: df.where(F.coalesce(F.col(name), F.lit("")) != "").select(*by, name).distinct()
    alone = lambda side, df, found: some(df).join(found, [*by, name], "left_anti").select(F.lit(side).alias("side"), *by, name)
    # the ratio goes from the first name to the second, so each side is asked in its own direction
    back = gestalt_pairs(right, left, name, by, head, least)
    return alone("left", left, pairs.select(*by, name)).unionByName(alone("right", right, back.select(*by, name)))


def similar_names(left: DataFrame, right: DataFrame, name: str, other: str, by: Sequence[str] = (), long: int = 6) -> DataFrame:
    """Pairs of rows whose names are the same: equal, or one letter apart where both have ``long`` letters.

    Names meet on themselves and, where they are long enough, on what is left without one
    of their letters, so a name has one key more than it has letters and equal keys miss no pair; keys are
    hashed, and what shares one only by chance is told apart afterwards. ``by`` must agree as well. Empty names meet none.
    """
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.concat(F.substr(c, F.lit(1), k - 1), F.substr(c, k + 1)))
    told = lambda c: F.concat(F.array(c), F.when(F.length(c) >= long, cut(c)).otherwise(F.array().cast("array<string>")))
    keys = lambda c: F.explode(F.array_distinct(F.transform(told(c), lambda k: F.xxhash64(k))))
    a = left.where(F.col(name) != "").withColumn("_key", keys(F.col(name)))
    b = right.where(F.col(other) != "").withColumn("_key", keys(F.col(other)))
    met = a.join(b.hint("merge"), [*by, "_key"]).where(same_name(F.col(name), F.col(other), long))
    return met.drop("_key").distinct()


def match_or_fingerprint(changes: DataFrame, entries: DataFrame, change_id: str, entry_id: str, mark: Sequence[str]) -> DataFrame:
    """(change_id, entry_id, fell_back): by id, else the smallest entry with the same ``mark`` columns."""
    ids = entries.select(F.col(entry_id).alias("_entry")).distinct()
    direct = changes.join(ids, F.col(change_id) == F.col("_entry"), "left")
    hit = direct.where(F.col("_entry").isNotNull()).select(change_id, F.col("_entry").alias("entry_id"), F.lit(False).alias("fell_back"))
    rest = direct.where(F.col("_entry").isNull()).select(change_id, *mark)
    marked = entries.groupBy(*mark).agg(F.min(entry_id).alias("entry_id"))
    return hit.unionByName(rest.join(marked, list(mark)).select(change_id, "entry_id", F.lit(True).alias("fell_back")))


def next_number(rows: DataFrame, by: Sequence[str], number: str, value: str) -> DataFrame:
    """(by, number, value, next_value): rows of a group whose numbers follow each other; of equal numbers the least value."""
    one = rows.groupBy(*by, number).agg(F.min(value).alias(value))
    after = one.select(*by, (F.col(number) - 1).alias(number), F.col(value).alias(f"next_{value}"))
    return one.join(after, [*by, number])


Rule = Callable[[DataFrame, DataFrame], DataFrame]


def cascade(rows: DataFrame, row_id: str, rules: Sequence[tuple[str, Rule]]) -> DataFrame:
    """(row_id, place_id, rule): rules in order, each sees the rows that none before has placed, and the placements so far.

    Each rule's placements and the rows that it leaves are checkpointed, so no later rule computes them again.
    """
    shared_folder(rows.sparkSession)
    placed, left = None, rows
    for k, (name, rule) in enumerate(rules, 1):
        found = rule(left, placed).groupBy(row_id).agg(F.min("place_id").alias("place_id")).withColumn("rule", F.lit(name)).checkpoint()
        placed = found if placed is None else placed.unionByName(found)
        if k < len(rules):
            left = left.join(found.select(row_id).hint("merge"), row_id, "left_anti").checkpoint().hint("merge")
    return placed
