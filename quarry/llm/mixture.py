"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: weights share out a multiple of all
words, a target stops at a multiple of what its source has, and the excess is
shared again by weight until none is above. A document's expected copies are its
source's target over its source's words. They are summed up in order of size
within the source, in whole units of 2**-32, one random offset is added, and a
document is emitted once for each integer that its own stretch crosses. As a
source's documents come in order of size, what is taken differs from the target
by about one of its largest documents at most, whatever the offset.

Sums are whole numbers in a defined order, so a rerun with the same seed gives the
same copies however the rows are dealt; a source of any size spans many ranges
of ``in_order.running``. Targets come from rounds over the table of sources, of
which the driver sees one row of sums a round.

Defined results: a null or blank text has size 0, isn't emitted and passes with
zero copies; a null source is a source of its own, the last; a source without
words has target 0; rows that tie in size and id are told apart by a further
number and take copies as separate rows; repeated rows count as often as they
occur; null ids come first; a very long text is one document, emitted at most
``ceil(most)`` times; an empty table gives an empty result; other columns, whatever
their names, pass through ``mix`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import apart, settle, small
from quarry.llm.in_order import running

CYCLE = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mixture"
WORD = r"[^\x20\x09-\x0D]+"
#: Expected copies are counted in units of 1 / ONE.
ONE = 1 << 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighed(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Sources (source, source_size) with the weights of ``cycle``, repeating, by code point and null last."""
    placed = running(sources.withColumns({"_all": F.lit(0), "_null": F.col("source").isNull().cast("int"), "_one": F.lit(1)}), "_all", ["_null", "source"], "_one")
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    return placed.withColumn("weight", F.get(weights, F.pmod("_before", F.lit(len(cycle))).cast("int"))).drop("_all", "_null", "_one", "_before")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Settled sources (source, source_size, weight) with target (double).

    A target is the weight times a level, or ``most`` times the source's size where
    that is less. A round raises the level by what the stopped sources leave; the
    set of them only grows, so the rounds end.
    """
    limit = most * F.col("source_size")
    first = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    wanted, stopped = share * (first["words"] or 0), -1
    level = wanted / first["weight"] if first["weight"] else 0.0
    while True:
        above = F.col("weight") * F.lit(level) > limit
        now = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, limit)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if now["n"] == stopped or not now["weight"]:
            break
        level, stopped = (wanted - (now["taken"] or 0)) / now["weight"], now["n"]
    return sources.withColumn("target", F.when(F.col("weight") * F.lit(level) > limit, limit).otherwise(F.col("weight") * F.lit(level)).cast("double"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A source's random offset in [0, ONE), from the seed and its name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def draw(rows: DataFrame, weights: DataFrame | None = None, share: float = SHARE, most: float = MOST, seed: str = SEED, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Rows (doc_id, source, size, ...) with source_size, target and copies (long).

    ``rows`` should be narrow: all its columns are sorted and written. ``weights``
    (source, weight) takes the place of the cycle; a source without a weight gets none.
    """
    rows = settle(rows)
    sources = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    if weights is None:
        named = weighed(sources, cycle)
    else:
        own = weights.groupBy(F.col("source").alias("_s")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        named = sources.join(own, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna({"weight": 0.0})
    goals = settle(targets(settle(named), share, most))
    rate = F.coalesce(F.round(F.col("target") / F.nullif("source_size", F.lit(0)) * F.lit(float(ONE))).cast("long"), F.lit(0))
    rated = small(goals.select(F.col("source").alias("_s"), "source_size", "target", rate.alias("_rate")), 120)
    expected = rows.join(rated, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_expected", F.when(F.col("size") > 0, F.col("_rate")).otherwise(0))
    summed = running(expected, "source", ["size", "doc_id"], "_expected", ONE)
    begun = F.pmod(F.col("_before") + offset(F.col("source"), seed), F.lit(ONE))
    return summed.withColumn("copies", F.shiftright(begun + F.col("_expected"), 32).cast("long")).drop("_before", "_expected", "_rate")


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, most: float = MOST, seed: str = SEED, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """The documents as often as the mix takes them, with copy (int, from 0), in place of a column so named.

    Texts are written once with a number and then joined with the copies of their
    numbers; only ids, sources and sizes are sorted.
    """
    held, named = apart(docs.drop("copy"), "doc_id", "source", "text")
    rows = settle(held.withColumn("_row", F.monotonically_increasing_id()))
    sizes = rows.select("_row", F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    drawn = draw(sizes, weights, share, most, seed, cycle).where(F.col("copies") > 0).select("_row", "copies")
    out = rows.join(drawn, "_row").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    return named(out, "copy")


def digest_mixture(docs: DataFrame) -> DataFrame:
    """The contract's columns, and copies, for all documents."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    drawn = draw(sizes)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The same in DuckDB: the level by sorted prefix sums instead of rounds.
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ \x09-\x0D]+')) END AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([{", ".join(f"{w}.0" for w in CYCLE)}][k % {len(CYCLE)} + 1] AS DOUBLE) AS weight FROM s),
p AS (SELECT *, source_size * {MOST} / weight AS ratio,
             coalesce(sum(source_size * {MOST}) OVER (ORDER BY source_size * {MOST} / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
             sum(weight) OVER (ORDER BY source_size * {MOST} / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT arg_min(CAST({SHARE} * (SELECT sum(size) FROM d) - stopped AS DOUBLE) / rest, ratio) AS level FROM p
      WHERE CAST({SHARE} * (SELECT sum(size) FROM d) - stopped AS DOUBLE) / rest <= ratio),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(CASE WHEN weight * level > source_size * {MOST} THEN source_size * {MOST} ELSE weight * level END AS DOUBLE) AS target FROM w, l),
e AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
             CASE WHEN d.size > 0 THEN CAST(round(t.target / t.source_size * {ONE}.0) AS BIGINT) ELSE 0 END AS expected,
             CAST('0x' || substr(sha256('{SEED}:' || coalesce('=' || d.source, '')), 1, 8) AS BIGINT) AS shift
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
b AS (SELECT *, coalesce(sum(expected) OVER (PARTITION BY source ORDER BY size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + shift AS begun FROM e),
c AS (SELECT *, CAST((begun + expected) // {ONE} - begun // {ONE} AS BIGINT) AS copies FROM b)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
