"""Statistics and review queues over linked entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_rollup(rows: DataFrame, section: str, page: str, verified: Column, needs_review: Column, edited: Column) -> DataFrame:
    """Counts at page, section and overall grain; missing sections are ``unknown``."""
    told = rows.select(F.coalesce(F.nullif(F.col(section), F.lit("")), F.lit("unknown")).alias("section"), F.col(page).alias("page"), verified.alias("v"), needs_review.alias("n"), edited.alias("e"))
    count = lambda c: F.count_if(F.col(c))
    grain = F.when(F.grouping_id() == 0, "page").when(F.grouping_id() == 1, "section").otherwise("overall")
    out = told.groupingSets([[F.col("section"), F.col("page")], [F.col("section")], []], "section", "page").agg(grain.alias("grain"), F.count("*").alias("total"), count("v").alias("verified"), count("n").alias("needs_review"), count("e").alias("edited"))
    return out.withColumn("unreviewed", F.col("total") - F.col("verified") - F.col("needs_review"))


def buckets(rows: DataFrame, named: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row: how many rows each condition is the first to hold for; the rest count as other."""
    taken, out = F.lit(False), []
    for name, test in named:
        test = F.coalesce(test, F.lit(False))
        out.append(F.count_if(test & ~taken).alias(name))
        taken = taken | test
    return rows.agg(F.count("*").alias("total"), *out, F.count_if(~taken).alias("other"))


def section_summary(rows: DataFrame, section: str, stem: str, page: str) -> DataFrame:
    """Smallest stem, its last four characters as a number, smallest page and size of each named section."""
    named = rows.where(F.coalesce(F.col(section), F.lit("")) != "")
    out = named.groupBy(F.col(section).alias("section")).agg(F.min(stem).alias("first_stem"), F.min(page).alias("first_page"), F.count("*").alias("entries"))
    return out.withColumn("first_number", F.right("first_stem", F.lit(4)).try_cast("int"))


def established(rows: DataFrame, column: str, over: int = 10, blocked: Sequence[str] = ()) -> DataFrame:
    """Values in more than ``over`` rows, without the blocked ones."""
    return rows.where(F.col(column).isNotNull() & ~F.lower(F.btrim(F.col(column))).isin([b.lower() for b in blocked])).groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > over)


def inverted_index(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, ids): the sorted values of each key, blank keys left out. For keys of bounded use; ``postings`` keep a row each."""
    return postings(rows, key, value).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def postings(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, id): the index as rows, which a lookup filters and gathers, whatever a key's use."""
    return rows.select(F.nullif(F.lower(F.btrim(key)), F.lit("")).alias("key"), value.alias("id")).where("key is not null")


def vote(rows: DataFrame, by: Sequence[str], ballot: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """The most common ballot of each group with at least ``least`` votes and ``share`` of them; ties go by ballot."""
    counts = rows.groupBy(*by, ballot).agg(F.count("*").alias("votes"))
    first = F.min_by(F.struct(ballot, "votes"), F.struct(-F.col("votes"), F.col(ballot)))
    best = counts.groupBy(*by).agg(first.alias("b"), F.sum("votes").alias("cast"))
    return best.select(*by, "b.*", "cast").where((F.col("votes") >= least) & (F.col("votes") >= share * F.col("cast")))


def middles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, low, high): the two middle values of each group, equal where their number is odd.

    Values are counted first, so what a group's window sees is its distinct values with running counts.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    told = counts.withColumns({"_to": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    at = lambda place: F.min(F.when(F.col("_to") >= place, F.col(value)))
    return told.groupBy(by).agg(at(F.ceil(F.col("_all") / 2)).alias("low"), at(F.floor(F.col("_all") / 2) + 1).alias("high"))


def within_median(rows: DataFrame, by: str, value: str, factor: float = 1.25) -> DataFrame:
    """Rows at most ``factor`` times their group's median; adds median."""
    mids = middles(rows, by, value).select(F.col(by).alias("_by"), ((F.col("low") + F.col("high")) / 2).alias("median"))
    return rows.join(mids, F.col(by).eqNullSafe(F.col("_by"))).where(F.col(value) <= factor * F.col("median")).drop("_by")


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The upper of the two middle values of each group."""
    return middles(rows, by, value).select(by, F.col("high").alias("upper_median"))


def piles(rows: DataFrame, place: str, parts: Sequence[str], least: int = 3) -> DataFrame:
    """Places that ``least`` or more distinct combinations of ``parts`` share."""
    return rows.groupBy(place).agg(F.count_distinct(F.struct(*parts)).alias("distinct_parts")).where(F.col("distinct_parts") >= least)


def histogram(rows: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """(bin, n) of values in 0..1; 1 itself falls into the last bin."""
    k = F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")
    return rows.select(k.alias("bin")).where("bin between 0 and " + str(bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))


def cost_report(usage: DataFrame, prices: DataFrame, model: str, units: str) -> DataFrame:
    """Units and cost of each model; no price, no cost."""
    total = usage.groupBy(F.col(model).alias("model")).agg(F.sum(units).alias("units"), F.count("*").alias("calls"))
    return total.join(prices, "model", "left").withColumn("cost", F.col("units") * F.col("price")).select("model", "units", "calls", "cost")


def leave_one_out(rows: DataFrame, by: Sequence[str], at: str, value: str, bounds: Sequence[tuple[str, float]]) -> DataFrame:
    """(bucket, n): how far each value is from the mean of its neighbours before and after, by the first bound that holds."""
    w = Window.partitionBy(*by).orderBy(at)
    guess = (F.lag(value).over(w) + F.lead(value).over(w)) / 2
    told = rows.withColumn("_e", F.abs(F.col(value) - guess)).where("_e is not null")
    bucket = F.lit("further")
    for name, bound in reversed(bounds):
        bucket = F.when(F.col("_e") <= bound, F.lit(name)).otherwise(bucket)
    return told.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def queue(rows: DataFrame, test: Column, order: Sequence[str], limit: int) -> DataFrame:
    """The first rows of a review queue; ordered as text by ``order``."""
    return rows.where(test).orderBy(*order).limit(limit)


def match_rate(rows: DataFrame, matched: Column) -> DataFrame:
    """Total, matched and the percentage to one decimal; 0 of nothing is 0."""
    total, hit = F.count("*"), F.count_if(matched)
    return rows.agg(total.alias("total"), hit.alias("matched"), F.round(F.when(total > 0, 100 * hit / total).otherwise(0.0), 1).alias("percent"))
