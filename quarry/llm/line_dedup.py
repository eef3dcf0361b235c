"""Line removal by site-relative frequency, in DataFrame functions only.

Pages are grouped by host; the pages that contain a line are divided by the
host's pages, and lines above a boilerplate ratio go. Lines are compared without
white space at their ends, by two independent 64-bit hashes, so a line's text never moves.

A host's boilerplate lines are at most its mean number of distinct lines a page
over the ratio, so the list of them is small; pages get the list of their host by
one join, broadcast where the counted size allows it. Beyond that a host of more
than ``hot_pages`` pages is dealt over as many salts as it has multiples of them,
so no key of the join holds more.

Defined results: a null text stays null and has no lines; a null host is a host
of its own; blank lines are never boilerplate; a line repeated within a page
counts once for it; hosts with fewer than ``min_pages`` pages that share a line
lose none; a line exactly at the ratio stays; an empty table gives an empty
result; repeated rows count as pages of their own; a very long text is treated
line by line as any other; other columns, whatever their names, pass through
unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_BYTES, apart, settle, small

MAX_RATIO = 0.05
MIN_PAGES = 5
HOT_PAGES = 100_000
EDGE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    shown = F.btrim(line, F.lit(EDGE))
    return F.struct(F.xxhash64(shown).alias("a"), F.xxhash64(F.lit("line"), shown).alias("b"))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGE)) == ""


def _with_host(rows: DataFrame, hosts: DataFrame, spread: Column, row_bytes: int, kind: str, hot_pages: int, limit: int) -> DataFrame:
    """``rows`` with _host beside settled ``hosts`` (_h, _total, ...), a hot host dealt by ``spread`` unless all are broadcast."""
    same = F.col("_host").eqNullSafe(F.col("_h"))
    if hosts.count() * row_bytes <= limit:
        return rows.join(F.broadcast(hosts), same, kind)
    salts = F.ceil(F.col("_total") / hot_pages)
    hot = small(settle(hosts.where(F.col("_total") > hot_pages).select(F.col("_h").alias("_hot"), salts.alias("_salts"))), 90)
    dealt = rows.join(hot, F.col("_host").eqNullSafe(F.col("_hot")), "left").withColumn("_salt", F.pmod(spread, F.coalesce("_salts", F.lit(1)))).drop("_hot", "_salts")
    each = hosts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(each, same & (F.col("_salt") == F.col("_s")), kind).drop("_salt", "_s")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, hot_pages: int = HOT_PAGES, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(_h, _total, _drop): each host's boilerplate lines as hashes."""
    marks = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), _mark))
    rows = pages.select(F.col(host).cast("string").alias("_host"), marks.alias("_marks"))
    totals = settle(rows.groupBy(F.col("_host").alias("_h")).agg(F.count("*").alias("_total")))
    # counts of a (host, line) meet after a sum within each task, so a line of a third of all pages is one row a task
    seen = rows.select("_host", F.explode("_marks").alias("_mark")).groupBy("_host", "_mark").agg(F.count("*").alias("_seen")).where(F.col("_seen") >= min_pages)
    often = _with_host(seen, totals, F.col("_mark.a"), 90, "inner", hot_pages, limit).where(F.col("_seen") > F.lit(max_ratio) * F.col("_total"))
    return often.groupBy(F.col("_host").alias("_h")).agg(F.first("_total").alias("_total"), F.collect_list("_mark").alias("_drop"))


def drop_boilerplate_lines(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = True, hot_pages: int = HOT_PAGES, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """The pages with boilerplate lines removed from ``text``; ``counts`` adds n_lines and n_dropped (long), in place of columns so named."""
    found = settle(boilerplate(pages, host, text, max_ratio, min_pages, hot_pages, limit))
    widest = found.agg(F.coalesce(F.max(F.size("_drop")), F.lit(0)).alias("n")).first()["n"]
    rows, named = apart(pages.drop("n_lines", "n_dropped") if counts else pages, host, text)
    joined = _with_host(rows.withColumn("_host", F.col(host).cast("string")), found, F.monotonically_increasing_id(), 64 + 48 * widest, "left", hot_pages, limit)
    lines = _lines(F.col(text))
    # the host's list shrinks to the page's own lines of it by one hashed intersection, before any line is compared
    own = F.array_intersect(F.transform(lines, lambda x: _mark(x)["a"]), F.transform("_drop", lambda d: d["a"]))
    out = joined.withColumn("_own", F.filter("_drop", lambda d: F.array_contains(own, d["a"])))
    some = F.coalesce(F.size("_own") > 0, F.lit(False)) & F.col(text).isNotNull()
    out = out.withColumn("_kept", F.when(some, F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("_own"), _mark(x)))))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.coalesce(F.size(lines), F.lit(0))).cast("long")
    dropped = F.when(some, n_lines - F.size("_kept")).otherwise(0).cast("long")
    shown = F.when(some & (dropped > 0), F.array_join("_kept", "\n")).otherwise(F.col(text))
    made = out.withColumns({"n_lines": n_lines, "n_dropped": dropped, text: shown})
    return named(made, "n_lines", "n_dropped") if counts else named(made)


#: The same in DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
m AS (SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM e),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
f AS (SELECT m.source, m.k FROM (SELECT DISTINCT doc_id, source, k FROM m WHERE k <> '') m JOIN t ON t.source IS NOT DISTINCT FROM m.source
      GROUP BY m.source, m.k, t.total HAVING count(*) >= {MIN_PAGES} AND count(*) > {MAX_RATIO} * t.total),
g AS (SELECT m.doc_id, m.pos, m.line, f.k IS NOT NULL AS gone FROM m LEFT JOIN f ON f.k = m.k AND f.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped
FROM g GROUP BY doc_id
"""
