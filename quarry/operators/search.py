"""Prefix full-text search ranked by BM25, grouped by cluster, and its fuzzy variant.

The index is two DataFrames: postings (term, head, row_id, tf, len), where len is
the number of the row's terms, and stats (row_id, len), whose count and mean alone
a search needs. Only the postings of the query's prefixes are read for a query;
written with ``partitionBy("head")`` (a term's first two characters) they are
pruned to them, and a search shuffles those by row and nothing else.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import edit_limit, edit_score, query_terms, terms, unmarked
from quarry.operators.cluster import shared_folder

K1, B = 1.2, 0.75
CANDIDATES = 500
#: Postings that one task writes, about.
POSTINGS_A_FILE = 5_000_000


def build_index(rows: DataFrame, row_id: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """postings(term, head, row_id, tf, len) and stats(row_id, len) over the columns' terms together; row ids are unique."""
    texts = [F.coalesce(terms(F.col(c)), F.array().cast("array<string>")) for c in columns]
    found = rows.select(F.col(row_id).alias("row_id"), (F.flatten(F.array(*texts)) if len(texts) > 1 else texts[0]).alias("terms"))
    stats = found.select("row_id", F.size("terms").cast("long").alias("len"))
    # the outer form, as Spark puts a filter that splits the texts once more before the inner one
    single = found.select("row_id", F.size("terms").cast("long").alias("len"), F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    postings = single.groupBy("term", "row_id").agg(F.count("*").alias("tf"), F.max("len").alias("len")).withColumn("head", F.substring("term", 1, 2))
    return postings, stats


def write_index(index: tuple[DataFrame, DataFrame], path: str, postings_a_file: int = POSTINGS_A_FILE) -> None:
    """Postings laid out by head, so a search reads the folders of its prefixes alone, stats beside them, and their count and mean.

    A head is written by as many tasks as its counted postings need; heads are pairs of letters, so their counts are few.
    """
    counts = index[0].groupBy(F.col("head").alias("_h")).agg(F.ceil(F.count("*") / postings_a_file).cast("long").alias("_files"))
    dealt = index[0].join(F.broadcast(counts), F.col("head") == F.col("_h")).withColumn("_salt", F.pmod(F.xxhash64("row_id"), "_files"))
    dealt.repartition("head", "_salt").drop("_h", "_files", "_salt").write.mode("overwrite").partitionBy("head").parquet(f"{path}/postings")
    index[1].write.mode("overwrite").parquet(f"{path}/stats")
    totals_of(index[1].sparkSession.read.parquet(f"{path}/stats")).write.mode("overwrite").parquet(f"{path}/totals")


def totals_of(stats: DataFrame) -> DataFrame:
    """One row: docs and mean, all that a search needs of the stats."""
    return stats.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.option("basePath", f"{path}/postings").schema("term string, row_id long, tf long, len long, head string").parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/totals")


def refreshed_index(index: tuple[DataFrame, DataFrame], changed: DataFrame, row_id: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The index after inserts, updates and deletes: ``changed`` has the rows as they are now; rows whose columns are all null leave it.

    Only the changed rows are split into terms again; the others' postings stay.
    """
    ids = changed.select(F.col(row_id).alias("row_id")).distinct()
    new = build_index(changed.dropna("all", subset=columns), row_id, columns)
    return tuple(old.join(ids, "row_id", "left_anti").unionByName(fresh.select(*old.columns)) for old, fresh in zip(index, new, strict=True))


def rank_rows(postings: DataFrame, stats: DataFrame, query: str | list[str], every: bool = True, totals: DataFrame | None = None) -> DataFrame:
    """(row_id, rank) of rows that hold all (or any) prefixes; lower ranks are better. Written ``totals`` save a scan of the stats.

    A prefix's documents and its uses in a row are counted over all terms it begins.
    """
    prefixes = query_terms(query) if isinstance(query, str) else list(query)
    if not prefixes:
        return stats.select("row_id", F.lit(0.0).alias("rank")).limit(0)
    heads = sorted({p[:2] for p in prefixes if len(p) >= 2})
    near = postings.where(F.col("head").isin(heads)) if "head" in postings.columns and all(len(p) >= 2 for p in prefixes) else postings
    holds = [F.col("term").startswith(p) for p in prefixes]
    met = near.where(reduce(or_, holds)).groupBy("row_id").agg(F.max("len").alias("len"), *[F.sum(F.when(h, F.col("tf")).otherwise(0)).alias(f"f{k}") for k, h in enumerate(holds)])
    uses = [F.col(f"f{k}") for k in range(len(prefixes))]
    held = met.agg(*[F.count_if(f > 0).alias(f"n{k}") for k, f in enumerate(uses)])
    total = held.join(totals_of(stats) if totals is None else totals)  # one row beside one row
    ranked = (met.where(reduce(and_, [f > 0 for f in uses])) if every else met).join(F.broadcast(total))
    parts = []
    for k, f in enumerate(uses):
        idf = F.log((F.col("docs") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        parts.append(F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    return ranked.select("row_id", (-reduce(add, parts)).alias("rank"))


def best_clusters(ranked: DataFrame, rows: DataFrame, row_id: str, cluster: str, limit: int, offset: int = 0, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Hits (row_id, cluster_id, rank, ``keep``), settled, and the best clusters (cluster_id, min_rank) with their first hit's ``keep``."""
    shared_folder(rows.sparkSession)
    told = rows.select(F.col(row_id).alias("row_id"), F.col(cluster).alias("cluster_id"), *keep)
    hits = ranked.join(told, "row_id").checkpoint()
    first = [F.min_by(c, "row_id").alias(c) for c in keep]
    return hits, hits.groupBy("cluster_id").agg(F.min("rank").alias("min_rank"), *first).orderBy("min_rank", "cluster_id").offset(offset).limit(limit)


def search(index: tuple[DataFrame, DataFrame], rows: DataFrame, query: str, row_id: str, cluster: str, mention: list[str], limit: int = 50, offset: int = 0, totals: DataFrame | None = None) -> DataFrame:
    """(cluster_id, min_rank, mentions) of the best clusters, mentions in order of row; ties go by cluster_id.

    Clusters are ranked on their hits' ids and ranks; what mentions show is fetched for the best ones alone.
    """
    hits, best = best_clusters(rank_rows(*index, query, totals=totals), rows, row_id, cluster, limit, offset)
    held = hits.join(F.broadcast(best), "cluster_id").select("cluster_id", "min_rank", "row_id")
    shown = rows.select(F.col(row_id).alias("row_id"), F.struct(F.col(row_id).alias("row_id"), *[F.col(c) for c in mention if c != row_id]).alias("m"))
    grouped = held.join(shown, "row_id").groupBy("cluster_id").agg(F.first("min_rank").alias("min_rank"), F.array_sort(F.collect_list("m")).alias("mentions"))
    return grouped.orderBy("min_rank", "cluster_id")


def count_clusters(index: tuple[DataFrame, DataFrame], rows: DataFrame, query: str, row_id: str, cluster: str) -> DataFrame:
    told = rows.select(F.col(row_id).alias("row_id"), F.col(cluster).alias("cluster_id"))
    return rank_rows(*index, query).join(told, "row_id").agg(F.count_distinct("cluster_id").alias("total"))


def search_fuzzy(index: tuple[DataFrame, DataFrame], rows: DataFrame, query: str, row_id: str, cluster: str, name: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """(cluster_id, name, dist, min_rank): the best CANDIDATES clusters by short prefixes, filtered and ordered by edit distance."""
    words = [w for w in query.lower().split() if len(w) >= 2]
    ranked = rank_rows(*index, [w[:3] if len(w) >= 4 else w for w in words], every=False)
    best = best_clusters(ranked, rows, row_id, cluster, CANDIDATES, keep=(name,))[1].withColumn("name", F.col(name))
    return best.withColumn("dist", edit_score(words, F.col("name"))).where(F.col("dist") <= edit_limit(words)).orderBy("dist", "min_rank", "cluster_id").offset(offset).limit(limit).select("cluster_id", "name", "dist", "min_rank")


def search_names(index: tuple[DataFrame, DataFrame], rows: DataFrame, query: str, row_id: str, cluster: str, name: str, canonical: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """As ``search_fuzzy`` by the canonical name of a cluster, or its first mention's without one; adds total, the survivors among the candidates.

    Words of the query are what stands between spaces and punctuation.
    """
    words = [w for w in re.split(r"[^\w]+|_", unmarked(query).lower()) if len(w) >= 2]
    ranked = rank_rows(*index, [w[:3] if len(w) >= 4 else w for w in words], every=False)
    best = best_clusters(ranked, rows, row_id, cluster, CANDIDATES, keep=(name, canonical))[1].withColumn("name", F.coalesce(F.nullif(canonical, F.lit("")), F.col(name)))
    left = best.withColumn("dist", edit_score(words, F.col("name"))).where(F.col("dist") <= edit_limit(words))
    total = F.count("*").over(Window.partitionBy(F.lit(0)))  # of at most CANDIDATES rows
    return left.withColumn("total", total).orderBy("dist", "min_rank", "cluster_id").offset(offset).limit(limit).select("cluster_id", "name", "dist", "min_rank", "total")


def bm25_sql(prefixes: list[str], source: str, every: bool = True) -> str:
    """The ranking in DuckDB over a relation ``source`` with (row_id, text)."""
    tests = " UNION ALL ".join(f"SELECT {k} AS k, row_id, term, tf FROM p WHERE starts_with(term, '{x}')" for k, x in enumerate(prefixes))
    keep = f"HAVING count(*) = {len(prefixes)}" if every else ""
    return f"""t AS (SELECT row_id, unnest(list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM ({source})),
p AS (SELECT row_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT row_id, len(list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS len FROM ({source})),
h AS ({tests}), u AS (SELECT row_id, k, sum(tf) AS f FROM h GROUP BY ALL),
a AS (SELECT count(*) AS docs, avg(len) AS mean FROM s),
w AS (SELECT k, CASE WHEN ln((docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - n + 0.5) / (n + 0.5)) END AS idf, mean FROM (SELECT k, count(*) AS n FROM u GROUP BY k), a),
r AS (SELECT u.row_id, -sum(idf * f * {K1 + 1} / (f + {K1} * ({1 - B} + {B} * len / mean))) AS rank FROM u JOIN w ON w.k = u.k JOIN s ON s.row_id = u.row_id GROUP BY u.row_id {keep})"""


