"""Near-duplicate removal by bottom-k sketches of one hash function.

1. A document's word shingles become a set of 64-bit hashes; the k smallest are
   its sketch. Documents with equal sets are one node.
2. Inverted lists of retained values generate the overlaps. Two nodes over the
   threshold share at least ``s`` retained values, so of each sketch only the
   ``len - s + 1`` values that the fewest sketches hold enter the lists: values
   of common passages stay out unless a sketch has nearly nothing else.
3. Lists of at most ``HOT`` nodes give their pairs. Nodes that reach longer lists
   go through the same filter again over their whole sets, where the required
   overlap is exact and the place of the shared value in both nodes bounds it
   further. In the lists that are long even so, every node meets the list's most
   central node; links make components, and then each node outside a list's
   largest component meets the whole list. Pairs within a component add nothing
   to it, so no link between components is lost.
4. The union sketch estimates the similarity of a pair, ``DEVIATIONS`` standard
   deviations below the threshold; exact Jaccard on the whole sets decides.
5. Components grow by alternating large and small stars; the joins at the root of a
   large component are inner joins whose other side has one row for a node, which
   adaptive execution splits where they are skewed.

Defined results: a document without words or text has an empty set and is linked
with nothing; fewer words than a shingle count as one shingle; the component is
named by its smallest non-null doc_id, or null if it has none; two texts under one
doc_id are two documents, whose components stay apart but for that name; repeated
rows fall into one component; a pair exactly at the threshold is linked; a very
long text counts with its whole set; an empty table gives an empty result; other
columns, whatever their names, are ignored, or kept by ``drop_near_duplicates``,
which takes five words and 0.8, as near-duplicate stages do unless told otherwise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import apart, each_row, in_arrow, settle, small

K = 64
HOT = 16
DEVIATIONS = 6
REMEMBERED = 100_000


@dataclass(frozen=True)
class Rule:
    """Shingle width in words and similarity in hundredths."""

    width: int = 3
    percent: int = 85
    k: int = K

    def required(self, m: int) -> int:
        """Least number of shared retained values for a sketch of ``m`` values."""
        t = self.percent / 100
        if m < self.k:
            return max(1, min(math.ceil(t * m), self.k - math.floor((1 - t) / t * m)))
        return max(1, math.floor(self.k * (t - DEVIATIONS * math.sqrt(t * (1 - t) / self.k))))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Hashes()
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes (63 bits) of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(ids))
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mix(h + ids[k : len(ids) - width + 1 + k] * np.uint64(FACTORS[k % 3]))
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(doc, text).alias("_key"))


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, _key, n_shingles, node, sketch) of every row; node is null for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def sketch(batches):
        for batch in batches:
            out = []
            for doc, key, text in each_row([batch], "doc_id", "_key", "text"):
                found = shingle_set(text, rule.width)
                node = xxhash.xxh64_intdigest(found.tobytes()) >> 1 if len(found) else None
                out.append((doc, key, len(found), node, found[: rule.k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return in_arrow(_keyed(docs), sketch, "doc_id long, _key long, n_shingles long, node long, sketch array<long>")


def whole_sets(docs: DataFrame, keys: DataFrame, rule: Rule) -> DataFrame:
    """(node, shingles) of the rows whose _key is in ``keys``."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def collect(batches):
        for batch in batches:
            nodes, sets = [], []
            for (text,) in each_row([batch], "text"):
                found = shingle_set(text, rule.width)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()) >> 1)
                sets.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, schema.field(1).type)], schema=schema)

    wanted = _keyed(docs).join(small(keys, 16), "_key", "left_semi").select("text")
    return in_arrow(wanted, collect, "node long, shingles array<long>").dropDuplicates(["node"])


def _pairs_of_lists(postings: DataFrame, admitted) -> DataFrame:
    """(a, b) of the nodes that meet in a list of at most HOT nodes. A posting is (value, p) with p.node."""
    lists = postings.groupBy("value").agg(F.array_sort(F.collect_list("p")).alias("l")).where(F.size("l") > 1)
    each = lists.select("l", F.posexplode("l").alias("at", "x")).select("x", F.explode(F.slice("l", F.col("at") + 2, F.size("l"))).alias("y"))
    return _ordered(each.where(admitted(F.col("x"), F.col("y"))))


def _ordered(met: DataFrame) -> DataFrame:
    a, b = F.least("x.node", "y.node"), F.greatest("x.node", "y.node")
    return met.where(F.col("x.node") != F.col("y.node")).select(a.alias("a"), b.alias("b")).distinct()


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return (F.least(x["n"], y["n"]) * 100) >= (F.greatest(x["n"], y["n"]) * percent)


def _places_fit(x: Column, y: Column, percent: int) -> Column:
    """The overlap from a shared value on, at ``pos`` in both orders, can still reach the threshold."""
    left = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return _sizes_fit(x, y, percent) & (left * (100 + percent) >= (x["n"] + y["n"]) * percent)


def sketch_pairs(nodes: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Pairs from the lists of values that few sketches hold, and the nodes that reach longer lists."""
    values = nodes.select("node", F.explode("sketch").alias("value"))
    # sums within tasks come first, so a value that a third of all sketches hold is one row a task
    hot = settle(values.groupBy("value").agg(F.count("*").alias("held")).where(F.col("held") > HOT))
    some = values.join(small(hot, 24), "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("_hot"))
    lengths = F.array(*[F.lit(m - rule.required(m) + 1) for m in range(1, rule.k + 1)])
    told = nodes.join(some, "node", "left").withColumn("_hot", F.transform(F.coalesce("_hot", F.array().cast("array<struct<held: bigint, value: bigint>>")), lambda h: h["value"]))
    told = told.withColumn("_cold", F.array_except("sketch", "_hot")).withColumn("_enter", F.element_at(lengths, F.size("sketch")))
    told = told.select("node", F.col("n_shingles").alias("n"), F.slice("_cold", F.lit(1), F.col("_enter")).alias("_cold"), (F.size("_cold") < F.col("_enter")).alias("_deep"))
    told = settle(told)
    postings = told.select(F.explode("_cold").alias("value"), F.struct("node", "n").alias("p"))
    return _pairs_of_lists(postings, lambda x, y: _sizes_fit(x, y, rule.percent)), told.where("_deep").select("node")


def estimated(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose union sketch doesn't rule out the threshold."""
    pairs = settle(pairs)
    wanted = small(settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), 16)
    held = settle(nodes.join(wanted, "node", "left_semi").select("node", "sketch"))
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(held.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, rule.k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    t = rule.percent / 100
    size = F.size(union)
    # a union of fewer than k values is the whole union, so its share is exact
    least = F.when(size < rule.k, t - 1e-9).otherwise(F.lit(t - DEVIATIONS * math.sqrt(t * (1 - t) / rule.k)))
    return both.where(shared >= size * least).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * rule.percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach, by alternating large and small stars."""
    edges = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        edges = settle(met.select("a", F.col("m").alias("b")).unionByName(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def deep_links(sets: DataFrame, links: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Links among the nodes whose sketches are made of common values, by their whole sets."""
    values = sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("value"))
    held = values.groupBy("value").agg(F.count("*").alias("held"))
    order = Window.partitionBy("node").orderBy("held", "value")
    placed = values.join(held, "value").withColumn("pos", F.row_number().over(order).cast("long") - 1)
    # a value after the first (1 - t) n + 1 can't be the first that a linked pair shares
    enter = settle(placed.where((F.col("held") > 1) & ((F.col("n") - F.col("pos")) * 100 >= F.col("n") * rule.percent)))
    fit = lambda x, y: _places_fit(x, y, rule.percent)
    postings = enter.select("value", "held", F.struct("node", "n", "pos").alias("p"))
    few, many = postings.where(F.col("held") <= HOT), postings.where(F.col("held") > HOT)
    central = small(settle(many.groupBy("value").agg(F.min(F.struct("p.pos", "p.node", "p.n")).alias("c"))), 48)
    star = many.join(central, "value").select(F.col("p").alias("x"), F.struct("c.node", "c.n", "c.pos").alias("y"))
    met = settle(_pairs_of_lists(few, fit).unionByName(_ordered(star.where(fit(F.col("x"), F.col("y"))))).distinct())
    found = settle(confirmed(estimated(met, nodes, rule), sets, rule))
    roots = components(links.unionByName(found))
    rooted = many.withColumn("node", F.col("p.node")).join(small(roots, 24), "node", "left").select("value", "p", F.coalesce("root", "node").alias("root"))
    shares = rooted.groupBy("value", "root").agg(F.count("*").alias("n"))
    main = small(settle(shares.groupBy("value").agg(F.max(F.struct("n", "root")).alias("m")).select("value", F.col("m.root").alias("main"))), 24)
    minor = settle(rooted.join(main, "value").where("root <> main").select("value", F.col("p").alias("x"), F.col("root").alias("xr")))
    # sizes that fit lie in one band or in two that touch
    band = lambda n: F.floor(F.log(n) / F.lit(math.log(100 / rule.percent) + 1e-9)).cast("int")
    near = minor.withColumn("band", F.explode(F.sequence(band(F.col("x.n")) - 1, band(F.col("x.n")) + 1)))
    rest = near.join(rooted.select("value", F.col("p").alias("y"), F.col("root").alias("yr"), band(F.col("p.n")).alias("band")), ["value", "band"]).where(F.col("xr") != F.col("yr")).where(fit(F.col("x"), F.col("y")))
    return found.unionByName(confirmed(estimated(_ordered(rest), nodes, rule), sets, rule))


def find_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, _key, n_shingles, component_id, root) of every row; the root tells components apart and is null for a row alone."""
    rows = settle(sketches(docs, rule))
    # one node for each set: its smallest document, and a row that stands for it
    same = settle(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("_key").alias("_key"), F.count("*").alias("copies")))
    nodes = settle(rows.join(same.select("node", "_key"), ["node", "_key"], "left_semi").dropDuplicates(["node"]).select("node", "n_shingles", "sketch"))
    pairs, deep = sketch_pairs(nodes, rule)
    pairs = settle(estimated(pairs, nodes, rule))
    wanted = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(deep).distinct())
    keys = settle(same.join(small(wanted, 16), "node", "left_semi").select("_key").distinct())
    sets = settle(whole_sets(docs, keys, rule))
    links = settle(confirmed(pairs, sets, rule))
    more = deep_links(settle(sets.join(small(settle(deep), 16), "node", "left_semi")), links, nodes, rule)
    roots = components(links.unionByName(more))
    # nodes that are neither copied nor linked are their own components
    rooted = same.join(roots, "node", "left").where("copies > 1 or root is not null").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = small(settle(rooted.join(named, "root").select("node", "component_id", "root")), 90)
    return rows.drop("sketch").join(known, "node", "left").select("doc_id", "_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def digest_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    out = find_components(docs, rule)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, rule: Rule = Rule(5, 80)) -> DataFrame:
    """The documents with one row of each component left: that with the smallest doc_id, then key."""
    found = settle(find_components(docs, rule).where("root is not null"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    first = found.groupBy("root").agg(F.min(rank).alias("f"), F.count("*").alias("n"))
    stays = settle(first.select("f._key").distinct())
    goes = settle(found.select("_key").distinct().join(stays, "_key", "left_anti"))
    twice = settle(found.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").join(stays, "_key", "left_semi").select("_key"))
    rows, named = apart(docs, "doc_id", "text")
    keyed = rows.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(small(goes, 16), "_key", "left_anti")
    again = small(twice, 16)
    out = keyed.join(again, "_key", "left_anti")
    if twice.take(1):  # rows that are equal in doc_id and text: any one of them stays
        out = out.unionByName(keyed.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return named(out)


#: The digests in DuckDB: all pairs that share a shingle, then the closure of the links.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r AS (SELECT doc_id, doc_id AS x FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.x),
c AS (SELECT doc_id, min(x) AS m FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, w.doc_id) AS component_id, coalesce(c.m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
