"""A Merkle manifest of a dataset in a store of node tables.

Rows become leaves; each group has a tree of its own, and the trees' roots are the
leaves of one tree above. Leaf digests go in order through ranges of (group, order)
and get their positions; the store is Parquet by level, each sorted by coordinate
(tree, position) within its files. A level is made by one scan of the level below: every
16 consecutive nodes become one, whose row keeps the digests that it was made
of. Proofs are taken from the top down: a level's rows meet, on their
coordinates, the paths that the level above hands down, and hand their own down to
their nodes, so each level is read once and a leaf's siblings are never searched for.

Nothing but the number of levels and the root reaches the driver. A group of any size
is spread over its coordinates, and one row holds 16 digests and a path of a few
levels.

Defined results: null fields are a `-`; null ids come first and equal ids by
their leaf; repeated rows are leaves of their own; a null group is a tree of
its own, the first; a tree of one leaf is that leaf; an empty table has no root and
gives an empty result; a very long text is hashed whole; other columns, whatever their
names, don't enter the leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import new_folder, settle, small
from quarry.llm.in_order import running

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<left:string,right:string>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf: byte count, colon, value; `-` where null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return hashed(*(field(v) for v in values))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, digest, lambda d, s: hashed(s["left"], d, s["right"]))


def siblings(path: Column) -> Column:
    """All digests of a path in order, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass
class Store:
    """Node tables ``path``/level=k: (tree, pos, n, digest), from level 1 on with the children's digests, in level 1 also what the leaves hold."""

    df: DataFrame
    path: str
    levels: int
    fanout: int = FANOUT

    def level(self, k: int) -> DataFrame:
        return self.df.sparkSession.read.parquet(f"{self.path}/level={k}")

    def tops(self) -> DataFrame:
        """(tree, digest) of each tree's root."""
        tops = [self.level(k).where("n = 1").select("tree", "digest") for k in range(self.levels + 1)]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out


def grow(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Store:
    """The levels over leaves (tree, digest, held, ...), in ``order`` within each tree."""
    path = new_folder(leaves.sparkSession, "manifest")
    leaves = settle(leaves)
    placed = running(leaves.withColumn("_one", F.lit(1)), "tree", order, "_one").withColumnRenamed("_before", "pos")
    sizes = small(settle(leaves.groupBy(F.col("tree").alias("_t")).agg(F.count("*").alias("n"))), 100)
    rows = placed.join(sizes, F.col("tree").eqNullSafe(F.col("_t"))).select("tree", "pos", "n", "digest", "held")
    store = Store(leaves, path, 0, fanout)
    rows.sortWithinPartitions("tree", "pos").write.parquet(f"{path}/level=0")
    while (store.level(store.levels).agg(F.max("n")).first()[0] or 0) > 1:
        below = store.level(store.levels).where("n > 1")
        ground = store.levels == 0
        run = F.sort_array(F.collect_list(F.struct("pos", "digest", *(["held"] if ground else []))))
        runs = below.groupBy("tree", F.floor(F.col("pos") / fanout).alias("at"), "n").agg(run.alias("run"))
        children = F.col("run.digest")
        up = runs.select("tree", F.col("at").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join(children, ""), 256).alias("digest"), children.alias("children"), *([F.col("run.held").alias("leaves")] if ground else []))
        store.levels += 1
        up.sortWithinPartitions("tree", "pos").write.parquet(f"{path}/level={store.levels}")
    return store


def paths(store: Store, above: DataFrame) -> DataFrame:
    """Each leaf's (held, digest, path) and what ``above`` (tree, top, path), settled, gives its tree; path: the siblings from the leaf up.

    A level's rows that end their tree begin with the tree's path, the others with their parent's.
    """
    above = above.select(F.col("tree").alias("_t"), *(c for c in above.columns if c != "tree"))
    more = [c for c in above.columns if c not in ("_t", "path")]
    meet = lambda df: df.where("n = 1").join(small(above, 4096), F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
    down: DataFrame | None = None  # (tree, pos, path, more) of the nodes of the level
    for k in range(store.levels, 0, -1):
        rows = store.level(k)
        begun = meet(rows)
        if down is not None:
            own = down.select(F.col("tree").alias("_t"), F.col("pos").alias("_p"), "path", *more)
            begun = begun.unionByName(rows.where("n > 1").join(own, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("pos") == F.col("_p"))).drop("_t", "_p"))
        each = begun.select("*", F.posexplode("children").alias("_i", "_digest"))
        side = lambda start, length: F.array_join(F.slice("children", start, length), "")
        step = F.struct(side(F.lit(1), F.col("_i")).alias("left"), side(F.col("_i") + 2, F.size("children")).alias("right"))
        path = F.concat(F.array(step), "path").cast(f"array<{STEP}>")
        if k > 1:
            # a node's coordinate: its parent's position times the fanout, which is the size of all runs but the last
            down = each.select("tree", (F.col("pos") * store.fanout + F.col("_i")).alias("pos"), path.alias("path"), *more)
        else:
            down = each.select(F.get("leaves", F.col("_i")).alias("held"), F.col("_digest").alias("digest"), path.alias("path"), *more)
    alone = meet(store.level(0)).select("held", "digest", "path", *more)
    return alone if down is None else down.unionByName(alone)


def prove(leaves: DataFrame, order: list[str]) -> DataFrame:
    """(held, digest, path, subroot, root) of each of the leaves (tree, digest, held, ...)."""
    store = grow(leaves, order)
    tops = settle(store.tops())
    over = grow(tops.select(F.lit("").alias("tree"), "digest", F.struct("tree", "digest").alias("held"), F.col("tree").alias("_name")), ["_name"])
    root = over.tops().select("tree", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    named = paths(over, settle(root)).select(F.col("held.tree").alias("tree"), F.col("held.digest").alias("subroot"), "root", "path")
    return paths(store, settle(named))


def digest_manifest(docs: DataFrame) -> DataFrame:
    """The contract's columns for all documents: each leaf proved, and every fifth or so after its text has changed."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    *others, text = (F.col(f) for f in FIELDS)
    held = F.struct("doc_id", F.when(changed, leaf_of(*others, F.translate(text, UPPER, LOWER))).alias("changed"))
    leaves = typed.select(F.col("source").alias("tree"), leaf_of(*others, text).alias("digest"), held.alias("held"), "doc_id")
    proved = prove(leaves, ["doc_id", "digest"])
    folded = proved.withColumn("folded_root", fold(F.coalesce("held.changed", "digest"), F.col("path")))
    return folded.select(
        F.col("held.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _levels(nodes: str) -> str:
    """The levels over the level-0 rows of a CTE, in DuckDB."""
    return f"""SELECT 0 AS lvl, tree, pos, n, digest FROM {nodes}
      UNION ALL SELECT lvl + 1, tree, pos // {FANOUT}, CAST(ceil(n / {FANOUT}) AS BIGINT), sha256(string_agg(digest, '' ORDER BY pos)) FROM RECUR WHERE n > 1 GROUP BY lvl, tree, pos // {FANOUT}, n"""


def _sides(nodes: str) -> str:
    order = f"PARTITION BY lvl, tree, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
    return f"""SELECT lvl, tree, pos, coalesce(string_agg(digest, '') OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
             coalesce(string_agg(digest, '') OVER ({order} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes} WHERE n > 1"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(f) for f in (*FIELDS[:-1], text))})"


#: The same in DuckDB, whose crc32 is spelt out bit by bit.
SQL = f"""
WITH RECURSIVE bits AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS name, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, name, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, CAST(ascii(name[i // 9 + 1]) AS BIGINT)) ELSE xor(c >> 1, 3988292384 * (c & 1)) END FROM bits WHERE i < 9 * length(name)),
crc AS (SELECT doc_id, xor(c, 4294967295) % 5 = 0 AS changed FROM bits WHERE i = 9 * length(name)),
d AS (SELECT doc_id, source AS tree, {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS other FROM documents),
z AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM d),
nodes AS ({_levels("z").replace("RECUR", "nodes")}),
tops AS (SELECT tree AS name, digest, '' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
over AS ({_levels("tops").replace("RECUR", "over")}),
sides AS ({_sides("nodes")}),
above AS ({_sides("over")}),
steps AS (
  SELECT z.doc_id, z.leaf, z.tree, z.pos, s.lvl AS k, s.l, s.r FROM z JOIN sides s ON s.tree IS NOT DISTINCT FROM z.tree AND s.pos = z.pos // CAST(pow({FANOUT}, s.lvl) AS BIGINT)
  UNION ALL SELECT z.doc_id, z.leaf, z.tree, z.pos, 1000 + a.lvl, a.l, a.r FROM z JOIN tops t ON t.name IS NOT DISTINCT FROM z.tree JOIN above a ON a.pos = t.pos // CAST(pow({FANOUT}, a.lvl) AS BIGINT)),
p AS (SELECT z.tree, z.pos, coalesce(string_agg(s.l || s.r, '' ORDER BY s.k), '') AS proof, coalesce(list(s.l || '|' || s.r ORDER BY s.k) FILTER (WHERE s.k IS NOT NULL), []) AS path
      FROM z LEFT JOIN steps s ON s.tree IS NOT DISTINCT FROM z.tree AND s.pos = z.pos GROUP BY z.tree, z.pos),
f AS (SELECT z.doc_id, z.leaf, t.digest AS subroot, (SELECT digest FROM over WHERE n = 1) AS root, sha256(p.proof) AS proof_sha256,
             list_reduce(list_concat([CASE WHEN c.changed THEN z.other ELSE z.leaf END], p.path), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
      FROM z JOIN p ON p.tree IS NOT DISTINCT FROM z.tree AND p.pos = z.pos JOIN tops t ON t.name IS NOT DISTINCT FROM z.tree LEFT JOIN crc c ON c.doc_id = z.doc_id)
SELECT *, folded_root = root AS verified FROM f
"""
