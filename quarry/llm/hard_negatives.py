"""Hard negatives by block matrix products over two dimensions.

Vectors become whole numbers and are packed into panels: blocks of rows, cut into
chunks of dimensions. An anchor panel and a row panel that share a chunk give a
partial tile of int64 scores; partial tiles are added up by a shuffle on the tile's
coordinates, and each tile is reduced at once to the few rows that its anchors can
use. No tile is kept, so memory is a few tiles in a task whatever the number of rows.

Two products follow one another. The first takes panels of one label and reduces
tiles to each anchor's best rows of its own label, the positives. The second
takes all rows, and reduces tiles to each (anchor, positive) window's best rows of
other labels. Reductions of tiles then meet by anchor, or by anchor and positive.
The anchors are the stated query set; each panel of them meets each panel of rows once.

Scores are exact: a partial tile is computed in floating point only where all its
sums stay below 2**53, else in int64, and components stop at the largest number whose
inner products fit into a long, which normal embeddings never come near.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; rows are told apart by their place, so repeated rows
are rows of their own and may be each other's positives; ties go by smaller id; a vector
shorter than others has zeros for the rest, so an empty one scores 0 with everything;
anchors without a positive, and positives without a row in their window, return no
row; one label or one vector may hold any share of the rows; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import settle, small

EVERY = 100
TOP = 5
LOW, HIGH = 80, 100
SCALE = 256
ANCHOR_ROWS, BLOCK_ROWS, CHUNKS = 512, 4096, 2

WINDOW = ("anchor_place", "other_place", "other_id", "score")
PANEL = "part long, block int, chunk int, ids binary, labels binary, places binary, matrix binary"
BEST = "anchor_id long, anchor_place long, other_id long, other_place long, score long"
MINED = "anchor_id long, anchor_place long, positive_id long, positive_place long, positive_score long, negative_id long, negative_score long"


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, label, place, q) of the rows that take part; q: array<long>."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    taking = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(finite)
    widest = F.lit(float(1 << 53))  # so that the cast to long stands; the limit of the width follows
    whole = F.transform(x, lambda c: F.greatest(-widest, F.least(widest, F.floor(c.cast("double") * SCALE).cast("double"))).cast("long"))
    return taking.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.monotonically_increasing_id().alias("place"), whole.alias("q"))


def _packed(width: int, chunks: int):
    """Packs the rows of a block into ``chunks`` pieces, with ids in order."""
    limit = int((((1 << 63) - 1) // max(1, width)) ** 0.5)
    edges = np.linspace(0, width, chunks + 1).astype(int)

    def pack(key, group):
        order = np.lexsort((group["place"].to_numpy(), group["vec_id"].to_numpy()))
        q = group["q"].combine_chunks()
        q = q.chunk(0) if isinstance(q, pa.ChunkedArray) else q
        lengths, matrix = np.diff(q.offsets.to_numpy()), np.zeros((len(q), width), "<i8")
        matrix[np.arange(width) < lengths[:, None]] = np.clip(q.flatten().to_numpy(zero_copy_only=False), -limit, limit)
        matrix = matrix[order]
        own = [group[c].to_numpy()[order].astype("<i8").tobytes() for c in ("vec_id", "label", "place")]
        part, block = key[0].as_py(), key[1].as_py()
        out = [(part, block, c, *own, np.ascontiguousarray(matrix[:, edges[c] : edges[c + 1]]).tobytes()) for c in range(chunks)]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("part", "block", "chunk", "ids", "labels", "places", "matrix"), zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)})

    return pack


def panels(rows: DataFrame, sizes: DataFrame, per: int, width: int, chunks: int) -> DataFrame:
    """Settled panels of ``rows`` (part, vec_id, label, place, q): about ``per`` rows a block, dealt by their place; sizes: (part, n)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / per))
    dealt = rows.join(small(sizes.select(F.col("part").alias("_p"), blocks.alias("_blocks")), 32), F.col("part") == F.col("_p")).withColumn("block", F.pmod(F.xxhash64("place"), "_blocks").cast("int"))
    return settle(dealt.select("part", "block", "vec_id", "label", "place", "q").groupBy("part", "block").applyInArrow(_packed(width, chunks), PANEL))


def _numbers(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<i8")


def _product(key, left, right):
    """The partial tile of one anchor piece and one row piece; ids and labels go with the first chunk."""
    names = ["part", "i", "j", "chunk", "tile", *(f"{s}_{c}" for s in "ab" for c in ("ids", "labels", "places")), "windows"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 8]
    if not left.num_rows or not right.num_rows:  # a block that no row was dealt to
        return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
    a, b = (_numbers(t["matrix"][0]).reshape(len(_numbers(t["ids"][0])), -1) for t in (left, right))
    most = [int(max(abs(int(m.min())), abs(int(m.max())))) if m.size else 0 for m in (a, b)]
    exact = most[0] * most[1] * a.shape[1] < 1 << 53
    tile = (a.astype(float) @ b.astype(float).T).astype("<i8") if exact else a @ b.T
    part, i, j, chunk = (k.as_py() for k in key)
    about = [t[c][0].as_py() if not chunk else None for t in (left, right) for c in ("ids", "labels", "places")]
    about.append(left["windows"][0].as_py() if "windows" in left.column_names and not chunk else None)
    return pa.table({n: pa.array([v], k) for n, v, k in zip(names, [part, i, j, chunk, tile.tobytes(), *about], kinds, strict=True)})


TILE = "part long, i int, j int, chunk int, tile binary, a_ids binary, a_labels binary, a_places binary, b_ids binary, b_labels binary, b_places binary, windows binary"


def tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Partial tiles: each anchor piece is sent to the blocks of rows of its part, each piece of rows to the blocks of anchors."""
    wide = small(settle(rows.groupBy(F.col("part").alias("_p")).agg((F.max("block") + 1).alias("_n"))), 24)
    tall = small(settle(anchors.groupBy(F.col("part").alias("_p")).agg((F.max("block") + 1).alias("_n"))), 24)
    each = lambda counted: F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = anchors.join(wide, F.col("part") == F.col("_p")).withColumn("j", each("_n")).withColumnRenamed("block", "i").drop("_p", "_n")
    right = rows.join(tall, F.col("part") == F.col("_p")).withColumn("i", each("_n")).withColumnRenamed("block", "j").drop("_p", "_n")
    at = ("part", "i", "j", "chunk")
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_product, TILE)


def _summed(group: pa.Table):
    """The whole tile of a group of partial ones, and its anchors' and rows' numbers."""
    total, about = None, None
    for k in range(group.num_rows):
        part = _numbers(group["tile"][k])
        total = part.copy() if total is None else np.add(total, part, out=total)
        if group["a_ids"][k].is_valid:
            about = [_numbers(group[f"{s}_{c}"][k]) for s in "ab" for c in ("ids", "labels", "places")]
    return total.reshape(len(about[0]), len(about[3])), *about


def _ranked(row: np.ndarray, score: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells in order of row, score downwards and column; ids ascend with the columns."""
    order = np.lexsort((column, -score, row))
    return row[order], score[order], column[order]


def _first(group: np.ndarray, top: int) -> np.ndarray:
    """Which cells are among the first ``top`` of their group, groups being runs."""
    at = np.arange(len(group))
    starts = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0)) if len(group) else at
    return at - starts < top


def _frame(names: str, *columns: np.ndarray) -> pa.Table:
    return pa.table({n.split()[0]: pa.array(c, pa.int64()) for n, c in zip(names.split(", "), columns, strict=True)})


def best_of(top: int):
    """Reduces a tile to the best ``top`` other rows of each anchor."""

    def reduce(group):
        scores, a, _, a_place, b, _, b_place = _summed(group)
        keep = min(top + 1, scores.shape[1])  # one may be the anchor itself
        least = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
        row, column = np.nonzero(scores >= least[:, None])
        other = a_place[row] != b_place[column]
        row, score, column = _ranked(row[other], scores[row[other], column[other]], column[other])
        sel = _first(row, top)
        row, score, column = row[sel], score[sel], column[sel]
        return _frame(BEST, a[row], a_place[row], b[column], b_place[column], score)

    return reduce


def mined_of(top: int, low: int, high: int):
    """Reduces a tile to the best ``top`` rows of other labels in each of its anchors' windows, which come along with the first chunk."""

    def reduce(group):
        scores, a, a_label, a_place, b, b_label, _ = _summed(group)
        wins = next((_numbers(w).reshape(-1, len(WINDOW)) for w in group["windows"] if w.is_valid), np.zeros((0, len(WINDOW)), "<i8")).copy()
        by_place = np.argsort(a_place)
        wins[:, 0] = by_place[np.searchsorted(a_place[by_place], wins[:, 0])]
        # percentages are compared on whole numbers that may exceed a long, so the bounds are worked out in Python's
        lows = np.array([max(-(1 << 63), -(-low * int(s) // 100)) for s in wins[:, 3]], "<i8")
        highs = np.array([min((1 << 63) - 1, high * int(s) // 100) for s in wins[:, 3]], "<i8")
        lowest, highest = np.full(len(a), (1 << 63) - 1, "<i8"), np.full(len(a), -(1 << 63), "<i8")
        np.minimum.at(lowest, wins[:, 0], lows)
        np.maximum.at(highest, wins[:, 0], highs)
        row, column = np.nonzero((scores >= lowest[:, None]) & (scores <= highest[:, None]) & (a_label[:, None] != b_label[None, :]))
        row, score, column = _ranked(row, scores[row, column], column)
        edges = np.searchsorted(row, np.arange(len(a) + 1))
        out = []
        for (at, place, ident, positive), lo, hi in zip(wins, lows, highs, strict=True):
            begin, end = edges[at], edges[at + 1]
            first = begin + np.searchsorted(-score[begin:end], -hi)  # scores fall within an anchor
            last = min(first + top, begin + np.searchsorted(-score[begin:end], -lo, side="right"))
            out += [(a[at], a_place[at], ident, place, positive, b[column[k]], score[k]) for k in range(first, last)]
        return _frame(MINED, *(np.array(out, "<i8").reshape(-1, 7).T))

    return reduce


def _windows(key, group):
    """The windows of an anchor panel as numbers."""
    cells = np.stack([group[c].to_numpy() for c in WINDOW], axis=1).astype("<i8")
    return pa.table({"_i": pa.array([key[0].as_py()], pa.int32()), "windows": pa.array([cells.tobytes()], pa.binary())})


def first_of(df: DataFrame, top: int, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def mine(rows: DataFrame, every: int = EVERY, top: int = TOP, low: int = LOW, high: int = HIGH, anchor_rows: int = ANCHOR_ROWS, block_rows: int = BLOCK_ROWS, chunks: int = CHUNKS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over all rows (vec_id, embedding, label)."""
    rows = settle(quantised(rows))
    width = max(1, rows.agg(F.max(F.size("q"))).first()[0] or 0)
    chunks = min(chunks, width)
    anchor = F.col("vec_id") % every == 0
    # positives: parts are labels that have an anchor
    labelled = rows.withColumn("part", F.col("label"))
    counted = settle(labelled.groupBy("part").agg(F.count("*").alias("n"), F.count_if(anchor).alias("a")).where("a > 0"))
    own = panels(labelled.where(anchor), counted.select("part", F.col("a").alias("n")), anchor_rows, width, chunks)
    near = tiles(own, panels(labelled, counted.select("part", "n"), block_rows, width, chunks))
    found = near.groupBy("part", "i", "j").applyInArrow(best_of(top), BEST)
    positives = settle(first_of(found, top, ["anchor_place"], F.desc("score"), F.col("other_id"), F.col("other_place")).drop("rank"))
    # negatives: one part with all rows; an anchor panel brings the windows of its positives along
    whole = rows.withColumn("part", F.lit(0).cast("long"))
    sizes = settle(whole.agg(F.count("*").alias("n"), F.count_if(anchor).alias("a")).withColumn("part", F.lit(0).cast("long")))
    queries = panels(whole.where(anchor), sizes.select("part", F.col("a").alias("n")), anchor_rows, width, chunks)
    blocks = F.greatest(F.lit(1), F.ceil(sizes.first()["a"] / F.lit(anchor_rows)))
    dealt = positives.withColumn("_i", F.pmod(F.xxhash64("anchor_place"), blocks).cast("int"))
    windows = dealt.select("_i", *WINDOW).groupBy("_i").applyInArrow(_windows, "_i int, windows binary")
    asked = settle(queries.join(windows, F.col("block") == F.col("_i")).drop("_i"))
    cells = tiles(asked, panels(whole, sizes.select("part", "n"), block_rows, width, chunks))
    mined = cells.groupBy("part", "i", "j").applyInArrow(mined_of(top, low, high), MINED)
    return first_of(mined, top, ["anchor_place", "positive_place"], F.desc("negative_score"), F.col("negative_id")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


#: The same in DuckDB.
SQL = f"""
WITH q AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM (SELECT vec_id, label, CAST(embedding AS FLOAT[]) AS embedding FROM embeddings
                 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a, q b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE same) WHERE k <= {TOP}),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {TOP}
"""
