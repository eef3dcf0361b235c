"""Joins in the plane: polygons by cells of their own size, and a quadtree whose cells hold a bounded number of points."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import geometry as G
from quarry.operators.cluster import shared_folder, spread


def with_edges(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons with edges and box in place of their rings; those without a point go."""
    return polygons.where(F.size(F.flatten(rings)) > 0).withColumn("edges", G.edges(F.col(rings))).withColumn("box", G.box(F.col("edges"))).drop(rings)


#: Points and polygons that meet as one row.
POINTS_TOGETHER, POLYGONS_TOGETHER = 1000, 200


def _packed(rows: DataFrame, own: str, cell: list[str], most: int, into: str) -> DataFrame:
    """Rows of a cell as arrays (``into``) of about ``most`` each, numbered by ``into`` + "_part"."""
    n, part = rows.groupBy(*cell).agg(F.count("*").alias("_n")), f"{into}_part"
    dealt = rows.join(n.hint("merge"), cell).withColumn(part, F.pmod(F.xxhash64(own), F.ceil(F.col("_n") / most)))
    held = F.struct(F.col(own).alias("id"), *[c for c in rows.columns if c not in (own, *cell)])
    return dealt.groupBy(*cell, part).agg(F.collect_list(held).alias(into))


def _measured(points: DataFrame, point_id: str, polygons: DataFrame, place_id: str, cell: list[str], reach: float, best: bool) -> DataFrame:
    """(point_id, place_id, metres) of points (x, y) and polygons (edges, box) that share a cell and lie within ``reach`` of each other.

    Both are packed in their cells, so what moves is a part of a kilobyte for a thousand
    pairs, and parts of points meet parts of polygons in tasks of their own, so no cell is too full.
    """
    met = _packed(points, point_id, cell, POINTS_TOGETHER, "points").join(_packed(polygons, place_id, cell, POLYGONS_TOGETHER, "polygons").hint("merge"), cell)
    kinds = [points.schema[point_id].dataType.simpleString(), polygons.schema[place_id].dataType.simpleString()]

    def measure(batches):
        for b in batches:
            for found in G.near_pairs(b.column("points"), b.column("polygons"), reach, best):
                yield pa.RecordBatch.from_arrays(found, names=[point_id, place_id, "metres"])

    dealt = spread(met, *cell, "points_part", "polygons_part").select("points", "polygons")
    return dealt.mapInArrow(measure, f"`{point_id}` {kinds[0]}, `{place_id}` {kinds[1]}, metres double")


def within(points: DataFrame, polygons: DataFrame, point_id: str, place_id: str, reach: float, tree: Quadtree | None = None, best: bool = False) -> DataFrame:
    """(point_id, place_id, metres) of all polygons (``with_edges``) within ``reach`` of a point (x, y).

    Without a tree, a polygon enters the cells of a grid as wide as itself, at most
    four, and a point asks the grids that some polygon uses, of which there are as many as
    sizes differ by powers of two. With a tree of the points, both meet in its
    cells, so a dense town is as many keys as it needs. With ``best``, polygons that can't be
    a point's nearest may be missing.
    """
    asked, held = points.select(point_id, "x", "y"), polygons.select(place_id, "edges", "box")
    if tree is not None:
        probes, placed, cells = *tree.meet(asked, point_id, held, reach), ["level", "cx", "cy", "slot"]
    else:
        b = F.col("box")
        wide = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]) + 2 * reach
        sized = held.withColumn("level", F.ceil(F.log2(F.greatest(wide, F.lit(1e-9)))).cast("int"))
        levels = F.array(*[F.lit(r["level"]) for r in sized.select("level").distinct().collect()])
        cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level")))
        reached = lambda low, high: F.explode(F.sequence(cell(b[low] - reach), cell(b[high] + reach)))
        placed = sized.withColumn("cx", reached("x0", "x1")).withColumn("cy", reached("y0", "y1"))
        probes = asked.withColumn("level", F.explode(levels.cast("array<int>"))).withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
        cells = ["level", "cx", "cy"]
    return _measured(probes, point_id, placed, place_id, cells, reach, best)


def nearest(points: DataFrame, polygons: DataFrame, point_id: str, place_id: str, reach: float, tree: Quadtree | None = None) -> DataFrame:
    """The nearest polygon within ``reach`` of each point, ties by place: (point_id, place_id, metres)."""
    best = within(points, polygons, point_id, place_id, reach, tree, best=True).groupBy(point_id).agg(F.min(F.struct("metres", place_id)).alias("b"))
    return best.select(point_id, f"b.{place_id}", "b.metres")


def pair_distances(pairs: DataFrame, polygons: DataFrame, a: str, b: str, place_id: str) -> DataFrame:
    """``pairs`` with metres between the polygons ``a`` and ``b``; each pair of different ones is measured once."""
    edges = lambda name, into: polygons.select(F.col(place_id).alias(name), F.col("edges").alias(into))
    once = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct()
    told = once.join(edges("_a", "_e").hint("merge"), "_a").join(edges("_b", "_f").hint("merge"), "_b").select("_a", "_b", G.between(F.col("_e"), F.col("_f")).alias("_d"))
    out = pairs.join(told.hint("merge"), (F.least(a, b) == F.col("_a")) & (F.greatest(a, b) == F.col("_b")), "left")
    return out.withColumn("metres", F.when(F.col(a) == F.col(b), F.lit(0.0)).otherwise(F.col("_d"))).drop("_a", "_b", "_d")


@dataclass
class Quadtree:
    """Cells of an adaptive quadtree over points: nodes (level, cx, cy, n, leaf), where a leaf holds at most ``most`` points.

    Only points that coincide at the greatest depth can make a fuller leaf; such a
    leaf is dealt over slots, about half a ``most`` each.
    """

    nodes: DataFrame
    x0: float
    y0: float
    size: float
    depth: int
    most: int

    def at(self, v: Column, low: float) -> Column:
        """Coordinate of the finest cell; what lies outside belongs to the cell at the border."""
        return F.greatest(F.lit(0), F.least(F.lit((1 << self.depth) - 1), F.floor((v - low) / self.size * (1 << self.depth)))).cast("long")

    def leaves(self) -> DataFrame:
        """(level, cx, cy, n, x0, y0, x1, y1, slots) of the leaves."""
        wide = F.lit(self.size) / F.pow(F.lit(2.0), F.col("level"))
        own = self.nodes.where("leaf").drop("leaf")
        corner = {"x0": self.x0 + F.col("cx") * wide, "y0": self.y0 + F.col("cy") * wide}
        ends = {"x1": F.col("x0") + wide, "y1": F.col("y0") + wide, "slots": F.when(F.col("n") > self.most, F.ceil(2 * F.col("n") / self.most)).otherwise(1)}
        return own.withColumns(corner).withColumns(ends)

    def placed(self, points: DataFrame, point_id: str) -> DataFrame:
        """Points with the leaf (level, cx, cy, slot) that holds them."""
        leaves = self.leaves().select("level", "cx", "cy", "slots")
        levels = F.array(*[F.lit(r["level"]) for r in leaves.select("level").distinct().collect()]).cast("array<int>")  # at most depth + 1
        up = lambda c: F.expr(f"shiftright({c}, {self.depth} - level)")
        fine = points.withColumns({"_fx": self.at(F.col("x"), self.x0), "_fy": self.at(F.col("y"), self.y0)})
        probes = fine.withColumn("level", F.explode(levels)).withColumns({"cx": up("_fx"), "cy": up("_fy")}).drop("_fx", "_fy")
        return probes.join(leaves, ["level", "cx", "cy"]).withColumn("slot", F.pmod(F.xxhash64(point_id), "slots")).drop("slots")

    def covering(self, boxes: DataFrame, reach: float) -> DataFrame:
        """Boxes (box) with each leaf (level, cx, cy, slot) that they reach: from the root down, one level of nodes at a time."""
        b = F.col("box")
        open_, out = boxes.withColumns({"level": F.lit(0), "cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")}), None
        deepest = self.nodes.agg(F.max("level")).first()[0] or 0
        last = (1 << self.depth) - 1
        low = {c: self.at(b[f"{c}0"] - reach, getattr(self, f"{c}0")) for c in "xy"}
        high = {c: self.at(b[f"{c}1"] + reach, getattr(self, f"{c}0")) for c in "xy"}
        kids = F.explode(F.array(*[F.struct((2 * F.col("cx") + i).alias("cx"), (2 * F.col("cy") + j).alias("cy")) for i in (0, 1) for j in (0, 1)]))
        for level in range(deepest + 1):
            nodes = self.nodes.where(F.col("level") == level)
            nodes = nodes if level else nodes.coalesce(1)  # one row; a box is read again for each of its partitions
            met = open_.join(nodes, ["level", "cx", "cy"]).checkpoint()
            slots = F.when(F.col("n") > self.most, F.ceil(2 * F.col("n") / self.most)).otherwise(1)
            here = met.where("leaf").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), slots.cast("long") - 1))).drop("leaf", "n")
            out = here if out is None else out.unionByName(here)
            below = met.where("not leaf").drop("leaf", "n").withColumn("_k", kids).withColumns({"level": F.lit(level + 1), "cx": F.col("_k.cx"), "cy": F.col("_k.cy")}).drop("_k")
            shift = self.depth - level - 1
            inside = lambda c: F.col(f"c{c}").between(F.shiftright(low[c], shift), F.shiftright(high[c], shift))  # noqa: B023, E731
            open_ = below.where(inside("x") & inside("y")) if shift >= 0 else below.where(F.lit(last < 0))
        return out

    def coarser(self, most: int) -> Quadtree:
        """The tree cut off at cells that hold at most ``most`` points, if that is more than its own bound."""
        if most <= self.most:
            return self
        full = self.nodes.where(F.col("n") > most).select((F.col("level") + 1).alias("level"), F.col("cx").alias("_px"), F.col("cy").alias("_py"))
        under = (self.nodes["level"] == full["level"]) & (F.shiftright("cx", 1) == F.col("_px")) & (F.shiftright("cy", 1) == F.col("_py"))
        nodes = self.nodes.where("level = 0").unionByName(self.nodes.join(full, under, "left_semi"))
        return replace(self, nodes=nodes.withColumn("leaf", F.col("leaf") | (F.col("n") <= most)).checkpoint(), most=most)

    def meet(self, points: DataFrame, point_id: str, boxes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
        """Points and boxes with the cells (level, cx, cy, slot) of at most POINTS_TOGETHER points that they lie in or reach."""
        tree = self.coarser(POINTS_TOGETHER)
        return tree.placed(points, point_id), tree.covering(boxes, reach)


def quadtree(points: DataFrame, most: int, depth: int = 20, step: int = 3) -> Quadtree:
    """Split the square around the points (x, y) until no cell holds more than ``most``, or to ``depth``.

    A round counts the points of the cells that are still too full, ``step`` levels
    further down, and adds the counts up for the levels between. Counts are summed
    within tasks first; a cell's points never meet.
    """
    shared_folder(points.sparkSession)
    b = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    n = b["n"] or 0
    size = max((b["x1"] or 0.0) - (b["x0"] or 0.0), (b["y1"] or 0.0) - (b["y0"] or 0.0)) * (1 + 1e-9) or 1.0
    tree = Quadtree(None, b["x0"] or 0.0, b["y0"] or 0.0, size, depth, most)
    fine = points.select(tree.at(F.col("x"), tree.x0).alias("_fx"), tree.at(F.col("y"), tree.y0).alias("_fy"))
    spark = points.sparkSession
    nodes = spark.createDataFrame([(0, 0, 0, n, n <= most)], "level int, cx long, cy long, n long, leaf boolean")
    level, full = 0, n > most
    front = nodes.select("cx", "cy")
    while full and level < depth:
        ahead = min(step, depth - level)
        cell = lambda l: [F.shiftright("_fx", depth - l).alias("cx"), F.shiftright("_fy", depth - l).alias("cy")]  # noqa: E731, E741
        still = fine.select(*cell(level), *[c.alias(n) for c, n in zip(cell(level + ahead), ("dx", "dy"), strict=True)])
        counted = still.join(front, ["cx", "cy"], "left_semi").groupBy("dx", "dy").agg(F.count("*").alias("n")).checkpoint()
        for k in range(1, ahead + 1):
            up = lambda c, j: F.shiftright(c, ahead - j)  # noqa: B023, E731
            sums = counted.groupBy(up("dx", k).alias("cx"), up("dy", k).alias("cy")).agg(F.sum("n").alias("n"))
            parents = counted.groupBy(up("dx", k - 1).alias("px"), up("dy", k - 1).alias("py")).agg(F.sum("n").alias("pn")).where(F.col("pn") > most)
            here = sums.join(parents, (F.shiftright("cx", 1) == F.col("px")) & (F.shiftright("cy", 1) == F.col("py")), "left_semi")
            nodes = nodes.unionByName(here.select(F.lit(level + k).alias("level"), "cx", "cy", "n", ((F.col("n") <= most) | F.lit(level + k == depth)).alias("leaf")))
        nodes, level = nodes.checkpoint(), level + ahead
        front = nodes.where((F.col("level") == level) & ~F.col("leaf")).select("cx", "cy")
        full = not front.isEmpty()
    tree.nodes = nodes
    return tree
