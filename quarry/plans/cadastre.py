"""Queries in the plane and along numbers, each beside its SQL in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import geometry as G
from quarry.operators import runs, spatial
from quarry.operators.cluster import shared_folder, spread
from quarry.plans.queries import query, table

# ---------------------------------------------------------------- polygons and cells

#: Points, and a polygon in the shape of an L beside each; coordinates are eighths, so that no sum rounds.
SPOTS = "SELECT vec_id, floor(CAST(embedding[1] AS DOUBLE) * 800) / 8 AS x, floor(CAST(embedding[2] AS DOUBLE) * 800) / 8 AS y, floor(CAST(embedding[3] AS DOUBLE) * 800) / 8 AS px, floor(CAST(embedding[4] AS DOUBLE) * 800) / 8 AS py, 2.0 + vec_id % 5 + CASE WHEN vec_id % 97 = 0 THEN 40 ELSE 0 END AS w, 2.0 + vec_id % 3 AS h FROM embeddings"
RECT = "sqrt(power(greatest({x0} - x, 0, x - ({x1})), 2) + power(greatest({y0} - y, 0, y - ({y1})), 2))"
FAR = f"least({RECT.format(x0='b.px', x1='b.px + b.w', y0='b.py', y1='b.py + b.h / 2')}, {RECT.format(x0='b.px', x1='b.px + b.w / 2', y0='b.py', y1='b.py + b.h')})".replace("- x", "- a.x").replace("x - (", "a.x - (").replace("- y", "- a.y").replace("y - (", "a.y - (")
MEET = f"e AS ({SPOTS}), m AS (SELECT a.vec_id, b.vec_id AS place_id, {FAR} AS d FROM e a JOIN e b ON {FAR} <= 3)"


def _spots(spark, sf_dir):
    at = lambda k: F.floor(F.col("embedding")[k].cast("double") * 800) / 8
    return table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("px"), at(3).alias("py"), F.expr("2.0D + vec_id % 5 + if(vec_id % 97 = 0, 40, 0)").alias("w"), F.expr("2.0D + vec_id % 3").alias("h"))


def _shapes(spots):
    corner = lambda i, j: F.struct((F.col("px") + F.col("w") * i).alias("x"), (F.col("py") + F.col("h") * j).alias("y"))
    ring = F.array(*(corner(i, j) for i, j in ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0))))
    return spatial.with_edges(spots.select(F.col("vec_id").alias("place_id"), F.array(ring).alias("rings")))


@query(f"WITH {MEET} SELECT vec_id, place_id, round(d, 6) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, place_id) AS r FROM m) WHERE r = 1")
def polygon_snap(spark, sf_dir):
    """The nearest polygon of each point by cells as wide as the polygons."""
    spots = _spots(spark, sf_dir)
    return spatial.nearest(spots, _shapes(spots), "vec_id", "place_id", 3.0).withColumn("metres", F.round("metres", 6))


def _rounded(metres):
    """The SQL's round(metres, 6): halves go up, and no decimal number is made of each pair, which took 0.7 microseconds."""
    return F.floor(metres * 1e6 + 0.5) / 1e6


@query(f"WITH {MEET} SELECT vec_id, place_id, round(d, 6) AS metres FROM m")
def quadtree_join(spark, sf_dir):
    """All polygons within reach of each point by the cells of a quadtree of the points."""
    spots = _spots(spark, sf_dir)
    tree = spatial.quadtree(spots, 50)
    return spatial.within(spots, _shapes(spots), "vec_id", "place_id", 3.0, tree).withColumn("metres", _rounded(F.col("metres")))


DEPTH, MOST = 8, 50


@query(f"""WITH e AS ({SPOTS}), b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) * (1 + 1e-9) AS size FROM e),
f AS (SELECT least({(1 << DEPTH) - 1}, CAST(floor((x - x0) / size * {1 << DEPTH}) AS BIGINT)) AS fx, least({(1 << DEPTH) - 1}, CAST(floor((y - y0) / size * {1 << DEPTH}) AS BIGINT)) AS fy FROM e, b),
c AS (SELECT l AS level, fx // (1 << ({DEPTH} - l)) AS cx, fy // (1 << ({DEPTH} - l)) AS cy, count(*) AS n FROM f, (SELECT CAST(unnest(range({DEPTH + 1})) AS INT) AS l) GROUP BY ALL)
SELECT c.level, c.cx, c.cy, c.n FROM c LEFT JOIN c p ON p.level = c.level - 1 AND p.cx = c.cx // 2 AND p.cy = c.cy // 2 WHERE (c.n <= {MOST} OR c.level = {DEPTH}) AND (p.n IS NULL OR p.n > {MOST})""")
def quadtree_leaves(spark, sf_dir):
    return spatial.quadtree(_spots(spark, sf_dir), MOST, DEPTH).leaves().select("level", "cx", "cy", "n")


@query(f"WITH e AS ({SPOTS}) SELECT vec_id AS place_id, px + w / 4 AS x, py + 3 * h / 4 AS y, true AS inside FROM e")
def polygon_points(spark, sf_dir):
    """A point inside each polygon, and whether it is."""
    inner = _shapes(_spots(spark, sf_dir)).withColumn("p", G.point_inside(F.col("edges")))
    return inner.select("place_id", "p.x", "p.y", G.contains(F.col("edges"), F.col("p.x"), F.col("p.y")).alias("inside"))


# ---------------------------------------------------------------- numbers of wards

#: A ward has 400 numbers; two in three are linked, some to the yard next door; parcels run up or down with the numbers.
WARDS = """p AS (SELECT p_partkey AS id, p_partkey // 400 AS ward, p_partkey % 400 AS n, p_size AS s, repeat(chr(CAST(97 + (p_partkey % 400 // 50) AS INT)), 7) AS street FROM part),
x AS (SELECT ward, n, id + CASE WHEN s % 10 = 1 THEN 1 ELSE 0 END AS place, street FROM p WHERE s % 3 <> 0),
y AS (SELECT id AS place, ward AS section, CASE WHEN ward % 2 = 0 THEN n + 7 ELSE 500 - n END AS parcel, n * 7.0 AS x0, n * 7.0 + 6 + s % 2 AS x1, ward * 1000.0 AS y0, ward * 1000.0 + 12 AS y1 FROM p),
a AS (SELECT ward, n, id AS place, street FROM p WHERE s % 4 = 0),
r AS (SELECT id AS qid, ward, n + CASE WHEN s % 11 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN s % 7 = 0 THEN 'zzzzzzz' ELSE street END AS street, NULL AS skip FROM p WHERE s % 3 = 0),
h AS (SELECT ward * 1000 + n AS qid, ward, n, street, n AS skip FROM x)"""
GAP = "sqrt(power(greatest({0}.x0 - {1}.x1, {1}.x0 - {0}.x1, 0), 2) + power(greatest({0}.y0 - {1}.y1, {1}.y0 - {0}.y1, 0), 2))"


def _run_sql(q: str) -> str:
    return f"""SELECT w.qid, z.place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, section, sg DESC, c) AS k FROM (
  SELECT qid, n, section, sg, c, total, count(*) AS votes, min(num) AS low, max(num) AS high FROM (
    SELECT q.qid, q.n, x.n AS num, y.section, g.sg, y.parcel - g.sg * x.n AS c, count(*) OVER (PARTITION BY q.qid) / 2 AS total FROM {q} q JOIN x ON x.ward = q.ward AND abs(x.n - q.n) <= 6 AND x.n IS DISTINCT FROM q.skip JOIN y ON y.place = x.place, (SELECT unnest([1, -1]) AS sg) g
    WHERE NOT EXISTS (SELECT 1 FROM x e WHERE e.ward = q.ward AND e.n = q.n AND e.n IS DISTINCT FROM q.skip)) GROUP BY ALL)) w
  JOIN y z ON z.section = w.section AND z.parcel = w.c + w.sg * w.n WHERE k = 1 AND votes >= 3 AND votes >= 0.6 * total AND low < w.n AND w.n < high"""


def _between_sql(q: str, held: str, nearer: str, same: str) -> str:
    lo, hi = (f"(SELECT {f}({held}.n) FROM {held} WHERE {held}.ward = q.ward AND {held}.n {c} AND {held}.n IS DISTINCT FROM q.skip)" for f, c in (("max", "BETWEEN q.n - 3 AND q.n - 1"), ("min", "BETWEEN q.n + 1 AND q.n + 3")))
    return f"""SELECT g.qid, CASE WHEN g.n - g.lo <= g.hi - g.n THEN l.place ELSE u.place END AS place FROM (SELECT q.*, {lo} AS lo, {hi} AS hi FROM {q} q) g
  JOIN {held} l ON l.ward = g.ward AND l.n = g.lo JOIN {held} u ON u.ward = g.ward AND u.n = g.hi LEFT JOIN y c ON c.place = l.place LEFT JOIN y d ON d.place = u.place
  WHERE (l.place = u.place OR ({nearer} AND {GAP.format("c", "d")} <= 15)) AND g.street IN (l.street, u.street) AND {same}"""


def _interpolate_sql(q: str) -> str:
    linked = "x e WHERE e.ward = {0}.ward AND e.n = {0}.n AND e.n IS DISTINCT FROM {0}.skip"
    return f"""SELECT q.qid, x.place FROM {q} q JOIN x ON x.ward = q.ward AND x.n = q.n AND x.n IS DISTINCT FROM q.skip WHERE x.street = q.street
  UNION ALL {_between_sql(q, "x", "least(g.n - g.lo, g.hi - g.n) <= 1", f"NOT EXISTS (SELECT 1 FROM {linked.format('g')})")}"""


def _anchors_sql(q: str) -> str:
    return _between_sql(q, "a", "true", "true")


def _numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey div 400 AS ward", "p_partkey % 400 AS number", "p_size AS s", "repeat(char(97 + (p_partkey % 400) div 50), 7) AS street")
    exact = p.where("s % 3 <> 0").select("ward", "number", F.expr("id + if(s % 10 = 1, 1, 0)").alias("place_id"), F.array("street").alias("streets"))
    yards = p.select(F.col("id").alias("place_id"), F.col("ward").alias("section"), F.expr("if(ward % 2 = 0, number + 7, 500 - number)").alias("parcel"))
    corner = lambda i, j: F.struct(F.expr(f"number * 7.0D + {i} * (6 + s % 2)").alias("x"), F.expr(f"ward * 1000.0D + {j} * 12").alias("y"))
    shapes = spatial.with_edges(p.select(F.col("id").alias("place_id"), F.array(F.array(*(corner(i, j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))))).alias("rings")))
    anchors = p.where("s % 4 = 0").select("ward", "number", F.col("id").alias("place_id"), F.array("street").alias("streets"))
    rows = p.where("s % 3 = 0").select(F.col("id").alias("row_id"), "ward", F.expr("number + if(s % 11 = 0, 1, 0)").alias("number"), F.expr("if(s % 7 = 0, 'zzzzzzz', street)").alias("street"))
    return rows, exact, yards, shapes, anchors


@query(f"WITH {WARDS} SELECT qid AS row_id, place AS place_id FROM ({_run_sql('r')})")
def parcel_run(spark, sf_dir):
    rows, exact, yards, _, _ = _numbers(spark, sf_dir)
    return runs.parcel_run(yards, yards)(rows, exact)


@query(f"WITH {WARDS} SELECT qid AS row_id, place AS place_id FROM ({_interpolate_sql('r')})")
def interpolate_numbers(spark, sf_dir):
    rows, exact, _, shapes, _ = _numbers(spark, sf_dir)
    return runs.interpolate(shapes)(rows, exact)


@query(f"WITH {WARDS} SELECT qid AS row_id, place AS place_id FROM ({_anchors_sql('r')})")
def between_anchors(spark, sf_dir):
    rows, exact, _, shapes, anchors = _numbers(spark, sf_dir)
    return runs.between_anchors(anchors, shapes)(rows, exact)


@query(f"""WITH {WARDS}, o AS (SELECT 'parcel_run' AS rule, * FROM ({_run_sql('h')}) UNION ALL SELECT 'interpolate', * FROM ({_interpolate_sql('h')}) UNION ALL SELECT 'anchors', * FROM ({_anchors_sql('h')})),
t AS (SELECT o.rule, x.ward, x.n AS number, x.place, o.place AS predicted, {GAP.format("c", "d")} AS g FROM o JOIN x ON o.qid = x.ward * 1000 + x.n LEFT JOIN y c ON c.place = x.place LEFT JOIN y d ON d.place = o.place)
SELECT rule, ward, number, predicted, CASE WHEN place = predicted THEN 'same' WHEN g < 1 THEN 'adjoining' WHEN g <= 10 THEN 'near' ELSE 'further' END AS bucket FROM t""")
def holdout_rules(spark, sf_dir):
    """Each linked number from the others, by three rules."""
    _, exact, yards, shapes, anchors = _numbers(spark, sf_dir)
    rules = {"parcel_run": (runs.parcel_run(yards, yards), 6), "interpolate": (runs.interpolate(shapes), 3), "anchors": (runs.between_anchors(anchors, shapes), 3)}
    out = [runs.holdout(rule, exact, shapes, reach).select(F.lit(name).alias("rule"), "ward", "number", "predicted", "bucket") for name, (rule, reach) in rules.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- the whole cascade

#: Names of a ward's people come from 80, a fifth of them with a letter more; owners mostly are whom the book names.
PEOPLE = "repeat(chr(CAST(97 + {k} % 26 AS INT)), 4) || repeat(chr(CAST(97 + ({k} // 26) AS INT)), 3) || repeat(chr(CAST(97 + ward % 26 AS INT)), 2)"
BOOK = f"""{WARDS.split("x AS (")[0]}y AS (SELECT id AS place, ward AS section, CASE WHEN ward % 2 = 0 THEN n + 7 ELSE 500 - n END AS parcel, n, s % 13 <> 0 AS premises, ward * 8 + (n // 50) AS along, n * 7.0 AS x0, n * 7.0 + 6 + s % 2 AS x1, ward * 1000.0 AS y0, ward * 1000.0 + 12 AS y1 FROM p),
a AS (SELECT ward, n, id AS place, street FROM p WHERE s % 4 = 0),
o AS (SELECT id AS place, {PEOPLE.format(k="((id * 7 + CASE WHEN s % 4 = 0 THEN 1 ELSE 0 END) % 80)")} AS name, chr(CAST(97 + (id + CASE WHEN s % 6 = 0 THEN 1 ELSE 0 END) % 4 AS INT)) AS initial FROM p),
w AS (SELECT id, ward, n, street, {PEOPLE.format(k="(id * 7 % 80)")} || CASE WHEN id % 5 = 0 THEN 'x' ELSE '' END AS name, chr(CAST(97 + id % 4 AS INT)) AS initial, ward * 8 + (n // 50) AS along, s % 19 = 0 AS quay, id % 6 <> 0 AS settled,
  CASE WHEN s % 4 <> 3 THEN (CASE WHEN s % 4 = 1 THEN (n // 8) * 8 ELSE n + CASE WHEN s % 5 = 0 THEN 1 ELSE 0 END END) * 7.0 + 3 END AS px, ward * 1000.0 - 1 AS py, CASE WHEN s % 7 = 0 AND n < 399 THEN id + 1 END AS reg FROM p),"""
FROM_POINT = "sqrt(power(greatest({y}.x0 - w.px, 0, w.px - {y}.x1), 2) + power(greatest({y}.y0 - w.py, 0, w.py - {y}.y1), 2))"
SAME = "({0} = {1} OR (length({0}) >= 6 AND length({1}) >= 6 AND levenshtein({0}, {1}) <= 1))"


def _open(name: str, before: str, extra: str = "true") -> str:
    return f"{name} AS (SELECT id AS qid, ward, n, street, NULL AS skip FROM w WHERE id NOT IN (SELECT id FROM {before}) AND {extra})"


CASCADE = f"""WITH {BOOK}
near AS (SELECT w.id, arg_min(y.place, {{'d': {FROM_POINT.format(y="y")}, 'p': y.place}}) AS place FROM w JOIN y ON y.section = w.ward AND w.px IS NOT NULL AND {FROM_POINT.format(y="y")} <= 8 GROUP BY w.id),
at_ AS (SELECT w.*, near.place, y.premises FROM w JOIN near USING (id) JOIN y ON y.place = near.place),
ns AS (SELECT t.id, t.place, count(DISTINCT y.place) AS k, min(y.place) AS yard FROM at_ t JOIN y ON y.along = t.along JOIN o ON o.place = y.place AND {SAME.format("t.name", "o.name")} WHERE t.premises AND NOT t.quay GROUP BY 1, 2),
mv AS (SELECT ns.id, ns.yard FROM ns JOIN y c ON c.place = ns.place JOIN y d ON d.place = ns.yard WHERE k = 1 AND ns.yard <> ns.place AND d.premises AND {GAP.format("c", "d")} < 1),
tl AS (SELECT t.*, mv.yard, count(DISTINCT t.ward * 1000 + t.n) FILTER (WHERE premises AND NOT quay AND mv.yard IS NULL) OVER (PARTITION BY place) AS pile FROM at_ t LEFT JOIN mv USING (id)),
pt AS (SELECT id, coalesce(yard, place) AS place, CASE WHEN NOT premises THEN 'off' WHEN quay THEN 'quay' WHEN yard IS NOT NULL THEN 'owner_next' WHEN pile >= 3 THEN 'piled' ELSE 'point' END AS how FROM tl),
x AS (SELECT ward, n, place, street FROM pt JOIN w USING (id) WHERE how = 'point'),
c0 AS (SELECT id, place, how AS rule FROM pt WHERE how IN ('quay', 'owner_next', 'point')),
c1 AS (SELECT * FROM c0 UNION ALL SELECT id, reg, 'register' FROM w WHERE reg IS NOT NULL AND id NOT IN (SELECT id FROM c0)),
{_open("q2", "c1")}, c2 AS (SELECT * FROM c1 UNION ALL SELECT g.qid, g.place, 'parcel_run' FROM ({_run_sql("q2")}) g JOIN y ON y.place = g.place AND y.premises),
ow AS (SELECT w.id, count(DISTINCT y.place) AS k, min(y.place) AS place FROM w JOIN y ON y.along = w.along JOIN o ON o.place = y.place AND o.initial = w.initial AND {SAME.format("w.name", "o.name")} WHERE w.id NOT IN (SELECT id FROM c2) GROUP BY 1),
rn AS (SELECT n.name FROM (SELECT DISTINCT name FROM w) n JOIN o ON {SAME.format("n.name", "o.name")} GROUP BY 1 HAVING count(DISTINCT o.place || o.name) <= 8),
c3 AS (SELECT * FROM c2 UNION ALL SELECT ow.id, ow.place, 'owner' FROM ow JOIN w USING (id) JOIN y ON y.place = ow.place AND y.premises WHERE k = 1 AND w.name IN (SELECT name FROM rn)),
c4 AS (SELECT * FROM c3 UNION ALL SELECT id, place, 'piled' FROM pt WHERE how = 'piled' AND id NOT IN (SELECT id FROM c3)),
c5 AS (SELECT * FROM c4 UNION ALL SELECT w.id, arg_min(y.place, {{'d': {FROM_POINT.format(y="y")}, 'p': y.place}}), 'premises' FROM w JOIN pt ON pt.id = w.id AND how = 'off' JOIN y ON y.section = w.ward AND y.premises AND {FROM_POINT.format(y="y")} <= 8 WHERE w.id NOT IN (SELECT id FROM c4) GROUP BY w.id),
{_open("q6", "c5")}, c6 AS (SELECT * FROM c5 UNION ALL SELECT qid, place, 'interpolate' FROM ({_interpolate_sql("q6")})),
kn AS (SELECT DISTINCT w.name, w.initial, w.street, c6.place FROM c6 JOIN w USING (id) WHERE w.settled),
c7 AS (SELECT * FROM c6 UNION ALL SELECT w.id, min(kn.place), 'same_person' FROM w JOIN kn ON kn.name = w.name AND kn.initial = w.initial AND kn.street = w.street WHERE w.settled AND w.id NOT IN (SELECT id FROM c6) GROUP BY w.id HAVING count(DISTINCT kn.place) = 1),
{_open("q8", "c7", "settled")}, c8 AS (SELECT * FROM c7 UNION ALL SELECT qid, place, 'anchors' FROM ({_anchors_sql("q8")}))
SELECT id AS row_id, place AS place_id, rule, rule = 'point' AS exact FROM c8"""


def _book(spark, sf_dir):
    shared_folder(spark)
    # few bytes a row, so few tasks would read what is long to work out, and each table below reads it again
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").checkpoint()
    p = p.selectExpr("p_partkey AS id", "p_partkey div 400 AS ward", "p_partkey % 400 AS number", "p_size AS s", "repeat(char(97 + (p_partkey % 400) div 50), 7) AS street")
    person = lambda k: f"concat(repeat(char(97 + {k} % 26), 4), repeat(char(97 + {k} div 26), 3), repeat(char(97 + ward % 26), 2))"
    yards = p.selectExpr("id AS place_id", "ward AS section", "if(ward % 2 = 0, number + 7, 500 - number) AS parcel", "s % 13 <> 0 AS premises", "number", "s", "ward")
    corner = lambda i, j: F.struct(F.expr(f"number * 7.0D + {i} * (6 + s % 2)").alias("x"), F.expr(f"ward * 1000.0D + {j} * 12").alias("y"))
    yards = spatial.with_edges(yards.withColumn("rings", F.array(F.array(*(corner(i, j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)))))).drop("number", "s", "ward"))
    streets = p.selectExpr("ward * 8 + number div 50 AS along", "id AS place_id")
    owners = yards_owned(p.selectExpr("id", f"{person('((id * 7 + if(s % 4 = 0, 1, 0)) % 80)')} AS name", "char(97 + (id + if(s % 6 = 0, 1, 0)) % 4) AS initial"))
    rows = p.selectExpr(
        "id AS row_id", "ward", "number", "street", f"concat({person('(id * 7 % 80)')}, if(id % 5 = 0, 'x', '')) AS name", "char(97 + id % 4) AS initial", "ward * 8 + number div 50 AS along", "s % 19 = 0 AS quay", "id % 6 <> 0 AS settled",
        "if(s % 4 <> 3, if(s % 4 = 1, number div 8 * 8, number + if(s % 5 = 0, 1, 0)) * 7.0D + 3, NULL) AS x", "ward * 1000.0D - 1 AS y",
    )
    register = p.where("s % 7 = 0 and number < 399").selectExpr("id AS row_id", "id + 1 AS place_id")
    anchors = p.where("s % 4 = 0").select("ward", "number", F.col("id").alias("place_id"), F.array("street").alias("streets"))
    return rows, yards, owners, streets, register, anchors


def yards_owned(rows):
    from quarry.operators.yards import readings

    return readings(rows, "id", ("name", "initial"))


@query(CASCADE)
def place_on_yards(spark, sf_dir):
    """All entries on yards by the rules in order."""
    from quarry.operators import yards

    return yards.place_on_yards(*_book(spark, sf_dir))
