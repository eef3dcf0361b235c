"""Queries of upkeep, dated versions and page trees, each beside its SQL in DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import cluster, review, upkeep
from quarry.plans.queries import query, table

# ---------------------------------------------------------------- clusters and links after edits

#: A tenth of the parts changes its type; a brand is a block, parts of one type or one price are linked.
PARTS = "p AS (SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_size % 10 = 3 THEN 'NEW ' || p_size ELSE p_type END AS type, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part)"


@query(f"""WITH RECURSIVE {PARTS}, r AS (SELECT id, id AS reached, brand, type, price FROM p UNION SELECT r.id, n.id, n.brand, n.type, n.price FROM r JOIN p n ON n.brand = r.brand AND (n.type = r.type OR n.price = r.price))
SELECT id, min(reached) AS component FROM r GROUP BY id""")
def components_after_edits(spark, sf_dir):
    """Components kept up from those before the edits, frontier by frontier."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS brand", "p_type AS type", "CAST(floor(p_retailprice) AS BIGINT) AS price", "p_size")
    after = part.withColumn("type", F.expr("if(p_size % 10 = 3, concat('NEW ', p_size), type)"))
    links = [["type"], ["price"]]
    before = cluster.connected_components(part, cluster.star_edges(part, "id", ["brand"], links), "id")
    return upkeep.refreshed_components(part, after, part.where("p_size % 10 = 3").select("id"), before, "id", ["brand"], links)[0]


#: Customers link to nations: some are linked already, links name another or the same market segment, unlinks the right or a wrong nation.
LINKED = """c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS place, c_mktsegment AS guard FROM customer),
l AS (SELECT c_custkey AS id, c_nationkey AS place, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS guard FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_nationkey END, NULL FROM customer WHERE c_custkey % 6 = 3 OR (c_custkey % 3 = 0 AND c_nationkey = 7) UNION ALL SELECT -5, 1, 'X'),
b AS (SELECT n_nationkey AS place, n_name AS name, 1000 AS entry_count FROM nation WHERE n_nationkey % 4 <> 1),
d AS (SELECT c.id, CASE WHEN l.guard IS NOT NULL AND c.place IS NULL AND c.guard = l.guard THEN 'linked' WHEN l.id IS NOT NULL AND l.guard IS NULL AND c.place = l.place THEN 'unlinked' WHEN l.id IS NOT NULL THEN 'skipped' END AS does, l.place AS lp, c.place, l.id AS lid FROM c FULL JOIN l ON l.id = c.id),
e AS (SELECT id, CASE does WHEN 'linked' THEN lp WHEN 'unlinked' THEN NULL ELSE place END AS place FROM d WHERE id IS NOT NULL),
h AS (SELECT lp AS place, bool_or(does = 'unlinked') AS gone, bool_or(does = 'linked') AS came FROM d WHERE does IN ('linked', 'unlinked') GROUP BY 1),
n AS (SELECT place, name, entry_count, true AS there FROM b UNION ALL SELECT n_nationkey, n_name, 0, false FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey IN (SELECT place FROM h WHERE came)),
k AS (SELECT n.*, h.place IS NOT NULL AS hit, gone, (SELECT count(*) FROM e WHERE e.place = n.place) AS now FROM n LEFT JOIN h ON h.place = n.place)"""


def _links(spark, sf_dir):
    c, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    entries = c.selectExpr("c_custkey AS id", "if(c_custkey % 3 = 0, c_nationkey, NULL) AS place", "c_mktsegment AS guard")
    put = c.where("c_custkey % 2 = 0 and c_custkey % 3 <> 0").selectExpr("c_custkey AS id", "c_nationkey AS place", "if(c_custkey % 5 = 0, 'OTHER', c_mktsegment) AS guard")
    off = c.where("c_custkey % 6 = 3 or (c_custkey % 3 = 0 and c_nationkey = 7)").selectExpr("c_custkey AS id", "if(c_custkey % 4 = 0, -1, c_nationkey) AS place", "CAST(NULL AS STRING) AS guard")
    stray = spark.range(1).selectExpr("-5L AS id", "1 AS place", "'X' AS guard")
    held = nation.where("n_nationkey % 4 <> 1").selectExpr("n_nationkey AS place", "n_name AS name", "1000L AS entry_count")
    fresh = nation.where("n_nationkey % 4 = 1").selectExpr("n_nationkey AS place", "n_name AS name", "0L AS entry_count")
    return upkeep.merge_links(entries, put.unionByName(off).unionByName(stray), held, fresh, "id", "place", "guard")


@query(f"WITH {LINKED} SELECT 'entry' AS kind, id, CAST(place AS VARCHAR) AS value FROM e UNION ALL SELECT 'building', place, name || ' ' || CASE WHEN hit THEN now ELSE entry_count END FROM k WHERE NOT coalesce(gone AND now = 0, false)")
def merged_links(spark, sf_dir):
    """Entries and buildings after links and unlinks."""
    entries, buildings, _ = _links(spark, sf_dir)
    one = entries.select(F.lit("entry").alias("kind"), "id", F.col("place").cast("string").alias("value"))
    return one.unionByName(buildings.select(F.lit("building").alias("kind"), F.col("place").cast("long").alias("id"), F.concat_ws(" ", "name", F.col("entry_count").cast("string")).alias("value")))


@query(f"""WITH {LINKED} SELECT (SELECT count(*) FROM d WHERE does = 'linked') AS linked, (SELECT count(*) FROM d WHERE does = 'unlinked') AS unlinked, (SELECT count(*) FROM d WHERE does = 'skipped') AS skipped,
count(*) FILTER (WHERE NOT there) AS new_buildings, count(*) FILTER (WHERE hit) AS recounted, count(*) FILTER (WHERE hit AND gone AND now = 0) AS deleted FROM k""")
def merged_links_report(spark, sf_dir):
    return _links(spark, sf_dir)[2]


#: Overrides of orders: every fourth by its key, others by a key that is gone and a mark that one, several or no orders have.
OVERRIDDEN = """o AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS mark, o_orderstatus AS status, o_orderpriority AS note FROM orders),
v AS (SELECT o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 100000000 END AS k, CASE WHEN o_orderkey % 4 = 2 THEN 'nobody' ELSE CAST(o_custkey AS VARCHAR) END AS mark, o_orderkey % 3 > 0 AS has_status, o_orderkey % 3 < 2 AS has_note, CASE WHEN o_orderkey % 7 > 0 THEN 'S' || o_orderkey END AS status, 'N' || o_orderkey AS note FROM orders WHERE o_orderkey % 8 IN (0, 1, 2)),
m AS (SELECT v.*, o.id AS direct, CASE WHEN o.id IS NULL THEN (SELECT min(q.id) FROM o q WHERE q.mark = v.mark) END AS other FROM v LEFT JOIN o ON o.id = v.k),
f AS (SELECT *, coalesce(direct, other) AS here, direct IS NOT NULL AS d FROM m WHERE coalesce(direct, other) IS NOT NULL),
s AS (SELECT here, status, row_number() OVER (PARTITION BY here ORDER BY d DESC, k DESC) AS r FROM f WHERE has_status), t AS (SELECT here, note, row_number() OVER (PARTITION BY here ORDER BY d DESC, k DESC) AS r FROM f WHERE has_note)"""


def _overridden(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    entries = orders.selectExpr("o_orderkey AS id", "CAST(o_custkey AS STRING) AS mark", "o_orderstatus AS status", "o_orderpriority AS note")
    fields = "map_filter(map('status', if(o_orderkey % 7 > 0, concat('S', o_orderkey), NULL), 'note', concat('N', o_orderkey)), (k, v) -> if(k = 'status', o_orderkey % 3 > 0, o_orderkey % 3 < 2)) AS fields"
    overrides = orders.where("o_orderkey % 8 in (0, 1, 2)").selectExpr("o_orderkey + if(o_orderkey % 4 = 0, 0, 100000000) AS id", "if(o_orderkey % 4 = 2, 'nobody', CAST(o_custkey AS STRING)) AS mark", fields)
    return upkeep.merge_overrides(entries, overrides, "id", "mark", ["status", "note"])


@query(f"WITH {OVERRIDDEN} SELECT o.id, CASE WHEN s.here IS NOT NULL THEN s.status ELSE o.status END AS status, CASE WHEN t.here IS NOT NULL THEN t.note ELSE o.note END AS note FROM o LEFT JOIN s ON s.here = o.id AND s.r = 1 LEFT JOIN t ON t.here = o.id AND t.r = 1")
def merged_overrides(spark, sf_dir):
    return _overridden(spark, sf_dir)[0].select("id", "status", "note")


@query(f"WITH {OVERRIDDEN} SELECT count(direct) AS applied, count(other) AS fell_back, count(*) FILTER (WHERE direct IS NULL AND other IS NULL) AS missing FROM m")
def merged_overrides_report(spark, sf_dir):
    return _overridden(spark, sf_dir)[1]


# ---------------------------------------------------------------- ward numbers and dated versions

#: Customers ask for a number of a ward in their year; parts are its versions, overlapping and partly open.
DATED = """q AS (SELECT c_custkey AS row_id, chr(CAST(65 + c_nationkey AS INT)) AS ward, CASE WHEN c_custkey % 10 = 9 THEN 'alley' ELSE CAST(c_custkey % 40 AS VARCHAR) END AS number, CASE WHEN c_custkey % 3 = 0 THEN 'zzzzzz' ELSE 'yyyyyy' END AS street, 1800 + c_custkey % 60 AS year FROM customer),
v AS (SELECT chr(CAST(65 + p_partkey % 25 AS INT)) AS ward, CAST((p_partkey // 25) % 40 AS VARCHAR) AS number, CASE p_size % 3 WHEN 0 THEN 'zzzzzz' WHEN 1 THEN 'xxxxxx' ELSE 'yyyyyy' END AS street, CASE WHEN p_size % 4 > 0 THEN CAST(p_size % 8 AS VARCHAR) ELSE '' END AS house, CASE WHEN p_size % 5 = 0 THEN 'north' END AS side, CASE WHEN p_size % 6 = 0 THEN 'zzzzzz' END AS before,
  CASE WHEN p_size % 9 > 0 THEN 1800 + p_size END AS low, CASE WHEN p_size % 7 > 0 THEN 1810 + p_size * 2 END AS high FROM part),
l AS (SELECT ward, number, min({'s': 'S' || (CAST(number AS INT) % 7), 'p': number, 'c': 'sure'}) AS lot FROM v WHERE CAST(number AS INT) % 2 = 0 GROUP BY 1, 2),
m AS (SELECT q.row_id, list(DISTINCT v.street) AS ss, list(DISTINCT v.house) FILTER (WHERE v.house <> '') AS hs, list(DISTINCT v.side) FILTER (WHERE v.side IS NOT NULL) AS ds, bool_or(v.street = q.street OR v.before = q.street) AS ok FROM q JOIN v ON v.ward = q.ward AND v.number = q.number AND coalesce(v.low, 0) <= q.year AND q.year < coalesce(v.high, 9999) GROUP BY 1)"""


@query(f"""WITH {DATED} SELECT q.row_id, CASE WHEN m.row_id IS NULL THEN 'none' WHEN len(hs) = 1 THEN 'house' WHEN len(hs) > 1 THEN 'ambiguous' ELSE 'street_only' END AS status, coalesce(array_to_string(list_sort(ss), ' / '), '') AS modern_street,
coalesce(array_to_string(list_sort(hs), ' / '), '') AS modern_number, coalesce(array_to_string(list_sort(ds), ' / '), '') AS side, CASE WHEN m.row_id IS NULL THEN '' WHEN ok THEN 'ok' ELSE 'differs' END AS street_check,
coalesce(lot.s || ' ' || lot.p, '') AS parcel, CASE WHEN q.number = 'alley' THEN 'no ward number' WHEN m.row_id IS NULL AND (q.ward, q.number) IN (SELECT (ward, number) FROM v) THEN 'only in another period' ELSE '' END AS notes
FROM q LEFT JOIN m USING (row_id) LEFT JOIN l ON l.ward = q.ward AND l.number = q.number""")
def modern_addresses(spark, sf_dir):
    from quarry.operators import wards

    q = table(spark, sf_dir, "customer").selectExpr("c_custkey AS row_id", "char(65 + c_nationkey) AS ward", "if(c_custkey % 10 = 9, 'alley', CAST(c_custkey % 40 AS STRING)) AS number", "if(c_custkey % 3 = 0, 'zzzzzz', 'yyyyyy') AS street", "1800 + c_custkey % 60 AS year")
    v = table(spark, sf_dir, "part").selectExpr(
        "char(65 + p_partkey % 25) AS ward", "CAST((p_partkey div 25) % 40 AS STRING) AS number", "CASE p_size % 3 WHEN 0 THEN 'zzzzzz' WHEN 1 THEN 'xxxxxx' ELSE 'yyyyyy' END AS street", "if(p_size % 4 > 0, CAST(p_size % 8 AS STRING), '') AS house",
        "if(p_size % 5 = 0, 'north', NULL) AS side", "if(p_size % 6 = 0, 'zzzzzz', NULL) AS before", "if(p_size % 9 > 0, 1800 + p_size, NULL) AS `from`", "if(p_size % 7 > 0, 1810 + p_size * 2, NULL) AS until",
    )
    lots = v.where("CAST(number AS INT) % 2 = 0").selectExpr("ward", "number", "concat('S', CAST(number AS INT) % 7) AS section", "number AS parcel", "'sure' AS certainty").distinct()
    out = wards.modern_addresses(q, v, lots, v.select("ward", "number").limit(0))
    return out.select("row_id", "status", "modern_street", "modern_number", "side", "street_check", "parcel", "notes")


@query("""WITH a AS (SELECT DISTINCT p_size % 5 AS page, p_name AS name FROM part WHERE p_size % 3 > 0), b AS (SELECT DISTINCT p_size % 5 AS page, CASE WHEN p_size % 4 = 0 THEN p_name || 's' WHEN p_size % 4 = 1 THEN p_name || ' and daughters' ELSE p_name END AS name FROM part WHERE p_size % 3 = 0),
m AS (SELECT a.page, a.name, b.name AS other FROM a JOIN b ON a.page = b.page AND (a.name = b.name OR (b.name = a.name || 's' AND 2.0 * length(a.name) / (2 * length(a.name) + 1) > 0.8)))
SELECT 'left' AS side, * FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page = a.page AND m.name = a.name) UNION ALL SELECT 'right', * FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page = b.page AND m.other = b.name)""")
def index_check(spark, sf_dir):
    """Names of an index without a like one in the register of the page, and the other way round."""
    from quarry.operators import linkage

    part = table(spark, sf_dir, "part").selectExpr("p_size % 5 AS page", "p_name AS name", "p_size")
    right = part.where("p_size % 3 = 0").selectExpr("page", "CASE WHEN p_size % 4 = 0 THEN concat(name, 's') WHEN p_size % 4 = 1 THEN concat(name, ' and daughters') ELSE name END AS name")
    return linkage.two_sided_anti(part.where("p_size % 3 > 0"), right, "name", ["page"])


# ---------------------------------------------------------------- page trees

#: Events as lines of a user's page, in two columns for most, two words each.
PAGES = """n AS (SELECT user_id AS page, event_id AS k, CASE WHEN user_id % 4 > 0 THEN event_id % 2 * 520 ELSE 200 END + CAST(floor(value) AS INT) % 40 AS x1, event_id * 7 % 900 AS y1, 100 + event_id % 50 AS w, event_id % 3 > 0 AS alike, event_type AS a, event_type || 'en' AS b FROM events),
c AS (SELECT *, x1 + w AS x2, x1 + w / 2 AS mid, row_number() OVER (PARTITION BY page ORDER BY k) AS i FROM n)"""


@query(f"""WITH {PAGES}, g AS (SELECT page, mid, lead(mid) OVER (PARTITION BY page ORDER BY mid, k) AS nxt, count(*) OVER (PARTITION BY page) AS n, row_number() OVER (PARTITION BY page ORDER BY mid, k) AS r FROM c),
b AS (SELECT page, n, nxt - mid AS wide, (mid + nxt) / 2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY nxt - mid DESC NULLS LAST, r) AS best FROM g) WHERE best = 1),
f AS (SELECT b.page, b.cut FROM b JOIN c USING (page) GROUP BY b.page, b.cut, b.n, b.wide HAVING b.n >= 6 AND wide >= 80 AND b.cut BETWEEN 300 AND 700 AND least(count(*) FILTER (WHERE c.mid < b.cut), count(*) FILTER (WHERE c.mid >= b.cut)) >= greatest(3, 0.15 * b.n)),
o AS (SELECT c.*, f.cut, row_number() OVER (PARTITION BY c.page ORDER BY c.mid >= f.cut, CASE WHEN f.cut IS NOT NULL THEN y1 END, i) AS place FROM c LEFT JOIN f USING (page)),
v AS (SELECT *, unnest([0, 1]) AS j, length(a) AS la, length(b) AS lb FROM o)
SELECT page, CASE WHEN cut IS NULL THEN 'b' ELSE 'block_' || ((place - 1) // 50 + 1) END AS block, CASE WHEN cut IS NULL THEN 'l' || k ELSE printf('line_%04d', place) END AS line, CASE WHEN cut IS NULL THEN 'w' || (2 * k + j) ELSE printf('w_%04d', 2 * place - 1 + j) END AS word, CASE j WHEN 0 THEN a ELSE b END AS text,
CAST(CASE WHEN NOT alike THEN x1 + 300 * j WHEN j = 0 THEN x1 ELSE x1 + floor((la + 1.0) / (la + lb + 1) * w) END AS INT) AS x_from, CAST(CASE WHEN NOT alike THEN x2 + 300 * j WHEN j = 0 THEN x1 + floor(CAST(la AS DOUBLE) / (la + lb + 1) * w) ELSE x2 END AS INT) AS x_to FROM v""")
def repaired_pages(spark, sf_dir):
    """Words of page trees after their repair, in reading order."""
    from quarry.operators import trees

    n = table(spark, sf_dir, "events").selectExpr(
        "user_id AS page", "event_id AS k", "CAST(if(user_id % 4 > 0, event_id % 2 * 520, 200) + CAST(floor(value) AS INT) % 40 AS INT) AS x1", "CAST(event_id * 7 % 900 AS INT) AS y1", "CAST(100 + event_id % 50 AS INT) AS w", "event_id % 3 > 0 AS alike", "event_type AS a"
    )
    word = lambda j, text: f"named_struct('id', concat('w', 2 * k + {j}), 'text', {text}, 'bbox', if(alike, array(x1, y1, x1 + w, y1 + 20), array(x1 + {300 * j}, y1, x1 + w + {300 * j}, y1 + 20)), 'confidence', 1, 'line_id', concat('l', k))"
    line = f"named_struct('k', k, 'line', named_struct('id', concat('l', k), 'bbox', array(x1, y1, x1 + w, y1 + 20), 'words', array({word(0, 'a')}, {word(1, 'concat(a, chr(101), chr(110))')})))"
    pages = n.groupBy("page").agg(F.array_sort(F.collect_list(F.expr(line))).alias("rows"))
    made = pages.select("page", F.lit(1000).alias("width"), F.array(F.struct(F.lit("b").alias("id"), F.array(*[F.lit(0)] * 4).alias("bbox"), F.transform("rows", lambda r: r["line"]).alias("lines"))).alias("blocks"))
    blocks = trees.repaired(made).select("page", F.explode("blocks").alias("b")).select("page", F.col("b.id").alias("block"), F.explode("b.lines").alias("l"))
    words = blocks.select("page", "block", F.col("l.id").alias("line"), F.explode("l.words").alias("w"))
    return words.select("page", "block", "line", F.col("w.id").alias("word"), "w.text", F.col("w.bbox")[0].alias("x_from"), F.col("w.bbox")[2].alias("x_to"))


@query("""WITH r AS (SELECT user_id AS page, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS text, floor(value * 8) / 8 AS x FROM events),
l AS (SELECT *, CASE WHEN i % 12 = 0 THEN 3 WHEN i % 4 = 1 THEN 4 ELSE 5 END AS level FROM r),
n AS (SELECT *, i // 12 AS b, count(*) FILTER (WHERE level = 4) OVER (PARTITION BY page ORDER BY k) AS li, count(*) FILTER (WHERE level = 5 AND text <> ' ') OVER (PARTITION BY page ORDER BY k) AS w FROM l)
SELECT page, printf('b_%03d', b) AS block, printf('l_%03d_%03d', b, li - b * 3 - 1) AS line, printf('w_%04d', w) AS word, text, CAST(round_even(x * 2, 0) AS INT) AS x_from FROM n WHERE level = 5 AND text <> ' '""")
def level_trees(spark, sf_dir):
    """Words of trees that level codes make up."""
    from quarry.operators import trees

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").withColumn("i", i).selectExpr("user_id AS page", "event_id AS order", "CASE WHEN i % 12 = 0 THEN 3 WHEN i % 4 = 1 THEN 4 ELSE 5 END AS level", "if(event_id % 4 = 0, ' ', event_type) AS text", "floor(value * 8) / 8 AS left", "1.0D AS top", "4.0D AS width", "2.0D AS height")
    heads = rows.select("page").distinct().selectExpr("page", "-1L AS order", "1 AS level", "'' AS text", "0.0D AS left", "0.0D AS top", "500.0D AS width", "700.0D AS height")
    images = heads.selectExpr("page", "1000 AS width", "1400 AS height")
    blocks = trees.from_levels(rows.unionByName(heads), images).select("page", F.explode("blocks").alias("b")).select("page", F.col("b.id").alias("block"), F.explode("b.lines").alias("l"))
    words = blocks.select("page", "block", F.col("l.id").alias("line"), F.explode("l.words").alias("w"))
    return words.select("page", "block", "line", F.col("w.id").alias("word"), "w.text", F.col("w.bbox")[0].alias("x_from"))


# ---------------------------------------------------------------- streets that repeat names

NAMED = "t AS (SELECT event_id, user_id, 'S' || CASE WHEN event_id % 3 = 0 THEN event_id % 40 ELSE event_id // 40 % 5 END AS street, CASE WHEN event_id % 5 = 0 THEN ' s' || CASE WHEN event_id % 3 = 0 THEN event_id % 40 ELSE event_id // 40 % 5 END ELSE 'N' || event_id END AS name, event_id % 40 AS number FROM events)"


@query(f"""WITH {NAMED}, o AS (SELECT *, lower(trim(name)) = lower(trim(street)) AND street <> 'S3' AS own FROM t), k AS (SELECT street FROM o WHERE NOT own GROUP BY street HAVING count(*) >= 30),
a AS (SELECT *, CASE WHEN NOT own AND street <> 'S3' AND street IN (SELECT street FROM k) THEN street END AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM o),
n AS (SELECT *, last_value(a IGNORE NULLS) OVER b AS p, first_value(a IGNORE NULLS) OVER f AS q, first_value(CASE WHEN a IS NOT NULL THEN i END IGNORE NULLS) OVER f - i AS d FROM a
WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)),
m AS (SELECT *, CASE WHEN p IS NOT NULL AND (q IS NULL OR lower(p) = lower(q)) THEN p WHEN p IS NULL AND d <= 5 THEN q END AS guess FROM n), g AS (SELECT *, CASE WHEN lower(trim(guess)) IS DISTINCT FROM lower(trim(name)) THEN guess END AS inferred FROM m)
SELECT event_id, CASE WHEN own THEN inferred ELSE street END AS street, CASE WHEN own THEN inferred || ' ' || number ELSE street || ' ' || number END AS address_full, CASE WHEN own THEN trim(name) || coalesce(' ' || inferred || ' ' || number, '') ELSE 'old' END AS searchable_text, CASE WHEN own THEN CASE WHEN inferred IS NULL THEN 'cleared' ELSE 'fixed' END END AS mended FROM g""")
def mended_own_names(spark, sf_dir):
    """Streets that repeat names get the street around them."""
    street = "concat('S', if(event_id % 3 = 0, event_id % 40, event_id div 40 % 5))"
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", f"{street} AS street", f"if(event_id % 5 = 0, lower(concat(' ', {street})), concat('N', event_id)) AS name", "CAST(event_id % 40 AS STRING) AS number", f"concat({street}, ' ', event_id % 40) AS address_full", "'old' AS searchable_text", "CAST(NULL AS STRING) AS expanded"
    )
    out = review.mend_own_names(rows, "user_id", ["event_id"], "name", "street", "expanded", "number", "address_full", ["name", "address_full"], ["S3"], 30)
    return out.select("event_id", "street", "address_full", "searchable_text", "mended")
