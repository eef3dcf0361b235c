"""Queries over entries, streets, reviews, placements, pages and jobs, each beside its SQL in DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import streets
from quarry.functions import text as T
from quarry.operators import cluster, flatten, jobs, linkage, pages, placement, review, search
from quarry.plans.queries import query, table

# ---------------------------------------------------------------- streets and displays

KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 \\-'']', ' ', 'g'), '\\s+', ' ', 'g'))"
TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"


@query(f"SELECT p_partkey, {TITLE.format('lower(p_type)')} AS title, {TITLE.format(KEY.format('p_name'))} AS name_title FROM part")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", streets.titled(F.col("p_type")).alias("title"), streets.titled(T.street_key(F.col("p_name"))).alias("name_title"))


SPECIAL = streets.combined_keys((("small", "smal"), ("ring", "rings", "rod"), ("", "nz")), "Small Market")
NAMES = {"red ring": "Roode Ring", "blue rod": "Blauwe Bak"}
PARTS = """SELECT p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN ' N.Z.' ELSE '' END AS street, CASE WHEN p_size % 2 = 0 THEN p_name || CASE WHEN p_size % 3 = 0 THEN ' N.Z.' ELSE '' END END AS expanded,
CAST(p_size AS VARCHAR) AS number, CASE WHEN p_size % 5 > 0 THEN p_name || ' old' END AS full_, p_name FROM part"""


def _parts(spark, sf_dir):
    street = F.expr("concat(p_name, if(p_size % 3 = 0, ' N.Z.', ''))")
    return table(spark, sf_dir, "part").select(
        "p_partkey", street.alias("address_street"), F.when(F.expr("p_size % 2 = 0"), street).alias("address_street_expanded"),
        F.col("p_size").cast("string").alias("address_number"), F.when(F.expr("p_size % 5 > 0"), F.concat("p_name", F.lit(" old"))).alias("address_full"),
    )


@query(f"""WITH p AS ({PARTS}), k AS (SELECT *, p_name IN ('small ring', 'small rod') AS special, CASE WHEN p_name IN ('small ring', 'small rod') THEN 'Small Market' WHEN p_name = 'red ring' THEN 'Roode Ring' WHEN p_name = 'blue rod' THEN 'Blauwe Bak'
WHEN street <> p_name THEN {TITLE.format("p_name")} ELSE street END AS new FROM p), h AS (SELECT *, new <> street OR special AS hit FROM k)
SELECT p_partkey, CASE WHEN hit THEN new ELSE street END AS address_street, CASE WHEN hit AND expanded IS NOT NULL THEN new ELSE expanded END AS address_street_expanded,
CASE WHEN hit AND (NOT special OR full_ IS NULL) THEN new || ' ' || number ELSE full_ END AS address_full FROM h""")
def correct_addresses(spark, sf_dir):
    out = streets.correct_addresses(_parts(spark, sf_dir), NAMES, SPECIAL, ["n z"])
    return out.select("p_partkey", "address_street", "address_street_expanded", "address_full")


@query("SELECT p_partkey, replace(replace(replace(lower(trim(p_name)) || ' ' || p_size, 'ring', 'ringweg'), 'red ', 'roode '), 'roode ringweg', 'rw') AS query FROM part")
def geocode_queries(spark, sf_dir):
    told = F.concat_ws(" ", F.concat(F.lit("N. "), "p_name"), F.lit("z.z. n.z."), F.col("p_size").cast("string"))
    out = streets.geocode_query(told, [r"z\.z\.", r"n\.z\."], [("ring", "ringweg"), ("red ", "roode "), ("roode ringweg", "rw")], [(r"^n\.\s*", "")])
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("query"))


@query("""WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_name = 'red ring' THEN 'Rode ring' WHEN p_name LIKE 'small %' THEN 'Kleine' || p_name[6:] ELSE p_name END AS a FROM part),
s AS (SELECT *, replace(upper(a[1]) || a[2:], 'ing', 'yng') AS b FROM t) SELECT p_partkey, nullif(CASE WHEN b = 'Kleine rod' THEN 'Doosje' ELSE b END, p_name) AS renamed FROM s""")
def rename_streets(spark, sf_dir):
    held = spark.createDataFrame([("red ring", "Rode ring"), ("red", "Nooit"), ("small", "Kleine"), ("Kleine rod", "Doosje")], "old string, new string").where("old <> 'red'")
    return streets.rename_streets(table(spark, sf_dir, "part"), "p_name", held, [("ing", "yng")], "renamed").select("p_partkey", "renamed")


@query("""WITH k AS (SELECT DISTINCT regexp_replace(p_name, '[^a-z]', '', 'g') || CASE WHEN p_size % 9 = 0 THEN 's' WHEN p_size % 9 = 1 THEN 'z' ELSE '' END AS n FROM part) SELECT a.n AS a, b.n AS b FROM k a JOIN k b ON a.n = b.n OR (length(a.n) >= 6 AND length(b.n) >= 6 AND levenshtein(a.n, b.n) <= 1)""")
def same_names(spark, sf_dir):
    """Pairs of names that are the same, found by what is left without one letter."""
    name = F.concat(streets.street_letters(F.col("p_name")), F.expr("CASE p_size % 9 WHEN 0 THEN 's' WHEN 1 THEN 'z' ELSE '' END"))
    k = table(spark, sf_dir, "part").select(name.alias("a")).distinct()
    return linkage.similar_names(k, k.withColumnRenamed("a", "b"), "a", "b")


@query("""SELECT c_custkey, CAST(c_custkey % 50 AS INTEGER) AS ward_number, 'W ' || (c_custkey % 50) || 'a' AS plain, lower(regexp_extract(c_mktsegment, '[A-Za-z]')) AS initial, lower(c_mktsegment) AS surname FROM customer""")
def ward_numbers(spark, sf_dir):
    told = F.concat(F.expr("(c_custkey % 50)"), F.lit("a"))
    again = F.concat(F.lit("C C W "), told)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", streets.ward_number(told).alias("ward_number"), streets.strip_ward(streets.strip_ward(again, "C"), "C").alias("plain"),
        streets.initial(F.concat(F.lit("1. "), "c_mktsegment")).alias("initial"), streets.surname(F.concat(F.lit("van der "), "c_mktsegment", F.lit(", jr."))).alias("surname"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL WHEN p_name = 'red ring' AND p_size BETWEEN 4 AND 36 THEN CAST(2 * p_size - 3 AS VARCHAR) WHEN p_name = 'small rod' AND p_size BETWEEN 1 AND 28 THEN CAST(2 * p_size + 1 AS VARCHAR) END AS today FROM part""")
def quay_numbers(spark, sf_dir):
    number = F.concat(F.col("p_size").cast("string"), F.expr("CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN '' ELSE '/2' END"))
    sides = {("red ring", "north"): (-3, 4, 36), ("small rod", "north"): (1, 1, 28)}
    return table(spark, sf_dir, "part").select("p_partkey", streets.quay_number(F.col("p_name"), F.lit("north"), number, sides).alias("today"))


@query("""SELECT c_custkey, coalesce(nullif(concat_ws(' ', nullif(CASE WHEN c_custkey % 7 > 0 THEN c_name END, ''), CASE WHEN c_custkey % 7 > 1 THEN left(c_mktsegment, 1) || '.' END), ''), '-') AS title, concat_ws(' · ', nullif(c_mktsegment, 'BUILDING'), 'Street ' || c_nationkey) AS line,
CASE WHEN c_custkey % 3 = 0 THEN 'Street ' || (c_custkey % 5) WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 5 AS VARCHAR) ELSE 'Street ' || (c_custkey % 5) END AS address FROM customer""")
def entry_displays(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    number = F.expr("CAST(c_custkey % 5 AS STRING)")
    street = F.when(F.expr("c_custkey % 3 = 0"), F.lit("Street")).when(F.expr("c_custkey % 3 = 1"), number).otherwise(F.concat(F.lit("Street "), number))
    title = streets.entry_name(F.when(F.expr("c_custkey % 7 > 0"), F.col("c_name")), F.when(F.expr("c_custkey % 7 > 1"), F.concat(F.left("c_mktsegment", F.lit(1)), F.lit("."))), F.lit(""))
    line = streets.mention_line(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")), F.concat(F.lit("Street "), F.col("c_nationkey").cast("string")), F.lit(" "))
    return c.select("c_custkey", title.alias("title"), line.alias("line"), T.build_address(street, number).alias("address"))


@query("SELECT p_partkey, p_size || ',2 ' || (p_size + 5) || ',2 ' || (p_size + 5) || ',9 ' || p_size || ',9' AS points, 5 AS width, 7 AS height, round(sqrt(power(p_size * 2.0, 2) + power(3.0 * p_size, 2)), 6) AS metres FROM part")
def box_shapes(spark, sf_dir):
    box = F.array(F.col("p_size"), F.lit(2), F.col("p_size") + 5, F.lit(9))
    here, origin = streets.planar(F.col("p_size").cast("double"), F.col("p_size").cast("double"), 2.0, 3.0), streets.planar(F.lit(0.0), F.lit(0.0), 2.0, 3.0)
    out = table(spark, sf_dir, "part").select("p_partkey", streets.box_points(box).alias("points"), streets.box_size(box).alias("s"), F.round(streets.distance(here, origin), 6).alias("metres"))
    return out.select("p_partkey", "points", "s.width", "s.height", "metres")


@query("""WITH e AS (SELECT d.doc_id, lang, source, CASE lang WHEN 'es' THEN 'advertisement' WHEN 'fr' THEN 'other' WHEN 'de' THEN 'institutional' ELSE 'name_register' END AS section, toxic, quality, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
k AS (SELECT *, CASE WHEN section = 'advertisement' THEN 'advertisement' WHEN section = 'other' THEN 'text' WHEN toxic = 1 THEN 'organization' WHEN quality = 1 THEN CASE WHEN section = 'institutional' THEN 'institutional' ELSE 'person' END WHEN section = 'institutional' THEN CASE WHEN quality = 0 THEN 'institutional' ELSE 'organization' END ELSE 'person' END AS kind,
'smith' AS occ, CASE WHEN n_chars % 2 = 0 THEN 'about' ELSE '' END AS about, CASE WHEN quality = 0 THEN 'chair' ELSE '' END AS role, CASE WHEN n_chars % 3 = 0 THEN source ELSE '' END AS parent, CASE WHEN n_chars % 5 = 0 THEN 'Street 1' ELSE '' END AS adr, CASE WHEN n_chars % 7 = 0 THEN 'gone' WHEN n_chars % 7 = 1 THEN 'New 2' ELSE '' END AS mod FROM e),
m AS (SELECT *, concat_ws(' · ', nullif(adr, ''), CASE WHEN mod = 'gone' THEN 'no longer there' WHEN mod <> '' THEN 'now ' || mod END) AS address FROM k)
SELECT doc_id, kind, 'N ' || doc_id AS title, CASE WHEN kind = 'organization' THEN coalesce(nullif(about, ''), occ) WHEN kind = 'institutional' THEN concat_ws(' / ', nullif(role, ''), nullif(parent, '')) WHEN kind IN ('advertisement', 'text') THEN coalesce(nullif(about, ''), occ) ELSE occ END AS subtitle,
CASE WHEN kind = 'institutional' THEN coalesce(nullif(role, ''), nullif(parent, ''), nullif(about, ''), '-') WHEN kind = 'person' THEN occ ELSE coalesce(nullif(about, ''), occ) END AS detail,
CASE WHEN kind IN ('advertisement', 'text') THEN kind WHEN kind = 'institutional' OR (kind = 'organization' AND section = 'institutional') THEN 'institution' WHEN kind = 'organization' THEN 'organization' END AS badge, address, kind NOT IN ('institutional', 'text') OR address <> '' AS on_map FROM m""")
def present_entries(spark, sf_dir):
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    rows = d.join(marks, F.col("doc_id") == F.col("_id"), "left").selectExpr(
        "doc_id", "CASE lang WHEN 'es' THEN 'advertisement' WHEN 'fr' THEN 'other' WHEN 'de' THEN 'institutional' ELSE 'name_register' END AS section",
        "CASE WHEN toxic = 1 THEN 'organization' WHEN quality = 1 THEN 'person' END AS entity_type", "concat('N ', doc_id) AS name", "'' AS initials", "CAST(NULL AS STRING) AS name_prefix",
        "'smith' AS occupation", "'' AS occupation_expanded", "if(n_chars % 2 = 0, 'about', NULL) AS description", "'' AS notes", "if(quality = 0, 'chair', NULL) AS role", "if(n_chars % 3 = 0, source, NULL) AS parent_organization",
        "if(n_chars % 5 = 0, 'Street 1', NULL) AS address_full", "CASE WHEN n_chars % 7 = 0 THEN 'gone' WHEN n_chars % 7 = 1 THEN 'New 2' END AS address_modern",
    )
    kind = flatten.entry_kind(F.col("section"), F.col("entity_type"), F.col("role"), F.col("name"))
    return flatten.presented(rows, kind, "now", "gone", "no longer there").select("doc_id", "kind", "title", "subtitle", "detail", "badge", "address", "on_map")


# ---------------------------------------------------------------- review and corrections


@query("""SELECT c_custkey, CASE WHEN o IS NULL THEN c_name ELSE 'db ' || o END AS c_name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN o IS NOT NULL THEN 'held' END) AS c_mktsegment, CASE WHEN o IS NULL THEN true ELSE o % 2 = 1 END AS verified FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def overlay_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.expr("c_custkey % 2 = 0"), F.col("c_mktsegment")).alias("c_mktsegment"), F.lit(True).alias("verified"))
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o"))
    held = held.select("c_custkey", F.concat(F.lit("db "), F.col("o").cast("string")).alias("c_name"), F.lit("held").alias("c_mktsegment"), F.expr("o % 2").alias("verified"))
    return review.overlay(rows, held, "c_custkey", ["c_name"], ["c_mktsegment"], ["verified"])


@query("""SELECT event_id, concat_ws(',', 'event=' || event_type, CASE WHEN user_id % 3 = 0 THEN 'kind=' || CASE user_id % 2 WHEN 0 THEN 'person' ELSE '' END END) AS fields, CASE WHEN value < 50 AND floor(value + 0.5) > 10 THEN '10,20,' || CAST(floor(value + 0.5) AS INTEGER) || ',30' END AS box FROM events""")
def sanitize_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.expr("CASE WHEN user_id % 3 = 0 THEN CASE user_id % 2 WHEN 0 THEN 'person' ELSE '' END ELSE 'robot' END")
    fields = F.create_map(F.lit("event"), F.col("event_type"), F.lit("kind"), kind, F.lit("admin"), F.lit("yes"))
    told = F.array_join(F.transform(F.map_entries(review.sanitized(fields, ["event", "kind"], {"kind": ["person", "organization"]})), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    box = review.sane_box(F.array(F.lit(10.2), F.lit(19.6), F.when(F.col("value") < 50, F.col("value")).otherwise(F.lit(float("nan"))), F.lit(30.0)))
    return e.select("event_id", told.alias("fields"), F.array_join(F.transform(box, lambda x: x.cast("string")), ",").alias("box"))


@query("SELECT page_id FROM pages WHERE page_id BETWEEN 20 AND 60 UNION ALL SELECT page_id FROM pages WHERE page_id >= 100")
def page_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id")
    return review.page_slice(rows, "page_id", "20-60").unionByName(review.page_slice(rows, "page_id", "100-"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars > 3000 OR toxic = 1 OR quality = 0")
def edited_or_flagged(spark, sf_dir):
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    rows = d.join(marks, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.when(F.col("n_chars") > 3000, "2024-01-01").alias("edited_at"), "toxic", (F.col("quality") == 0).alias("poor"))
    return review.touched(rows, "edited_at", ["toxic", "poor"]).select("doc_id")


@query("""SELECT p_partkey, CASE WHEN p_name IN ('red ring', 'hot ring') THEN NULL WHEN p_name LIKE 'small %' AND p_name NOT LIKE '%ring' THEN 'place_outside' WHEN p_name LIKE '%rod' THEN 'multi_address' WHEN p_name LIKE 'cold%' AND p_name NOT LIKE '%ring' THEN 'caps_noise' WHEN p_name LIKE '%bolt%' THEN 'entity_name' END AS class FROM part""")
def non_street_classes(spark, sf_dir):
    name = F.col("p_name")
    told = F.when(name.startswith("cold"), F.upper(name)).when(name.endswith("rod") & ~name.startswith("small "), F.concat(name, F.lit(", hoek"))).otherwise(name)
    told = F.when(name.startswith("cold") & name.endswith("rod"), F.concat(F.upper(name), F.lit(", HOEK"))).otherwise(told)
    canonical = name.isin("red ring", "hot ring")
    return table(spark, sf_dir, "part").select("p_partkey", review.doubtful_class(told, canonical, ["small"], [" en ", ", hoek"], ["bolt"], ["ring"]).alias("class"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_mktsegment <> 'BUILDING' THEN NULL ELSE c_mktsegment END AS street FROM customer")
def fix_own_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("street"), F.when(F.expr("c_custkey % 4 = 0"), F.concat(F.lit(" "), F.lower("c_mktsegment"))).alias("name"))
    return c.select("c_custkey", F.when(~review.is_own_name(F.col("name"), F.col("street"), ["building"]), F.col("street")).alias("street"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'anv') OR contains(lower(p_type), 'anv')")
def contains_text(spark, sf_dir):
    return review.contains(table(spark, sf_dir, "part"), ["p_name", "p_type"], "ANV").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' AND o_orderkey % 3 = 1")
def rejected_reviews(spark, sf_dir):
    verdict = F.when(F.col("o_orderpriority").rlike("^[12]"), F.lit("stale no")).when(F.expr("o_orderkey % 3 = 1"), " No ").when(F.expr("o_orderkey % 3 = 2"), "y")
    return review.rejected_streets(table(spark, sf_dir, "orders").withColumn("verdict", verdict), "verdict").select("o_orderkey", "o_orderpriority")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS street, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment || ' ' || c_nationkey END AS full_address,
CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN concat_ws('; ', CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'street: ' || c_mktsegment) ELSE CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END END AS notes FROM customer""")
def apply_reviewed_streets(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment AS street", "'' AS expanded", "CAST(c_nationkey AS STRING) AS number", "concat(c_mktsegment, ' ', c_nationkey) AS full_address", "if(c_custkey % 2 = 0, c_name, '') AS notes")
    decisions = spark.createDataFrame([("BUILDING", " N "), ("MACHINERY", "no"), ("HOUSEHOLD", "y"), ("AUTOMOBILE", "")], "value string, decision string")
    return review.apply_review(rows, decisions, "street", "expanded", "number", "full_address", "notes").select("c_custkey", "street", "full_address", "notes")


EDITED = "c_custkey % 3 = 0 AND c_custkey % 2 = 0"


@query(f"""WITH e AS (SELECT *, {EDITED} AS hit, CASE WHEN {EDITED} THEN CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'Quay' END ELSE c_mktsegment END AS st FROM customer), m AS (SELECT *, hit AND st IS DISTINCT FROM c_mktsegment AS moved FROM e)
SELECT c_custkey, st AS address_street, CASE WHEN hit THEN 't1' ELSE 't0' END AS edited_at, CASE WHEN moved THEN CASE WHEN st = 'Quay' AND c_nationkey < 10 THEN CAST(c_nationkey AS DOUBLE) END ELSE CAST(99 AS DOUBLE) END AS lat, CASE WHEN hit THEN concat_ws(' ', c_name, st, c_nationkey) ELSE 'old' END AS searchable_text FROM m""")
def patch_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment AS address_street", "CAST(c_nationkey AS STRING) AS address_number", "99.0D AS lat", "99.0D AS lng", "'t0' AS edited_at", "'old' AS searchable_text")
    edits = rows.where("c_custkey % 3 = 0").select("c_custkey", F.create_map(F.lit("address_street"), F.expr("if(c_custkey % 9 = 0, NULL, 'Quay')")).alias("fields"), F.lit("t1").alias("edited_at"), F.expr("if(c_custkey % 2 = 0, 't0', 'other')").alias("base"))
    places = spark.range(10).selectExpr("concat('quay ', id) AS address", "CAST(id AS DOUBLE) AS lat", "CAST(id AS DOUBLE) AS lng")
    out = review.patch_entries(rows, edits, places, "c_custkey", ["address_street", "address_number"], ["c_name", "address_street", "address_number"])
    return out.select("c_custkey", "address_street", "edited_at", "lat", "searchable_text")


@query("SELECT s_suppkey, CAST(s_nationkey * 11 AS VARCHAR) AS number, 'address_number=' || s_nationkey * 11 || ',verified=true,needs_review=false' AS payload FROM supplier WHERE s_nationkey >= 10 AND s_acctbal >= 0 AND s_suppkey % 2 = 1")
def number_corrections(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumns({"number": F.expr("CAST(s_nationkey * 11 AS STRING)"), "street": F.col("s_name"), "box": F.expr("array(1, 2, 3, 4)")})
    queue = review.suspicious_numbers(rows, "number", F.col("s_acctbal") < 0, F.expr("s_suppkey % 2 = 0"), present=["box", "street"])
    p = review.number_correction(F.col("s_suppkey"), F.col("number"))
    told = F.concat_ws(",", F.concat(F.lit("address_number="), p["fields"]["address_number"]), F.concat(F.lit("verified="), p["flags"]["verified"].cast("string")), F.concat(F.lit("needs_review="), p["flags"]["needs_review"].cast("string")))
    return queue.select("s_suppkey", "number", told.alias("payload"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def drop_overrides(spark, sf_dir):
    deleted = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return review.drop_overrides(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), deleted, "c_custkey")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey ELSE o_custkey END AS id, 'seg' || (o_orderkey % 40) AS mark FROM orders), f AS (SELECT EXISTS (SELECT 1 FROM customer WHERE c_custkey = id) AS here, mark IN (SELECT 'seg' || c_nationkey FROM customer) AS there FROM o)
SELECT count(*) FILTER (WHERE here) AS applied, count(*) FILTER (WHERE NOT here AND there) AS fell_back, count(*) FILTER (WHERE NOT here AND NOT there) AS missing FROM f""")
def override_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("if(o_orderkey % 4 = 0, -o_orderkey, o_custkey) AS id", "concat('seg', o_orderkey % 40) AS mark")
    return review.override_report(o, table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat('seg', c_nationkey) AS mark"), "id", "mark")


@query("SELECT p_brand, max_by(p_name, length(p_name) * 1000000 - p_partkey) AS p_name, count(*) AS entry_count FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7) GROUP BY p_brand")
def refresh_clusters(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return review.refresh_clusters(part, part.where("p_size = 7"), "p_brand", "p_partkey", ["p_name"])


@query("""WITH a AS (SELECT s_suppkey AS ask_id, 'n' || (s_suppkey % 90) AS name, s_nationkey AS ini, s_suppkey % 5 AS seg FROM supplier), p AS (SELECT c_custkey AS person_id, 'n' || (c_custkey % 90) AS name, c_nationkey AS ini, c_custkey % 5 AS seg FROM customer)
SELECT ask_id, min(person_id) AS person_id FROM a JOIN p ON (a.name = p.name AND a.seg = p.seg) OR (a.ini = p.ini AND a.seg = p.seg) GROUP BY ask_id""")
def candidate_persons(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS ask_id", "concat('n', s_suppkey % 90) AS name", "s_nationkey AS ini", "s_suppkey % 5 AS seg")
    persons = table(spark, sf_dir, "customer").selectExpr("c_custkey AS person_id", "concat('n', c_custkey % 90) AS name", "c_nationkey AS ini", "c_custkey % 5 AS seg")
    return review.candidate_persons(asked, persons, [["name", "seg"], ["ini", "seg"]])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN c_custkey * 1.5 ELSE c_acctbal END AS c_acctbal FROM customer")
def guarded_update(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal", "'2024-01-01T00:00:00Z' AS edited_at")
    late = rows.where("c_custkey % 2 = 0").selectExpr("c_custkey", "c_custkey * 1.5D AS c_acctbal", "if(c_custkey % 3 = 0, '2023-12-31T00:00:00Z', '2024-01-01T00:00:00.000Z') AS edited_at")
    return review.guarded_update(rows, late, "c_custkey", "edited_at", ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'modern ' || s_suppkey ELSE s_name END AS s_name FROM supplier")
def write_modern(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    some = s.where("s_suppkey % 4 < 2").select("s_suppkey", F.when(F.expr("s_suppkey % 4 = 1"), F.concat(F.lit("modern "), F.col("s_suppkey").cast("string"))).alias("s_name"))
    return review.set_field(s, some, "s_suppkey", "s_name")


@query("SELECT n_nationkey, n_name, count(*) AS entry_count FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 3 > 0 AND n_nationkey % 4 > 0 GROUP BY ALL")
def recount_links(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.expr("c_nationkey % 4 > 0"), F.col("c_nationkey")).alias("n_nationkey"))
    left = review.unlink(c, c.where("c_custkey % 3 = 0"), "c_custkey", "n_nationkey")
    return review.recount_links(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(0).alias("entry_count")), left, "n_nationkey")


@query("SELECT page, verified FROM (SELECT source AS page, count(*) FILTER (WHERE quality = 1) AS verified, count(*) FILTER (WHERE toxic = 1) AS needs_review FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1) WHERE verified > 0 OR needs_review > 0")
def dashboard_pages(spark, sf_dir):
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    rows = d.join(marks, F.col("doc_id") == F.col("_id"), "left").groupBy(F.col("source").alias("page")).agg(F.count_if(F.col("quality") == 1).alias("verified"), F.count_if(F.col("toxic") == 1).alias("needs_review"))
    return review.touched(rows.withColumn("edited_at", F.lit(None)), "edited_at", ["verified", "needs_review"]).select("page", "verified")


# ---------------------------------------------------------------- placement

POINTS = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings"


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))


@query(f"""WITH e AS ({POINTS}), m AS (SELECT a.vec_id, b.vec_id AS place_id, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS d FROM e a JOIN e b ON a.vec_id % 3 <> 0 AND b.vec_id % 3 = 0)
SELECT vec_id, place_id, round(d, 6) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, place_id) AS r FROM m WHERE d <= 3) WHERE r = 1""")
def snap_places(spark, sf_dir):
    e = _points(spark, sf_dir)
    out = placement.snap(e.where("vec_id % 3 <> 0"), e.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "place_id"), "vec_id", "place_id", 3.0)
    return out.withColumn("metres", F.round("metres", 6))


@query(f"WITH e AS ({POINTS}) SELECT a.vec_id, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id AND b.vec_id % 3 = 0 AND sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) <= 3 GROUP BY 1")
def places_near(spark, sf_dir):
    e = _points(spark, sf_dir)
    met = placement.places_within(e, e.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "place_id"), "vec_id", "place_id", 3.0)
    return met.where("vec_id <> place_id").groupBy("vec_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_type IS NULL OR NOT regexp_matches(p_type, '(?i)^(eco|prom)')")
def premises(spark, sf_dir):
    return placement.premises(table(spark, sf_dir, "part"), "p_type", "(?i)^(eco|prom)").select("p_partkey")


@query("""WITH h AS (SELECT DISTINCT p_brand AS owner, p_name AS street, p_size AS place_id FROM part), f AS (SELECT owner FROM h GROUP BY owner HAVING count(DISTINCT place_id) <= 50), o AS (SELECT owner, street, min(place_id) AS place_id FROM h WHERE owner IN (SELECT owner FROM f) GROUP BY 1, 2 HAVING count(*) = 1)
SELECT s_suppkey, CAST(place_id AS INTEGER) AS place_id FROM (SELECT s_suppkey, 'Brand#' || (s_suppkey % 50) AS owner FROM supplier) s JOIN o ON o.owner = s.owner""")
def unique_owners(spark, sf_dir):
    owners = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("street"), F.col("p_size").alias("place"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.expr("s_suppkey % 50").cast("string")).alias("owner"))
    rows = rows.join(owners.select("owner", "street").distinct(), "owner")  # every street of the owner's
    return placement.unique_owner(rows, owners, ["owner"], "place", "s_suppkey", 50)


@query("""WITH r AS (SELECT c_custkey, c_custkey % 397 AS who, 'zand ' || CASE c_custkey % 3 WHEN 0 THEN 'weg' WHEN 1 THEN 'weg' ELSE 'qqqqq' END AS street, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 END AS place FROM customer),
k AS (SELECT DISTINCT who, street, place FROM r WHERE place IS NOT NULL) SELECT c_custkey, min(k.place)::BIGINT AS place_id FROM r JOIN k ON k.who = r.who AND k.street = r.street WHERE r.place IS NULL GROUP BY c_custkey HAVING count(DISTINCT k.place) = 1""")
def same_person(spark, sf_dir):
    r = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 397 AS who", "concat('zand ', if(c_custkey % 3 < 2, 'weg', 'qqqqq')) AS street")
    placed = r.where("c_custkey % 5 = 0").selectExpr("c_custkey", "c_custkey % 4 AS place_id")
    return placement.same_person_elsewhere(r, placed, "c_custkey", ["who"], "street")


@query("""WITH t AS (SELECT p_type AS ward, p_size AS n, min({'street': p_name, 'house': p_size % 7, 'x': p_retailprice, 'y': p_size * 1.0}) AS v FROM part GROUP BY 1, 2),
g AS (SELECT a.v.street AS street, sqrt(power(a.v.x - b.v.x, 2) + power(a.v.y - b.v.y, 2)) AS gap FROM t a JOIN t b ON a.ward = b.ward AND b.n = a.n + 1 AND a.v.street = b.v.street AND abs(a.v.house - b.v.house) = 1)
SELECT street, round(list_sort(list(gap))[count(*) // 2 + 1], 6) AS median FROM g GROUP BY street HAVING count(*) >= 2 AND list_sort(list(gap))[count(*) // 2 + 1] > 30""")
def renumbered_streets(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_type AS ward", "p_size AS n", "p_name AS street", "p_size % 7 AS house", "p_retailprice AS x", "p_size * 1.0D AS y")
    return placement.renumbered_streets(rows, "ward", "n").withColumn("median", F.round("median", 6))


@query("""WITH t AS (SELECT event_id, user_id, event_type, event_id % 6 AS number, CASE WHEN event_id % 3 = 0 THEN user_id END AS place, value AS x, value * 2 AS y FROM events), k AS (SELECT *, CASE WHEN place IS NOT NULL THEN {'n': number, 'x': x, 'y': y} END AS k FROM t),
n AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(k IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM k)
SELECT event_id, CASE WHEN place IS NULL THEN CASE WHEN p.n = number THEN 'same_number' WHEN q.n = number THEN 'same_number' WHEN sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) <= 60 THEN 'between' END END AS rule,
round(CASE WHEN place IS NULL THEN CASE WHEN p.n = number THEN p.x WHEN q.n = number THEN q.x WHEN sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) <= 60 THEN (p.x + q.x) / 2 END END, 6) AS fx FROM n""")
def between_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "event_id % 6 AS number", "if(event_id % 3 = 0, user_id, NULL) AS place", "value AS x", "value * 2 AS y")
    return placement.neighbours_agree(rows, ["user_id"], ["event_id"], "event_type", "place", 60.0).select("event_id", "rule", F.round("fx", 6).alias("fx"))


@query("""WITH c AS (SELECT user_id, event_type AS ballot, count(*) AS votes, min(event_id) AS low, max(event_id) AS high FROM events GROUP BY 1, 2), w AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS cast_, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, ballot) AS r FROM c),
v AS (SELECT * FROM w WHERE r = 1 AND votes >= 3 AND votes >= 0.25 * cast_) SELECT user_id, ballot, count(*) AS inside FROM v JOIN events USING (user_id) WHERE event_id > low AND event_id < high GROUP BY 1, 2""")
def vote_inside_range(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("ballot"))
    won = placement.vote_inside(e, ["user_id"], "ballot", "event_id", 3, 0.25)
    return placement.inside_range(e.select("user_id", "event_id"), won, ["user_id"], "event_id").groupBy("user_id", "ballot").agg(F.count("*").alias("inside"))


@query("""WITH h AS (SELECT p_brand AS b, p_name AS street, CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 4 AS VARCHAR) END AS number FROM part WHERE p_size <= 30 AND p_size + 15 > 20), g AS (SELECT b, list_sort(list_distinct(list(street))) AS s, list_sort(list_distinct(list(number) FILTER (WHERE number IS NOT NULL))) AS n FROM h GROUP BY b)
SELECT b AS p_brand, CASE WHEN coalesce(len(n), 0) = 1 THEN 'house' WHEN len(n) > 1 THEN 'ambiguous' ELSE 'street_only' END AS status, array_to_string(s, ' / ') AS streets, coalesce(array_to_string(n, ' / '), '') AS numbers FROM g""")
def placed_status(spark, sf_dir):
    hits = table(spark, sf_dir, "part").selectExpr("p_brand", "p_name AS street", "if(p_size % 3 > 0, CAST(p_size % 4 AS STRING), NULL) AS number", "if(p_size <= 30, p_size - 10, 99) AS `from`", "p_size + 15 AS until")
    return placement.placed_status(hits, "p_brand", "street", "number", F.lit(20))


@query("SELECT l_suppkey, l_returnflag AS letter, min(l_partkey) AS place FROM lineitem l WHERE l_returnflag = (SELECT min(CASE WHEN m.l_returnflag = 'N' THEN '' ELSE m.l_returnflag END) FROM lineitem m WHERE m.l_suppkey = l.l_suppkey) OR (l_returnflag = 'N' AND EXISTS (SELECT 1 FROM lineitem m WHERE m.l_suppkey = l.l_suppkey AND m.l_returnflag = 'N')) GROUP BY 1, 2")
def exact_letter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.lit("N").alias("wanted"), F.col("l_partkey").alias("place"))
    return placement.exact_letter_first(rows, "l_suppkey", "l_returnflag", "wanted", "place")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN value > 20 THEN 'adres' END WHEN user_id % 2 = 0 THEN 'approx' END AS kind FROM events")
def geocode_precedence(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", placement.geocode_kind(F.when(F.col("value") > 20, "adres"), F.col("event_type") == "click", F.expr("user_id % 2 = 0")).alias("kind"))


MATCHED = "SELECT c_nationkey AS pand_id, c_mktsegment AS address, c_acctbal AS lat, c_acctbal / 2 AS lng, c_custkey AS stable_id, c_custkey % 5 = 0 AS approx FROM customer"


def _matches(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_nationkey AS pand_id", "c_mktsegment AS address", "c_acctbal AS lat", "c_acctbal / 2 AS lng", "c_custkey AS stable_id", "c_custkey % 5 = 0 AS approx")


@query(f"WITH m AS ({MATCHED}) SELECT pand_id, address, min_by(lat, stable_id) AS lat, string_agg(CAST(stable_id AS VARCHAR), ',' ORDER BY stable_id) AS entries FROM m GROUP BY 1, 2")
def place_groups(spark, sf_dir):
    out = placement.place_groups(_matches(spark, sf_dir))
    return out.select("pand_id", "address", "lat", F.array_join(F.transform("entries", lambda x: x.cast("string")), ",").alias("entries"))


@query(f"WITH m AS ({MATCHED}) SELECT count(DISTINCT pand_id) AS places, count(DISTINCT (pand_id, address)) AS addresses, count(DISTINCT stable_id) AS entries, count(*) FILTER (WHERE approx) AS approx FROM m")
def match_summary(spark, sf_dir):
    return jobs.match_summary(_matches(spark, sf_dir))


@query(f"""WITH m AS ({MATCHED}) SELECT pand_id, '{{"entries":[' || string_agg(CAST(stable_id AS VARCHAR), ',' ORDER BY stable_id) || '],"n_name":"' || n_name || '"}}' AS payload FROM m JOIN nation ON n_nationkey = pand_id GROUP BY pand_id, n_name""")
def link_payload(spark, sf_dir):
    return jobs.link_payload(_matches(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pand_id"), "n_name"))


@query("SELECT n_nationkey, n_name, count(*) AS entry_count FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY ALL")
def with_entries(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("n_nationkey"))
    return placement.with_entries(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), s, "n_nationkey")


@query("""WITH p AS (SELECT c_nationkey AS n_nationkey, c_custkey % 4 AS cl, CASE WHEN c_custkey % 4 < 3 THEN 'C' || (c_custkey % 4 % 2) END AS canonical, min(c_name) AS name, string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY c_custkey) AS m FROM customer GROUP BY 1, 2, 3)
SELECT n_nationkey, n_name, string_agg(coalesce(canonical, '?') || '=' || m, ';' ORDER BY canonical NULLS FIRST, name, cl) AS persons FROM p JOIN nation USING (n_nationkey) GROUP BY ALL""")
def building_detail(spark, sf_dir):
    e = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS n_nationkey", "c_custkey % 4 AS cl", "if(c_custkey % 4 < 3, concat('C', c_custkey % 4 % 2), NULL) AS canonical", "c_name", "c_custkey", "c_mktsegment")
    out = placement.building_detail(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), e, "n_nationkey", "cl", "c_name", "canonical", "c_custkey", ["c_mktsegment"])
    told = F.transform("persons", lambda p: F.concat(F.coalesce(p["canonical_name"], F.lit("?")), F.lit("="), F.array_join(F.transform(p["mentions"], lambda m: F.concat_ws(":", m["c_custkey"].cast("string"), m["c_mktsegment"])), ",")))
    return out.select("n_nationkey", "n_name", F.array_join(told, ";").alias("persons"))


# ---------------------------------------------------------------- pages and words

WORDS = "SELECT doc_id AS page, unnest(list_distinct(list_transform(string_split(source, 'c'), lambda x: 'w_' || lpad(nullif(regexp_replace(x, '[^0-9]', '', 'g'), ''), 4, '0')))) AS id FROM documents"


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'w_' || lpad(CAST(doc_id AS VARCHAR), 4, '0') WHEN 1 THEN 'w_0007,w_' || lpad(CAST(doc_id AS VARCHAR), 4, '0') WHEN 2 THEN 'w_0001,w_0002,w_0003' WHEN 3 THEN 'w_9' ELSE '' END AS ids FROM documents WHERE doc_id < 10000
UNION ALL SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'w_' || doc_id WHEN 1 THEN 'w_0007,w_' || doc_id WHEN 2 THEN 'w_0001,w_0002,w_0003' WHEN 3 THEN 'w_9' ELSE '' END FROM documents WHERE doc_id >= 10000""")
def coerce_word_ids(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN concat(doc_id) WHEN 1 THEN concat('[\"7\", {\"text\": \"x\", \"id\": ', doc_id, '}]') WHEN 2 THEN '[[1, [2]], \" w_0003 \", \"\", null, {\"x\": 1}]' WHEN 3 THEN '\"w_9\"' ELSE 'no json' END")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pages.word_ids(F.when(i.isNotNull(), raw)), ",").alias("ids"))


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 2 = 0 THEN 'a' END, 'b') AS valid, concat_ws(',', CASE WHEN turn % 2 = 1 THEN 'a' END, 'z') AS invalid FROM conversations")
def word_id_validity(spark, sf_dir):
    known = F.when(F.expr("turn % 2 = 0"), F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    v = pages.valid_ids(F.array(F.lit("a"), F.lit("z"), F.lit("b")), known)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(v["valid"], ",").alias("valid"), F.array_join(v["invalid"], ",").alias("invalid"))


def _page_words(spark, sf_dir):
    """Orders as pages, their lines' rows as words: (page, id, line_id, box), and (page, line_id, box) of the lines."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS page", "concat('w', l_partkey, '-', l_linenumber) AS id", "concat('l', l_linenumber) AS line_id", "CAST(l_quantity AS INT) AS q", "l_linenumber AS n")
    words = rows.groupBy("page", "id", "line_id", "n").agg(F.min("q").alias("q")).selectExpr("page", "id", "line_id", "array(q, n * 10 + 2, q + 5, n * 10 + 6) AS box", "id AS text")
    lines = words.select("page", "line_id").distinct().where("line_id <> 'l3'").withColumn("n", F.expr("CAST(substr(line_id, 2) AS INT)")).selectExpr("page", "line_id", "array(0, n * 10, 100, n * 10 + 9) AS box", "line_id AS text")
    return words, lines


BOXED = """w AS (SELECT l_suppkey AS page, 'w' || l_partkey || '-' || l_linenumber AS id, l_linenumber AS n, l_partkey % 3 AS g, min(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {BOXED} SELECT page, g, min(q) AS x1, min(CASE WHEN n = 3 THEN 32 ELSE n * 10 END) AS y1, max(q + 5) AS x2, max(CASE WHEN n = 3 THEN 36 ELSE n * 10 + 9 END) AS y2, count(*) AS n_words FROM w GROUP BY page, g")
def span_boxes(spark, sf_dir):
    words, lines = _page_words(spark, sf_dir)
    spans = words.withColumn("g", F.expr("CAST(regexp_extract(id, 'w(\\\\d+)', 1) AS INT) % 3")).groupBy("page", "g").agg(F.collect_list("id").alias("ids"))
    out = pages.span_boxes(spans, words, lines, ["page", "g"])
    return out.select("page", "g", *[F.col("box")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], "n_words")


@query(f"WITH {BOXED} SELECT page, count(*) AS n_words, count(*) FILTER (WHERE g = 0) AS n_used, round(count(*) FILTER (WHERE g = 0) / count(*), 6) AS share FROM w GROUP BY page")
def word_coverage(spark, sf_dir):
    words, _ = _page_words(spark, sf_dir)
    used = words.where(F.expr("CAST(regexp_extract(id, 'w(\\\\d+)', 1) AS INT) % 3 = 0")).select("page", F.array("id", "id").alias("ids"))
    return pages.word_coverage(words, used, ["page"]).withColumn("share", F.round("share", 6))


@query(f"""WITH {BOXED}, e AS (SELECT page, min(id) AS first_id FROM w GROUP BY page), b AS (SELECT e.page, e.first_id, w.q, w.n FROM e JOIN w ON w.page = e.page AND w.id = e.first_id)
SELECT page AS stable_id, first_id AS ids, q || ',' || CASE WHEN n = 3 THEN 32 ELSE n * 10 END || ',' || (q + 5) || ',' || CASE WHEN n = 3 THEN 36 ELSE n * 10 + 9 END AS box, 'Street ' || page AS address_full, 'N ' || page || ' Street ' || page AS searchable_text, 'sha1:' || sha1('n ' || page || '|street ' || page) AS fingerprint, CAST(0.5 AS DOUBLE) AS confidence FROM b""")
def align_entries(spark, sf_dir):
    words, lines = _page_words(spark, sf_dir)
    first = words.groupBy("page").agg(F.min("id").alias("id"))
    entries = first.select("page", F.col("page").alias("stable_id"), F.to_json(F.array(F.lit("zzz"), F.col("id"))).alias("raw_ids"), F.concat(F.lit("N "), F.col("page").cast("string")).alias("name"), F.lit("Street").alias("address_street"), F.col("page").cast("string").alias("address_number"))
    out = pages.align_entries(entries, words, lines)
    return out.select("stable_id", F.array_join("ids", ",").alias("ids"), F.array_join(F.transform("box", lambda x: x.cast("string")), ",").alias("box"), "address_full", "searchable_text", "fingerprint", "confidence")


@query(f"""WITH {BOXED} SELECT page, md5('{{"page":' || page || ',"section":null,"words":[' || string_agg('{{"id":"' || id || '","text":"' || id || '"}}', ',' ORDER BY id) || ']}}') AS json_md5 FROM w GROUP BY page""")
def page_documents(spark, sf_dir):
    words, _ = _page_words(spark, sf_dir)
    told = words.select("page").distinct().withColumn("section", F.lit(None).cast("string"))
    return pages.page_documents(told, words).select("page", F.md5("json").alias("json_md5"))


@query(f"""WITH {BOXED}, l AS (SELECT DISTINCT page, n FROM w WHERE n <> 3) SELECT page, count(*) AS n_lines, sum(length('<TextLine id="l' || n || '"><Coords points="0,' || n * 10 || ' 100,' || n * 10 || ' 100,' || (n * 10 + 9) || ' 0,' || (n * 10 + 9) || '"/><TextEquiv><Unicode>l' || n || '</Unicode></TextEquiv></TextLine>'))::BIGINT AS chars FROM l GROUP BY page""")
def page_xml(spark, sf_dir):
    _, lines = _page_words(spark, sf_dir)
    xml = pages.page_xml(lines)
    body = F.regexp_extract("xml", "(?s)<Page>(.*)</Page>", 1)
    return xml.select("page", (F.size(F.split(body, "</TextLine>")) - 1).cast("long").alias("n_lines"), F.length(body).cast("long").alias("chars"))


@query(f"WITH {BOXED} SELECT page, id || chr(9) || '' || chr(9) || 'l' || n AS line FROM w")
def word_dump(spark, sf_dir):
    words, _ = _page_words(spark, sf_dir)
    return pages.word_dump(words.withColumn("none", F.lit(None)), ["id", "none", "line_id"])


@query("SELECT p_brand AS stem, min(p_size) FILTER (WHERE p_size % 7 = 6) AS first_index FROM part GROUP BY 1")
def first_boxed(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("stem"), F.col("p_size").alias("entry_index"), F.when(F.expr("p_size % 7 = 6"), F.array(F.lit(1))).alias("box"))
    return pages.first_boxed(rows, "box")


# ---------------------------------------------------------------- jobs


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 5 <> 0)")
def pending_lookups(spark, sf_dir):
    done = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS o_custkey", "if(c_nationkey % 5 = 0, 'error', 'ok') AS status")
    return jobs.pending(table(spark, sf_dir, "orders"), done, "o_custkey", F.col("status") == "error").select("o_orderkey")


def _lengths(frames):
    for f in frames:
        yield f.assign(status="ok", lat=f["address"].str.len().astype(float))


@query("SELECT DISTINCT p_name AS address, CASE WHEN p_name LIKE '%i%' THEN 'ok' ELSE 'no_number' END AS status, CASE WHEN p_name LIKE '%i%' THEN CAST(length(p_name) AS DOUBLE) END AS lat FROM part WHERE p_name NOT LIKE 'red%'")
def cached_lookups(spark, sf_dir):
    work = table(spark, sf_dir, "part").select(F.col("p_name").alias("address"))
    cache = work.where(F.col("address").startswith("red")).distinct().select("address", F.lit("ok").alias("status"), F.lit(1.0).alias("lat"))
    return jobs.with_cache(work, cache, "address", _lengths, F.col("address").contains("i"))[1]


STATUS = "SELECT user_id AS page, event_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'completed' ELSE 'started' END AS status, event_type || event_id AS error FROM events"
LAST = f"l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts DESC, event_id DESC) AS r FROM ({STATUS})) WHERE r = 1)"


def _status(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id AS page", "event_id", "ts", "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'completed' ELSE 'started' END AS status", "concat(event_type, event_id) AS error")


@query(f"WITH {LAST} SELECT DISTINCT user_id % 300 AS page FROM events WHERE user_id % 300 NOT IN (SELECT page FROM l WHERE status = 'completed')")
def resume_pages(spark, sf_dir):
    asked = table(spark, sf_dir, "events").selectExpr("user_id % 300 AS page").distinct()
    return jobs.resume(asked, _status(spark, sf_dir), "page", "ts", "event_id")


@query(f"WITH {LAST}, c AS (SELECT page, count(*) FILTER (WHERE status = 'failed') AS failures FROM ({STATUS}) GROUP BY page) SELECT l.page, error, failures FROM l JOIN c ON c.page = l.page WHERE status = 'failed'")
def open_failures(spark, sf_dir):
    return jobs.open_failures(_status(spark, sf_dir), "page", "ts", "event_id")


@query("SELECT event_id FROM events WHERE user_id % 3 > 0")
def invalidate_pages(spark, sf_dir):
    s = _status(spark, sf_dir)
    return jobs.invalidated(s, s.where("page % 3 = 0").select("page"), "page").select("event_id")


@query("SELECT event_type AS model, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) * 838, 4) AS projected FROM events GROUP BY 1")
def usage_projection(spark, sf_dir):
    out = jobs.projection(table(spark, sf_dir, "events").withColumnRenamed("event_type", "model"), "model", "value", 838)
    return out.select("model", "n", F.round("mean", 6).alias("mean"), F.round("projected", 4).alias("projected"))


@query("""SELECT 'missing' AS side, count(*) AS n, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FILTER (WHERE r <= 5), '') AS sample FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
UNION ALL SELECT 'unknown', count(*), coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE r <= 5), '') FROM (SELECT k, row_number() OVER (ORDER BY k) AS r FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer))""")
def index_report(spark, sf_dir):
    return jobs.index_report(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 5)


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("_low", -F.col("p_retailprice"))
    return jobs.top_slices(rows, "p_brand", ["_low", "p_partkey"], 3).select("p_brand", "p_partkey")


# ---------------------------------------------------------------- the written index

CHANGED = "SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN 'the new words of ' || source ELSE text END AS text FROM documents WHERE doc_id % 7 > 0"


@query(f"WITH {search.bm25_sql(['the', 'new'], CHANGED, False)} SELECT row_id, round(rank, 6) AS rank FROM r")
def fts_refreshed(spark, sf_dir):
    """An index written by head, read again, and brought up to date with deleted and changed documents alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    path = f"{cluster.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    search.write_index(search.build_index(docs, "doc_id", ["text"]), path)
    changed = docs.where("doc_id % 3 = 0 OR doc_id % 7 = 0").select("doc_id", F.when(F.expr("doc_id % 7 > 0"), F.concat(F.lit("the new words of "), "source")).alias("text"))
    index = search.refreshed_index(search.read_index(spark, path), changed, "doc_id", ["text"])
    return search.rank_rows(*index, "the new", every=False).select("row_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH c AS (SELECT p_partkey AS row_id, p_name AS text, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS canonical FROM part), {search.bm25_sql(['sma', 'rin'], 'SELECT row_id, text FROM c', False)},
g AS (SELECT 'n-' || text AS cluster_id, min(rank) AS min_rank, min(text) AS name FROM r JOIN c ON c.row_id = r.row_id GROUP BY 1 ORDER BY min(rank), cluster_id LIMIT 500),
d AS (SELECT *, list_min(list_transform(string_split(name, ' '), lambda w: levenshtein(w, 'smal'))) + list_min(list_transform(string_split(name, ' '), lambda w: levenshtein(w, 'ringg'))) AS dist FROM g),
f AS (SELECT *, count(*) OVER () AS total FROM d WHERE dist <= 3) SELECT cluster_id, name, CAST(dist AS INTEGER) AS dist, round(min_rank, 6) AS min_rank, total FROM f ORDER BY dist, min_rank, cluster_id LIMIT 20""")
def fuzzy_canonical(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"cluster_id": F.concat(F.lit("n-"), "p_name"), "canonical": F.when(F.expr("p_size % 2 = 0"), F.col("p_name")).otherwise("")})
    index = search.build_index(rows, "p_partkey", ["p_name"])
    return search.search_names(index, rows, "smal, ringg!", "p_partkey", "cluster_id", "p_name", "canonical", 20).withColumn("min_rank", F.round("min_rank", 6))


# ---------------------------------------------------------------- whole pipelines


@query("""WITH d AS (SELECT doc_id, doc_id || ':0' AS stable_id, 'n' || (doc_id % 50) AS name, source, doc_id % 4 = 0 AS o, CASE WHEN doc_id % 4 = 0 THEN 99 ELSE doc_id % 7 END AS number, CASE WHEN doc_id % 5 = 0 THEN 'p' || (doc_id % 3) END AS pand FROM documents),
a AS (SELECT *, CASE WHEN source = 'src1' THEN 'Source One' ELSE source END AS street, CASE WHEN source = 'src1' THEN 'Source One ' || number WHEN o THEN source || ' 99' END AS full_ FROM d),
g AS (SELECT *, CASE WHEN number < 10 AND source = 'src1' THEN 'ok' WHEN number < 10 AND source = 'src2' THEN 'no_match' END AS status FROM a)
SELECT stable_id, street AS address_street, CAST(number AS VARCHAR) AS address_number, full_ AS address_full, status, CASE WHEN status = 'ok' THEN CAST(number AS DOUBLE) END AS lat, CASE WHEN status IS NOT NULL THEN CASE WHEN status = 'ok' THEN 'adres' END WHEN pand IS NOT NULL AND doc_id % 10 = 0 THEN 'approx' END AS geocode_type,
o AS flag_verified, CASE WHEN doc_id % 8 = 0 THEN '1,2,3,4' END AS box, pand AS pand_id, 'sha1:' || sha1(name || '|' || coalesce(lower(full_), '')) AS fingerprint, CASE WHEN o THEN name || ' ' || source || ' 99' ELSE name END AS searchable_text,
CASE WHEN pand IS NULL THEN stable_id ELSE min(stable_id) OVER (PARTITION BY name, pand) END AS person_id FROM g""")
def store_build(spark, sf_dir):
    box = F.array_join(F.transform("entry_bbox", lambda x: x.cast("string")), ",").alias("box")
    return _store(spark, sf_dir)["entries"].select("stable_id", "address_street", "address_number", "address_full", "status", "lat", "geocode_type", "flag_verified", box, "pand_id", "fingerprint", "searchable_text", "person_id")


@query("""SELECT 'building' AS kind, 'p' || (doc_id % 3) AS name, count(*) AS n FROM documents WHERE doc_id % 5 = 0 GROUP BY 2
UNION ALL SELECT 'reference', 'see ' || (doc_id % 4), CAST(doc_id % 9 AS BIGINT) FROM documents WHERE doc_id % 6 = 0""")
def store_parts(spark, sf_dir):
    """The store's buildings and cross references."""
    out = _store(spark, sf_dir)
    held = out["buildings"].select(F.lit("building").alias("kind"), F.col("pand_id").alias("name"), F.col("entry_count").alias("n"))
    return held.unionByName(out["cross_references"].select(F.lit("reference").alias("kind"), F.col("text").alias("name"), F.col("page_number").cast("long").alias("n")))


def _store(spark, sf_dir):
    from quarry.operators import store
    from quarry.sources.schemas import OVERRIDE, PAGE

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), "doc_id", "source")
    entry = F.to_json(F.array(F.struct(F.expr("concat('n', doc_id % 50)").alias("name"), F.col("source").alias("address_street"), F.expr("CAST(doc_id % 7 AS STRING)").alias("address_number"), F.expr("if(doc_id % 6 = 0, array(named_struct('text', concat('see ', doc_id % 4), 'page', CAST(doc_id % 9 AS INT))), array())").alias("cross_references"))))
    book = d.select("stem", F.from_json(F.concat(F.lit('{"section":"name_register","entries":'), entry, F.lit("}")), PAGE).alias("p")).select("stem", "p.*")
    edit = F.expr("""concat('{"fields":{"address_number":"99"},"flags":{"verified":true}', if(doc_id % 8 = 0, ',"bbox":{"value":[1,2,3,4]}', ''), '}')""")
    overrides = d.where("doc_id % 4 = 0").select(F.concat("stem", F.lit(":0")).alias("stable_id"), F.from_json(edit, OVERRIDE).alias("o")).select("stable_id", "o.*")
    geocodes = spark.createDataFrame([(f"{s} {k}", status, float(k), float(k), 11.0, kind) for k in range(10) for s, status, kind in (("source one", "ok", "adres"), ("src2", "no_match", None))], "address string, status string, lat double, lng double, score double, type string")
    matches = d.where("doc_id % 5 = 0").selectExpr("concat(stem, ':0') AS stable_id", "concat('p', doc_id % 3) AS pand_id", "doc_id % 10 = 0 AS approx")
    return store.build_store(book, overrides, geocodes, matches, {"src1": "Source One"}, {}, [r"n z"])


@query("""WITH i AS (SELECT p_name, p_size, min(p_partkey) AS place FROM part GROUP BY 1, 2), e AS (SELECT p_partkey AS stable_id, place, p_name || ' ' || p_size || 'b' AS address, p_retailprice AS lat FROM part JOIN i USING (p_name, p_size) WHERE p_retailprice > 950)
SELECT place AS pand_id, lower(address) AS address, min_by(lat, stable_id) AS lat, string_agg(CAST(stable_id AS VARCHAR), ',' ORDER BY stable_id) AS entries FROM e GROUP BY 1, 2""")
def link_book(spark, sf_dir):
    out = _linked_book(spark, sf_dir)["groups"]
    return out.select("pand_id", "address", "lat", F.array_join(F.transform("entries", lambda x: x.cast("string")), ",").alias("entries"))


@query("""WITH i AS (SELECT p_name, p_size, min(p_partkey) AS place FROM part GROUP BY 1, 2), e AS (SELECT p_partkey, place FROM part JOIN i USING (p_name, p_size) WHERE p_retailprice > 950)
SELECT 'match' AS kind, p_partkey AS a, place AS b FROM e UNION ALL SELECT 'summary', count(*), count(*) FROM e""")
def link_book_parts(spark, sf_dir):
    """The book's matches and summary."""
    out = _linked_book(spark, sf_dir)
    met = out["matches"].select(F.lit("match").alias("kind"), F.col("stable_id").alias("a"), F.col("pand_id").alias("b"))
    return met.unionByName(out["summary"].select(F.lit("summary").alias("kind"), F.col("total").alias("a"), F.col("matched").alias("b")))


def _linked_book(spark, sf_dir):
    from quarry.operators import store

    part = table(spark, sf_dir, "part")
    entries = part.selectExpr("p_partkey AS stable_id", "concat(p_name, ' ', p_size, 'B') AS address", "if(p_retailprice > 950, p_retailprice, NULL) AS lat", "p_retailprice AS lng")
    index = part.selectExpr("p_name AS street", "p_size AS number", "'' AS letter", "p_partkey AS place_id")
    return store.link_book(entries, index, [("^large ", "l ")], [("ing", "yng")])


@query("""WITH e AS (SELECT vec_id, label * 10 + vec_id % 7 AS who, CASE vec_id % 2 WHEN 0 THEN 'aaa way' ELSE 'bbb way' END AS street, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings),
m AS (SELECT a.vec_id, b.vec_id AS place, sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) AS d FROM e a JOIN e b ON a.vec_id % 3 <> 0 AND b.vec_id % 3 = 0), p AS (SELECT vec_id, arg_min(place, {'d': d, 'p': place}) AS place FROM m WHERE d <= 2 GROUP BY vec_id),
r AS (SELECT * FROM e WHERE vec_id % 3 <> 0), h AS (SELECT DISTINCT who, street, vec_id AS place FROM e WHERE vec_id % 3 = 0), f AS (SELECT who FROM h GROUP BY who HAVING count(DISTINCT place) <= 6), o AS (SELECT who, street, min(place) AS place FROM h WHERE who IN (SELECT who FROM f) GROUP BY 1, 2 HAVING count(*) = 1),
q AS (SELECT r.vec_id, o.place FROM r JOIN o ON o.who = r.who AND o.street = r.street WHERE r.vec_id NOT IN (SELECT vec_id FROM p)), k AS (SELECT * FROM p UNION ALL SELECT * FROM q), n AS (SELECT DISTINCT r.who, r.street, k.place FROM r JOIN k USING (vec_id)),
s AS (SELECT r.vec_id, min(n.place) AS place FROM r JOIN n ON n.who = r.who AND n.street = r.street WHERE r.vec_id NOT IN (SELECT vec_id FROM k) GROUP BY 1 HAVING count(DISTINCT n.place) = 1)
SELECT vec_id, place AS place_id, 'point' AS rule FROM p UNION ALL SELECT vec_id, place, 'owner' FROM q UNION ALL SELECT vec_id, place, 'same_person' FROM s""")
def place_entries(spark, sf_dir):
    from quarry.operators import store

    told = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("label * 10 + vec_id % 7").alias("who"), F.expr("if(vec_id % 2 = 0, 'aaa way', 'bbb way')").alias("street"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))
    places, rows = told.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "place_id"), told.where("vec_id % 3 <> 0")
    owners = places.select("who", "street", F.col("place_id").alias("place"))
    return store.place_entries(rows, places.select("place_id", "x", "y"), owners, "vec_id", ["who"], "street", 2.0, 6)
