"""The library's operators as queries over the driver's tables, each beside its SQL in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import cluster, corrections, flatten, jobs, linkage, ordered, quality, review, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- search

CLUSTERS = "SELECT d.doc_id AS row_id, text, coalesce('p-' || (quality * 2 + toxic) || '-' || source, 'u-' || d.doc_id) AS cluster_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    named = F.concat(F.lit("p-"), (F.col("quality") * 2 + F.col("toxic")).cast("string"), F.lit("-"), "source")
    return docs.join(labels, F.col("doc_id") == F.col("_id"), "left").withColumn("cluster_id", F.coalesce(named, F.concat(F.lit("u-"), F.col("doc_id").cast("string"))))


@query(f"WITH c AS ({CLUSTERS}), {search.bm25_sql(['the', 'with'], 'SELECT row_id, text FROM c')} SELECT cluster_id, round(min(rank), 6) AS min_rank, count(*) AS hits FROM r JOIN c ON c.row_id = r.row_id GROUP BY cluster_id ORDER BY min(rank), cluster_id LIMIT 50")
def fts_prefix_bm25(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    found = search.search(search.build_index(rows, "doc_id", ["text"]), rows, "the with", "doc_id", "cluster_id", ["doc_id", "lang"])
    return found.select("cluster_id", F.round("min_rank", 6).alias("min_rank"), F.size("mentions").cast("long").alias("hits"))


@query(f"WITH c AS ({CLUSTERS}), {search.bm25_sql(['que', 'ver'], 'SELECT row_id, text FROM c', False)} SELECT row_id, round(rank, 6) AS rank FROM r")
def fts_or(spark, sf_dir):
    index = search.build_index(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return search.rank_rows(*index, "que ver", every=False).select("row_id", F.round("rank", 6).alias("rank"))


@query(f"WITH c AS ({CLUSTERS}), {search.bm25_sql(['and', 'th'], 'SELECT row_id, text FROM c')} SELECT row_id, round(rank, 6) AS rank FROM r")
def fts_and(spark, sf_dir):
    index = search.build_index(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return search.rank_rows(*index, "and th").select("row_id", F.round("rank", 6).alias("rank"))


@query(f"WITH c AS ({CLUSTERS}), {search.bm25_sql(['the'], 'SELECT row_id, text FROM c')} SELECT count(DISTINCT cluster_id) AS total FROM r JOIN c ON c.row_id = r.row_id")
def fts_count_clusters(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    return search.count_clusters(search.build_index(rows, "doc_id", ["text"]), rows, "the", "doc_id", "cluster_id")


@query("""WITH p AS (SELECT p_name, p_partkey, list_filter(string_split_regex(lower(p_name), '\\s+'), lambda x: x <> '') AS ws FROM part),
s AS (SELECT *, list_min(list_transform(ws, lambda w: levenshtein(w, 'smal'))) + list_min(list_transform(ws, lambda w: levenshtein(w, 'rings'))) AS dist FROM p)
SELECT p_partkey, p_name, CAST(dist AS INTEGER) AS dist FROM s WHERE dist <= 3 ORDER BY dist, p_partkey LIMIT 100""")
def fuzzy_levenshtein_topk(spark, sf_dir):
    words = ["smal", "rings"]
    rows = table(spark, sf_dir, "part").withColumn("dist", T.edit_score(words, F.col("p_name")))
    return rows.where(F.col("dist") <= T.edit_limit(words)).orderBy("dist", "p_partkey").limit(100).select("p_partkey", "p_name", "dist")


@query(f"""WITH c AS (SELECT p_partkey AS row_id, p_name AS text FROM part), {search.bm25_sql(['sma', 'rin'], 'SELECT row_id, text FROM c', False)},
g AS (SELECT 'n-' || text AS cluster_id, min(rank) AS min_rank, min(text) AS name FROM r JOIN c ON c.row_id = r.row_id GROUP BY 1 ORDER BY min(rank), cluster_id LIMIT 500),
d AS (SELECT *, list_min(list_transform(string_split(name, ' '), lambda w: levenshtein(w, 'smal'))) + list_min(list_transform(string_split(name, ' '), lambda w: levenshtein(w, 'ringg'))) AS dist FROM g)
SELECT cluster_id, name, CAST(dist AS INTEGER) AS dist, round(min_rank, 6) AS min_rank FROM d WHERE dist <= 3 ORDER BY dist, min_rank, cluster_id LIMIT 50""")
def fuzzy_search_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("cluster_id", F.concat(F.lit("n-"), "p_name"))
    index = search.build_index(rows, "p_partkey", ["p_name"])
    return search.search_fuzzy(index, rows, "smal ringg", "p_partkey", "cluster_id", "p_name").withColumn("min_rank", F.round("min_rank", 6))


# ---------------------------------------------------------------- text functions


@query("SELECT doc_id, lang, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 \\-'']', ' ', 'g'), '\\s+', ' ', 'g'))) AS key_md5, length(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS compact_len FROM documents")
def normalize_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(T.street_key(F.col("text"))).alias("key_md5"), F.length(T.compact_key(F.col("text"))).cast("long").alias("compact_len"))


@query("SELECT doc_id, md5(strip_accents(text)) AS plain_md5 FROM documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_accents(F.col("text"))).alias("plain_md5"))


@query("SELECT c_custkey, 'sha1:' || sha1(lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) || '|' || lower(c_mktsegment) || '|' || CAST(c_nationkey AS VARCHAR)) AS mark FROM customer")
def fingerprint_sha1(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("mark"))


@query("SELECT p_partkey, concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(p_brand), ''), CASE WHEN p_size > 25 THEN p_type END) AS searchable_text FROM part")
def searchable_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.searchable_text(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type"))).alias("searchable_text"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]', '', 'g') AS person_key FROM customer")
def person_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.person_key(F.col("c_name")).alias("person_key"))


RULES = [(r"^small ", "s. "), (r"\bred\b", "rood"), (r"ring$", "ringen"), (r"rood ringen", "rr")]


@query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name, '^small ', 's. ', 'g'), '\\bred\\b', 'rood', 'g'), 'ring$', 'ringen', 'g'), 'rood ringen', 'rr', 'g') AS ruled FROM part")
def rule_chain_regex(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.apply_rules(F.col("p_name"), RULES).alias("ruled"))


@query("""WITH k AS (SELECT p_partkey, p_name AS b FROM part),
g AS (SELECT p_partkey, unnest(list_distinct([b, regexp_replace(b, '^large ', 'l ')])) AS s FROM k),
e AS (SELECT p_partkey, s FROM g UNION SELECT p_partkey, replace(s, 'ing', 'yng') FROM g WHERE contains(s, 'ing') UNION SELECT p_partkey, replace(s, 'yng', 'ing') FROM g WHERE contains(s, 'yng')),
d AS (SELECT * FROM e UNION SELECT p_partkey, replace(s, '-', ' ') FROM e UNION SELECT p_partkey, replace(s, ' ', '-') FROM e),
p AS (SELECT * FROM d UNION SELECT p_partkey, x || s FROM d, (VALUES ('de '), ('van '), ('der ')) v(x))
SELECT p_partkey, count(*) AS n_aliases, string_agg(s, '|' ORDER BY s) AS aliases FROM p GROUP BY p_partkey""")
def alias_expand(spark, sf_dir):
    out = T.aliases(F.col("p_name"), [("^large ", "l ")], [("ing", "yng")])
    return table(spark, sf_dir, "part").select("p_partkey", F.size(out).cast("long").alias("n_aliases"), F.array_join(F.array_sort(out), "|").alias("aliases"))


@query("""SELECT o_orderkey, 'Street ' || (o_custkey % 40) AS street_in, CAST(o_orderkey % 300 AS INTEGER) AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE '' END AS letter, 'street ' || (o_custkey % 40) AS street FROM orders""")
def parse_addresses(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    street = F.concat(F.lit("Street "), F.expr("o_custkey % 40").cast("string"))
    tail = F.when(F.expr("o_orderkey % 3 = 0"), "B").otherwise("")
    text = F.concat(F.lit("Firm, "), street, F.lit(" "), F.expr("o_orderkey % 300").cast("string"), tail, F.when(F.expr("o_orderkey % 5 = 0"), " (rear)").otherwise("."))
    # a single letter may stand before the number's range or the brackets
    p = o.select("o_orderkey", street.alias("street_in"), T.parse_address(text).alias("p"))
    return p.select("o_orderkey", "street_in", "p.number", "p.letter", "p.street")


@query("SELECT page_id, regexp_extract(url, '^(\\w+)://([^/]+)', 1) AS scheme, regexp_extract(url, '^(\\w+)://([^/]+)', 2) AS host, greatest(1, coalesce(TRY_CAST(nullif(regexp_extract(url, '/(\\d+)(?:[?#]|$)', 1), '') AS INTEGER), 1) - 5) AS page_number FROM pages")
def url_parse(spark, sf_dir):
    url, host = F.col("url"), r"^(\w+)://([^/]+)"
    number = F.coalesce(F.regexp_extract(url, r"/(\d+)(?:[?#]|$)", 1).try_cast("int"), F.lit(1)) - 5
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, host, 1).alias("scheme"), F.regexp_extract(url, host, 2).alias("host"), F.greatest(F.lit(1), number).alias("page_number"))


# ---------------------------------------------------------------- predicates and presentation


@query("SELECT p_partkey, CAST(p_size * 11 AS VARCHAR) AS number FROM part WHERE p_size * 11 > 99 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0")
def digits_predicate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("number", F.when(F.expr("p_partkey % 3 = 0"), "12a4").otherwise((F.col("p_size") * 11).cast("string")))
    return review.suspicious_numbers(rows, "number", F.expr("p_partkey % 5 = 0"), F.lit(None).cast("boolean")).select("p_partkey", "number")


@query("SELECT event_id, event_type FROM events WHERE TRY_CAST(substr(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR), 1, 4) AS INTEGER) IS NULL OR length(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR)) < 4 OR TRY_CAST(substr(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR), 1, 4) AS INTEGER) BETWEEN 1000 AND 2500")
def range_filter_null_passes(spark, sf_dir):
    told = F.floor(F.round(F.col("value") * 100, 0)).cast("long").cast("string")
    return table(spark, sf_dir, "events").where(review.in_code_range(told, 1000, 2500)).select("event_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END, 99999) <= 1996")
def built_before(spark, sf_dir):
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").where(review.built_by(year, 1996)).select("o_orderkey")


@query("""SELECT d.doc_id, CASE WHEN d.lang = 'es' THEN 'advertisement' WHEN d.lang = 'fr' THEN 'text' WHEN l.toxic = 1 THEN 'organization'
WHEN l.quality = 1 THEN CASE WHEN d.lang = 'de' THEN 'institutional' ELSE 'person' END WHEN d.lang = 'de' THEN CASE WHEN l.quality = 0 THEN 'institutional' ELSE 'organization' END
WHEN regexp_matches(d.source, '^src1') THEN 'organization' ELSE 'person' END AS kind FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def classify_entry(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    section = F.when(F.col("lang") == "es", "advertisement").when(F.col("lang") == "fr", "other").when(F.col("lang") == "de", "institutional").otherwise("name_register")
    kind = F.when(F.col("toxic") == 1, "organization").when(F.col("quality") == 1, "person")
    role = F.when(F.col("quality") == 0, "chair")
    name = F.when(F.col("source").rlike("^src1"), F.concat(F.lit("Firma "), "source")).otherwise(F.col("source"))
    return rows.select("doc_id", flatten.entry_kind(section, kind, role, name).alias("kind"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'not_found' WHEN event_type = 'click' AND (user_id % 10 = 0 OR value < 10) THEN 'uncertain' ELSE '' END AS flags FROM events""")
def confidence_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "ok").otherwise("no_number")
    kind = F.when(F.expr("user_id % 10 = 0"), "weg").otherwise("adres")
    return e.select("event_id", F.array_join(flatten.confidence_flags(status, kind, F.col("value")), ",").alias("flags"))


@query("SELECT d.doc_id, coalesce(toxic, 0) = 1 AS needs_review FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE (coalesce(quality, 0) = 0 AND coalesce(toxic, 0) = 0) OR coalesce(toxic, 0) = 1")
def status_filter(spark, sf_dir):
    rows, v, n = _clustered(spark, sf_dir), F.col("quality") == 1, F.col("toxic") == 1
    some = [review.by_status(rows, v, n, s).select("doc_id", F.lit(s == "needs_review").alias("needs_review")) for s in ("unreviewed", "needs_review")]
    return some[0].unionByName(some[1])


@query("""WITH u AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN '' ELSE CAST(s_suppkey % 7 AS VARCHAR) END AS num, 'S' || (s_nationkey % 5) AS street, s_acctbal < 3000 AS linked FROM supplier)
SELECT s_suppkey, street FROM u WHERE NOT linked AND coalesce(trim(num), '') = '' AND EXISTS (SELECT 1 FROM u v WHERE v.linked AND v.street = u.street) ORDER BY street, s_suppkey LIMIT 50""")
def semi_validated(spark, sf_dir):
    num = F.when(F.expr("s_suppkey % 4 = 0"), None).when(F.expr("s_suppkey % 4 = 1"), "").otherwise(F.expr("s_suppkey % 7").cast("string"))
    u = table(spark, sf_dir, "supplier").select("s_suppkey", num.alias("num"), F.concat(F.lit("S"), F.expr("s_nationkey % 5").cast("string")).alias("street"), (F.col("s_acctbal") < 3000).alias("linked"))
    missing = u.where(~F.col("linked") & (F.coalesce(F.btrim("num"), F.lit("")) == ""))
    held = missing.join(u.where("linked").select("street").distinct(), "street", "left_semi")
    return quality.queue(held, F.lit(True), ["street", "s_suppkey"], 50).select("s_suppkey", "street")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40 AND p_retailprice > 950 ORDER BY p_name, CAST(p_size AS VARCHAR), p_partkey LIMIT 25")
def topk_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("_t", F.col("p_size").cast("string"))
    return quality.queue(rows, (F.col("p_size") > 40) & (F.col("p_retailprice") > 950), ["p_name", "_t", "p_partkey"], 25).select("p_partkey", "p_name", "p_size")


# ---------------------------------------------------------------- flattening and corrections


@query("SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN role END, ''), 'conv-' || conv_id) AS speaker, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS entry_index, conv_id || ':' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS stable_id FROM conversations")
def flatten_inherit(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.expr("turn % 2 = 0"), F.col("role")).alias("role")))).alias("entries"), F.concat(F.lit("conv-"), F.first("conv_id").cast("string")).alias("name"))
    flat = nested.select("conv_id", "name", F.posexplode("entries").alias("entry_index", "e"))
    speaker = F.when(F.coalesce("e.role", F.lit("")) == "", F.col("name")).otherwise(F.col("e.role"))
    return flat.select("conv_id", "e.turn", speaker.alias("speaker"), F.col("entry_index").cast("long").alias("entry_index"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("entry_index").cast("string")).alias("stable_id"))


@query("""SELECT lang AS section, doc_id || ':0' AS stable_id, 'n' || doc_id AS name, CASE WHEN lang IN ('de', 'es') THEN source END AS street FROM documents WHERE lang IN ('en', 'fr', 'de')
UNION ALL SELECT lang, doc_id || ':0', 'Unknown', source FROM documents WHERE lang = 'es'""")
def flatten_union_sections(spark, sf_dir):
    """Page documents of every section kind, flattened: registers by name and street, institutions, found addresses."""
    from quarry.sources.schemas import PAGE

    d = table(spark, sf_dir, "documents")
    kind = {"en": "name_register", "fr": "institutional", "de": "street_register", "es": "other"}
    name = F.to_json(F.array(F.struct(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"))))
    section = F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])[F.col("lang")]
    told = F.concat(
        F.lit('{"section":"'), section, F.lit('"'),
        F.when(F.col("lang") == "en", F.concat(F.lit(',"entries":'), name)).when(F.col("lang") == "fr", F.concat(F.lit(',"entities":'), name))
        .when(F.col("lang") == "de", F.concat(F.lit(',"streets":[{"street_name":"'), "source", F.lit('","entries":'), name, F.lit("}]")))
        .otherwise(F.concat(F.lit(',"addresses_found":[{"address_street":"'), "source", F.lit('"}]'))), F.lit("}"),
    )
    pages = d.select(F.col("doc_id").cast("string").alias("stem"), F.from_json(told, PAGE).alias("p")).select("stem", "p.*")
    back = F.create_map(*[F.lit(x) for k, v in kind.items() for x in (v, k)])[F.col("section")]
    return flatten.flatten_pages(pages).select(back.alias("section"), "stable_id", "name", F.col("address_street").alias("street"))


@query("""WITH o AS (SELECT user_id % 1500 AS k, max_by(event_type, event_id) AS v, max_by(event_id, event_id) AS e FROM events GROUP BY 1)
SELECT c_custkey, CASE WHEN e % 3 = 0 THEN NULL WHEN e % 3 = 1 THEN v ELSE c_mktsegment END AS c_mktsegment, c_name, coalesce(e % 3 <> 2, false) AS edited FROM customer LEFT JOIN o ON o.k = c_custkey""")
def override_merge(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.expr("user_id % 1500").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("v"), F.max("event_id").alias("e"))
    fields = F.when(F.expr("e % 3 = 0"), F.create_map(F.lit("c_mktsegment"), F.lit(None).cast("string"))).when(F.expr("e % 3 = 1"), F.create_map(F.lit("c_mktsegment"), F.col("v"))).otherwise(F.create_map().cast("map<string,string>"))
    out = corrections.apply_overrides(table(spark, sf_dir, "customer"), last.select("c_custkey", fields.alias("fields")), "c_custkey", ["c_mktsegment"])
    return out.select("c_custkey", "c_mktsegment", "c_name", "edited")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) DESC, event_id) AS r FROM events) WHERE r = 1")
def lww_merge(spark, sf_dir):
    return corrections.last_writer_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", F.date_trunc("hour", F.col("ts")), "event_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT k AS key, count(DISTINCT event_type) AS versions FROM (SELECT user_id || '-' || date_trunc('day', ts)::DATE AS k, event_type FROM events) GROUP BY k HAVING count(DISTINCT event_type) > 1")
def lww_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    return corrections.conflicts(e, "key", ["event_type"])


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey - 1 ELSE o_custkey END AS want, o_custkey % 25 AS nk, 'seg' || (o_orderkey % 5) AS seg FROM orders),
m AS (SELECT c_nationkey AS nk, 'seg' || (c_custkey % 5) AS seg, min(c_custkey) AS e FROM customer GROUP BY 1, 2)
SELECT c.o_orderkey, coalesce(k.c_custkey, m.e) AS entry_id, k.c_custkey IS NULL AS fell_back FROM c LEFT JOIN customer k ON k.c_custkey = c.want LEFT JOIN m ON m.nk = c.nk AND m.seg = c.seg WHERE coalesce(k.c_custkey, m.e) IS NOT NULL""")
def id_match_fingerprint_fallback(spark, sf_dir):
    want = F.when(F.expr("o_orderkey % 4 = 0"), -F.col("o_orderkey") - 1).otherwise(F.col("o_custkey"))
    c = table(spark, sf_dir, "orders").select("o_orderkey", want.alias("want"), F.expr("o_custkey % 25").cast("int").alias("nk"), F.concat(F.lit("seg"), F.expr("o_orderkey % 5").cast("string")).alias("seg"))
    e = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nk"), F.concat(F.lit("seg"), F.expr("c_custkey % 5").cast("string")).alias("seg"))
    out = linkage.match_or_fingerprint(c, e, "want", "c_custkey", ["nk", "seg"])
    return c.select("o_orderkey", "want").join(out.dropDuplicates(["want", "entry_id"]), "want").select("o_orderkey", "entry_id", "fell_back")


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS c_mktsegment, concat_ws('; ', c_name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment: ' || c_mktsegment END) AS c_name FROM customer")
def clear_rejected_values(spark, sf_dir):
    gone = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    return corrections.clear_values(table(spark, sf_dir, "customer"), gone, "c_mktsegment", "c_name").select("c_custkey", "c_mktsegment", "c_name")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'old' WHEN s_nationkey % 2 = 0 THEN 'new-' || s_suppkey END AS link FROM supplier")
def link_where_open(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") < 0, "old").alias("link"))
    links = rows.select("s_suppkey", F.concat(F.lit("new-"), F.col("s_suppkey").cast("string")).alias("link"), F.when(F.expr("s_nationkey % 2 = 0"), F.col("s_nationkey")).otherwise(-1).cast("int").alias("s_nationkey"))
    return corrections.link_where_open(rows, links, "s_suppkey", "link", "s_nationkey").select("s_suppkey", "link")


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'c_name' END, CASE WHEN c_nationkey < 20 THEN 'c_nationkey' END) AS changed FROM customer WHERE c_custkey % 2 = 0 OR c_nationkey < 20""")
def changed_fields(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    new = old.select("c_custkey", F.when(F.expr("c_custkey % 2 = 0"), F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_nationkey") >= 20, F.col("c_nationkey")).alias("c_nationkey"))
    return corrections.changed_fields(old, new, "c_custkey", ["c_name", "c_nationkey"]).select("c_custkey", F.array_join(F.map_keys("changes"), ",").alias("changed"))


# ---------------------------------------------------------------- joins


@query("""SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS c_name, CASE WHEN a.c_custkey IS NOT NULL THEN a.c_acctbal ELSE b.c_acctbal END AS c_acctbal, CASE WHEN a.c_custkey IS NOT NULL THEN 1 WHEN b.c_custkey IS NOT NULL THEN 2 END AS hit
FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey * 2 LEFT JOIN customer b ON b.c_custkey = o_custkey""")
def lookup_two_key_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("k1"), F.col("o_custkey").alias("k2"))
    return linkage.lookup_with_fallback(rows, table(spark, sf_dir, "customer"), "k1", "k2", "c_custkey", ["c_name", "c_acctbal"]).select("o_orderkey", "c_name", "c_acctbal", "hit")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_pending(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return jobs.pending(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, "c_custkey")


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS address_count, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def left_group_count(spark, sf_dir):
    some = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("l"))
    out = table(spark, sf_dir, "nation").join(some, "n_nationkey", "left")
    return out.select("n_nationkey", "n_name", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("address_count"), F.coalesce(F.array_join(F.transform("l", lambda x: x.cast("string")), ","), F.lit("")).alias("suppliers")).withColumn("address_count", F.greatest("address_count", F.lit(0)))


NEAR = "(VALUES (0, 0), (1, 2), (2, -2), (3, 4), (4, -4), (5, 1), (6, -1)) v(t, d)"


@query(f"""WITH i AS (SELECT p_type AS street, p_size AS number, min(p_partkey) AS place_id FROM part GROUP BY 1, 2),
p AS (SELECT p_partkey, 0 AS a, p_name AS street, p_size FROM part UNION ALL SELECT p_partkey, 1, p_type, p_size FROM part),
h AS (SELECT p_partkey, a, CASE WHEN t = 0 THEN 0 ELSE t + 9 END AS tier, place_id FROM p, {NEAR} JOIN i ON i.street = p.street AND i.number = p.p_size + d)
SELECT p_partkey, place_id, CAST(a AS INTEGER) AS alias_rank, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY a, tier, place_id) AS r FROM h) WHERE r = 1""")
def tiered_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    index = part.select(F.col("p_type").alias("street"), F.col("p_size").alias("number"), F.lit("").alias("letter"), F.col("p_partkey").alias("place_id"))
    probes = part.select("p_partkey", F.array("p_name", "p_type").alias("aliases"), F.col("p_size").alias("number"), F.lit("").alias("letter"))
    return linkage.tiered_match(probes, index, "p_partkey")


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
m AS (SELECT a.vec_id, b.vec_id AS place_id, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d FROM e a JOIN e b ON b.vec_id % 3 = 0 AND a.vec_id % 3 <> 0 AND abs(b.x - a.x) <= 0.02 AND abs(b.y - a.y) <= 0.02)
SELECT vec_id, place_id, round(d, 9) AS dist2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, place_id) AS r FROM m) WHERE r = 1""")
def knn_box(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    places = e.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "place_id")
    return linkage.nearest_in_box(e.where("vec_id % 3 <> 0"), places, "vec_id", "place_id", 0.02).withColumn("dist2", F.round("dist2", 9))


BOX = "SELECT p_partkey AS box_id, p_size % 40 AS x1, p_partkey % 90 AS y1, p_size % 40 + 4 AS x2, p_partkey % 90 + 6 AS y2 FROM part"


@query(f"WITH b AS ({BOX}), p AS (SELECT s_suppkey, s_nationkey * 1.5 AS x, s_suppkey % 100 AS y FROM supplier) SELECT s_suppkey, min(box_id) AS box_id FROM p JOIN b ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 GROUP BY s_suppkey")
def hit_test_rect(spark, sf_dir):
    boxes = table(spark, sf_dir, "part").selectExpr("p_partkey AS box_id", "p_size % 40 AS x1", "p_partkey % 90 AS y1", "p_size % 40 + 4 AS x2", "p_partkey % 90 + 6 AS y2")
    points = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey * 1.5D AS x", "s_suppkey % 100 AS y")
    return ordered.first_hit(points, boxes, "s_suppkey", "box_id", 10.0)


RANGES = [(1, 10, "low"), (8, 20, "mid"), (30, 45, "high")]


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'low' WHEN p_size BETWEEN 8 AND 20 THEN 'mid' WHEN p_size BETWEEN 30 AND 45 THEN 'high' ELSE 'generic' END AS label FROM part")
def range_join_first(spark, sf_dir):
    return linkage.first_range(table(spark, sf_dir, "part"), RANGES, "p_size", "generic").select("p_partkey", "label")


@query("""SELECT a.event_id, b.event_id AS mark FROM (SELECT * FROM events WHERE event_type <> 'error') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_prev(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return linkage.as_of(e.where("event_type <> 'error'").select("event_id", "user_id", "ts"), marks, ["user_id"], "ts", "mark").select("event_id", "mark")


@query("SELECT p_partkey FROM part WHERE coalesce(CASE WHEN p_size % 3 > 0 THEN 1800 + p_size END, 0) <= 1830 AND 1830 < coalesce(CASE WHEN p_size % 4 > 0 THEN 1820 + p_size END, 9999)")
def interval_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_size % 3 > 0 THEN 1800 + p_size END").alias("from"), F.expr("CASE WHEN p_size % 4 > 0 THEN 1820 + p_size END").alias("until"))
    return linkage.valid_at(rows, F.lit(1830)).select("p_partkey")


@query("""WITH s AS (SELECT s_nationkey AS nk, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS pos FROM supplier), c AS (SELECT c_nationkey AS nk, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer)
SELECT coalesce(s.nk, c.nk) AS nk, CAST(coalesce(s.pos, c.pos) AS INTEGER) AS pos, s_suppkey, c_custkey FROM s FULL JOIN c ON s.nk = c.nk AND s.pos = c.pos""")
def positional_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nk"), "s_suppkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nk"), "c_custkey")
    return linkage.positional_join(s, c, "nk", ["s_suppkey"], ["c_custkey"])


@query("""SELECT p_partkey, p_name FROM part a WHERE p_size <= 25 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size = 50 - a.p_size AND b.p_size > 25 AND left(b.p_name, 4) = left(a.p_name, 4) AND levenshtein(a.p_name, b.p_name) <= 2)""")
def fuzzy_antijoin(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    left = part.where("p_size <= 25").select("p_partkey", "p_name", (50 - F.col("p_size")).alias("k"))
    right = part.where("p_size > 25").select("p_name", F.col("p_size").alias("k"))
    return linkage.fuzzy_anti(left, right, "p_name", ["k"]).select("p_partkey", "p_name")


@query("""WITH k AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS m FROM part GROUP BY ALL) SELECT a.p_brand, a.p_type, a.p_size AS n, a.m AS here, b.m AS next_one FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND b.p_size = a.p_size + 1""")
def offset_selfjoin(spark, sf_dir):
    out = linkage.next_number(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_size", "p_partkey")
    return out.select("p_brand", "p_type", F.col("p_size").alias("n"), F.col("p_partkey").alias("here"), F.col("next_p_partkey").alias("next_one"))


@query("""WITH a AS (SELECT s_suppkey, min(p_partkey) AS place_id FROM supplier JOIN part ON p_size = s_nationkey AND p_partkey % 50 = s_suppkey % 50 GROUP BY 1),
b AS (SELECT s_suppkey, min(p_partkey) AS place_id FROM supplier JOIN part ON p_size = s_nationkey + 20 AND p_partkey % 3 = 0 WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a) AND s_acctbal > 2000 GROUP BY 1)
SELECT s_suppkey, place_id, 'exact' AS rule FROM a UNION ALL SELECT s_suppkey, place_id, 'near' FROM b UNION ALL SELECT s_suppkey, (SELECT min(place_id) FROM a), 'neighbour' FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a) AND s_suppkey NOT IN (SELECT s_suppkey FROM b)""")
def placement_cascade(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    exact = lambda left, _: left.join(part, (F.col("p_size") == F.col("s_nationkey")) & (F.expr("p_partkey % 50") == F.expr("s_suppkey % 50"))).select("s_suppkey", F.col("p_partkey").alias("place_id"))
    near = lambda left, _: left.where("s_acctbal > 2000").join(part.where("p_partkey % 3 = 0"), F.col("p_size") == F.col("s_nationkey") + 20).select("s_suppkey", F.col("p_partkey").alias("place_id"))
    # one row of the placements so far
    rest = lambda left, placed: left.join(F.broadcast(placed.where("rule = 'exact'").agg(F.min("place_id").alias("place_id"))), F.lit(True)).select("s_suppkey", "place_id")
    return linkage.cascade(table(spark, sf_dir, "supplier"), "s_suppkey", [("exact", exact), ("near", near), ("neighbour", rest)])


# ---------------------------------------------------------------- clusters

LINKS = "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey <> b.p_partkey AND (a.p_size = b.p_size OR a.p_type = b.p_type AND floor(a.p_retailprice) % 10 = floor(b.p_retailprice) % 10)"


@query(f"WITH RECURSIVE l AS ({LINKS}), r AS (SELECT p_partkey AS n, p_partkey AS x FROM part UNION SELECT r.n, l.b FROM r JOIN l ON l.a = r.x) SELECT n AS p_partkey, min(x) AS component FROM r GROUP BY n")
def connected_components(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("tail", F.expr("CAST(floor(p_retailprice) AS INT) % 10"))
    edges = cluster.star_edges(part, "p_partkey", ["p_brand", "p_name"], [["p_size"], ["p_type", "tail"]])
    return cluster.connected_components(part, edges, "p_partkey")


@query("SELECT p_brand, p_name, p_size, min(p_partkey) AS a, count(*) - 1 AS n_edges FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1")
def pair_edges(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    edges = cluster.star_edges(part, "p_partkey", ["p_brand", "p_name"], [["p_size"]]).groupBy("a").agg(F.count("*").alias("n_edges"))
    return edges.join(part, F.col("a") == F.col("p_partkey")).select("p_brand", "p_name", "p_size", "a", "n_edges")


@query("""SELECT p_brand, max_by(p_name, length(p_name) * 1000000 - p_partkey) AS p_name, max_by(p_type, length(p_type) * 1000000 - p_partkey) AS p_type, min_by(p_size, p_partkey) AS p_size, count(*) AS entry_count FROM part GROUP BY p_brand""")
def canonical_longest(spark, sf_dir):
    return cluster.canonical_values(table(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_name", "p_type"], ["p_size"])


# ---------------------------------------------------------------- statistics


@query("""WITH t AS (SELECT coalesce(lang, 'unknown') AS section, source AS page, coalesce(quality = 1, false) AS v, coalesce(toxic = 1 AND quality = 0, false) AS n, n_chars > 3000 AS e FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT section, page, CASE WHEN grouping(section) = 1 THEN 'overall' WHEN grouping(page) = 1 THEN 'section' ELSE 'page' END AS grain, count(*) AS total, count(*) FILTER (WHERE v) AS verified, count(*) FILTER (WHERE n) AS needs_review, count(*) FILTER (WHERE e) AS edited,
count(*) - count(*) FILTER (WHERE v) - count(*) FILTER (WHERE n) AS unreviewed FROM t GROUP BY GROUPING SETS ((section, page), (section), ())""")
def review_rollup(spark, sf_dir):
    rows = _clustered(spark, sf_dir)
    return quality.review_rollup(rows, "lang", "source", F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit(False)), F.col("n_chars") > 3000)


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS linked, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice < 100000) AS no_number, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice >= 100000 AND o_orderpriority = '1-URGENT') AS no_place,
count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice >= 100000 AND o_orderpriority <> '1-URGENT') AS other FROM orders""")
def coverage_buckets(spark, sf_dir):
    return quality.buckets(table(spark, sf_dir, "orders"), [("linked", F.col("o_orderstatus") == "F"), ("no_number", F.col("o_totalprice") < 100000), ("no_place", F.col("o_orderpriority") == "1-URGENT")])


@query("""SELECT lang AS section, min('stem-' || lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS first_stem, min(n_chars) AS first_page, count(*) AS entries, CAST(right(min('stem-' || lpad(CAST(doc_id AS VARCHAR), 8, '0')), 4) AS INTEGER) AS first_number FROM documents WHERE lang <> '' GROUP BY lang""")
def section_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("stem", F.concat(F.lit("stem-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")))
    return quality.section_summary(rows, "lang", "stem", "n_chars")


@query("SELECT p_name, count(*) AS n FROM part WHERE lower(p_name) <> 'red ring' GROUP BY p_name HAVING count(*) > 10")
def having_established(spark, sf_dir):
    return quality.established(table(spark, sf_dir, "part"), "p_name", 10, ["Red Ring"])


@query("SELECT lower(trim(p_name)) AS key, count(*) AS n, md5(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS ids_md5 FROM part GROUP BY 1")
def inverted_index(spark, sf_dir):
    out = quality.inverted_index(table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_partkey"))
    return out.select("key", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("ids_md5"))


@query("""WITH c AS (SELECT user_id, CAST(value AS INTEGER) // 30 AS ballot, count(*) AS votes FROM events GROUP BY ALL), r AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS cast_, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, ballot) AS r FROM c)
SELECT user_id, CAST(ballot AS BIGINT) AS ballot, votes, CAST(cast_ AS BIGINT) AS "cast" FROM r WHERE r = 1 AND votes >= 3 AND votes >= 0.6 * cast_""")
def vote_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.floor(F.round("value") / 30).alias("ballot"))
    return quality.vote(rows, ["user_id"], "ballot")


@query("WITH m AS (SELECT event_type, median(value) AS median FROM events GROUP BY 1) SELECT event_id, e.event_type, value, round(median, 6) AS median FROM events e JOIN m ON m.event_type = e.event_type WHERE value <= 1.25 * median")
def median_filter(spark, sf_dir):
    return quality.within_median(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value").withColumn("median", F.round("median", 6))


@query("SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_returnflag")
def upper_median(spark, sf_dir):
    return quality.upper_median(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT l_suppkey, count(DISTINCT (l_partkey, l_returnflag)) AS distinct_parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_partkey, l_returnflag)) >= 100")
def pile_detect(spark, sf_dir):
    return quality.piles(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_partkey", "l_returnflag"], 100)


@query("SELECT CAST(least(floor(l_discount * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 1 GROUP BY 1")
def histogram10(spark, sf_dir):
    return quality.histogram(table(spark, sf_dir, "lineitem"), F.col("l_discount"))


PRICES = [("click", 0.5), ("error", 2.0), ("purchase", 1.25)]


@query("""SELECT event_type AS model, sum(user_id)::BIGINT AS units, count(*) AS calls, sum(user_id) * CASE event_type WHEN 'click' THEN 0.5 WHEN 'error' THEN 2.0 WHEN 'purchase' THEN 1.25 END::DOUBLE AS cost FROM events GROUP BY event_type""")
def cost_report(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "model string, price double")
    return quality.cost_report(table(spark, sf_dir, "events"), prices, "event_type", "user_id")


@query("""WITH g AS (SELECT value, (lag(value) OVER w + lead(value) OVER w) / 2 AS guess FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT CASE WHEN abs(value - guess) <= 1 THEN 'same' WHEN abs(value - guess) <= 10 THEN 'near' ELSE 'further' END AS bucket, count(*) AS n FROM g WHERE guess IS NOT NULL GROUP BY 1""")
def holdout_loo(spark, sf_dir):
    return quality.leave_one_out(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "value", [("same", 1.0), ("near", 10.0)])


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_totalprice > 250000) AS matched, round(100.0 * count(*) FILTER (WHERE o_totalprice > 250000) / count(*), 1) AS percent FROM orders")
def match_rate(spark, sf_dir):
    return quality.match_rate(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 250000)


@query("""SELECT event_type, count(*) AS n_ids, count(*) FILTER (WHERE user_id < 100) AS n_valid, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value < 20) AS low, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE user_id < 100) / count(*) ELSE 0 END, 6) AS ratio FROM events GROUP BY event_type""")
def alignment_quality(spark, sf_dir):
    n, ok = F.count("*"), F.count_if(F.col("user_id") < 100)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(n.alias("n_ids"), ok.alias("n_valid"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") < 20).alias("low"), F.round(F.when(n > 0, ok / n).otherwise(0.0), 6).alias("ratio"))


# ---------------------------------------------------------------- ordered rows

ANCHOR = "CASE WHEN event_type = 'error' AND value > 60 THEN CASE WHEN value < 80 THEN 'A' ELSE 'b' END END"


@query(f"""WITH t AS (SELECT event_id, user_id, {ANCHOR} AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
n AS (SELECT event_id, last_value(a IGNORE NULLS) OVER b AS p, first_value(a IGNORE NULLS) OVER f AS q, first_value(CASE WHEN a IS NOT NULL THEN i END IGNORE NULLS) OVER f - i AS d FROM t
WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING))
SELECT event_id, CASE WHEN p IS NOT NULL AND (q IS NULL OR lower(p) = lower(q)) THEN p WHEN p IS NULL AND d <= 5 THEN q END AS inferred FROM n""")
def nearest_anchor_60(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return ordered.nearest_anchor(rows, "user_id", ["event_id"], F.expr(ANCHOR)).select("event_id", "inferred")


@query("SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def prev_next(spark, sf_dir):
    return ordered.neighbours(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "prev", "next")


@query("""WITH e AS (SELECT user_id, event_id, value % 50 AS value FROM events), g AS (SELECT user_id AS k, value AS v, lead(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS nx FROM e),
b AS (SELECT k, count(*) AS n, max(nx - v) AS g, max_by((v + nx) / 2, {'g': nx - v, 'v': -v}) FILTER (WHERE nx IS NOT NULL) AS mid FROM g GROUP BY k)
SELECT b.k AS user_id, round(mid, 6) AS mid FROM b JOIN e ON e.user_id = b.k WHERE n >= 6 AND g >= 4 AND mid BETWEEN 15 AND 35
GROUP BY b.k, mid, n HAVING least(count(*) FILTER (WHERE value < mid), count(*) FILTER (WHERE value >= mid)) >= greatest(3, 0.15 * n)""")
def gap_detect(spark, sf_dir):
    out = ordered.column_gap(table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("value % 50").alias("value")), "user_id", "value", F.lit(50.0), "event_id")
    return out.withColumn("mid", F.round("mid", 6))


@query("""WITH s AS (SELECT conv_id, turn, greatest(1, length(text)) AS n FROM conversations)
SELECT conv_id, turn, round(coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (sum(n + 1) OVER (PARTITION BY conv_id) - 1), 9) AS start,
round((coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n) / (sum(n + 1) OVER (PARTITION BY conv_id) - 1), 9) AS "end" FROM s""")
def prefix_sum(spark, sf_dir):
    out = ordered.prefix_share(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.length("text"))
    return out.select("conv_id", "turn", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS BIGINT) AS chunk FROM events")
def chunk50(spark, sf_dir):
    return ordered.chunk(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("event_id", "chunk")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id FROM r WHERE n <= 10 OR r IN (SELECT i * r.n // 10 FROM range(10) t(i))""")
def systematic_sample(spark, sf_dir):
    return ordered.systematic_sample(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], 10).select("event_id")


@query("""WITH t AS (SELECT event_id, user_id, event_id AS pos, CASE WHEN event_type <> 'click' THEN value END AS v FROM events), k AS (SELECT *, CASE WHEN v IS NOT NULL THEN {'pos': pos, 'v': v} END AS kv FROM t),
n AS (SELECT *, last_value(kv IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(kv IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM k)
SELECT event_id, round(coalesce(v, CASE WHEN pos - p.pos <= 500 AND q.pos - pos <= 500 THEN p.v + (q.v - p.v) * (pos - p.pos) / (q.pos - p.pos) END), 3) AS filled FROM n""")
def interpolate(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "click", F.col("value")).alias("v"))
    return ordered.interpolate(rows, ["user_id"], "event_id", "v", [], 500).select("event_id", F.round("filled", 3).alias("filled"))


# ---------------------------------------------------------------- sets and output


@query("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey * 7 FROM supplier")
def union_sets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).union(table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 7")).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey * 7 FROM supplier")
def intersect_sets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 7"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey * 7 FROM supplier")
def except_sets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "supplier").selectExpr("s_suppkey * 7"))


@query("""SELECT n_nationkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || n_nationkey || ',' || n_regionkey || ']},"properties":{"n_nationkey":' || n_nationkey || ',"r_name":' || CASE WHEN n_regionkey = 0 THEN 'null' ELSE '"' || r_name || '"' END || '}}' AS feature FROM nation JOIN region ON r_regionkey = n_regionkey""")
def geojson_features(spark, sf_dir):
    from quarry.sources.writers import features

    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    point = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("n_nationkey").cast("string"), F.lit(","), F.col("n_regionkey").cast("string"), F.lit("]}"))
    rows = rows.withColumn("geometry", point).withColumn("r_name", F.when(F.col("n_regionkey") != 0, F.col("r_name")))
    return features(rows, "geometry", ["n_nationkey", "r_name"], "n_nationkey")


@query("SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def windowed_activity(spark, sf_dir):
    from quarry.streaming.corrections import windowed_activity as activity

    out = activity(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("event_type"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def events_lww_stream(spark, sf_dir):
    """The events as a stream of edits (a glob, since a stream's source is no single file), merged batch by batch; the newest version of the table."""
    import uuid

    from quarry.operators.cluster import shared_folder
    from quarry.streaming.corrections import merge_stream, newest

    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    batch = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    edits = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/even[t]s.parquet").select(*batch.columns)
    merge_stream(edits, f"{path}/table", "user_id", "ts", "event_id", f"{path}/checkpoint").awaitTermination()
    return newest(batch, f"{path}/table").select("user_id", "event_id", "event_type")




from quarry.plans import cadastre, records, upkeep  # noqa: E402, F401  register their queries here
