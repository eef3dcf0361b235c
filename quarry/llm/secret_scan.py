"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong spans (assigned secrets, access key ids, long hex) are always reported.
Weak parts are account names, unlabelled tokens of mixed characters, and
endpoints; one alone is noise. The parts of a document become intervals, and an
interval join brings together parts that lie within ``scope`` code points of each
other; a weak part is reported only if a part that complements it is there: an
identifier or endpoint for a secret, a secret for an identifier, an identifier
and a secret for an endpoint.

The places of matches come from the text between them: the lengths of the pieces
that a split by the pattern leaves and of the matches alternate.

Defined results: a null text is empty and has no spans; an empty table gives an
empty result; repeated rows are scanned each for itself; equal places of two
kinds are ordered as the kinds are listed; spans and texts may have any length;
parts that overlap don't complement each other; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle

SCOPE = 200
#: Strong kinds in the order of reports: pattern, group whose length counts, least length. Fixed values.
STRONG = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Weak kinds: pattern and role.
WEAK = (
    ("account", r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])"),
    ("endpoint", r"""(?i)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{4,}+"""),
)
KINDS = [k for k, *_ in STRONG] + [k for k, _ in WEAK]
#: Which roles a weak kind needs in its scope. access and account identify; assign, hex and opaque are secrets.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "opaque": "secret", "endpoint": "endpoint"}
NEEDS = {"account": ("secret",), "opaque": ("identifier", "endpoint"), "endpoint": ("identifier", "secret")}
#: Matches of a text are placed in groups of so many, as each place costs a copy of its group's list.
GROUP = 256
SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Places of the pattern's matches whose ``group`` has at least ``least`` characters."""
    texts = F.regexp_extract_all(text, F.lit(pattern), 0)
    counted = F.transform(texts, lambda x: F.length(F.regexp_extract(x, pattern, group)))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.zip_with(F.transform(texts, F.length), F.arrays_zip(F.slice(gaps, 1, F.size(texts)).alias("gap"), counted.alias("counted")), lambda n, m: F.struct(m["gap"].alias("gap"), n.alias("size"), m["counted"].alias("counted")))
    groups = F.transform(F.sequence(F.lit(1), F.size(matches), F.lit(GROUP)), lambda at: F.slice(matches, at, GROUP))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + m["size"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["counted"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def placed(acc: Column, own: Column) -> Column:
        begun = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(own, begun, step, lambda g: F.struct(g["at"].alias("at"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

    begun = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    found = F.aggregate(groups, begun, placed, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def find_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, strong, weak): the spans of each text, without the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    strong = F.array_sort(F.concat(*[_spans(F.col("text"), k, p, g, n) for k, (_, p, g, n) in enumerate(STRONG)]))
    weak = F.concat(*[_spans(F.col("text"), len(STRONG) + k, p, 0, 1) for k, (_, p) in enumerate(WEAK)])
    return rows.select("doc_id", "row", strong.alias("strong"), weak.alias("weak"))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, linked): the weak spans whose complements lie within ``scope`` code points.

    The interval join meets on (row, cell of ``scope`` code points); a span is in
    every cell that it and the scope around it touch, so one cell holds a bounded number of parts.
    """
    roles = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (k, ROLE[kind])])
    every = parts.where(F.size("weak") > 0).select("row", F.explode(F.concat("strong", "weak")).alias("s")).select("row", "s.*")
    every = every.withColumn("role", roles[F.col("kind")])
    left = every.where(F.col("kind") >= len(STRONG)).withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))))
    right = every.select("row", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("cell"))
    near = (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
    # an opaque token that is part of a stronger span, or of an endpoint, is not a second part
    apart = (F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start"))
    met = left.join(right, ["row", "cell"]).where(near & apart)
    there = met.groupBy("row", "start", "kind", "end").agg(*[F.max(F.col("o_role") == r).alias(f"has_{r}") for r in ("identifier", "secret", "endpoint")])
    account, opaque, endpoint = (KINDS.index(k) for k in ("account", "opaque", "endpoint"))
    enough = (
        ((F.col("kind") == account) & F.col("has_secret"))
        | ((F.col("kind") == opaque) & (F.col("has_identifier") | F.col("has_endpoint")))
        | ((F.col("kind") == endpoint) & F.col("has_identifier") & F.col("has_secret"))
    )
    return there.where(enough).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).cast(SPAN).alias("linked"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, strong, linked) for every row."""
    parts = settle(find_parts(docs))
    return parts.join(link_parts(parts, scope), "row", "left").select("doc_id", "strong", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts and digests of the spans of every row."""
    out = scan_secrets(docs, scope)
    of = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_told(F.col("strong")), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("strong", "linked"))).alias("spans"),
    )
