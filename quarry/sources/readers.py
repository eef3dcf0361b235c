"""Readers of page documents, OCR trees, corrections, caches, features and delimited files.

Every reader has a fixed schema, so nothing is inferred by a pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.trees import repaired
from quarry.sources.schemas import GEOCODE, MATCH, OCR, OVERRIDE, PAGE


def _stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"(\.ocr)?\.json$", "")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page document, with its stem; unreadable files give rows whose fields are null."""
    return spark.read.schema(PAGE).json(path, multiLine=True, mode="PERMISSIVE").withColumn("stem", _stem())


def read_ocr(spark: SparkSession, path: str, version: int = 2) -> DataFrame:
    """OCR trees of the current cache version, words laid out and columns in reading order (``trees.repaired``); unreadable files give none."""
    return repaired(spark.read.schema(OCR).json(path, multiLine=True).withColumn("stem", _stem()).where(F.col("schema_version") == version))


def ocr_words(trees: DataFrame) -> DataFrame:
    """(stem, block, line, word, id, text, bbox, line_id) of every word in reading order."""
    lines = trees.select("stem", F.posexplode("blocks").alias("block", "b")).select("stem", "block", F.posexplode("b.lines").alias("line", "l"))
    return lines.select("stem", "block", "line", F.posexplode("l.words").alias("word", "w")).select("stem", "block", "line", "word", "w.id", "w.text", "w.bbox", "w.line_id")


def page_text(words: DataFrame) -> DataFrame:
    """(stem, full_text): words by line, lines by page; blank lines are dropped."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ")
    lines = words.groupBy("stem", "block", "line").agg(line.alias("t")).where(F.btrim("t") != "")
    return lines.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "t"))), lambda x: x["t"]), "\n").alias("full_text"))


def _json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).where(~F.col("_metadata.file_name").startswith("._")).select("value", _stem().alias("stem"))
    return texts.select("stem", F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(stem, stable_id, fields, flags, bbox, fingerprint, edited_at); ids of other pages and corrupt files give no rows."""
    return _json_map(spark, path, OVERRIDE).where(F.col("key").startswith(F.concat("stem", F.lit(":")))).select("stem", F.col("key").alias("stable_id"), "v.*")


def read_geocodes(spark: SparkSession, path: str) -> DataFrame:
    return _json_map(spark, path, GEOCODE).select(F.col("key").alias("address"), "v.*")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(stable_id, pand_id, approx): places by entry; of several places of an entry the last in the file, then the largest id."""
    found = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{MATCH}>"))).alias("at", "m")).where("m.key <> '_summary'")
    each = found.select("at", F.col("m.key").alias("pand_id"), F.explode("m.value.addresses").alias("address", "a"))
    each = each.select("at", "pand_id", F.explode("a.entries").alias("stable_id"), F.coalesce("a.approx", F.lit(False)).alias("approx"))
    return each.groupBy("stable_id").agg(F.max(F.struct("at", "pand_id", "approx")).alias("m")).select("stable_id", "m.pand_id", "m.approx")


def read_features(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON collections or one a line: properties, geometry as text, and its bounding box."""
    feature = f"struct<properties: struct<{properties}>, geometry: string>"
    if lines:
        told = spark.read.text(path).select(F.from_json("value", feature).alias("f"))
    else:
        told = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    return with_bounds(told.select("f.properties.*", "f.geometry"))


def with_bounds(rows: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds west, south, east, north and the middle of a Polygon's or MultiPolygon's bounding box."""
    kind = F.get_json_object(geometry, "$.type")
    told = F.get_json_object(geometry, "$.coordinates")
    polygon = F.flatten(F.from_json(told, "array<array<array<double>>>"))
    multi = F.flatten(F.flatten(F.from_json(told, "array<array<array<array<double>>>>")))
    points = F.when(kind == "Polygon", polygon).when(kind == "MultiPolygon", multi)
    out = rows.withColumn("_p", points)
    x, y = F.transform("_p", lambda p: p[0]), F.transform("_p", lambda p: p[1])
    out = out.withColumns({"west": F.array_min(x), "south": F.array_min(y), "east": F.array_max(x), "north": F.array_max(y)}).drop("_p")
    return out.withColumns({"mid_x": (F.col("west") + F.col("east")) / 2, "mid_y": (F.col("south") + F.col("north")) / 2})


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """Text columns and _bad: the row as it stands where it has fewer or more fields, so that none is lost unseen.

    Files are split among tasks, so a field doesn't run over the end of a line.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=f"{schema}, _bad string", sep=sep, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def discover_scans(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff")) -> DataFrame:
    """(path, stem, page_number) of image files; contents aren't read."""
    glob = "*.{" + ",".join(x for k in kinds for x in (k, k.upper())) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    name = F.substring_index("path", "/", -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem")).withColumn("page_number", scan_page(F.col("stem")))


def scan_page(stem: Column, offset: int = 0) -> Column:
    """The number at the end of a scan's name less the offset, 1 at least."""
    return F.greatest(F.lit(1), F.regexp_extract(stem, r"(\d+)$", 1).try_cast("int") - offset)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """(stem, order, level, page, left, top, width, height, text) of a text layer in tab-separated rows with level codes, quotes as they are.

    A file's rows are numbered as they stand, which needs a file in one task; a text layer is one book's.
    """
    fields = ("level", "page_num", "par_num", "block_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")
    whole = spark.read.text(path, wholetext=True).select(_stem().alias("stem"), F.posexplode(F.split("value", "\r?\n")).alias("order", "line"))
    parts = whole.where("order > 0 and line <> ''").withColumn("f", F.split("line", "\t", len(fields)))
    named = {c: F.get("f", F.lit(k)) for k, c in enumerate(fields)}
    number = lambda c, kind: named[c].try_cast(kind).alias(c)
    return parts.select("stem", "order", number("level", "int"), named["page_num"].try_cast("int").alias("page"), *[number(c, "double") for c in ("left", "top", "width", "height")], named["text"].alias("text"))


def read_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Sidecar files of usage or failures, one object each, with the stem; unreadable ones are left out."""
    bad = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True, mode="PERMISSIVE")
    return bad.withColumn("stem", _stem()).where("_bad is null").drop("_bad")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text list, one a line; blank lines and comments are left out."""
    return spark.read.text(path).select(F.btrim("value").alias("stem")).where("stem <> '' and not startswith(stem, '#')").distinct()


def canonical_streets(features: DataFrame, addresses: str = "addresses", street: str = "openbare_ruimte") -> DataFrame:
    """Distinct streets of the features' addresses."""
    return features.select(F.explode(addresses).alias("a")).select(F.col(f"a.{street}").alias("street")).where("coalesce(street, '') <> ''").distinct()


def stems(pages: DataFrame) -> DataFrame:
    return pages.select("stem").distinct().orderBy("stem")
