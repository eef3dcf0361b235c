"""Writers: feature collections, combined indexes, page documents, ALTO pages, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def features(rows: DataFrame, geometry: str, properties: list[str], key: str) -> DataFrame:
    """(key, feature): one GeoJSON feature a row, nulls kept; an invalid geometry raises with its key."""
    parsed = F.try_parse_json(F.col(geometry))
    sure = F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("invalid geometry of "), F.col(key).cast("string")))).otherwise(F.col(geometry))
    told = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return rows.select(key, F.concat(F.lit('{"type":"Feature","geometry":'), sure, F.lit(',"properties":'), told, F.lit("}")).alias("feature"))


def feature_collection(rows: DataFrame, geometry: str, properties: list[str], key: str) -> DataFrame:
    """One row: the collection as JSON, features by key, and its SHA-1 tag. For one map's worth of rows; larger sets write ``features`` a line each."""
    one = features(rows, geometry, properties, key).agg(F.array_sort(F.collect_list(F.struct(key, "feature"))).alias("f"))
    told = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}"))
    return one.select(told.alias("json")).withColumn("etag", F.sha1("json"))


def combined_indexes(entries: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """search, address, street, cross_reference and manifest tables of flattened entries."""
    told = entries.withColumn("id", F.concat(F.lit("entry_"), F.col("stable_id")))
    by = lambda key: told.select(F.lower(F.nullif(key, F.lit(""))).alias("key"), F.struct("id", "name", "stem").alias("e")).where("key is not null").groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    xrefs = told.select(F.col("id").alias("source_id"), "stem", F.explode("cross_references").alias("x"))
    return {
        "search": told,
        "address": by(F.col("address_full")),
        "street": by(F.coalesce(F.nullif(F.col("address_street_expanded"), F.lit("")), F.col("address_street"))),
        "cross_reference": xrefs.select("source_id", "stem", F.coalesce("x.type", "x.text").alias("target"), F.coalesce("x.page", "x.page_number").alias("target_page")),
        "manifest": pages.select("stem", "scan_file", "page_number", F.coalesce("section", F.lit("unknown")).alias("section"), "dimensions"),
    }


def write_indexes(indexes: dict[str, DataFrame], path: str) -> None:
    for name, df in indexes.items():
        df.write.mode("overwrite").json(f"{path}/{name}_index")


def alto_pages(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(stem, alto): a page's words as ALTO XML, each tagged with the last entry that refers to it."""
    tags = entries.select("stem", "entry_index", F.explode("word_ids").alias("id")).groupBy("stem", "id").agg(F.max("entry_index").alias("tag"))
    told = words.join(tags, ["stem", "id"], "left")
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    box = F.format_string('HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d"', F.col("bbox")[0], F.col("bbox")[1], F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1])
    ref = F.when(F.col("tag").isNotNull(), F.format_string(' TAGREFS="entry_%04d"', F.col("tag"))).otherwise("")
    word = F.concat(F.lit('<String ID="'), F.col("id"), F.lit('" CONTENT="'), escape(F.col("text")), F.lit('" '), box, ref, F.lit("/>"))
    gather = lambda keys, tag, body: F.concat(F.lit(f"<{tag}>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, body.alias("_x")))), lambda x: x["_x"]), ""), F.lit(f"</{tag}>"))
    lines = told.groupBy("stem", "block", "line").agg(gather(["word"], "TextLine", word).alias("x"))
    blocks = lines.groupBy("stem", "block").agg(gather(["line"], "TextBlock", F.col("x")).alias("x"))
    head = '<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace>'
    return blocks.groupBy("stem").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda b: b["x"]), ""), F.lit("</PrintSpace></Page></Layout></alto>")).alias("alto"))


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """The serving tables as Parquet; entries are laid out by section."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("section") if name == "entries" and "section" in df.columns else writer).parquet(f"{path}/{name}")


def write_snapshot(rows: DataFrame, path: str, kind: str = "edits-snapshot/v1") -> None:
    """Edited and flagged entries as JSON lines that name their kind."""
    from quarry.operators.review import touched

    touched(rows, "edited_at", ["flag_verified", "flag_needs_review"]).withColumn("schema", F.lit(kind)).write.mode("overwrite").json(path)


def write_delimited(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited files with a header; nulls are empty."""
    rows.write.mode("overwrite").option("nullValue", "").csv(path, header=True, sep=sep)
