"""Words and boxes of pages: coerced word ids, boxes of spans, alignment of entries with words, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import build_address, fingerprint, searchable_text

#: The keys under which an object holds its word id, in order of preference.
ID_KEYS = ("id", "word_id", "wid", "ID")
#: Levels of lists and objects that are opened.
NESTED = 6


def _opened(value: Column) -> Column:
    """A variant as an array of variants: a list's items, what an object holds as its id, or itself."""
    kind = F.schema_of_variant(value)
    item = lambda k: F.try_variant_get(value, f"$.{k}", "variant")
    held = F.coalesce(*(F.when(item(k).isNotNull(), F.array(item(k))) for k in ID_KEYS), F.array().cast("array<variant>"))
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).when(kind.startswith("OBJECT"), held).otherwise(F.array(value))


def _padded(digits: Column) -> Column:
    """``w_`` and a whole number of at least four places."""
    plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.concat(F.lit("w_"), F.when(F.length(plain) < 4, F.lpad(plain, 4, "0")).otherwise(plain))


def _as_id(value: Column) -> Column:
    """The word id of a scalar, or null."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    told = F.when(kind == "BOOLEAN", _padded(F.when(text == "true", "1").otherwise("0"))).when(kind == "BIGINT", F.when(text.startswith("-"), F.concat(F.lit("w_-"), F.lpad(F.substring(text, 2, 40), 3, "0"))).otherwise(_padded(text)))
    word = F.btrim(text, F.lit(" \t\r\n\f\x0b"))
    return told.when(kind == "STRING", F.when(word.rlike("^[0-9]+$"), _padded(word)).otherwise(F.nullif(word, F.lit(""))))


def word_ids(raw: Column) -> Column:
    """Word ids of JSON text of any shape, level by level: lists are opened in place, objects give the id that they hold; unreadable text gives none."""
    values = F.coalesce(F.array(F.try_parse_json(raw)), F.array().cast("array<variant>"))
    for _ in range(NESTED):
        values = F.flatten(F.transform(values, _opened))
    return F.coalesce(F.filter(F.transform(values, _as_id), lambda w: w.isNotNull()), F.array().cast("array<string>"))


def valid_ids(ids: Column, known: Column) -> Column:
    """struct(valid, invalid): the ids that are known and those that aren't, in their order."""
    there = lambda x: F.array_contains(known, x)
    return F.struct(F.filter(ids, there).alias("valid"), F.filter(ids, lambda x: ~there(x)).alias("invalid"))


def span_boxes(spans: DataFrame, words: DataFrame, lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, box, n_words): the union of the words' boxes, from the top of their highest line to the bottom of their lowest.

    ``spans`` has by, page and ids; ``words`` page, id, line_id and box; ``lines``
    page, line_id and box. Words without a line keep their own height.
    """
    each = spans.select(*by, "page", F.explode("ids").alias("id"))
    held = words.select("page", "id", "line_id", F.col("box").alias("w")).join(lines.select("page", "line_id", F.col("box").alias("l")), ["page", "line_id"], "left")
    met = each.join(held, ["page", "id"])
    top, low = F.coalesce(F.col("l")[1], F.col("w")[1]), F.coalesce(F.col("l")[3], F.col("w")[3])
    box = F.array(F.min(F.col("w")[0]), F.min(top), F.max(F.col("w")[2]), F.max(low))
    return met.groupBy(*by).agg(box.alias("box"), F.count("*").alias("n_words"))


def align_entries(entries: DataFrame, words: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries (page, stable_id, raw_ids, name, address_street, address_number, ...) with ids, box, address_full, searchable_text, fingerprint and confidence.

    Confidence is the share of the ids that the page's words know.
    """
    told = entries.withColumn("_ids", word_ids(F.col("raw_ids")))
    known = words.select("page", "id").distinct()
    each = told.select("stable_id", "page", F.posexplode("_ids").alias("_at", "id")).join(known.withColumn("_k", F.lit(True)), ["page", "id"], "left")
    ok = each.groupBy("stable_id").agg(F.array_sort(F.collect_list(F.when(F.col("_k"), F.struct("_at", "id")))).alias("_ok"), F.count("*").alias("_n"))
    out = told.join(ok, "stable_id", "left").withColumn("ids", F.coalesce(F.transform("_ok", lambda x: x["id"]), F.array().cast("array<string>")))
    boxes = span_boxes(out.select("stable_id", "page", "ids"), words, lines, ["stable_id"]).select("stable_id", "box")
    full = build_address(F.col("address_street"), F.col("address_number"))
    out = out.join(boxes, "stable_id", "left").withColumn("address_full", full)
    return out.withColumns(
        {
            "searchable_text": searchable_text(F.col("name"), F.col("address_full")),
            "fingerprint": fingerprint(F.col("name"), F.col("address_full")),
            "confidence": F.when(F.col("_n") > 0, F.size("ids") / F.col("_n")).otherwise(0.0),
        }
    ).drop("_ids", "_ok", "_n")


def word_coverage(words: DataFrame, entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_words, n_used, share): words that entries refer to, each counted once."""
    used = entries.select("page", F.explode("ids").alias("id")).distinct().withColumn("_u", F.lit(True))
    return words.join(used, ["page", "id"], "left").groupBy(*by).agg(F.count("*").alias("n_words"), F.count("_u").alias("n_used"), (F.count("_u") / F.count("*")).alias("share"))


def page_documents(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(page, json): a page's fields with its whole word list in order, one document each."""
    gathered = words.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("words"))
    out = pages.join(gathered, "page", "left").withColumn("words", F.coalesce("words", F.array().cast(gathered.schema["words"].dataType)))
    return out.select("page", F.to_json(F.struct(*pages.columns, "words"), {"ignoreNullFields": "false"}).alias("json"))


def page_xml(lines: DataFrame) -> DataFrame:
    """(page, xml): text lines with their corner points, in order, as PageXML."""
    safe = F.col("text")
    for c, put in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(c), F.lit(put))
    points = F.format_string("%d,%d %d,%d %d,%d %d,%d", *[F.col("box")[k] for k in (0, 1, 2, 1, 2, 3, 0, 3)])
    line = F.concat(F.lit('<TextLine id="'), F.col("line_id"), F.lit('"><Coords points="'), points, F.lit('"/><TextEquiv><Unicode>'), safe, F.lit("</Unicode></TextEquiv></TextLine>"))
    told = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line_id", line.alias("x")))).alias("l"))
    head = '<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page>'
    return told.select("page", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</Page></PcGts>")).alias("xml"))


def word_dump(words: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(page, line): a word's columns with tabs between."""
    return words.select("page", F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def first_boxed(entries: DataFrame, box: str) -> DataFrame:
    """(stem, first_index): sorted stems and the first entry with a box, null without one."""
    return entries.groupBy("stem").agg(F.min(F.when(F.col(box).isNotNull(), F.col("entry_index"))).alias("first_index")).orderBy("stem")
