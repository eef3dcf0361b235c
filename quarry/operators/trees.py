"""Page trees of blocks, lines and words: repaired, put in reading order and built from level codes.

A page is one row with nested arrays, and all of this rewrites arrays within the row: no
page is taken apart over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.schemas import WORD

LINES = f"array<struct<id: string, bbox: array<int>, words: array<{WORD}>>>"
#: Fixed values of the reading order: lines of a block, and what makes a gap between columns.
BLOCK_LINES = 50
LEAST_LINES, LEAST_GAP, MIDDLE, LEAST_SIDE, SIDE_SHARE = 6, 0.08, (0.30, 0.70), 3, 0.15


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(sizes: Column) -> Column:
    """Sums of the numbers before each of an array of them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(sizes, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])


def repaired_words(line: Column) -> Column:
    """The line's words, laid out anew along the line where half of them or more share a box to the nearest ten.

    Each word then takes its share of the line's width by letters, one letter's space between two words, and all have the
    height of the words together. Halves round to the even number. A line without a box keeps its words as they are.
    """
    words = line["words"]
    tens = F.transform(words, lambda w: F.transform(w["bbox"], lambda v: (F.bround(v / 10.0) * 10).cast("int")))
    shared = lambda t: F.size(F.filter(t, lambda x: F.size(F.filter(t, lambda y: y == x)) > 1))
    chars = F.transform(words, lambda w: F.greatest(F.lit(1), F.length(F.coalesce(w["text"], F.lit("")))))

    def laid(c: Column) -> Column:
        sides = F.struct(
            (F.aggregate(c, F.lit(0), lambda s, n: s + n) + F.size(words) - 1).alias("total"), _before(F.transform(c, lambda n: n + 1)).alias("starts"), F.greatest(F.lit(1), line["bbox"][2] - line["bbox"][0]).alias("span"),
            F.array_min(F.transform(words, lambda w: w["bbox"][1])).alias("top"), F.array_max(F.transform(words, lambda w: w["bbox"][3])).alias("low"),
        )

        def moved(s: Column) -> Column:
            x = lambda cursor: line["bbox"][0] + F.floor(cursor / s["total"] * s["span"]).cast("int")
            return F.transform(words, lambda w, i: w.withField("bbox", F.array(x(F.get(s["starts"], i)), s["top"], x(F.get(s["starts"], i) + F.get(c, i)), s["low"])))

        return _let(sides, moved)

    broken = line["bbox"].isNotNull() & (F.size(words) >= 2) & (_let(tens, shared) * 2 >= F.size(words))
    return F.when(broken, _let(chars, laid)).otherwise(words)


def column_gap(centres: Column, width: Column) -> Column:
    """The middle of the widest gap between the sorted centres of lines, if it is wide and central and both sides are filled; else null."""

    def widest(at: Column) -> Column:
        n = F.size(at)
        gaps = F.transform(F.sequence(F.lit(0), n - 2), lambda k: F.struct((F.get(at, k + 1) - F.get(at, k)).alias("wide"), (-k).alias("k"), ((F.get(at, k) + F.get(at, k + 1)) / 2).alias("mid")))

        def fits(b: Column) -> Column:
            left = F.size(F.filter(at, lambda c: c < b["mid"]))
            filled = F.least(left, n - left) >= F.greatest(F.lit(LEAST_SIDE), SIDE_SHARE * n)
            return F.when((b["wide"] >= LEAST_GAP * width) & b["mid"].between(MIDDLE[0] * width, MIDDLE[1] * width) & filled, b["mid"])

        return F.when(n >= LEAST_LINES, _let(F.array_max(gaps), fits))

    return _let(F.array_sort(centres), widest)


def _enclosing(lines: Column) -> Column:
    low, high = (lambda k: F.array_min(F.transform(lines, lambda x: x["bbox"][k]))), (lambda k: F.array_max(F.transform(lines, lambda x: x["bbox"][k])))
    return F.array(low(0), low(1), high(2), high(3))


def _numbered(lines: Column) -> Column:
    """Lines and words with ids in the order that they stand in."""

    def named(starts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            name = F.format_string("line_%04d", i + 1)
            words = F.transform(x["words"], lambda w, k: w.withField("id", F.format_string("w_%04d", F.get(starts, i) + k + 1)).withField("line_id", name))
            return F.struct(name.alias("id"), x["bbox"].alias("bbox"), words.alias("words"))

        return F.transform(lines, one)

    return _let(_before(F.transform(lines, lambda x: F.size(x["words"]))), named)


def _in_blocks(lines: Column) -> Column:
    count = F.ceil(F.size(lines) / F.lit(float(BLOCK_LINES))).cast("int")
    block = lambda own, k: F.struct(F.format_string("block_%d", k + 1).alias("id"), _enclosing(own).alias("bbox"), own.alias("lines"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: _let(F.slice(lines, k * BLOCK_LINES + 1, F.lit(BLOCK_LINES)), lambda own: block(own, k)))


def repaired(trees: DataFrame) -> DataFrame:
    """Page trees (width, blocks) with words laid out and columns in reading order.

    Where the lines of a page stand in two columns, the left one comes first, each from the top; lines and words
    are numbered anew and dealt over blocks of ``BLOCK_LINES``. Pages without such a gap keep their blocks.
    """
    fixed = F.transform("blocks", lambda b: b.withField("lines", F.transform(b["lines"], lambda x: x.withField("words", repaired_words(x)))))
    centre = lambda x: (x["bbox"][0] + x["bbox"][2]) / 2

    def ordered(blocks: Column) -> Column:
        def split(lines: Column) -> Column:
            def columns(gap: Column) -> Column:
                # stable by the top: ties keep their order
                order = F.array_sort(F.transform(lines, lambda x, i: F.struct((centre(x) >= gap).alias("right"), x["bbox"][1].alias("top"), i.alias("i"))))
                return F.when(gap.isNotNull(), _let(F.transform(order, lambda o: F.get(lines, o["i"])), lambda x: _let(_numbered(x), _in_blocks))).otherwise(blocks)

            return _let(column_gap(F.transform(lines, centre), F.col("width")), columns)

        return _let(F.flatten(F.transform(blocks, lambda b: b["lines"])), split)

    return trees.withColumn("blocks", _let(fixed, ordered)).select(*trees.columns)


def from_levels(rows: DataFrame, images: DataFrame, page: str = "page", order: str = "order") -> DataFrame:
    """(page, width, height, blocks) from rows (page, order, level, text, left, top, width, height) in reading order.

    Level 1 is a page, 3 a block, 4 a line, 5 a word. Boxes are scaled by the width of the page's image (``images``: page, width,
    height) over that of its level-1 row, halves to the even number. Blank words, lines without words
    and blocks without lines go, but keep their numbers; words are numbered without the blank ones.
    """
    w = Window.partitionBy(page).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda k, over: F.sum(F.when(F.col("level") == k, 1).otherwise(0)).over(over).cast("int")
    real = (F.col("level") == 5) & (F.btrim("text") != "")
    told = rows.withColumns({"_b": count(3, upto) - 1, "_l": count(4, upto) - 1, "_w": F.sum(F.when(real, 1).otherwise(0)).over(upto).cast("int")})
    cell = F.struct(F.col(order).alias("at"), "level", F.btrim("text").alias("text"), *[F.col(c).cast("double").alias(c) for c in ("left", "top", "width", "height")], F.col("_b").alias("b"), F.col("_l").alias("l"), F.col("_w").alias("w"))
    pages = told.where("level in (1, 3, 4) or (level = 5 and trim(text) <> '')").groupBy(page).agg(F.array_sort(F.collect_list(cell)).alias("_rows"))
    sized = images.select(page, F.col("width").alias("_iw"), F.col("height").alias("_ih"))
    met = pages.join(sized, page)

    def tree(p: Column) -> Column:
        at = lambda v: F.bround(v * p["scale"]).cast("int")
        box = lambda r: F.array(at(r["left"]), at(r["top"]), at(r["left"] + r["width"]), at(r["top"] + r["height"]))

        def block(b: Column) -> Column:
            def line(x: Column, i: Column) -> Column:
                name = F.format_string("l_%03d_%03d", x["b"], i)
                own = F.filter(p["words"], lambda r: r["l"] == x["l"])
                words = F.transform(own, lambda r: F.struct(F.format_string("w_%04d", r["w"]).alias("id"), r["text"].alias("text"), box(r).alias("bbox"), F.lit(50).alias("confidence"), name.alias("line_id")))
                return F.struct(name.alias("id"), box(x).alias("bbox"), words.alias("words"))

            lines = F.transform(F.filter(p["lines"], lambda x: x["b"] == b["b"]), line)
            return F.struct(F.format_string("b_%03d", b["b"]).alias("id"), box(b).alias("bbox"), F.filter(lines, lambda x: F.size(x["words"]) > 0).alias("lines"))

        return F.filter(F.transform(p["blocks"], block), lambda b: F.size(b["lines"]) > 0)

    def parted(rows: Column) -> Column:
        of = lambda level: F.filter(rows, lambda r: r["level"] == level)
        return _let(F.struct((F.col("_iw") / of(1)[0]["width"]).alias("scale"), of(3).alias("blocks"), of(4).alias("lines"), of(5).alias("words")), tree)

    return met.select(page, F.col("_iw").alias("width"), F.col("_ih").alias("height"), _let(F.col("_rows"), parted).alias("blocks"))
