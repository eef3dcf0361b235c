"""Quality rules with risk-controlled cutoffs.

Every rule is a signal of a document and rejects above a cutoff. Labelled rows
are split by a hash: one half gives, for each stratum (language), a path of
cutoffs from lenient to strict, as high quantiles of the good rows' signals; the
other half tests them. A step of the path passes while the exact binomial
(Clopper-Pearson) upper bound of the false rejection rate, at a level divided by
the number of strata, stays within ``max_rejection``; the path is tested in a
fixed order and stops at the first step that fails, so no further correction is
due. What is guaranteed, at that level, is the rate among good documents that
pass the base rule; what the base rule itself rejects isn't counted. Languages
without enough labelled rows to pass even without a rejection (59 bound the rate by
5 % at a level of 5 %; with four strata 86 are needed), those without any included, are one
pooled stratum, tested at the same split level, so what is guaranteed there is the
rate over all of them together. Which are pooled follows from the numbers of rows alone,
not from their signals. Where the pooled rows don't suffice either, the base rule decides.

One signal counts words of a lexicon that is fitted on at most ``fit_rows``
labelled rows of the first half (the first by hashed id), whose features tasks
count; quantiles and tests cover all labelled rows and signals all documents.

Defined results: a null text has no words; a null language is a stratum of its
own; labels with a null field or for unknown documents are ignored, of repeated
labels the worst counts; without labels only the base rule decides; an empty
table gives an empty result; repeated rows are judged each for itself; a very long
text is measured whole; a signal that equals its cutoff doesn't reject; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import each_row, in_arrow, settle, small
from quarry.llm.cotrain import BEGINNINGS, LETTERS

#: Characters that count as symbols; fixed values.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
SIGNALS = ("symbol_share", "shout_share", "dup_line_share", "repeat_share", "top_word_share", "flagged_rate")
#: Steps from lenient to strict: the share of the first half's good rows above the quantile, and a margin on it.
PATH = ((0.0, 2.0), (0.0, 1.5), (0.0, 1.25), (0.0, 1.1), (0.0, 1.0), (0.001, 1.0), (0.002, 1.0), (0.003, 1.0))
#: No cutoff is below these, by signal.
FLOORS = (0.01, 0.01, 0.1, 0.1, 0.1, 0.3)
MAX_REJECTION = 0.05
LEVEL = 0.05
LEAST_SUPPORT = 4
LEAST_ODDS = 8.0


def binomial_upper(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper bound of a rate with ``k`` of ``n``: the rate at which k or fewer have probability ``level``."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n if k else 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(min(max(mid, 1e-15), 1 - 1e-15)) > level else (low, mid)
    return high


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids = np.fromiter(map({}.setdefault, words, range(n)), np.int64, n)
    key, span = ids, 1
    while span < width:  # keys of longer windows from pairs of shorter ones, renumbered so that they stay exact
        step = min(span, width - span)
        key = key[: len(key) - step] * n + key[step:]
        key = np.unique(key, return_inverse=True)[1]
        span += step
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    edge[: len(again)] += again
    np.subtract.at(edge, at + width, 1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def features(word: bytes) -> list[bytes]:
    """The folded word and its beginnings."""
    parts = word.translate(LETTERS).split()
    return [t for p in parts for t in (b"=" + p, *(p[:k] for k in BEGINNINGS if k <= len(p)))]


class _Flags(dict):
    """Word -> its largest lexicon weight."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = w = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
        return w


def measure(text: str | None, flags: dict) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, *SIGNALS) of a whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    repeated = repeated_words(words)
    shouts = raw.count(b"!!")
    duplicates = len(lines) - len(set(lines))
    top = max(Counter(words).values(), default=0)
    flagged = sum(map(flags.__getitem__, words)) / math.sqrt(max(1, n))
    return n, chars, symbols, duplicates, repeated, symbols / max(1, chars), shouts / max(1, n), duplicates / max(1, len(lines)), repeated / max(1, n), top / max(10, n), flagged


def judged(labels: DataFrame) -> DataFrame:
    """(_id, _good, _fit): a row for each labelled document; _fit marks the first half."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("_ok"))
    return marks.groupBy("_id").agg(F.min("_ok").alias("_good")).withColumn("_fit", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)) == 0)


def fit_lexicon(docs: DataFrame, marks: DataFrame, fit_rows: int) -> dict[bytes, float]:
    """Log odds of word features that several bad rows use far more often than good ones.

    Of at most ``fit_rows`` labelled rows; their features are counted and told apart in tasks, the driver gets those that are left.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("_id")).join(marks.where("_fit"), "_id").dropDuplicates(["_id"])
    first = settle(known.orderBy(F.xxhash64("_id", F.lit("lexicon")), "_id").limit(fit_rows).select("_id", "_good"))
    total = {r["_good"]: r["n"] for r in first.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return {}
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(first), "_id").select("text", "_good")

    def count(batches):
        use: dict[bytes, list[int]] = {}  # of a bounded number of rows
        for text, good in each_row(batches, "text", "_good"):
            counts: Counter = Counter()
            for w, c in Counter((text or "").encode().split()).items():
                for f in set(features(w)):
                    counts[f] += c
            for f, c in counts.items():
                told = use.setdefault(f, [0, 0, 0])
                told[0 if good else 1] += min(c, 10)
                told[2] += not good
        yield pa.RecordBatch.from_arrays([pa.array(list(use), pa.binary()), *(pa.array([u[k] for u in use.values()], pa.int64()) for k in range(3))], names=["feature", "good", "bad", "support"])

    used = in_arrow(rows, count, "feature binary, good long, bad long, support long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("good", "bad", "support")])
    odds = ((F.col("bad") + 0.5) / total[False]) / ((F.col("good") + 0.5) / total[True])
    left = used.where(F.col("support") >= LEAST_SUPPORT).select("feature", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    return {bytes(r["feature"]): math.log(r["odds"]) for r in left.toLocalIterator()}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, lexicon: dict[bytes, float]) -> DataFrame:
    """(doc_id, lang, COUNTS, SIGNALS) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in SIGNALS)])
    types = [pa.int64(), pa.string(), *[pa.int64()] * len(COUNTS), *[pa.float64()] * len(SIGNALS)]

    def run(batches):
        flags = _Flags(shared.value)
        for batch in batches:
            out = [(doc, lang, *measure(text, flags)) for doc, lang, text in each_row([batch], "doc_id", "lang", "text")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def select_cutoffs(rows: DataFrame, marks: DataFrame, path: tuple[tuple[float, float], ...] = PATH, max_rejection: float = MAX_REJECTION, level: float = LEVEL) -> list[tuple]:
    """(lang, cutoff of each signal, rejected, tested, upper bound) for the strata that pass a step."""
    told = rows.join(marks, rows["doc_id"] == marks["_id"]).where("_good").where(~base_failed())
    steps = F.array(*[F.lit(1 - p) for p, _ in path])
    quantiles = told.where("_fit").groupBy("lang").agg(*[F.percentile_approx(s, steps, F.lit(100_000)).alias(f"_q_{s}") for s in SIGNALS])
    quantiles = settle(quantiles.select("lang", *[F.array(*[F.greatest(F.col(f"_q_{s}")[k] * m, F.lit(f)) for k, (_, m) in enumerate(path)]).alias(f"_q_{s}") for s, f in zip(SIGNALS, FLOORS, strict=True)]))
    tests = told.where("not _fit").join(small(quantiles.withColumnRenamed("lang", "_lang"), 400), F.col("lang").eqNullSafe(F.col("_lang")))
    beyond = [F.greatest(*[(F.col(s) > F.col(f"_q_{s}")[k]).cast("int") for s in SIGNALS]) for k in range(len(path))]
    counts = tests.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(b).alias(f"k{k}") for k, b in enumerate(beyond)])
    found = {r["lang"]: r for r in counts.collect()}  # one row for each labelled stratum
    out = []
    for q in quantiles.collect():
        r, chosen = found.get(q["lang"]), None
        for k in range(len(path)):
            bound = binomial_upper(int(r[f"k{k}"]), int(r["n"]), level / max(1, len(found))) if r else 1.0
            if bound > max_rejection:
                break
            chosen = (q["lang"], *[float(q[f"_q_{s}"][k]) for s in SIGNALS], int(r[f"k{k}"]), int(r["n"]), bound)
        if chosen:
            out.append(chosen)
    return out


POOLED = "+"


def with_strata(rows: DataFrame, marks: DataFrame, max_rejection: float = MAX_REJECTION, level: float = LEVEL) -> DataFrame:
    """``rows`` with the stratum in ``lang``: the language where it has test rows enough to pass without a rejection, else POOLED."""
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    tests = rows.join(marks, rows["doc_id"] == marks["_id"]).where("_good and not _fit").where(~base_failed())
    sizes = {r["_k"]: r["n"] for r in tests.groupBy(key.alias("_k")).agg(F.count("*").alias("n")).collect()}  # one row for each labelled stratum
    enough = math.log(level / (len(sizes) + 1)) / math.log(1 - max_rejection)
    own = rows.sparkSession.createDataFrame([(k,) for k, n in sizes.items() if n >= enough], "_own string")  # each has dozens of labelled rows
    return rows.withColumn("_k", key).join(F.broadcast(own), F.col("_k") == F.col("_own"), "left").withColumn("lang", F.coalesce("_own", F.lit(POOLED))).drop("_k", "_own")


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, SIGNALS) of every document."""
    spark, marks = docs.sparkSession, settle(judged(labels))
    rows = with_strata(settle(measured(docs, fit_lexicon(docs, marks, fit_rows))), marks)
    cutoffs = select_cutoffs(rows, marks)
    schema = ", ".join(["_lang string", *[f"_c_{s} double" for s in SIGNALS], "_k long", "_n long", "_bound double"])
    table = spark.createDataFrame(cutoffs, schema)
    # a row for each stratum that passed, each with dozens of labelled rows behind it
    joined = rows.join(F.broadcast(table) if len(cutoffs) < 100_000 else table, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rejected = F.coalesce(F.greatest(*[(F.col(s) > F.col(f"_c_{s}")).cast("int") for s in SIGNALS]) > 0, F.lit(False))
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"), *SIGNALS)
