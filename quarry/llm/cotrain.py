"""Quality classifier by co-training.

Two logistic models see a document through separate views: its text (hashed whole
words and word beginnings, and measures of its layout) and its page metadata
(source, language and stated length, none of it read from the text). Over rounds
each one labels, where its calibrated probability is beyond ``confident``,
documents of an unlabelled pool for the other. At the end both scores are
calibrated on held-out labelled rows and combined to score all documents.

The fit uses a bounded sample: at most ``labelled`` labelled (4000) and ``pool``
unlabelled rows (1500), the ones whose hashed id comes first; a round hands over at
most ``exchange`` (200) rows of each class. Tasks turn their texts into counted
features, and one task fits the model on these; the driver gets the model alone.
Scoring covers every row. A row is good if its quality is 1 and it isn't toxic.

Defined results: null text, source or language count as empty and a null length
as 0; labels with a null field or for unknown documents are ignored, of repeated
labels the worst counts; without both classes among the labels all documents get
probability 1 and stay; an empty table gives an empty result; repeated rows are
scored each for itself; a very long text is scored whole; rows that are equally
sure are handed over in the order of their hashed ids; a probability that equals
the threshold keeps; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import apart, each_row, in_arrow

BITS = 18
BEGINNINGS = (4, 5, 6, 7, 8)
#: Bytes of words: ASCII letters (A-Z as a-z) and all beyond ASCII; the rest are spaces.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
MARKS = b"#*$%&|<>"
PLACES = 64
LEAST_RATIO = 1.2
LEAST_SUPPORT = 4
REMEMBERED = 100_000


def word_features(word: bytes) -> list[int]:
    """Hashed whole word and beginnings."""
    told = [b"=" + word, *(b"^" + word[:k] for k in BEGINNINGS if k <= len(word))]
    return [zlib.crc32(t) >> (32 - BITS) for t in told]


def text_view(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def layout_view(text: str | None) -> list[float]:
    """Measures of the text's layout."""
    text = text or ""
    raw = text.encode()
    n, words, lines = max(1, len(raw)), text.split(), [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    marks = len(raw) - len(raw.translate(None, MARKS))
    common = max(seen.values(), default=0) / max(1, len(words))
    return [
        math.log1p(len(text)) / 5,
        math.log1p(len(lines)) / 3,
        math.log1p(len(words) / max(1, len(lines))) / 3,
        min(1.0, 10 * marks / n),
        min(1.0, 20 * raw.count(b"!") / n),
        min(1.0, 4 * upper / n),
        1 - len(seen) / max(1, len(words)),
        common,
        float(common > 0.3),
        1 - len(set(lines)) / max(1, len(lines)),
        float(len(words) < 10),
    ]


LAYOUT = len(layout_view(""))


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """One hashed place each for source, language and the power of 2 of the stated length, and that length."""
    size = max(0, n_chars or 0)
    places = [0.0] * (3 * PLACES)
    places[zlib.crc32((source or "").encode()) % PLACES] = 0.3
    places[PLACES + zlib.crc32((lang or "").encode()) % PLACES] = 0.3
    places[2 * PLACES + min(PLACES - 1, size.bit_length())] = 0.3
    return [math.log1p(size) / 5, *places]


class _Features(dict):
    """Word -> its features, for as many words as ``REMEMBERED``."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = word_features(word)
        return out


_FEATURES = _Features()


def count_features(words: list[bytes]) -> tuple[bytes, bytes]:
    """The features of a text's words (int32) and how often each occurs (float32)."""
    counts: Counter = Counter()
    for w, c in Counter(words).items():
        for f in _FEATURES[w]:
            counts[f] += c
    return np.fromiter(counts.keys(), "<i4", len(counts)).tobytes(), np.fromiter(counts.values(), "<f4", len(counts)).tobytes()


class _Sparse:
    """Rows of counts over the square root of the number of words."""

    def __init__(self, row: np.ndarray, index: np.ndarray, count: np.ndarray, per_word: np.ndarray):
        self.row, self.index, self.count, self.per_word, self.n = row, index, count, per_word, len(per_word)
        self.value = count * per_word[row]

    @classmethod
    def of(cls, rows: list[tuple[bytes, bytes, int]]) -> _Sparse:
        """From rows of ``count_features`` and a number of words."""
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) // 4 for r in rows])
        words = np.array([max(1, r[2]) for r in rows], float)
        return cls(row, np.frombuffer(b"".join(r[0] for r in rows), "<i4"), np.frombuffer(b"".join(r[1] for r in rows), "<f4"), (1 / np.sqrt(words)).astype(np.float32))

    def only(self, used: np.ndarray) -> _Sparse:
        """Without the features that aren't ``used``."""
        kept = used[self.index]
        return _Sparse(self.row[kept], self.index[kept], self.count[kept], self.per_word)

    def scale(self, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log ratio of a feature's use in the two classes; features of few documents or with a small ratio count as none."""
        often = np.minimum(10, self.count)
        use = [np.bincount(self.index, ((weight * (y == c)).astype(np.float32)[self.row] * often), 1 << BITS) for c in (1, 0)]
        share = [(u + 0.5) / max(1.0, weight[y == c].sum()) for u, c in zip(use, (1, 0), strict=True)]
        support = np.bincount(self.index, (weight > 0)[self.row], 1 << BITS)
        ratio = np.log(share[0] / share[1])
        return np.where((np.abs(ratio) >= LEAST_RATIO) & (support >= LEAST_SUPPORT), ratio, 0.0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * r[self.row], 1 << BITS)


class _Dense:
    def __init__(self, rows: list[list[float]]):
        self.x = np.array(rows, float).reshape(len(rows), -1)

    def only(self, used: np.ndarray) -> _Dense:
        return self

    def scale(self, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.ones(self.x.shape[1])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, r: np.ndarray) -> np.ndarray:
        return self.x.T @ r


class _Text:
    """Words and layout as one view; the layout's weights come last."""

    def __init__(self, words: _Sparse, layout: _Dense):
        self.words, self.layout = words, layout

    def only(self, used: np.ndarray) -> _Text:
        return _Text(self.words.only(used[:-LAYOUT]), self.layout)

    def scale(self, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.concatenate((self.words.scale(y, weight), self.layout.scale(y, weight)))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.words.dot(w[:-LAYOUT]) + self.layout.dot(w[-LAYOUT:])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate((self.words.back(r), self.layout.back(r)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 60, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad over all rows; ``weight`` 0 leaves a row out, classes weigh the same."""
    scale = x.scale(y, weight)
    x = x.only(scale != 0)  # features of scale 0 get no weight
    w, b = np.zeros(size), 0.0
    hist, hist_b = np.full(size, 1e-8), 1e-8
    weight = weight * np.where(y > 0, 1 / max(1e-9, weight[y > 0].sum()), 1 / max(1e-9, weight[y <= 0].sum())) / 2
    for _ in range(steps):
        r = weight * (_sigmoid(x.dot(w * scale) + b) - y)
        g, gb = x.back(r) * scale + decay * w, r.sum()
        hist, hist_b = hist + g * g, hist_b + gb * gb
        w, b = w - rate * g / np.sqrt(hist), b - rate * gb / math.sqrt(hist_b)
    return w * scale, b


def calibrate(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (one for each column of scores, then the bias) of a logistic fit on held-out rows, by Newton steps."""
    x = np.column_stack([scores, np.ones(len(y))])
    c = np.zeros(x.shape[1])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # Platt's targets
    for _ in range(50):
        p = _sigmoid(x @ c)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(c)), x.T @ (target - p) - 1e-3 * c)
        c = c + np.clip(step, -5, 5)
    return c


def surest(sure: np.ndarray, free: np.ndarray, most: int, confident: float) -> np.ndarray:
    """At most ``most`` free rows of at least ``confident``, the surest first, equally sure ones in their order."""
    rows = np.flatnonzero(free & (sure >= confident))
    return rows[np.argsort(-sure[rows], kind="stable")[:most]]


@dataclass(frozen=True)
class Model:
    words: np.ndarray
    words_bias: float
    meta: np.ndarray
    meta_bias: float
    blend: np.ndarray


def cotrain(texts: list[tuple[bytes, bytes, int]], layouts: list[list[float]], metas: list[list[float]], y: np.ndarray, held: np.ndarray, rounds: int = 3, exchange: int = 200, confident: float = 0.98) -> Model | None:
    """Fit both views; ``y`` is 1, 0 or nan (unlabelled), ``held`` marks rows for calibration only."""
    train, known = ~np.isnan(y) & ~held, ~np.isnan(y)
    if min(map(len, map(set, (y[train], y[held & known])))) < 2:
        return None
    views = [(_Text(_Sparse.of(texts), _Dense(layouts)), (1 << BITS) + LAYOUT), (_Dense(metas), len(metas[0]))]
    labels = [np.where(train, y, 0.0) for _ in views]
    weights = [train.astype(float) for _ in views]
    fits = [None, None]
    for turn in range(rounds + 1):
        for k, (x, size) in enumerate(views):
            fits[k] = fit_logistic(x, labels[k], weights[k], size, 60, 0.5 if k == 0 else 0.3)
        if turn == rounds:
            break
        for k, (x, _) in enumerate(views):  # view k labels for the other one
            score = x.dot(fits[k][0]) + fits[k][1]
            c = calibrate(score[held & known][:, None], y[held & known])
            p = _sigmoid(c[0] * score + c[1])
            for value, sure in ((1.0, p), (0.0, 1 - p)):
                chosen = surest(sure, ~known & (weights[1 - k] == 0), exchange, confident)
                labels[1 - k][chosen], weights[1 - k][chosen] = value, 0.5
    scores = np.column_stack([x.dot(w) + b for (x, _), (w, b) in zip(views, fits, strict=True)])
    return Model(fits[0][0], fits[0][1], fits[1][0], fits[1][1], calibrate(scores[held & known], y[held & known]))


class _Weights(dict):
    """Word -> the sum of its features' weights."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = s = float(self.w[word_features(word)].sum())
        return s


VIEWED = ("text", "source", "lang", "n_chars")


def sample_rows(docs: DataFrame, labels: DataFrame, labelled: int, pool: int) -> DataFrame:
    """At most ``labelled`` labelled and ``pool`` other rows, the first by hashed id: doc_id, _order, _good and what the views see."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("_good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("doc_id").cast("long"), F.lit("sample")).alias("_order"))
    told = rows.where("_id is not null").join(marks, "_id", "left")
    first = told.where("_good is not null").orderBy("_order", "_id").limit(labelled).unionByName(told.where("_good is null").orderBy("_order", "_id").limit(pool)).dropDuplicates(["_id"])
    # at most labelled + pool ids, so the texts come by one broadcast
    return docs.select(F.col("doc_id").cast("long").alias("_id"), *[F.col(c) for c in VIEWED]).join(F.broadcast(first), "_id")


SAMPLED = pa.schema([("id", pa.int64()), ("order", pa.int64()), ("good", pa.int32()), ("index", pa.binary()), ("count", pa.binary()), ("words", pa.int64()), ("layout", pa.list_(pa.float64())), ("meta", pa.list_(pa.float64()))])


def sampled_features(rows: DataFrame) -> DataFrame:
    """Both views of ``sample_rows`` as numbers."""

    def view(batches):
        for batch in batches:
            out = []
            for i, order, good, *seen in each_row([batch], "_id", "_order", "_good", *VIEWED):
                words = text_view(seen[0])
                out.append((i, order, good, *count_features(words), len(words), layout_view(seen[0]), metadata_view(*seen[1:])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SAMPLED, strict=True)], schema=SAMPLED)

    return in_arrow(rows, view, "id long, order long, good int, index binary, count binary, words long, layout array<double>, meta array<double>")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 4000, pool: int = 1500) -> Model | None:
    def train(batches):
        # by hashed id; of repeated ids one row
        rows = {r[1]: r for r in sorted(each_row(batches, "order", "id", "good", "index", "count", "words", "layout", "meta"))}.values()
        rows = sorted(rows)
        if rows:
            y = np.array([math.nan if r[2] is None else float(r[2]) for r in rows])
            model = cotrain([r[3:6] for r in rows], [r[6] for r in rows], [r[7] for r in rows], y, np.array([r[0] % 4 == 0 for r in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = in_arrow(sampled_features(sample_rows(docs, labels, labelled, pool)).repartition(1), train, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, keep_columns: bool = True) -> DataFrame:
    """Adds text_score, metadata_score, quality_score (probability of good) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField(n, T.DoubleType()) for n in ("text_score", "metadata_score", "quality_score")] + [T.StructField("kept", T.BooleanType())]
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added} and (keep_columns or f.name == "doc_id")]

    def rate(batches):
        m = shared.value
        weights, layout = (_Weights(m.words[:-LAYOUT]), m.words[-LAYOUT:]) if m else (None, None)
        for batch in batches:
            out = []
            for row in each_row([batch], *VIEWED):
                if m is None:
                    out.append((None, None, 1.0, True))
                    continue
                words = text_view(row[0])
                s = m.words_bias + sum(map(weights.__getitem__, words)) / math.sqrt(max(1, len(words))) + float(np.dot(layout, layout_view(row[0])))
                t = m.meta_bias + float(np.dot(m.meta, metadata_view(*row[1:])))
                p = float(_sigmoid(m.blend[0] * s + m.blend[1] * t + m.blend[2]))
                out.append((s, t, p, p >= threshold))
            if out:
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                made = [pa.array(c, pa.bool_() if f.name == "kept" else pa.float64()) for c, f in zip(zip(*out, strict=True), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[f.name for f in [*kept, *added]])

    return in_arrow(docs, rate, T.StructType([*kept, *added]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, text_score, metadata_score, quality_score, kept) of every document."""
    return score(docs.select("doc_id", *VIEWED), fit(docs, labels), threshold, False)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    rows, named = apart(docs, "doc_id", *VIEWED)
    return named(score(rows, fit(docs, labels), threshold).where("kept"))
