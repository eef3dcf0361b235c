"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items form one automaton; a document's words stream
through it and the longest matching length is tracked. Where it reaches the
window length, or a short item ends, the matched words are hit. Spans of hits are
removed from the text; a document whose hits exceed a coverage limit goes.

Items are dealt by hash into blocks of about ``BLOCK_WORDS`` words. Tasks build one
automaton for each block and write them to the shared folder. The documents then
go through one Python function, which gathers ``GATHERED`` bytes of texts, loads
one automaton after the other and streams the words of these texts through it. So
neither the driver nor a task ever holds more than one block's automaton, however
large the set of items.

Defined results: a null text has no words; an item without words or id is
ignored; items with equal ids and texts count once, equal ids with different texts
are one item; an empty table of documents or items gives an empty result or no
hits; repeated documents are searched each for itself; a very long text is
searched whole; overlapping hits of several items are one span; other columns,
whatever their names, pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import apart, each_row, in_arrow, place, settle, settled

WINDOW = 10
BLOCK_WORDS = 100_000
GATHERED = 16 << 20
MAX_COVERAGE = 0.5
#: Bytes that are not digits, letters or beyond ASCII become spaces; A-Z become a-z.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Automaton:
    """Generalised suffix automaton over the words of items, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, _Vocabulary()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.items: dict[tuple[int, ...], set[str]] = {}  # window -> items; a short item is one window
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            last = 0
            for word in ids:
                last = self._extend(last, word)
            span = min(window, len(ids))
            for at in range(len(ids) - span + 1 if ids else 0):
                self.items.setdefault(tuple(ids[at : at + span]), set()).add(item)
        self.short = sorted({len(k) for k in self.items if len(k) < window})

    def _state(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(edges)
        return len(self.size) - 1

    def _split(self, at: int, word: int) -> int:
        """The target of ``at`` by ``word``, cloned if it also stands for longer strings than this way reaches."""
        target = self.next[at][word]
        if self.size[target] == self.size[at] + 1:
            return target
        clone = self._state(self.size[at] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, at = self._state(self.size[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(end, longest length) of the match that ends at each word, as words stream through."""
        state, length = 0, 0
        for end, word in enumerate(ids, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield end, length

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words in order, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int32, len(words))
        least = min([self.window, *self.short])
        known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        spans: list[list[int]] = []
        found: set[str] = set()
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin < least:
                continue
            run = ids[begin:end].tolist()
            for at, length in self.matches(run):
                reach = length if length >= self.window else 0
                if reach:
                    found |= self.items[tuple(run[at - self.window : at])]
                for n in self.short:
                    if n > length:
                        break
                    if short := self.items.get(tuple(run[at - n : at])):
                        found |= short
                        reach = max(reach, n)
                if reach:
                    start = begin + at - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, begin + at])
        return [tuple(s) for s in spans], found


def build_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[str, list[int]]:
    """A folder with an automaton for each block of items, and the blocks' numbers."""
    items = settle(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct())
    # a word and the sign after it have two bytes at least; most have six or so
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // (6 * block_words)))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).repartition(min(blocks, 10_000), "block").sortWithinPartitions("block", "item_id", "text")

    def build(batches):
        def told(block, own):
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pickle.dumps(Automaton(own, window), 5)], pa.large_binary())], names=["block", "automaton"])

        last, own = None, []
        for block, item, text in each_row(batches, "block", "item_id", "text"):
            if block != last and own:
                yield told(last, own)
                own = []
            last = block
            own.append((item, words_of(text)))
        if own:
            yield told(last, own)

    built, path = settled(in_arrow(dealt, build, "block int, automaton binary"), "block")
    return path, sorted(r["block"] for r in built.select("block").collect())  # a number for each block


_LOADED: dict[tuple[str, int], Automaton] = {}  # the last automaton of this worker process


def _automaton(path: str, block: int) -> Automaton:
    if (path, block) not in _LOADED:
        _LOADED.clear()
        store, top = place(path)
        told = ds.dataset(f"{top}/block={block}", filesystem=store, format="parquet").to_table(columns=["automaton"])
        _LOADED[path, block] = pickle.loads(told["automaton"][0].as_buffer())
    return _LOADED[path, block]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as disjoint (start, end) in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, from a span's first word's start to its last one's end."""
    raw = text.encode()
    shown = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], shown.astype(np.int8), [0]))))
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : edges[2 * start]])
        at = int(edges[2 * end - 1])
    return b"".join([*out, raw[at:]]).decode()


def _gathered(batches) -> Iterator[list[pa.RecordBatch]]:
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield group
            group, size = [], 0
    if group:
        yield group


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, block_words: int, cut: bool) -> DataFrame:
    """``rows`` with items, n_words and n_hit; the text goes, or loses its hits if it is to be ``cut``."""
    path, blocks = build_blocks(benchmark, window, block_words)
    kept = [f for f in rows.schema.fields if cut or f.name != "text"]
    added = [T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())]

    def search(batches):
        for group in _gathered(batches):
            texts = [text for (text,) in each_row(group, "text")]
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            items: list[set[str]] = [set() for _ in texts]
            n_words = [0] * len(texts) if blocks else [len(words_of(t)) for t in texts]
            for block in blocks:
                automaton = _automaton(path, block)
                for k, text in enumerate(texts):
                    words = words_of(text)
                    n_words[k] = len(words)
                    new, found = automaton.hits(words)
                    spans[k] += new
                    items[k] |= found
            merged, at = [_merged(s) for s in spans], 0
            for batch in group:
                own = slice(at, at + batch.num_rows)
                at = own.stop
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
                if cut:
                    column = [f.name for f in kept].index("text")
                    columns[column] = pa.array([_cut(t, m) if m else t for t, m in zip(texts[own], merged[own], strict=True)], pa.string())
                columns += [pa.array(map(sorted, items[own]), pa.list_(pa.string())), pa.array(n_words[own], pa.int64()), pa.array([sum(e - s for s, e in m) for m in merged[own]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in [*kept, *added]])

    return in_arrow(rows, search, T.StructType([*kept, *added]))


def digest_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _searched(rows, benchmark, window, block_words, False).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with the hit spans cut out of their texts; those with more than ``max_coverage`` of their words hit go."""
    rows, named = apart(docs, "text")
    found = _searched(rows, benchmark, window, block_words, True)
    return named(found.where(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")))


#: The digests in DuckDB, by an equi-join on windows.
SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
i AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS size, array_to_string(ws[p : p + least(len(ws), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - {WINDOW} + 1, 1))) AS p FROM b WHERE len(ws) > 0)),
s AS (SELECT DISTINCT size FROM i),
d AS (SELECT doc_id, p, size, array_to_string(ws[p : p + size - 1], ' ') AS win FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS p FROM w, s WHERE len(ws) >= size)),
h AS (SELECT d.doc_id, d.p, d.size, i.item FROM d JOIN i ON d.win = i.win AND d.size = i.size),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(told, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""
