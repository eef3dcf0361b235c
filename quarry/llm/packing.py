"""Best-fit packing by linear grouping.

Token lengths are at most the capacity, so a histogram of them has a bounded
size whatever the corpus. The plan is made on that histogram: large lengths are
rounded up within groups of equal cardinality, the configurations of the few
rounded sizes are optimised by column generation, actual lengths replace the
rounded ones, and the rest goes by best fit, largest first. The plan names runs
of places (length, rank, sequence, offset); each piece then finds its place by
its length and its rank among the pieces of that length. Ranks come from sums over
(length, bucket), of which a length has four times as many as there are shuffle
partitions; only these few sums, never the pieces of a length, meet in one task.

Defined results: a null text is empty, so it is one end token; an empty table
gives an empty result; repeated rows are packed as often as they occur; ties of
length go by salt bucket, then document and piece; a very long text is encoded
whole and cut into pieces; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import each_row, in_arrow, settle, small

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END = np.zeros(1, "<u4").tobytes()


@functools.cache
def _encoders(path: str):
    """The tokenizer at ``path``, the strings of its added tokens, and a tiktoken encoding for texts without them.

    Its pattern and its vocabulary, whose ids are in the order of the merges, give
    the same ids at several times the speed.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as themselves
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    whole = Tokenizer.from_file(path)
    special = {t.content for t in whole.get_added_tokens_decoder().values()}
    ranks = {bytes(shown[c] for c in t): i for t, i in whole.get_vocab(with_added_tokens=False).items() if t not in special}
    return whole, tuple(special), tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, path: str) -> bytes:
    """Little-endian unsigned 32-bit ids of a whole text, with the end token."""
    whole, special, fast = _encoders(path)
    text = text or ""
    if not any(s in text for s in special):
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes() + END
        except ValueError:  # its pattern runs out of stack on about a million white-space characters in a row
            pass
    return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + END


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents beyond the capacity are cut, the first piece shorter."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text in each_row([batch], "doc_id", "text"):
                ids = encode_text(text, path)
                n = len(ids) // 4
                start, size = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    out.append((doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start, size = start + size, capacity
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Runs of places: the pieces of ``length`` with ranks from ``rank`` on lie at ``offset`` in the sequences from ``sequence`` on."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, count, sequence, offset
    sequences: int = 0
    used: dict[int, int] = field(default_factory=dict)
    open: list[list[tuple[int, int]]] = field(default_factory=list)  # by room: (first sequence, count)

    def __post_init__(self):
        self.open = [[] for _ in range(self.capacity + 1)]

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, count, sequence, offset))
        self.used[length] = rank + count

    def fill(self, sequence: int, count: int, room: int, length: int, times: int) -> None:
        """Put ``times`` pieces of ``length`` into each of ``count`` sequences with ``room``."""
        for _ in range(times):
            self.put(length, count, sequence, self.capacity - room)
            room -= length
        self.open[room].append((sequence, count))

    def best_fit(self, length: int, left: int) -> None:
        """Place ``left`` pieces of one length, each where the least room remains."""
        room = length
        while left and room <= self.capacity:
            if not self.open[room]:
                room += 1
                continue
            sequence, count = self.open[room].pop()
            left -= self._share(sequence, count, room, length, left)
        if left:
            count = -(-left // (self.capacity // length))
            sequence, self.sequences = self.sequences, self.sequences + count
            self._share(sequence, count, self.capacity, length, left)

    def _share(self, sequence: int, count: int, room: int, length: int, left: int) -> int:
        times = room // length
        full = min(count, left // times)
        if full:
            self.fill(sequence, full, room, length, times)
        placed, rest = full * times, (left - full * times) if full < count else 0
        if rest:
            self.fill(sequence + full, 1, room, length, rest)
            full, placed = full + 1, placed + rest
        if full < count:
            self.open[room].append((sequence + full, count - full))
        return placed


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the cutting problem of a few sizes, by column generation."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    use = demand / np.diag(basis)
    for _ in range(40 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = sizes <= room
            worth = best[room - sizes[fits]] + price[fits]
            k = int(np.argmax(worth))
            if worth[k] > best[room - 1] + 1e-12:
                best[room], last[room] = worth[k], np.flatnonzero(fits)[k]
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
                continue
            column[last[room]] += 1
            room -= sizes[last[room]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        use = use - ratio[out] * step
        use[out], basis[:, out] = ratio[out], column
    return [(basis[:, k].astype(int), max(0.0, float(use[k]))) for k in range(n)]


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 24, large_shares: tuple[int, ...] = (2, 3, 4, 6)) -> Plan:
    """The plan with the fewest sequences over several bounds of what counts as large."""
    return min((_plan(counts, capacity, groups, share) for share in large_shares), key=lambda p: p.sequences)


def _plan(counts: np.ndarray, capacity: int, groups: int, large_share: int) -> Plan:
    """A plan for ``counts[length]`` pieces of each length up to the capacity.

    Lengths over ``capacity / large_share`` are large; they form at most ``groups`` groups.
    """
    plan = Plan(capacity)
    left = {k: int(c) for k, c in enumerate(counts) if c and k}
    if full := left.pop(capacity, 0):
        plan.best_fit(capacity, full)
    large = sorted((k for k in left if k > capacity // large_share), reverse=True)
    total = sum(left[k] for k in large)
    heads: list[list[list[int]]] = []
    for k in large:  # groups of equal cardinality, largest lengths first; a length stays in one group
        if not heads or sum(c for _, c in heads[-1]) >= total / groups:
            heads.append([])
        heads[-1].append([k, left[k]])
    if heads:
        sizes, demand = np.array([g[0][0] for g in heads]), np.array([float(sum(c for _, c in g)) for g in heads])
        chosen = sorted(_configurations(sizes, demand, capacity), key=lambda c: -int(c[0] @ sizes))
        for column, times in chosen:
            _substitute(plan, heads, column, int(times + 1e-6))
        for k in large:
            left[k] = sum(c for g in heads for length, c in g if length == k)
    for k in sorted(left, reverse=True):
        if left[k]:
            plan.best_fit(k, left[k])
    return plan


def _substitute(plan: Plan, heads: list, column: np.ndarray, times: int) -> None:
    """Fill ``times`` sequences of a configuration with the groups' actual lengths, largest first."""
    wanted = [(g, int(c)) for g, c in enumerate(column) if c]
    while times > 0 and wanted:
        if any(sum(c for _, c in heads[g]) < n for g, n in wanted):
            return
        count = min([times, *(heads[g][0][1] // n for g, n in wanted)]) or 1
        sequence, room = plan.sequences, plan.capacity
        plan.sequences += count
        for g, n in wanted:
            for _ in range(n):
                length = heads[g][0][0]
                plan.put(length, count, sequence, plan.capacity - room)
                room -= length
                heads[g][0][1] -= count
                if not heads[g][0][1]:
                    heads[g].pop(0)
        plan.open[room].append((sequence, count))
        times -= count


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = settle(token_pieces(docs, path or tokenizer_path(), capacity).withColumn("_salt", F.monotonically_increasing_id()))
    spark = pieces.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("_salt"), F.lit(buckets)).cast("int"))
    # at most ``capacity`` lengths times ``buckets`` rows; joined on the window's own keys if too many to broadcast
    sizes = settle(pieces.groupBy("length", "_salt").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, "int64")
    for length, n in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length
        counts[length] = n
    plan = plan_packing(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.join(small(settle(bases), 90), ["length", "_salt"]).withColumn("_rank", F.col("_base") + rank).drop("_base", "_salt")
    runs = np.array(sorted(plan.runs) or np.zeros((0, 5)), "int64")
    shared = spark.sparkContext.broadcast((runs[:, 0] * (1 << 44) + runs[:, 1], runs[:, 1], runs[:, 3], runs[:, 4]))

    def locate(batches):
        keys, ranks, sequences, offsets = shared.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "_rank"))
            k = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            kept = [b.column(b.schema.get_field_index(n)) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences[k] + rank - ranks[k]), pa.array(offsets[k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return in_arrow(ranked, locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
