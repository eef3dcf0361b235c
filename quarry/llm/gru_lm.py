"""Language-model scoring with a gated recurrent network in numpy.

1. Words are counted over the whole corpus, in training documents and in all. The
   most frequent training words that make up the share ``covered`` of the training
   tokens, at least ``shortlist`` of them, get units of their own, in classes, so
   their number grows with the vocabulary; all other words fall into ``BUCKETS``
   further classes by their ending, within which a word has its smoothed share of
   the counts. So the model is a distribution over the same words as the counts,
   unknown ones included.
2. Each text is split into words once more and written as numbers of units, with
   the sums of the base score, by slices of the training documents.
3. Training passes once over every training document in slices that double: each
   task goes on from the common parameters by truncated backpropagation over its
   documents and the parameters are averaged, weighted by tokens. Which documents
   share a task so decides the last digits of the parameters: the scores of two
   runs over differently dealt tables differ a little.
4. Scoring runs documents side by side, each from a zero state that it carries
   across windows, so a document's score is the log-likelihood of its complete text.

Tasks know the counts of at most ``frequent`` words, the most frequent ones of the
whole corpus. The others never leave the cluster: a document's rare words meet
their counts in a join by hash, once for each word of a document; as each is rarer
than all the frequent ones, no key of the join is hot.

Defined results: a null text is empty, so it is one end token; a null doc_id
counts as an empty text for the split; without training documents all counts are
0 and the model is uniform over its classes; an empty table gives an empty
result; repeated rows are counted and scored each for itself; a very long text is
one sequence whatever its length; equal counts are ranked by the word; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import each_row, in_arrow, settle

END = b" "  # no word holds a space
CLASS_SIZE = 32
#: Words with units of their own: the least number, and the share of all counted tokens they make up.
SHORTLIST = 512
COVERED = 0.5
BUCKETS = 16
HIDDEN = 16
STREAMS = 256
STEPS = 32
#: Rows of class probabilities at a time, which then stay in a core's cache.
BLOCK = 1024
#: Training takes a step each time that it has gone through so many tokens, in windows of STEPS steps.
STEP_TOKENS = 2048
#: In scoring a window has as many steps, up to the second number, as make so many tokens of the streams that are left.
SCORE_TOKENS, LONGEST = 8192, 256
#: Hidden units grow with the fourth root of the training tokens from here on; from so few on, there are HIDDEN.
GROWS_FROM = 200_000_000
#: Parameter vectors that are averaged in one group.
FAN_IN = 32
CHUNK_TOKENS = 4_000_000
COUNTED = 250_000
#: Words of a batch's texts that are encoded at once, a whole text at least.
ENCODED = 200_000
REMEMBERED = 200_000
FREQUENT = 100_000
#: Slices of the training documents in 64ths, by hash; each doubles, together they are all of them.
SLICES = ((0, 4), (4, 8), (8, 16), (16, 32), (32, 64))
RATES = (0.01, 0.01, 0.01, 0.007, 0.004)


def words_of(text: str | bytes | None) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


# ---------------------------------------------------------------- the network


def _order(keys: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative keys; those of 16 bits sort by radix."""
    return np.argsort(keys.astype("u2") if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")


def _bounded(logits: np.ndarray) -> None:
    """At most 60, so that exponentials stay finite."""
    if logits.size and not logits.max() <= 60:
        np.minimum(logits, 60, out=logits)


class Network:
    """Parameters and the passes over a window of streams."""

    NAMES = ("inputs", "start", "recur", "recur_bias", "classes", "class_bias", "words", "word_bias")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.hidden = params["recur"].shape[0]
        self.n_words = params["words"].shape[0] * CLASS_SIZE

    @classmethod
    def initial(cls, counts: np.ndarray, bucket_mass: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> Network:
        """A network that starts as the unigram model of the shortlist's counts and the buckets' masses."""
        rng, n = np.random.default_rng(seed), -(-len(counts) // CLASS_SIZE) * CLASS_SIZE
        padded = np.zeros(n)
        padded[: len(counts)] = counts + 1.0
        by_class = padded.reshape(-1, CLASS_SIZE)
        mass = np.concatenate((by_class.sum(1), bucket_mass))
        with np.errstate(divide="ignore"):
            within = np.maximum(np.log(by_class / by_class.sum(1, keepdims=True)), -30.0)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype("f4")
        return cls(
            {
                "inputs": draw(n + BUCKETS, 3 * hidden),
                "start": draw(1, 3 * hidden),
                "recur": draw(hidden, 3 * hidden),
                "recur_bias": np.zeros(3 * hidden, "f4"),
                "classes": draw(hidden, len(mass)),
                "class_bias": np.log(mass / mass.sum()).astype("f4"),
                "words": draw(n // CLASS_SIZE, hidden, CLASS_SIZE),
                "word_bias": within.astype("f4"),
            }
        )

    def gates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, recurrence and bias gate by gate, so that a gate of all streams is one block; the two sigmoids' are negated."""
        p, k = self.p, self.hidden
        table = np.concatenate((p["inputs"], p["start"])).reshape(-1, 3, k).transpose(1, 0, 2).copy()
        table[:2] += p["recur_bias"].reshape(3, 1, k)[:2]
        recur = p["recur"].reshape(k, 3, k).transpose(1, 0, 2).copy()
        np.negative(table[:2], table[:2])
        np.negative(recur[:2], recur[:2])
        return table, recur, p["recur_bias"][2 * k :]

    def states(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool, ready: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states after each step of (steps, streams) inputs; ``fresh`` marks a document's first step.

        To ``keep`` are (gates, steps, streams, units) of z, r and n, and the states before each step and what r is multiplied with.
        """
        table, recur, late = ready or self.gates()
        (steps, width), k = ids.shape, self.hidden
        x = np.take(table, ids, 1)
        begins, anew = _rows_by_step(fresh)
        out, late = np.empty((steps, width, k), x.dtype), np.repeat(late[None], width, 0)
        before, inner = (np.empty_like(out), np.empty_like(out)) if keep else (None, None)
        a, product = np.empty((3, width, k), x.dtype), np.empty((width, k), x.dtype)
        for t in range(steps):
            if keep:
                before[t] = h
                h = before[t]
            elif begins[t] < begins[t + 1]:
                h = h.copy()
            if begins[t] < begins[t + 1]:
                h[anew[begins[t] : begins[t + 1]]] = 0
            np.matmul(h, recur, a)
            gates, n, an, new = x[:2, t], x[2, t], inner[t] if keep else a[2], out[t]
            gates += a[:2]
            np.exp(gates, gates)
            gates += 1
            np.reciprocal(gates, gates)
            np.add(a[2], late, an)
            np.multiply(gates[1], an, product)
            n += product
            np.tanh(n, n)
            np.subtract(h, n, new)
            new *= gates[0]
            new += n
            h = new
        return out, (x, before, inner)

    def outputs(self, hs: np.ndarray, targets: np.ndarray, grad: bool) -> tuple[np.ndarray, dict, np.ndarray | None]:
        """Natural log probabilities of flat targets, and on demand gradients of their negative sum."""
        p, k, n_classes = self.p, self.hidden, self.n_words // CLASS_SIZE
        classes = np.where(targets < self.n_words, targets // CLASS_SIZE, targets - self.n_words + n_classes)
        order = _order(classes)  # rows of one class side by side
        inside, mine = targets[order] % CLASS_SIZE, classes[order]
        wide = np.ones((len(order), k + 1), hs.dtype)  # states and a one for the biases
        wide[:, :k] = np.take(hs, order, 0)
        edges = np.searchsorted(mine, np.arange(n_classes + 1))
        # a bias is one more row of its weights
        of_class, of_word = np.vstack((p["classes"], p["class_bias"])), np.concatenate((p["words"], p["word_bias"][:, None]), 1)
        logp, dh, g_class = np.empty(len(order), hs.dtype), np.empty((len(order), k) if grad else 0, hs.dtype), np.zeros_like(of_class)
        for low in range(0, len(order), BLOCK):
            rows = slice(low, low + BLOCK)
            e, at = wide[rows] @ of_class, mine[rows]
            _bounded(e)
            every = np.arange(len(e))
            told = e[every, at]
            np.exp(e, e)
            total = e @ np.ones(e.shape[1], e.dtype)
            logp[rows] = told - np.log(total)
            if grad:  # those of e / total, which is never written
                e[every, at] -= total
                share = 1 / total
                np.matmul(e, p["classes"].T, dh[rows])
                dh[rows] *= share[:, None]
                g_class += (wide[rows] * share[:, None]).T @ e
        short = edges[-1]
        inner = np.empty((short, CLASS_SIZE), hs.dtype)
        met = np.flatnonzero(edges[:-1] < edges[1:]).tolist()
        parts = [slice(edges[c], edges[c + 1]) for c in met]
        for c, rows in zip(met, parts, strict=True):
            np.matmul(wide[rows], of_word[c], inner[rows])
        _bounded(inner)
        every, inside = np.arange(short), inside[:short]
        logp[:short] += inner[every, inside]
        np.exp(inner, inner)
        sums = inner @ np.ones(CLASS_SIZE, inner.dtype)
        logp[:short] -= np.log(sums)
        told = np.empty_like(logp)
        told[order] = logp
        if not grad:
            return told, {}, None
        inner[every, inside] -= sums
        inner *= (1 / sums)[:, None]
        g_word, d_word = np.zeros_like(of_word), np.empty((short, k), hs.dtype)
        for c, rows in zip(met, parts, strict=True):
            np.matmul(wide[rows].T, inner[rows], g_word[c])
            np.matmul(inner[rows], p["words"][c].T, d_word[rows])
        dh[:short] += d_word
        places = np.empty_like(order)
        places[order] = np.arange(len(order))
        return told, {"classes": g_class[:k], "class_bias": g_class[k], "words": g_word[:, :k], "word_bias": g_word[:, k]}, np.take(dh, places, 0)

    def gradients(self, ids: np.ndarray, fresh: np.ndarray, targets: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of a window's total loss and the state after it."""
        p, k = self.p, self.hidden
        hs, ((z, r, n), before, inner) = self.states(ids, fresh, h, True)
        at = np.flatnonzero(live.ravel())
        whole = len(at) == live.size
        _, g, d_out = self.outputs(hs.reshape(-1, k) if whole else hs.reshape(-1, k)[at], targets.ravel() if whole else targets.ravel()[at], True)
        if not whole:
            d_out, dh_all = np.zeros((live.size, k), hs.dtype), d_out
            d_out[at] = dh_all
        # dh_all holds the gradients of the states; what they are multiplied with doesn't depend on them
        dh_all, das = d_out.reshape(*live.shape, k), np.empty((3, *hs.shape), hs.dtype)
        slope_z, slope_r, slope_n = das
        np.multiply(n, n, slope_n)
        np.subtract(1, slope_n, slope_n)
        keeps = 1 - z
        slope_n *= keeps  # (1 - z) (1 - n n)
        keeps *= z
        np.subtract(before, n, slope_z)
        slope_z *= keeps
        np.subtract(1, r, slope_r)
        slope_r *= r
        slope_r *= inner
        slope_r *= slope_n
        d_late = slope_n.copy()
        slope_n *= r
        begins, anew = _rows_by_step(fresh)
        back, carried, shares = p["recur"].reshape(k, 3, k).transpose(1, 2, 0).copy(), np.zeros(h.shape, hs.dtype), np.empty((3, *h.shape), hs.dtype)
        for t in range(len(ids) - 1, -1, -1):
            dh, da = dh_all[t], das[:, t]
            dh += carried
            da *= dh
            np.matmul(da, back, shares)
            np.multiply(dh, z[t], carried)
            carried += shares[0]
            carried += shares[1]
            carried += shares[2]
            if begins[t] < begins[t + 1]:
                carried[anew[begins[t] : begins[t + 1]]] = 0
        d_late *= dh_all
        das = das.reshape(3, -1, k)
        g["recur"] = np.matmul(before.reshape(-1, k).T, das).transpose(1, 0, 2).reshape(k, 3 * k)
        g["recur_bias"] = (np.ones(live.size, hs.dtype) @ das).ravel()
        das[2] = d_late.reshape(-1, k)
        flat = ids.ravel()
        order = _order(flat)
        heads = np.flatnonzero(np.diff(flat[order], prepend=-1))
        table = np.zeros((len(p["inputs"]) + 1, 3, k), hs.dtype)
        table[flat[order][heads]] = np.add.reduceat(np.take(das, order, 1), heads, axis=1).transpose(1, 0, 2)
        table = table.reshape(-1, 3 * k)
        g |= {"inputs": table[:-1], "start": table[-1:]}
        return g, hs[-1]


def _rows_by_step(marks: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Streams marked in each step: those of step t lie from the t-th to the next place."""
    step, stream = np.nonzero(marks)
    return np.searchsorted(step, np.arange(len(marks) + 1)).tolist(), stream


class Adam:
    EPS = 1e-4

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        """All parameters lie in one vector, of which ``params`` becomes views."""
        self.flat, at = np.concatenate([v.ravel() for v in params.values()]), 0
        for k, v in params.items():
            params[k] = self.flat[at : at + v.size].reshape(v.shape)
            at += v.size
        self.names, self.rate, self.t = list(params), rate, 0
        self.m, self.v, self.buffer = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty_like(self.flat)

    def step(self, grads: dict[str, np.ndarray], seen: int, share: float = 1.0) -> None:
        """A step along the mean of gradients summed over ``seen`` tokens; ``share`` below 1 for fewer tokens than a whole one has."""
        self.t += 1
        g, a = np.concatenate([grads[k].ravel() for k in self.names]), self.buffer
        g *= np.float32(1 / seen)
        norm = math.sqrt(float(g @ g))
        g *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        np.subtract(g, self.m, a)
        a *= np.float32(0.1)
        self.m += a
        np.multiply(g, g, a)
        a -= self.v
        a *= np.float32(0.01)
        self.v += a
        np.sqrt(self.v, a)
        a += np.float32(self.EPS)
        np.divide(self.m, a, a)
        a *= np.float32(share * self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        self.flat -= a


def streams(docs: list[np.ndarray], start: int, width: int = STREAMS, longest: int = STEPS) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows over documents laid side by side, longest first into the shortest stream.

    (inputs, fresh, targets, live, doc) of shape (steps, streams). Streams are in
    order of length and a window has those alone that go on, so ``streams[:n]`` of a state carry over.
    """
    width = max(1, min(width, len(docs)))
    lanes, open_lanes = [[] for _ in range(width)], [(0, k) for k in range(width)]
    for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
        fill, lane = open_lanes[0]
        lanes[lane].append(k)
        heapq.heapreplace(open_lanes, (fill + len(docs[k]), lane))
    lanes = [lanes[k] for _, k in sorted(open_lanes, reverse=True)]
    order = np.array([k for own in lanes for k in own], np.int32)
    sizes = np.array([len(docs[k]) for k in order], np.int64)
    # stream after stream in one row each; a window gathers from them
    targets = np.concatenate([docs[k] for k in order])
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    inputs[np.cumsum(sizes) - sizes] = start
    owner = np.repeat(order, sizes)
    fill = np.array([sum(len(docs[k]) for k in own) for own in lanes])
    begin = np.cumsum(fill) - fill
    t = 0
    while t < fill[0]:
        n = int((fill > t).sum())
        steps = min(max(STEPS, min(longest, SCORE_TOKENS // n)), int(fill[0]) - t)
        step = t + np.arange(steps)[:, None]
        live = step < fill[:n]
        at = np.where(live, begin[:n] + step, 0)
        i = np.where(live, inputs[at], start)
        yield i, i == start, targets[at], live, owner[at]
        t += steps


def train(net: Network, docs: list[np.ndarray], adam: Adam) -> None:
    """One pass; windows gather until they have enough tokens for a step, so the narrow ends of long documents don't weigh more."""
    h, total, seen = np.zeros((STREAMS, net.hidden), "f4"), None, 0
    for inputs, fresh, targets, live, _ in streams(docs, len(net.p["inputs"])):
        grads, h = net.gradients(inputs, fresh, targets, live, h[: inputs.shape[1]])
        seen += int(live.sum())
        if total is None:
            total = grads
        else:
            for k, g in grads.items():
                total[k] += g
        if seen >= STEP_TOKENS:
            adam.step(total, seen)
            total, seen = None, 0
    if seen:
        adam.step(total, seen, seen / STEP_TOKENS)


def score(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each document's classes and shortlist words."""
    h, out, ready = np.zeros((STREAMS, net.hidden), "f4"), np.zeros(len(docs)), net.gates()
    for inputs, fresh, targets, live, owner in streams(docs, len(net.p["inputs"]), longest=LONGEST):
        hs, _ = net.states(inputs, fresh, h[: inputs.shape[1]], False, ready)
        h, at = hs[-1], np.flatnonzero(live.ravel())
        logp, _, _ = net.outputs(hs.reshape(-1, net.hidden)[at], targets.ravel()[at], False)
        out += np.bincount(owner.ravel()[at], logp, len(docs))
    return out


# ---------------------------------------------------------------- the corpus


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches with a column ``ids`` in groups of about CHUNK_TOKENS ids, and the documents' ids."""
    group, docs, size = [], [], 0
    for batch in batches:
        group.append(batch)
        docs += [np.frombuffer(b, "<i4") for b in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
        size += sum(map(len, docs[len(docs) - batch.num_rows :]))
        if size >= CHUNK_TOKENS:
            yield group, docs
            group, docs, size = [], [], 0
    if docs:
        yield group, docs


def count_words(rows: DataFrame) -> DataFrame:
    """(word, bucket, n, every) over (text, held_out): how often training documents and all documents hold a word, the end token included."""

    def count(batches):
        counts: dict[bool, Counter] = {False: Counter(), True: Counter()}

        def told():
            for held, c in counts.items():
                n = pa.array(list(c.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(np.zeros(len(c), np.int64)) if held else n, n], names=["word", "n", "every"])
                c.clear()

        for text, held in each_row(batches, "text", "held_out"):
            counts[held].update(words_of(text))
            counts[held][END] += 1
            if sum(map(len, counts.values())) > COUNTED:
                yield from told()
        yield from told()

    found = in_arrow(rows.select(F.col("text").cast("binary").alias("text"), "held_out"), count, "word binary, n long, every long")
    last = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(BUCKETS)).cast("int").alias("bucket")  # as ``bucket``
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("every").alias("every")).select("word", last, "n", "every")


class Lexicon:
    """What tasks know of the counts: the frequent words, the shortlist among them, and the masses of the buckets.

    A word's code is its rank among the frequent ones; ``units``, ``logs`` and ``seen``
    hold unit, log10(n + 1) and n > 0 at these codes.
    """

    def __init__(self, frequent: list[tuple[bytes, int]], shortlist: int, tokens: int, distinct: int, mass: np.ndarray):
        self.tokens, self.distinct, self.mass = tokens, distinct, mass
        ranked = sorted(frequent, key=lambda f: (-f[1], f[0]))
        shortlist = min(shortlist, sum(n > 0 for _, n in ranked))
        self.codes = {w: k for k, (w, _) in enumerate(ranked)}
        self.ids = {w: k for k, (w, _) in enumerate(ranked[:shortlist])}
        self.short_counts = np.array([c for _, c in ranked[:shortlist]], float)
        self.n_short = max(1, -(-shortlist // CLASS_SIZE)) * CLASS_SIZE
        self.units = np.array([*range(shortlist), *(self.n_short + bucket(w) for w, _ in ranked[shortlist:])], "<i4")
        self.logs = np.log10(np.array([n for _, n in ranked], float) + 1)
        self.seen = np.array([n > 0 for _, n in ranked], np.int64)


class _Codes(dict):
    """Word -> its code in a lexicon; other words are numbered on from there as they are met, up to about REMEMBERED."""

    def __init__(self, lexicon: Lexicon):
        super().__init__(lexicon.codes)
        self.lexicon, self.hashes, self.buckets = lexicon, array("q"), array("i")
        masses = np.log10(lexicon.mass)
        # what a word adds to the model's score: nothing with a unit of its own, else log10(n + 1) less its bucket's mass
        outside = lexicon.units >= lexicon.n_short
        self.shares, self.masses = np.zeros(len(outside)), masses
        self.shares[outside] = lexicon.logs[outside] - masses[lexicon.units[outside] - lexicon.n_short]

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.hashes.append(hash_of(word))
        self.buckets.append(bucket(word))
        return k

    def encode(self, words: list[bytes]) -> np.ndarray:
        """Codes of words, valid up to the next call."""
        if len(self) > len(self.lexicon.codes) + REMEMBERED:
            self.clear()
            self.update(self.lexicon.codes)
            self.hashes, self.buckets = array("q"), array("i")
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def rows(self, words: list[bytes], starts: np.ndarray) -> tuple[pa.Array, ...]:
        """n_tokens, sure, logs, share, hashes, times and ids of documents that begin at ``starts`` of the words."""
        lex, known, code = self.lexicon, len(self.lexicon.codes), self.encode(words)
        others, none = np.array(self.buckets, np.int32), np.zeros(len(self.buckets))
        units = np.concatenate((lex.units, lex.n_short + others), dtype="<i4")[code]
        sums = [np.add.reduceat(np.concatenate(parts)[code], starts) for parts in ((lex.seen, none.astype(np.int64)), (lex.logs, none), (self.shares, -self.masses[others]))]
        ends = np.append(starts[1:], len(words))
        at = np.flatnonzero(code >= known)
        pairs, times = np.unique((np.searchsorted(starts, at, "right") - 1) * np.int64(len(self)) + code[at], return_counts=True)
        docs, met = pairs // len(self), pairs % len(self)
        hashes = np.array(self.hashes, np.int64)[met - known] if len(met) else np.empty(0, np.int64)
        listed = pa.array(np.searchsorted(docs, np.arange(len(starts) + 1)), pa.int32())
        ids = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(words)).astype("<i4") * np.int32(4)), pa.py_buffer(units)])
        return pa.array(ends - starts), *map(pa.array, sums), pa.ListArray.from_arrays(listed, pa.array(hashes)), pa.ListArray.from_arrays(listed, pa.array(times, pa.int32())), ids


def fit_lexicon(counts: DataFrame, shortlist: int, frequent: int, covered: float = COVERED, rank: str = "n") -> Lexicon:
    """From settled counts. At most ``frequent`` words, those of the largest ``rank``, come to the driver; sums cover all.

    The shortlist is of the words that make up ``covered`` of the tokens, of at least
    ``shortlist`` words, and of all the frequent ones where they make up less.
    """
    least = _least(counts, frequent, rank)
    often = [(bytes(r["word"]), r["n"]) for r in counts.where(F.col(rank) >= least).select("word", "n").toLocalIterator()]
    sums = counts.where("n > 0").groupBy("bucket").agg(F.sum(F.col("n") + 1).alias("m"), F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # BUCKETS rows
    mass = np.ones(BUCKETS)
    for r in sums:
        mass[r["bucket"]] += r["m"]
    tokens = sum(r["n"] for r in sums)
    reached = np.cumsum(sorted((n for _, n in often), reverse=True))
    out = Lexicon(often, max(shortlist, int((reached < covered * tokens).sum()) + 1), tokens, sum(r["v"] for r in sums), mass)
    n_of = dict(often)
    for w in out.ids:  # the shortlist's words have units of their own
        out.mass[bucket(w)] -= n_of[w] + 1
    return out


def _least(counts: DataFrame, frequent: int, rank: str) -> int:
    """The smallest power of 2 that at most ``frequent`` words reach."""
    steps = counts.groupBy(F.floor(F.log2(rank)).cast("int").alias("k")).agg(F.count("*").alias("words")).collect()  # at most 64 rows
    taken, least = 0, 1 << 62
    for k, words in sorted(((r["k"], r["words"]) for r in steps if r["k"] is not None), reverse=True):
        if taken + words > frequent:
            break
        taken, least = taken + words, 1 << k
    return least


CODED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("slice", pa.int32()), ("n_tokens", pa.int64()), ("sure", pa.int64()), ("logs", pa.float64()), ("share", pa.float64())]
    + [("hashes", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("ids", pa.binary())]
)


def hash_of(word: bytes) -> int:
    """As Spark's ``xxhash64``."""
    k = xxhash.xxh64_intdigest(word, 42)
    return k - (1 << 64) if k >> 63 else k


def encode_documents(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(row, doc_id, held_out, slice, n_tokens, sure, logs, share, hashes, times, ids) of (doc_id, text, held_out).

    ``slice`` is -1 for held-out documents; ``sure``, ``logs`` and ``share`` are what
    the frequent words add to n_known, to the base score and to the model's score;
    ``hashes`` and ``times`` are a document's other words.
    """
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(64))
    part = F.when(F.col("held_out"), -1)
    for k, (_, high) in enumerate(SLICES):
        part = part.when(place < high, k)
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "slice": part.cast("int")})

    def encode(batches):
        codes = _Codes(shared.value)
        for batch in batches:
            words, starts, first = [], [], 0
            texts = batch.column(batch.num_columns - 1)
            for k, text in enumerate(texts):
                starts.append(len(words))
                words += words_of(text.as_py())
                words.append(END)
                if len(words) >= ENCODED or k + 1 == batch.num_rows:
                    own = batch.slice(first, k + 1 - first).drop_columns(["text"])
                    yield pa.RecordBatch.from_arrays([*own.columns, *codes.rows(words, np.array(starts))], schema=CODED)
                    words, starts, first = [], [], k + 1

    numbered = numbered.select("row", "doc_id", "held_out", "slice", F.col("text").cast("binary").alias("text"))
    told = "row long, doc_id long, held_out boolean, slice int, n_tokens long, sure long, logs double, share double, hashes array<long>, times array<int>, ids binary"
    return in_arrow(numbered, encode, told)


def hidden_units(tokens: int) -> int:
    """HIDDEN, from GROWS_FROM training tokens on times the fourth root of their multiple, in steps of four."""
    return max(HIDDEN, 4 * round(HIDDEN / 4 * (tokens / GROWS_FROM) ** 0.25))


def averaged(vectors: DataFrame, tasks: int) -> DataFrame:
    """The mean of (h, seen, flat) rows by ``seen``, in rounds whose groups hold about FAN_IN vectors, however many tasks there were."""

    def mean(key, frame):
        seen, total = int(frame["seen"].sum()), 0.0
        for n, f in zip(frame["seen"], frame["flat"], strict=True):
            total = total + n / seen * np.frombuffer(f, "f4").astype("f8")
        return pd.DataFrame({"h": [int(key[0])], "seen": [seen], "flat": [total.astype("f4").tobytes()]})

    groups = tasks
    while True:
        groups = -(-groups // FAN_IN)
        vectors = vectors.groupBy(F.pmod("h", F.lit(groups)).alias("g")).applyInPandas(mean, "h long, seen long, flat binary")
        if groups <= 1:
            return vectors


def fit_network(coded: DataFrame, shared: Broadcast) -> Network:
    """One pass of the training documents in doubling slices, parameters averaged after each."""
    lexicon = shared.value
    net = Network.initial(lexicon.short_counts if len(lexicon.ids) else np.zeros(1), lexicon.mass, hidden_units(lexicon.tokens))
    context = coded.sparkSession.sparkContext
    for k, rate in enumerate(RATES):
        params = context.broadcast(net.p)

        def learn(batches, params=params, rate=rate):
            own = Network({name: v.copy() for name, v in params.value.items()})
            adam, seen = Adam(own.p, rate), 0
            for _, docs in gathered(batches):
                seen += sum(map(len, docs))
                train(own, docs, adam)
            if seen:
                flat = np.concatenate([own.p[name].ravel() for name in Network.NAMES]).astype("f4")
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh32_intdigest(flat.tobytes())], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["h", "seen", "flat"])

        rows = coded.where(F.col("slice") == k).select("ids")
        means = averaged(in_arrow(rows, learn, "h long, seen long, flat binary"), rows.rdd.getNumPartitions()).collect()  # one row
        if means:
            flat, at, fitted = np.frombuffer(means[0]["flat"], "f4"), 0, {}
            for name in Network.NAMES:
                size = net.p[name].size
                fitted[name] = flat[at : at + size].reshape(net.p[name].shape).copy()
                at += size
            net = Network(fitted)
        params.destroy()
    return net


def score_documents(docs: DataFrame, shortlist: int = SHORTLIST, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    counts = settle(count_words(rows))
    lexicon = fit_lexicon(counts, shortlist, frequent, rank="every")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(lexicon)
    coded = settle(encode_documents(rows, shared), "slice")
    params = context.broadcast(fit_network(coded, shared).p)

    def run(batches):
        own = Network(params.value)
        for group, ids in gathered(batches):
            model, at = score(own, ids) / math.log(10), 0
            for batch in group:
                yield batch.drop_columns(["ids"]).append_column("model", pa.array(model[at : at + batch.num_rows]))
                at += batch.num_rows

    plain = ("row", "doc_id", "held_out", "n_tokens", "sure", "logs", "share")
    scored = in_arrow(coded.select(*plain, "ids"), run, "row long, doc_id long, held_out boolean, n_tokens long, sure long, logs double, share double, model double")

    known = counts.where((F.col("n") > 0) & (F.col("every") < _least(counts, frequent, "every"))).select(F.xxhash64("word").alias("hash"), "n")
    rare = coded.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("r")).select("row", F.col("r.hashes").alias("hash"), F.col("r.times").alias("times"))
    found = rare.join(known, "hash").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    joined = scored.join(found, "row", "left")
    more, size = F.coalesce("more_logs", F.lit(0.0)), math.log10(lexicon.tokens + lexicon.distinct + 1)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(size)).alias("base_score"),
        (F.col("model") + F.col("share") + more).alias("score"),
    )
