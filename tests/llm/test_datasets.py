"""Hard negatives, the Merkle manifest and mixtures against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives, manifest, mixture
from quarry.llm.in_order import running

from .conftest import DOCS, ODD

VECTORS = "vec_id long, embedding array<float>, label int, part string, place string, score string, rank string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# hard negatives


def brute_mined(rows, every, top, low=80, high=100):
    taking = []
    for vec, emb, label in rows:
        if vec is None or label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in emb]
        taking.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, q))
    out = []
    for k, (a, label, q) in enumerate(taking):
        if a % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, r, strict=False)), v, b) for j, (v, b, r) in enumerate(taking) if j != k]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], s[1]))[:top]:
            inside = sorted((s for s in scored if s[2] != label and low * ps <= 100 * s[0] <= high * ps), key=lambda s: (-s[0], s[1]))[:top]
            out += [(a, p, n + 1, v, ps, s) for n, (s, v, _) in enumerate(inside)]
    return sorted(out)


def vectors(n=90, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.normal(0.4, 0.3, 6)], int(rng.integers(0, 3))) for k in range(n)]
    rows += [(k, [0.5] * 6, k % 4) for k in range(100, 140)]  # one common vector
    rows += [(3, None, 1), (4, [0.1, None, 1.0], 1), (5, [float("nan")] * 6, 1), (6, [float("inf")] * 6, 1), (8, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    return [*rows, (20, [], 1), (40, [0.4, 0.5], 2), rows[10], rows[10], (-30, [0.9] * 6, 0), (60, [-3.0] * 6, 0)]


def mined(df, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, **more).collect())


@pytest.mark.parametrize("blocks", [(512, 4096, 2), (3, 7, 4), (1, 50, 1)])
def test_mined_negatives_equal_brute_force(spark, blocks):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], VECTORS)
    found = mined(df, every=10, top=3, anchor_rows=blocks[0], block_rows=blocks[1], chunks=blocks[2])
    want = brute_mined(rows, 10, 3)
    assert found == want and len(want) > 50
    if blocks[2] == 2:
        assert mined(df.limit(0)) == []


def test_huge_components_stay_exact_or_stop_at_the_limit(spark):
    rows = [(10, [3e5, 1.0], 1), (11, [3e5, 2.0], 1), (12, [2.9e5, -1.0], 2), (20, [1e30, 0.0], 1), (21, [-1e30, 1.0], 2)]
    df = spark.createDataFrame([(*r, *"abcd") for r in rows], VECTORS)
    want = brute_mined(rows[:3], 10, 5)
    assert want and [r for r in mined(df.where("vec_id < 20"), every=10)] == want
    assert isinstance(mined(df, every=10), list)


# sums in order and mixtures


def test_running_sums_in_any_number_of_ranges(spark):
    rows = [(g, k % 5, k) for k in range(60) for g in ("a", None)] + [("a", 1, 1)] * 40
    df = spark.createDataFrame(rows, "g string, o long, v long")
    for per in (1_000_000, 7):
        found = running(df, "g", ["o", "v"], "v", 100, per).collect()
        for g in ("a", None):
            before, want = 0, []
            for _, o, v in sorted(r for r in ((r[0] or "", r[1], r[2]) for r in rows if r[0] == g)):
                want.append((o, v, before % 100))
                before += v
            assert sorted((r.o, r.v, r._before) for r in found if r.g == g) == sorted(want)


def brute_targets(sizes, share=1.5, most=2, cycle=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    left, stopped = share * sum(sizes.values()), set()
    while True:
        total = sum(weight[s] for s in names if s not in stopped)
        goals = {s: most * sizes[s] if s in stopped else (left - sum(most * sizes[x] for x in stopped)) * weight[s] / total for s in names}
        above = {s for s in names if s not in stopped and goals[s] > most * sizes[s]}
        if not above:
            return goals
        stopped |= above


MIXED = [(k, "w " * (1 + (k * 37) % 90), f"s{k % 7 if k % 3 else 0}") for k in range(400)] + [(900, None, "s1"), (901, " \n", None), (902, "a b", None), (None, "null id", "s2"), (907, "twice", "s3"), (907, "twice", "s3"), (903, "x" * 9000, "s5"), (904, "w " * 30_000, "s6"), (905, "", "empty")]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([(d, t, "en", s, 1, "r", "k", "x", 1, *"abcdefg") for d, t, s in MIXED], DOCS)


def test_mixture_comes_near_its_targets(spark, mixed):
    found = mixture.digest_mixture(mixed).collect()
    assert len(found) == len(MIXED)
    sizes, sources = {}, {}
    for d, t, s in MIXED:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        sources[d] = s
    goals = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        s = sources[r.doc_id]
        assert (r.source_size, pytest.approx(r.target)) == (sizes[s], goals[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[s] += r.taken
    largest = {s: max(len((t or "").split()) for _, t, x in MIXED if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= 1.5 * largest[s] + 1
    again = mixture.digest_mixture(mixed.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixture.digest_mixture(mixed.limit(0)).count() == 0


def test_mix_emits_each_copy_with_all_columns(spark, mixed):
    out = mixture.mix(mixed)
    assert out.columns == [*mixed.columns, "copy"]
    emitted = sorted((r.doc_id, r.text, r.source) for r in out.collect() if r.doc_id is not None)
    want = {}
    for r in mixture.digest_mixture(mixed).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    counts = {}
    for d, _, _ in emitted:
        counts[d] = counts.get(d, 0) + 1
    assert counts == {d: n for d, n in want.items() if n and d is not None}
    own = mixture.mix(mixed, spark.createDataFrame([("s0", 1.0), (None, 5.0)], "source string, weight double"), share=0.1)
    assert {r.source for r in own.collect()} <= {"s0", None}


@pytest.mark.parametrize(("share", "most"), [(1.0, 1.0), (0.3, 2.0), (1.9, 2.0), (2.0, 2.0)])
def test_targets_by_rounds(spark, share, most):
    sizes = {"a": 100, "b": 3, "c": 50, "d": 0, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixture.targets(mixture.weighed(df), share, most).collect()}
    assert found == pytest.approx(brute_targets(sizes, share, most))


# the manifest


def h(*parts):
    return sha("".join(parts))


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests, fanout=16):
    """Root, and each leaf's (left, right) siblings from the leaf up."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = p // fanout * fanout
            paths[k].append(("".join(level[run:p]), "".join(level[p + 1 : run + fanout])))
            at[k] = p // fanout
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_manifest(rows):
    groups = {}
    for d, t, s in rows:
        leaf = lambda x: h(enc(d), enc(s), enc("en"), enc(1), enc(x))  # noqa: B023, E731
        groups.setdefault(s, []).append((d is not None, d or 0, leaf(t), leaf(lowered(t))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s])]) for s in names}
    root, above = climb([trees[s][0] for s in names])
    out = []
    for s, over in zip(names, above, strict=True):
        for (known, d, leaf, other), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            d = d if known else None
            fold = other if known and zlib.crc32(str(d).encode()) % 5 == 0 else leaf
            for left, right in path + over:
                fold = h(left, fold, right)
            out.append((d, leaf, trees[s][0], root, h(*(x for p in path + over for x in p)), fold, fold == root))
    return sorted(map(str, out))


MANY = [(k, f"Text {k} É" if k % 3 else f"text {k}", f"s{k % 3}" if k > 280 else "hot") for k in range(300)]
CASES = [MANY, [*((d, t, None if d and d > 4 else "s") for d, t in ODD), (9, "A", "Ä"), (9, "A", "Ä"), (-5, "NEG", "a")], [(k, "T", f"source {k:03}") for k in range(40)], [(1, "One", "s")], [(k, "T", None) for k in range(17)]]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_manifest_equals_brute_force(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame([(d, t, "en", s, 1, "r", "k", "x", 1, *"abcdefg") for d, t, s in rows], DOCS)
    found = manifest.digest_manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_manifest(rows)


def test_manifest_of_nothing_and_levels_of_the_store(spark, docs_of):
    assert manifest.digest_manifest(docs_of([])).count() == 0
    leaves = spark.range(300).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.col("id").alias("held"))
    store = manifest.grow(leaves, ["held"])
    assert [store.level(k).count() for k in range(store.levels + 1)] == [300, 19, 2, 1]
    assert store.tops().first().digest == climb([sha(str(k)) for k in range(300)])[0]
    assert [r.held for r in store.level(0).orderBy("pos").collect()] == list(range(300))
