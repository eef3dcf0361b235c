"""Quality rules, the classifier, language-model scoring, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry.llm import cotrain, gru_lm, quality_rules

from .conftest import ODD

BAD = ("idiot", "moron", "trash")


def corpus(n, seed):
    """(doc_id, text, good): prose, prose with bad words, and junk."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = ["".join(rng.choice(("an", "er", "th", "ou", "ing")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 120))]
        kind = k % 5
        if kind == 3:
            words = [rng.choice(BAD) if rng.random() < 0.08 else w for w in words] + [rng.choice(BAD)] * 2
        if kind == 4:
            words = [w + "$$$" for w in words]
        out.append((k, " ".join(words), kind < 3))
    return out


@pytest.fixture(scope="module")
def labelled(spark, docs_of):
    rows = corpus(900, 3)
    labels = [(k, int(k % 5 != 4), int(k % 5 == 3)) for k, _, _ in rows if k < 700]
    labels += [(1, None, 0), (None, 1, 1), (99_999, 1, 0), (2, 1, 0)]
    return docs_of(rows_of(rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: g for k, _, g in rows}


def rows_of(rows):
    return [(k, t) for k, t, _ in rows]


def test_binomial_bound_is_exact():
    for k, n in ((0, 10), (3, 50), (20, 400)):
        p = quality_rules.binomial_upper(k, n, 0.05)
        assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), 0.05, rel_tol=1e-6)
    assert quality_rules.binomial_upper(5, 5, 0.05) == 1.0


def brute_counts(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines, seen, duplicates = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(inside)


TEXTS = ["a b c d e a b c d e", "a b c d e f a b c d e", "one\ntwo\none\n \n \n#*$", "é é é é é é é\x1c x", "a a a a a a", "a b c d", "x y z w v u\nx y z w v u\nx y z w v u", None, ""]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert quality_rules.measure(text, quality_rules._Flags({}))[:5] == brute_counts(text)


def test_rules_catch_bad_and_keep_good(labelled):
    docs, labels, good = labelled
    found = quality_rules.judge(docs, labels).collect()
    assert len(found) == 900
    held = [r for r in found if r.doc_id >= 700]
    assert np.mean([r.kept for r in held if good[r.doc_id]]) >= 0.95
    assert np.mean([not r.kept for r in held if not good[r.doc_id]]) >= 0.95
    assert all(not r.kept for r in found if r.base_failed)


def test_rules_on_odd_rows(odd, labelled):
    _, labels, _ = labelled
    found = quality_rules.judge(odd, labels.limit(0)).collect()
    assert len(found) == len(ODD)
    for r in found:
        n, _, _, _, repeated = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and r.kept == (not r.base_failed)
    assert quality_rules.judge(odd.limit(0), labels).count() == 0


def test_classifier_on_held_out_rows(labelled):
    docs, labels, good = labelled
    found = {r.doc_id: r.kept for r in cotrain.classify(docs, labels).collect() if r.doc_id >= 700}
    assert len(found) == 200
    assert np.mean([k for d, k in found.items() if good[d]]) >= 0.95
    assert np.mean([not k for d, k in found.items() if not good[d]]) >= 0.95


def test_the_surest_rows_are_handed_over():
    sure = np.array([0.99, 0.5, 0.99, 1.0, 0.98, 0.99, 0.97])
    free = np.array([True, True, True, True, True, False, True])
    for most in range(8):
        want = sorted((k for k in range(7) if free[k] and sure[k] >= 0.98), key=lambda k: (-sure[k], k))[:most]
        assert cotrain.surest(sure, free, most, 0.98).tolist() == want


def test_views_are_apart():
    assert cotrain.metadata_view(None, None, None) == cotrain.metadata_view("", "", 0)
    assert cotrain.layout_view("a b") != cotrain.layout_view("A! B!")


def test_classifier_on_odd_rows(odd, labelled):
    _, labels, _ = labelled
    assert cotrain.keep_good(odd, labels.limit(0)).count() == len(ODD)
    assert cotrain.keep_good(odd, labels.limit(0)).columns == odd.columns
    assert cotrain.classify(odd.limit(0), labels).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    net = gru_lm.Network.initial(rng.integers(1, 50, 64).astype(float), np.ones(gru_lm.BUCKETS), hidden=5)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    docs = [rng.integers(0, 64 + gru_lm.BUCKETS, n).astype(np.int32) for n in (7, 4, 9)]
    inputs, fresh, targets, live, _ = next(gru_lm.streams(docs, len(net.p["inputs"]), 2))
    loss = lambda: -net.outputs(net.states(inputs, fresh, np.zeros((2, 5)), False)[0].astype("f8").reshape(-1, 5)[live.ravel()], targets.ravel()[live.ravel()], False)[0].sum()
    grads, _ = net.gradients(inputs, fresh, targets, live, np.zeros((2, 5)))
    for name in gru_lm.Network.NAMES:
        flat = net.p[name].reshape(-1)
        k = int(np.argmax(np.abs(grads[name])))
        kept = flat[k]
        flat[k] = kept + 1e-2
        up = loss()
        flat[k] = kept - 1e-2
        down = loss()
        flat[k] = kept
        assert math.isclose((up - down) / 2e-2, grads[name].reshape(-1)[k], rel_tol=0.03, abs_tol=1e-3)


def test_probabilities_add_up():
    rng = np.random.default_rng(4)
    net = gru_lm.Network.initial(rng.integers(1, 50, 40).astype(float), np.ones(gru_lm.BUCKETS))
    units = np.arange(net.n_words + gru_lm.BUCKETS)
    logp, _, _ = net.outputs(np.repeat(rng.standard_normal((1, gru_lm.HIDDEN)).astype("f4"), len(units), 0), units, False)
    assert math.isclose(np.exp(logp).sum(), 1.0, rel_tol=1e-4)


def test_streams_hold_each_document_once():
    docs = [np.arange(n, dtype=np.int32) + 1 for n in (1, 300, 5, 5, 70, 33)]
    got = {k: [] for k in range(len(docs))}
    for _, _, targets, live, owner in gru_lm.streams(docs, 999, 3):
        for lane in range(live.shape[1]):
            for t in range(live.shape[0]):
                if live[t, lane]:
                    got[int(owner[t, lane])].append(int(targets[t, lane]))
    assert all(got[k] == d.tolist() for k, d in enumerate(docs))


def test_scores(spark, docs_of):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(("a b", "c d", "e F g")) for _ in range(rng.randint(5, 60))) + f" rare{k}") for k in range(500)] + ODD
    found = gru_lm.score_documents(docs_of(rows), shortlist=4, frequent=6).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*gru_lm.words_of(t), gru_lm.END])
    total, distinct = sum(counts.values()), len(counts)
    want = {}
    for d, t in rows:
        words = [*gru_lm.words_of(t), gru_lm.END]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        want.setdefault(d, []).append((held(d), len(words), sum(counts[w] > 0 for w in words), total, base))
    assert len(found) == len(rows)
    for r in found:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9) for w in want[r.doc_id])
        assert r.score < 0
    normal = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id >= 10]
    assert sum(r.score for r in normal) > sum(r.base_score for r in normal)
    assert gru_lm.score_documents(docs_of([])).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path, docs_of):
    import corpus_pipeline

    passage = " ".join(f"bench{k}" for k in range(12))
    rows = [(k, t) for k, t, _ in corpus(400, 6)]
    text = dict(rows)
    rows += [(1000, text[0]), (1001, text[1] + " tail"), (1002, f"{text[2]} {passage}"), (1003, None)]
    spark.createDataFrame([(d, t, "en", f"src{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 5 != 4), int(k % 5 == 3)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: r.text for r in seen["benchmark_decontamination"].collect()}
    assert 1000 not in kept and 1001 not in kept and 0 in kept and 1 in kept
    assert not any("bench" in (t or "") for t in kept.values())
    bad = [k for k in range(400) if k % 5 >= 3]
    assert sum(k in kept for k in bad) <= 0.05 * len(bad)
    assert {r.doc_id for r in seen["best_fit_packing"].collect()} == set(kept)


def test_entry_has_all_training_data_queries():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names


def test_the_shortlist_grows_with_the_vocabulary(spark):
    for size in (400, 4000):
        words = [(f"w{k}".encode(), gru_lm.bucket(f"w{k}".encode()), 9 if k < size // 2 else 3) for k in range(size)]
        lexicon = gru_lm.fit_lexicon(spark.createDataFrame(words, "word binary, bucket int, n long"), 4, 5000)
        least = sorted((n for *_, n in words), reverse=True)
        assert lexicon.short_counts.sum() >= gru_lm.COVERED * lexicon.tokens
        assert len(lexicon.ids) == next(k for k in range(size) if sum(least[:k]) >= gru_lm.COVERED * lexicon.tokens)
        assert lexicon.n_short >= len(lexicon.ids)


def test_cutoffs_equal_brute_force(spark):
    rng = random.Random(11)
    names = [*quality_rules.COUNTS, *quality_rules.SIGNALS]
    rows = [(k, lang, 100, 500, 0, 0, 0, *(rng.random() for _ in quality_rules.SIGNALS)) for k in range(1200) for lang in [("en", "de", "fr", None)[min(3, k // 2 % 8)]]]
    marks = [(k, k % 3 > 0, k % 2 == 0) for k in range(1100)]
    path, most, level = ((0.0, 1.5), (0.0, 1.0), (0.02, 1.0), (0.1, 1.0), (0.0, 9.0)), 0.3, 0.05
    df = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{n} {'long' if n in quality_rules.COUNTS else 'double'}" for n in names))
    found = quality_rules.select_cutoffs(df, spark.createDataFrame(marks, "_id long, _good boolean, _fit boolean"), path, most, level)
    halves = {}
    for row in rows[:1100]:
        if row[0] % 3 > 0:
            halves.setdefault(row[1], ([], []))[row[0] % 2].append(row[7:])
    want = {}
    for lang, (fit, test) in halves.items():
        for share, margin in path:
            cuts = []
            for k, floor in enumerate(quality_rules.FLOORS):
                told = sorted(x[k] for x in fit)
                cuts.append(max(floor, margin * told[math.ceil((1 - share) * len(told)) - 1]))
            gone = sum(any(x > c for x, c in zip(row, cuts)) for row in test)
            if quality_rules.binomial_upper(gone, len(test), level / len(halves)) > most:
                break
            want[lang] = (cuts, gone, len(test))
    assert {f[0] for f in found} == set(want)
    for lang, *cuts, gone, n, _ in found:
        assert (gone, n) == want[lang][1:] and np.allclose(cuts, want[lang][0])


def test_languages_without_enough_labels_are_judged_together(spark):
    rng = random.Random(4)
    sizes = {"en": 700, "de": 90, "fr": 90, None: 60, "nl": 5}
    lang_of = [lang for lang, n in sizes.items() for _ in range(n)]
    names = [*quality_rules.COUNTS, *quality_rules.SIGNALS]
    rows = [(k, lang, 100, 500, 0, 0, 0, *(rng.random() for _ in quality_rules.SIGNALS)) for k, lang in enumerate(lang_of)] + [(5000, "unlabelled", 100, 500, 0, 0, 0, *[0.5] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{n} {'long' if n in quality_rules.COUNTS else 'double'}" for n in names))
    marks = spark.createDataFrame([(k, True, k % 2 == 0) for k in range(len(lang_of))], "_id long, _good boolean, _fit boolean")
    out = quality_rules.with_strata(df, marks)
    assert {(r.lang, r.n) for r in out.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {("=en", 700), (quality_rules.POOLED, 246)}
    found = {c[0]: c for c in quality_rules.select_cutoffs(out, marks)}
    assert set(found) == {"=en", quality_rules.POOLED}
    assert found[quality_rules.POOLED][-2] == sum(k % 2 for k, lang in enumerate(lang_of) if lang != "en")
    assert {r.lang for r in quality_rules.with_strata(df, marks.limit(0)).select("lang").distinct().collect()} == {quality_rules.POOLED}


def test_the_promised_rate_holds_over_many_draws():
    """Of cutoffs that the bound passes in fixed order, at most the level may truly reject more than promised."""
    rng, broken, draws = np.random.default_rng(5), 0, 3000
    true = (0.01, 0.03, 0.05, 0.07, 0.09)  # each step's true rate of false rejections
    for _ in range(draws):
        n, chosen = int(rng.integers(60, 400)), 0.0
        for p in true:
            if quality_rules.binomial_upper(int(rng.binomial(n, p)), n, 0.05) > 0.06:
                break
            chosen = p
        broken += chosen > 0.06
    assert broken / draws <= 0.05


def plain_log10(net, units):
    """A document's log10 probability of classes and shortlist words, word by word."""
    p, k = net.p, net.hidden
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, x, out = np.zeros(k), p["start"][0], 0.0
    for u in units:
        a = h @ p["recur"] + p["recur_bias"]
        z, r = sig(x[:k] + a[:k]), sig(x[k : 2 * k] + a[k : 2 * k])
        h = z * h + (1 - z) * np.tanh(x[2 * k :] + r * a[2 * k :])
        logits, short = h @ p["classes"] + p["class_bias"], net.n_words
        c = u // gru_lm.CLASS_SIZE if u < short else u - short + short // gru_lm.CLASS_SIZE
        out += logits[c] - np.log(np.exp(logits).sum())
        if u < short:
            inner = h @ p["words"][c] + p["word_bias"][c]
            out += inner[u % gru_lm.CLASS_SIZE] - np.log(np.exp(inner).sum())
        x = p["inputs"][u]
    return out / np.log(10)


def test_scores_equal_a_loop_over_words(docs_of, monkeypatch):
    """Whole scores, frequent, rare and unknown words included, under a network that the test knows."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{int(v)}" for v in rng.zipf(1.4, int(rng.integers(0, 60))) % 90)) for k in range(80)] + [(500, None), (501, "A b " * 700)]
    known = {}

    def fitted(coded, shared):
        lex = known["lex"] = shared.value
        net = known["net"] = gru_lm.Network.initial(lex.short_counts, lex.mass, 6)
        net.p["recur_bias"] += 0.3
        return net

    monkeypatch.setattr(gru_lm, "fit_network", fitted)
    found = {r.doc_id: r for r in gru_lm.score_documents(docs_of(rows), shortlist=8, frequent=20).collect()}
    lex, net = known["lex"], known["net"]
    counts = Counter()
    for d, t in rows:
        if not found[d].held_out:
            counts.update([*gru_lm.words_of(t), gru_lm.END])
    for d, t in rows:
        words = [*gru_lm.words_of(t), gru_lm.END]
        units = [lex.ids.get(w, lex.n_short + gru_lm.bucket(w)) for w in words]
        inside = sum(np.log10((counts[w] + 1) / lex.mass[gru_lm.bucket(w)]) for w in words if w not in lex.ids)
        assert found[d].score == pytest.approx(plain_log10(net, units) + inside, rel=1e-4)


def test_vectors_are_averaged_in_groups_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "FAN_IN", 3)
    rng = np.random.default_rng(0)
    own = [(k, int(rng.integers(1, 9)), rng.standard_normal(5).astype("f4")) for k in range(20)]
    df = spark.createDataFrame([(k, n, v.tobytes()) for k, n, v in own], "h long, seen long, flat binary")
    (row,) = gru_lm.averaged(df, 20).collect()
    total = sum(n for _, n, _ in own)
    assert row.seen == total and np.allclose(np.frombuffer(row.flat, "f4"), sum(n / total * v for _, n, v in own), atol=1e-5)


def test_hidden_units_grow_with_the_tokens():
    sizes = [gru_lm.hidden_units(10**k) for k in range(4, 14)]
    assert sizes == sorted(sizes) and sizes[0] == gru_lm.HIDDEN and sizes[-1] > 4 * gru_lm.HIDDEN


def test_blocks_of_rows_give_the_whole_windows_gradients(monkeypatch):
    rng = np.random.default_rng(6)
    net = gru_lm.Network.initial(rng.integers(1, 50, 100).astype(float), np.ones(gru_lm.BUCKETS), hidden=5)
    docs = [rng.integers(0, net.n_words + gru_lm.BUCKETS, n).astype(np.int32) for n in (37, 4, 29, 11)]
    window = next(gru_lm.streams(docs, len(net.p["inputs"]), 3))[:4]
    want, state = net.gradients(*window, np.zeros((3, 5), "f4"))
    monkeypatch.setattr(gru_lm, "BLOCK", 7)
    found, again = net.gradients(*window, np.zeros((3, 5), "f4"))
    assert np.array_equal(state, again) and all(np.allclose(found[k], want[k], atol=1e-4) for k in gru_lm.Network.NAMES)


def test_steps_are_those_of_adam():
    """Two steps, clipped and short ones too, against the formula for each parameter."""
    rng = np.random.default_rng(5)
    params = {"a": rng.standard_normal((3, 2)).astype("f4"), "b": rng.standard_normal(4).astype("f4")}
    want, m, v = ({k: f(p.astype("f8")) for k, p in params.items()} for f in (np.copy, np.zeros_like, np.zeros_like))
    adam = gru_lm.Adam(params, 0.01)
    for t, (size, share) in enumerate(((900.0, 1.0), (0.01, 0.3)), 1):
        grads = {k: (size * rng.standard_normal(p.shape)).astype("f4") for k, p in params.items()}
        adam.step(grads, 10, share)
        norm = math.sqrt(sum(float(((g / 10.0) ** 2).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g / 10.0 * min(1.0, 1 / norm)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            want[k] -= share * 0.01 * math.sqrt(1 - 0.99**t) / (1 - 0.9**t) * m[k] / (np.sqrt(v[k]) + adam.EPS)
            assert np.allclose(params[k], want[k], atol=1e-5)


def test_groups_of_texts_are_encoded_as_single_ones(monkeypatch):
    """Sums and rare words by document, when the memory of rare words is emptied between groups too."""
    monkeypatch.setattr(gru_lm, "REMEMBERED", 3)
    often = [(b"a", 9), (b"b", 5), (gru_lm.END, 4), (b"c", 2), (b"d", 0)]
    lex = gru_lm.Lexicon(often, 2, 20, 4, np.arange(1.0, gru_lm.BUCKETS + 1))
    codes = gru_lm._Codes(lex)
    for texts in (["a b x x c", None, "x yy zzz x"], ["vv ww vv"], ["", "d d a"]):
        words, starts = [], []
        for t in texts:
            starts.append(len(words))
            words += [*gru_lm.words_of(t), gru_lm.END]
        found = [column.to_pylist() for column in codes.rows(words, np.array(starts))]
        for t, n, sure, logs, share, hashes, times, ids in zip(texts, *found, strict=True):
            own, n_of = [*gru_lm.words_of(t), gru_lm.END], dict(often)
            assert (n, sure) == (len(own), sum(n_of.get(w, 0) > 0 for w in own))
            assert math.isclose(logs, sum(math.log10(n_of.get(w, 0) + 1) for w in own), abs_tol=1e-12)
            assert math.isclose(share, sum(math.log10(n_of.get(w, 0) + 1) - math.log10(lex.mass[gru_lm.bucket(w)]) for w in own if w not in lex.ids), abs_tol=1e-12)
            assert dict(zip(hashes, times, strict=True)) == {gru_lm.hash_of(w): c for w, c in Counter(own).items() if w not in n_of}
            assert np.frombuffer(ids, "<i4").tolist() == [lex.ids.get(w, lex.n_short + gru_lm.bucket(w)) for w in own]


def test_spark_gives_words_the_same_hashes_and_buckets(spark):
    words = [b"x", b"ab", b"\xc3\xa9", b"long" * 20, *(f"w{k}".encode() * (k % 9 + 1) for k in range(200))]
    rows = spark.createDataFrame([(" ".join(w.decode() for w in words), False)], "text string, held_out boolean")
    found = gru_lm.count_words(rows).withColumn("hash", F.xxhash64("word")).collect()
    assert {bytes(r.word): (r.bucket, r.hash) for r in found} == {w: (gru_lm.bucket(w), gru_lm.hash_of(w)) for w in [*words, gru_lm.END]}


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.095), ("sf0.1", 0.27)])
def test_held_out_gain_over_the_base_score(spark, sf, least):
    """Log10 a token above the base score on held-out documents, less what the order of tasks may take from it."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    r = gru_lm.score_documents(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r.s - r.b) / r.n >= least
