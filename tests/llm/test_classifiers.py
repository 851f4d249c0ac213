"""Toxicity and language ID against their definitions, written out plainly."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from chorale.llm import language, toxicity

ODD = [None, "", " ", "\n\t", "123 !?", "Aa", "İ ẞ ΣΑΣ", "x" * 5000, "same text", "same text", "日本語", "a\x00b"]


def _grams(word, bits=18):
    """Buckets of a word's n-grams of 3 to 6 characters, its edges counted as characters."""
    shown = f"<{word}>"
    out = []
    for n in range(3, 7):
        for i in range(len(shown) - n + 1):
            h = 0
            for k in range(n):
                h = ((h ^ ord(shown[i + k])) * int(toxicity.MULTIPLIERS[k])) & 0xFFFFFFFF
            out.append((h ^ (h >> 15)) & ((1 << bits) - 1))
    return out


def _labelled(n=300, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8)))
    return [(i, " ".join(word() for _ in range(rng.choice([5, 40, 200]))) + (" moronic scumbag" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = _labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def test_ratios_are_those_of_the_definition():
    rng = random.Random(1)
    for _ in range(50):
        clean, toxic = rng.randint(1, 50), rng.randint(1, 50)
        k0, k1 = rng.randint(0, clean), rng.randint(0, toxic)
        a, b = 2 * toxic / (clean + toxic), 2 * clean / (clean + toxic)
        p, q = (k1 + a) / (toxic + 2 * a), (k0 + b) / (clean + 2 * b)
        error = math.sqrt((1 - p) / (k1 + a) + (1 - q) / (k0 + b))
        r = math.log(p / q)
        want = math.copysign(max(abs(r) - error, 0), r)
        got = toxicity.log_count_ratios(np.array([k0]), np.array([k1]), clean, toxic, 2.0, 1.0)
        assert got[0] == pytest.approx(want, abs=1e-12)
    assert toxicity.log_count_ratios(np.zeros(1), np.zeros(1), 40, 4, 2.0, 1.0)[0] == 0


def test_features_and_tally(spark):
    docs = spark.createDataFrame([(1, "abc abc abd"), (0, None), (0, "abc"), (1, "")], "label int, text string")
    features = toxicity._features(docs, "text", 18)
    for row, text in zip(features.collect(), ["abc abc abd", "", "abc", ""]):
        want = Counter(g for w in set(text.split()) for g in _grams(w))
        assert dict(zip(np.frombuffer(row["bucket"], "<i4").tolist(), np.frombuffer(row["count"], "<u2").tolist())) == want
    total = toxicity._tally(features, 18)
    both = Counter({g: 1 for g in _grams("abc")}) + Counter({g: 1 for w in ("abc", "abd") for g in _grams(w)})
    assert {b: n for b, n in enumerate(total.sum(0).tolist()) if n} == both


@pytest.mark.parametrize("run_chars", [1, 7, 1000])
def test_runs_have_every_gram_once(run_chars):
    words = ["", "a", "abcdef" * 9, "é日x", "b"]
    got = [[] for _ in words]
    for bucket, owner in toxicity.gram_runs(words, 18, run_chars):
        for b, k in zip(bucket.tolist(), owner.tolist()):
            got[k].append(b)
    assert [Counter(x) for x in got] == [Counter(_grams(w)) for w in words]


def test_every_bucket_with_a_ratio_counts(model):
    assert np.count_nonzero(model.weights) > 1024


def test_scores_are_sums_over_distinct_words(spark, model):
    rows = [(i, t, 0.5, 1) for i, t in enumerate(ODD)] + [(None, "moronic words", 0.5, 1)] * 2
    assert list(toxicity.Scorer(model, limit=2, run_chars=3)(ODD)) == list(toxicity.Scorer(model)(ODD))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    got = toxicity.score(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        text = "moronic words" if r["doc_id"] is None else ODD[r["doc_id"]]
        z = sum(model.weights[g] for w in set((text or "").lower().split()) for g in _grams(w)) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), rel=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter((r["doc_id"], ODD[r["doc_id"]] if r["doc_id"] is not None else "moronic words") for r in got if r["score"] < 0.5)


def test_learning_in_parts_does_as_well(spark):
    rows = _labelled(400, seed=3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    parted = toxicity.fit(docs, labels, part_docs=60, held=20_000)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, parted).collect()}
    assert sum(got[i] == y for i, _, y in rows if i >= 300) >= 97


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0), ([(1, 0)], 0), ([(1, 1)], 1)):
        fitted = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["predicted"] for r in toxicity.score(docs, fitted).collect()} == {want}


def test_long_words_are_not_remembered(model):
    scorer = toxicity.Scorer(model, limit=3, run_chars=1)
    list(scorer(["a bb", "ccc " + "x" * 10_000]))
    assert 0 < len(scorer.known) <= 3 and max(map(len, scorer.known)) <= toxicity.LONGEST_KEPT


# -- language ID


def _brute_language(learn, texts, bits=16, smoothing=0.1):
    """Multinomial naive Bayes with plain dictionaries."""

    def buckets(text):
        shown = f" {text} ".lower()
        out = []
        for n in (1, 2, 3):
            for i in range(len(shown) - n + 1):
                h = 0
                for k in range(n):
                    h = ((h ^ ord(shown[i + k])) * int(language.MULTIPLIERS[k])) & 0xFFFFFFFF
                out.append((h ^ (h >> 15)) & ((1 << bits) - 1))
        return out

    languages = sorted({x for _, x in learn})
    counts = {x: Counter(b for t, y in learn if y == x for b in buckets(t)) for x in languages}
    prior = Counter(x for _, x in learn)
    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        z = []
        for x in languages:
            size = sum(counts[x].values()) + smoothing * (1 << bits)
            z.append(math.log(prior[x] / len(learn)) + sum(math.log((counts[x][b] + smoothing) / size) for b in buckets(t)))
        top = max(z)
        out.append((languages[z.index(top)], 1 / sum(math.exp(max(-700, v - top)) for v in z)))
    return out


@pytest.mark.parametrize(("block", "run_chars"), [(32, 1_000_000), (2, 1_000_000), (1, 7)])
def test_language_is_that_of_the_definition(spark, block, run_chars):
    rng = random.Random(6)
    alphabets = {"aa": "aeioust", "bb": "öäßkzw", "cc": "ñçéèu", "dd": "бвгде", "ee": "aeiöä"}
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 7)))
    learn = [(i, " ".join(word(a) for _ in range(rng.randint(1, 30))), x) for i, (x, a) in enumerate(list(alphabets.items()) * 6)]
    learn += [(900, None, "aa"), (901, "text", None), (None, "of no id", "aa")]
    docs = spark.createDataFrame(learn, "doc_id long, text string, lang string")
    model = language.fit(docs, block=block, run_chars=run_chars)
    texts = [*ODD, *[t for _, t, _ in learn[:15]], "aeö b", "e"]
    rows = [(i, t, "xx", 0.1) for i, t in enumerate(texts)]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double"), model, run_chars=run_chars).collect()
    want = _brute_language([(t, x) for i, t, x in learn if None not in (i, t, x)], texts)
    assert len(got) == len(texts)
    for r in got:
        name, score = want[r["doc_id"]]
        assert r["lang_pred"] == name
        assert r["score"] == pytest.approx(score, abs=2e-2)  # the matrix holds single-precision numbers


def test_too_many_languages_and_none(spark):
    docs = spark.createDataFrame([(i, "t", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language.fit(docs, max_languages=4)
    model = language.fit(docs.where("lang is null"))
    assert {tuple(r) for r in language.predict(docs, model).collect()} == {(i, "und", 0.0) for i in range(5)}
    assert language.predict(docs.limit(0), language.fit(docs)).count() == 0


def test_repeated_and_null_ids_are_predicted_one_by_one(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (1, "ab", "x"), (2, "кд", "y"), (None, "ab", None), (None, None, None)], "doc_id long, text string, lang string")
    got = Counter((r["doc_id"], r["lang_pred"]) for r in language.predict(docs, language.fit(docs)).collect())
    assert got == Counter({(1, "x"): 2, (2, "y"): 1, (None, "x"): 1, (None, "und"): 1})
