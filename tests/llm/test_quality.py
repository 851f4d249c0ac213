import random

import pytest
from pyspark.sql import functions as F

from chorale.llm import quality
from tests.llm.test_operators import _brute_counts


def _texts():
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a a", "a a a", "a a a a", "a b c a b c", "a b c d a b c", "x y z", "é é é é", "# $ | a", "l\nl\n\nl \n l", "w " * 2000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["\n".join(" ".join(rng.choice(["ab", "cd", "*"]) for _ in range(4)) for _ in range(9)) for _ in range(5)]
    return texts


@pytest.mark.parametrize("window_hash", [F.xxhash64, lambda *w: F.lit(1).cast("long"), lambda *w: F.length(F.concat(*w)).cast("long")])
def test_counts_are_exact_even_if_hashes_clash(spark, monkeypatch, window_hash):
    monkeypatch.setattr(quality, "window_hash", window_hash)
    texts = _texts()
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    judged = quality.judge(docs, [])
    assert judged.columns == ["doc_id", *quality.COUNTS, "base_failed", "rule", "kept"]
    for r in judged.collect():
        assert tuple(r[c] for c in quality.COUNTS) == _brute_counts(texts[r["doc_id"]] or ""), texts[r["doc_id"]]


def _brute_cover(rows, cuts, max_rules, max_conditions, min_precision, min_share):
    """The same covering with every option tried on every document."""
    total = len(rows)
    holds = lambda r, cs: all((r[0][f] > cuts[f][c]) == above for f, above, c in cs)

    def tally(cs, some, fold):
        n = [r for r in some if (fold is None or r[2] == fold) and holds(r, cs)]
        return sum(r[1] == 0 for r in n), len(n)

    def share(cs, some):
        b, n = tally(cs, some, 1)
        return (b + 0.5) / (n + 1) if n else 0.0

    rules, left = [], rows
    while len(rules) < max_rules:
        chosen = []
        while len(chosen) < max_conditions:
            b0, n0 = tally(chosen, left, 0)
            best, gain = None, 0.0
            if b0 and b0 < n0:
                for f in range(len(cuts)):
                    for c in range(len(cuts[f])):
                        for above in (True, False):
                            b, n = tally([*chosen, (f, above, c)], left, 0)
                            if b and n >= min_share * total * 2 / 3 and (g := b * ((b + 0.1) / (n + 0.2) - b0 / n0)) > gain:
                                best, gain = (f, above, c), g
            if best is None:
                break
            chosen.append(best)
        while len(chosen) > 1 and share(chosen[:-1], left) >= share(chosen, left):
            chosen.pop()
        b, n = tally(chosen, left, None)
        if not chosen or not n or b / n < min_precision or share(chosen, left) < min_precision - 0.03:
            break
        rules.append((tuple((quality.FEATURES[f], above, cuts[f][c]) for f, above, c in chosen), b, n))
        left = [r for r in left if not holds(r, chosen)]
    return rules


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_covering_is_that_of_trying_every_option(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(500):
        f = [float(rng.randint(0, 9)) for _ in quality.FEATURES]
        bad = (f[0] > 6 and f[2] > 4) or f[3] > 8 or rng.random() < 0.01
        rows.append((f, int(not bad), int(rng.random() < 0.33)))
    known = spark.createDataFrame([(y, k, *f) for f, y, k in rows], "label int, fold int, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = quality.cover(known, 12, 8, 3, 0.8, 0.002)
    cuts = []
    levels = [k / 12 for k in range(1, 12)]
    for some, more in zip(known.approxQuantile(quality.FEATURES, levels, 0.005), known.where("label = 0").approxQuantile(quality.FEATURES, levels, 0.005)):
        cuts.append(sorted({*some, *more}))
    want = _brute_cover(rows, cuts, 8, 3, 0.8, 0.002)
    assert got and [(tuple(tuple(c) for c in r.conditions), r.rejected, r.of) for r in got] == want


def test_null_and_repeated_ids_and_labels(spark):
    rng = random.Random(4)
    text = lambda bad: " ".join(f"w{rng.randint(0, 10**6)}" + ("###" if bad else "") for _ in range(80))
    rows = [(i if i % 10 else None, text(i % 5 == 0)) for i in range(300)] + [(7, text(False))] * 2
    labels = [(i, int(i % 5 != 0)) for i in range(300)] + [(None, 0), (3, None), (7, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules
    got = quality.judge(docs, rules).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == sum("#" not in t for _, t in rows)
