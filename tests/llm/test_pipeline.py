"""The pipeline's stages and run() against brute force on a few dozen documents."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chorale.llm import quality, toxicity
from chorale.llm.queries import tokenizer_path
from tests.llm.test_classifiers import _grams
from tests.llm.test_operators import _brute_counts, _brute_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chorale_row long, class_id string"


def _documents():
    rng = random.Random(12)
    text = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 999)}" for _ in range(n))
    rows, labels = [], []

    def add(i, t, quality_=None, toxic=None):
        rows.append((i, t, "en", "s", None if t is None else len(t), len(rows), "c"))
        if i is not None and (quality_ is not None or toxic is not None):
            labels.append((i, quality_, toxic))

    for i in range(190):
        add(i, text(rng.randint(60, 90)) + (" moronic scumbag filth" if i % 3 == 0 else "") + (" ### $$$" * 9 if i % 5 == 1 else ""), int(i % 5 != 1), int(i % 3 == 0))
    add(200, text(80) + " moronic scumbag filth")
    add(201, text(80) + " ### $$$" * 9)
    base = text(80).split()
    for k in range(6):  # near copies of one text, under null, repeated and other ids
        add((None, None, 300, 300, 299, None)[k], " ".join([*base[:-1], f"end{k}"]))
    for k in range(3):
        add(None, text(70))
    add(400, text(70))
    add(400, text(70))
    add(500, text(3000))
    add(501, rows[189][1].replace(" moronic scumbag filth", "", 1))
    for k in range(2):
        add(600, rows[2][1])
    add(601, None)
    add(602, "")
    add(None, "short")
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows, labels = _documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def _docs(spark, sf_dir):
    return spark.read.schema(SCHEMA).parquet(f"{sf_dir}/documents.parquet")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[5])


def _brute_clean(model, rows):
    def score(t):
        return sum(model.weights[g] for w in set((t or "").lower().split()) for g in _grams(w)) + model.bias

    return [r for r in rows if score(r[1]) < 0]


def _brute_kept(rules, rows):
    kept = []
    for r in rows:
        n, chars, symbols, dup, again = _brute_counts(r[1] or "")
        f = {"n_words": n, "mean_word": chars / max(n, 1), "symbol_share": symbols / max(chars, 1), "dup_lines": dup, "repeat_share": again / max(n, 1)}
        failed = n < 50 or 100 * again > 50 * n
        rejected = any(all((f[c.feature] > c.threshold) == c.above for c in rule.conditions) for rule in rules)
        if not failed and not rejected:
            kept.append(r)
    return kept


def _brute_classes(rows):
    root = list(range(len(rows)))
    links = _brute_links([r[1] for r in rows])
    while True:
        before = root[:]
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


def _check_copies(rows, kept):
    """One row of each class stays, of the lowest id; among equal ids any."""
    classes = defaultdict(list)
    for r, c in zip(rows, _brute_classes(rows)):
        classes[c].append(r)
    by_class = {r[5]: c for c, some in classes.items() for r in some}
    assert Counter(by_class[r[5]] for r in kept) == Counter(dict.fromkeys(classes, 1))
    for r in kept:
        assert r in rows
        assert r[0] == min((x[0] for x in classes[by_class[r[5]]] if x[0] is not None), default=None)


def _check_packed(rows, packed):
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1
        want.update((r[0], k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"]) for p in packed) == want
    held = defaultdict(list)
    for p in packed:
        held[p["sequence_id"]].append((p["offset"], p["length"]))
    for some in held.values():
        assert [o for o, _ in sorted(some)] == np.cumsum([0, *[n for _, n in sorted(some)]])[:-1].tolist()
        assert sum(n for _, n in some) <= 2048


def test_each_stage_and_run(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    given = _rows(docs)
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert _rows(clean) == _brute_clean(toxicity.fit(docs, labels), given)
    assert not any("moronic" in (r[1] or "") for r in _rows(clean)) and len(_rows(clean)) >= sum("moronic" not in (r[1] or "") for r in given) - 1

    good = corpus_pipeline.drop_poor(spark, clean, sf_dir)
    assert good.columns == docs.columns
    rules = quality.learn(clean, labels)
    assert rules and _rows(good) == _brute_kept(rules, _rows(clean))
    assert not any("###" in r[1] for r in _rows(good))

    one = corpus_pipeline.drop_copies(spark, good, sf_dir)
    assert one.columns == docs.columns
    _check_copies(_rows(good), _rows(one))

    packed = corpus_pipeline.pack(spark, one, sf_dir)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    _check_packed(_rows(one), packed.collect())

    ran = corpus_pipeline.run(spark, sf_dir).collect()
    _check_packed(_rows(one), ran)


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "best-fit packing"]


def test_an_empty_table_passes_through(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = _docs(spark, at)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, at)
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")] and docs.count() == 0
    assert corpus_pipeline.run(spark, at).count() == 0


def test_without_labels_nothing_learned_decides(spark, sf_dir, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = _docs(spark, sf_dir)
    assert corpus_pipeline.drop_toxic(spark, docs, at).count() == docs.count()
    assert _rows(corpus_pipeline.drop_poor(spark, docs, at)) == _brute_kept([], _rows(docs))
    assert corpus_pipeline.drop_copies(spark, docs.where(F.col("doc_id") == 600), at).count() == 1
