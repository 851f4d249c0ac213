"""Rows of null and repeated ids in the similarity join and in the pipeline's stage that drops copies."""

import random
from collections import Counter

import corpus_pipeline
from chorale.llm import near_join
from tests.llm.test_operators import _brute_links


def _rows():
    """Id, text and a number of the row: near copies under null, repeated and other ids."""
    rng = random.Random(9)
    rows = []
    for ids in ([None] * 6, [None, None, 7, 7, 8, 8], [7, 8, 9, 9, None, 20], [21, 22, 23, 24, None, None]):
        base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
        for k, i in enumerate(ids):
            copy = base[:]
            for _ in range(k % 4):
                copy[rng.randrange(len(copy))] = "new"
            rows.append((i, " ".join(copy)))
    rows += [(None, f"alone {k} of its own kind") for k in range(4)] + [(30, "one id"), (30, "with two texts"), (31, None), (None, "")]
    return [(*r, k) for k, r in enumerate(rows)]


def _classes(rows):
    links = _brute_links([r[1] for r in rows])
    root = list(range(len(rows)))
    while True:
        before = root[:]
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return links, root


def test_near_join_of_null_and_repeated_ids(spark):
    rows = _rows()
    links, root = _classes(rows)
    degree = Counter(i for pair in links for i in pair)
    lowest = {c: min((rows[k][0] for k in range(len(rows)) if root[k] == c and rows[k][0] is not None), default=None) for c in root}
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = near_join.near_join(docs, block=4).collect()
    want = Counter((r[0], lowest[root[k]], degree[k]) for k, r in enumerate(rows))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want


def test_drop_copies_keeps_one_row_of_each_class(spark):
    rows = _rows()
    _, root = _classes(rows)
    got = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, n long"), "")
    assert got.columns == ["doc_id", "text", "n"]
    kept = sorted(map(tuple, got.collect()), key=lambda r: r[2])
    assert all(r == rows[r[2]] for r in kept)
    assert Counter(root[r[2]] for r in kept) == Counter(set(root))
    for i, _, n in kept:
        ids = [r[0] for k, r in enumerate(rows) if root[k] == root[n] and r[0] is not None]
        assert i == min(ids, default=None)
