"""Links and classes against all pairs, in families that are compared whole and in welded ones."""

import random
from collections import Counter

import numpy as np
import pytest

from chorale.llm import near_join
from tests.llm.test_operators import _brute_links


def _want(texts):
    links = _brute_links(texts)
    degree = Counter(i for pair in links for i in pair)
    root = list(range(len(texts)))
    while True:
        before = root[:]
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return {i: (root[i], degree[i]) for i in range(len(texts))}


def _got(spark, texts, **limits):
    docs = spark.createDataFrame([(i, t, "b", 0) for i, t in enumerate(texts)], "doc_id long, text string, bands string, class_id int")
    joined = near_join.near_join(docs, **limits)
    assert joined.columns == ["doc_id", "class_id", "copy_id", "n_links"]
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in joined.collect()}


def _chain(rng, n, step):
    """Texts each near the one before, so that one family holds many that are far apart."""
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for k in range(n):
        words = [*words[step:], *[f"v{k}x{j}" for j in range(step)]]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [400, 3])
def test_chains(spark, block):
    rng = random.Random(2)
    texts = [*_chain(rng, 40, 2), *_chain(rng, 30, 5), *_chain(rng, 5, 60)]
    assert _got(spark, texts, block=block) == _want(texts)


@pytest.mark.parametrize("block", [400, 4])
def test_a_large_group_of_near_copies_and_a_shared_passage(spark, block):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 900)}" for _ in range(100)]
    texts = []
    for _ in range(60):
        copy = base[:]
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(100)] = f"n{rng.randint(0, 9)}"
        texts.append(" ".join(copy))
    for k in range(40):  # the passage makes up about half of each
        texts.append(" ".join([*base[:50], *[f"own{k}x{rng.randint(0, 99)}" for _ in range(rng.randint(20, 60))]]))
    assert _got(spark, texts, block=block) == _want(texts)


def test_buckets_are_used_where_a_family_is_welded(spark):
    rng = random.Random(5)
    texts = _chain(rng, 60, 3)
    rows = near_join.numbered(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    signed = near_join.signatures(rows, near_join.ROW, "id", "text", 5, 25, 5)
    sets = signed.selectExpr("row as node", "1L as copies", "shingles", "bands")
    members = near_join._families(sets, 60 * 25).join(sets, "node")
    assert {r["kind"] for r in near_join._groups(members, 60, 25, 5, 10**6).collect()} == {near_join.BUCKET}
    assert {r["kind"] for r in near_join._groups(members, 60, 25, 60, 10**6).collect()} == {near_join.FAMILY}


def test_pairs_of_a_bucket_are_those_of_their_first_common_band():
    bands = ([1, 9, 5], [2, 9, 5], [1, 8, 5])
    mine = np.array([0, 0, 0])
    assert near_join._proposed((near_join.BUCKET, 5, 0, 0), mine, bands).tolist() == [[False, False, False], [False, False, True], [False, True, False]]
    assert near_join._proposed((near_join.BUCKET, 9, 0, 0), mine[:2], bands[:2]).all() == np.False_
    assert near_join._proposed((near_join.BUCKET, 9, 0, 0), mine[:2], bands[:2]).sum() == 2
    assert near_join._proposed((near_join.FAMILY, 5, 0, 1), np.array([0, 1, 1]), bands).tolist() == [[False, True, True], [True, False, False], [True, False, False]]


def test_hot_copies_long_texts_and_none(spark):
    long = " ".join(f"x{k}" for k in range(60_000))
    texts = ["the same text of six words"] * 700 + [None] * 5 + ["", " \n", long, long + " end", "y" * 50_000]
    got = _got(spark, texts)
    assert [got[i] for i in (0, 699, 700, 706, 707, 708, 709)] == [(0, 699)] * 2 + [(700, 6)] * 2 + [(707, 1)] * 2 + [(709, 0)]
    assert near_join.near_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
