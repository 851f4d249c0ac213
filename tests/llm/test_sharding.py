import random
import zlib
from collections import Counter, defaultdict

import pytest

from chorale.llm import sharding


def _check(given, rows, shards):
    """Sizes, checksums, whole groups and gapless slots; returns the bytes of each shard."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} <= {("bytes", None)}
    of_group, slots, total = defaultdict(set), defaultdict(list), [0] * shards
    for r in rows:
        of_group[r["size"], r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of_group.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total


def _brute_difference(vectors, lanes):
    """The method written out with lists: combine the two of largest spread, oppositely ordered."""
    parts = [(list(v), [{(k, i)} for i in range(lanes)]) for k, v in enumerate(vectors)]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(p[0]) - min(p[0]), reverse=True)
        (a, x), (b, y), *rest = parts
        up, down = sorted(range(lanes), key=lambda i: a[i]), sorted(range(lanes), key=lambda i: -b[i])
        parts = [([a[i] + b[j] for i, j in zip(up, down)], [x[i] | y[j] for i, j in zip(up, down)]), *rest]
    return parts[0][0]


@pytest.mark.parametrize("seed", range(6))
def test_differencing_is_as_even_as_the_method_written_out(seed):
    rng = random.Random(seed)
    lanes = rng.randint(2, 6)
    vectors = [[rng.randint(0, 500) if rng.random() < 0.5 or not i else 0 for i in range(lanes)] for _ in range(60)]
    total = [0] * lanes
    for v, final in zip(vectors, sharding.difference(vectors, lanes)):
        assert sorted(final) == list(range(lanes))
        for x, lane in zip(v, final):
            total[lane] += x
    brute = _brute_difference(vectors, lanes)
    assert sum(total) == sum(brute)
    assert max(total) - min(total) <= max(brute) - min(brute) + 20


@pytest.mark.parametrize(("chunk_groups", "at_once"), [(40_000, 1_000), (30, 1_000), (10, 4), (5, 2)])
def test_bytes_are_even_whatever_the_levels(spark, chunk_groups, at_once):
    rng = random.Random(4)
    given = [(i, "é" * rng.randint(0, 400) + f" {i % 700}") for i in range(800)]
    docs = spark.createDataFrame([(*g, 0, "x") for g in given], "doc_id long, text string, shard int, size string")
    rows = sharding.shard(docs, shards=4, chunk_groups=chunk_groups, at_once=at_once, bucket_rows=50).collect()
    total = _check(given, rows, 4)
    assert max(total) - min(total) <= 0.01 * sum(total) / 4


def test_repeated_rows_null_ids_and_a_large_group(spark):
    given = [(None, None)] * 60 + [(7, "same row")] * 60 + [(None, f"t{i}") for i in range(20)] + [(8, ""), (9, "x" * 100_000)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    rows = sharding.shard(docs, shards=3, bucket_rows=10).collect()
    _check(given, rows, 3)


def test_an_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
