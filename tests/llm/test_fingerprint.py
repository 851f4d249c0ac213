"""I-Match against its definition, and the order of documents against a sort."""

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash

from chorale.llm import fingerprint


def _brute_lexicon(texts, min_share, max_share):
    df = Counter(w for t in texts for w in set((t or "").lower().split()))
    least = max(2, math.ceil(len(texts) * min_share))
    most = max(least, math.floor(len(texts) * max_share))
    return {w for w, n in df.items() if least <= n <= most}


def _spread(h):
    m = (1 << 64) - 1
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & m
    return h ^ (h >> 31)


def _brute_fingerprint(text, lexicon, levels, each):
    """Every subset written out: which terms it keeps, in the order of their hashes."""
    found = set((text or "").lower().split())
    chosen = found & lexicon or found
    hashes = sorted(xxhash.xxh64_intdigest(w) for w in chosen)
    out = []
    for i, shift in enumerate([0, *(level + 3 for level in range(levels) for _ in range(each))]):
        kept = [h for h in hashes if _spread((h + 0x9E3779B97F4A7C15 * (i + 1)) % 2**64) % (1 << shift) == 0]
        out.append(xxhash.xxh32_hexdigest(b"".join(h.to_bytes(8, "little") for h in kept)) if kept else "-")
    return out


def _likeness(a, b):
    both = [(x, y) for x, y in zip(a, b) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in both) / len(both) if both else 1.0


def _texts():
    rng = random.Random(7)
    texts = [None, "", "  ", "rare only here", "日本 é É"]
    for _ in range(15):
        base = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([3, 30, 120]))]
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base[:-1], "other"])]
    return texts


@pytest.mark.parametrize("shares", [(0.0005, 0.2), (0.1, 0.5), (0.9, 0.95)])
def test_fingerprints_are_those_of_the_definition(spark, shares):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    lexicon = _brute_lexicon(texts, *shares)
    assert set(fingerprint.lexicon(docs, "text", *shares)) == lexicon
    got = fingerprint.fingerprints(docs, min_share=shares[0], max_share=shares[1]).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: ".".join(_brute_fingerprint(t, lexicon, 7, 9)) for i, t in enumerate(texts)}


def _brute_edited(rows):
    """Of each row its edited text and the next document, in the stated order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    for k, (i, text, _) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        yield i, text, text[: len(text) - half] + follows[:half], follows


@pytest.mark.parametrize(("bucket_rows", "max_buckets"), [(5_000, 10_000), (7, 10_000), (1, 10_000), (7, 3)])
def test_edited_fingerprints_with_null_and_repeated_ids_and_rows(spark, bucket_rows, max_buckets):
    texts = _texts()
    rng = random.Random(1)
    given = [(rng.choice([None, 4, 4, i, -i]), t, "n") for i, t in enumerate(texts)] + [(None, "same", "n")] * 9 + [(4, None, "n")] * 9
    docs = spark.createDataFrame(given, "doc_id long, text string, n_chars string").repartition(3)
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    lexicon = _brute_lexicon([t for _, t, _ in given], 0.0005, 0.2)
    want = []
    for i, text, edited, follows in _brute_edited([(i, t or "", hashes[t or ""]) for i, t, _ in given]):
        a, b, c = (_brute_fingerprint(x, lexicon, 7, 9) for x in (text, edited, follows))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), ".".join(a), ".".join(b), round(_likeness(a, b), 9), round(_likeness(a, c), 9)))
    got = fingerprint.edited_fingerprints(docs, bucket_rows=bucket_rows, max_buckets=max_buckets)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()) == Counter(want)


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    row = fingerprint.edited_fingerprints(docs).collect()
    assert [(r["doc_id"], r["n_chars"], r["near_next"]) for r in row] == [(None, 7, 1.0)]
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
