import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.llm import fingerprint, html_model, language, near_join, packing, pieces, quality, sharding, toxicity, url_filter
from chorale.llm.queries import URL_RULES, tokenizer_path

ODD = ["", None, " ", "  a  b ", "\n a", "a\n\n b  ", "don't STOP we'll 12345 x²½ <|endoftext|> q", "İΣΑΣ é", "日本語 🎉🎉", "a▁b ▁", "\t tab\x1c y\x00z", "é" * 300, "word " * 3000, "same text twice here", "same text twice here"]
CLASH = "doc_id long, text string, score string, fingerprint string, f string, words string, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", "f", "f", "w", "k") for i, t in enumerate(ODD)], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/70?x", "https://com/en/1", "http://x.net/de/8", "http://a.example.net/de/81", "http://a.org/es", "no", None, "x://notexample.com/en/7", "http://b.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, URL_RULES).orderBy("page_id").collect()]
    assert got == [("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block"), ("com/en/", "block")]
    joined = url_filter.url_filter(pages, URL_RULES, max_trie_rules=2).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in joined] == got


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack(odd, path, capacity=64, part_rows=20).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(ODD):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = np.array(ids[64 * k : 64 * k + 64], dtype="<u4")
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, 64 * k, len(part), zlib.crc32(part.tobytes()))
    for _, some in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in some:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack(none, path).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    rng = random.Random(3)
    for _ in range(200):
        lengths = np.array(sorted((rng.randint(1, 50) for _ in range(rng.randint(1, 60))), reverse=True))
        bins, offsets, free = packing.best_fit_decreasing(lengths, 50)
        assert packing.lower_bound(np.bincount(lengths, minlength=51), 50) <= len(free)
        assert np.bincount(bins, weights=lengths).max() <= 50


def test_pieces(odd, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.digests(odd, path).collect():
        ids = lib.encode(ODD[r["doc_id"]] or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids))]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *sha)
    for r in pieces.decode(pieces.encode(odd, path), path).collect():
        assert r["text"] == lib.decode(lib.encode(ODD[r["doc_id"]] or ""))
    assert pieces.digests(none, path).count() == 0


def test_sharding(odd, none):
    rows = sharding.shard(odd, shards=3).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        raw = (ODD[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    shard_of = {r["doc_id"]: r["shard"] for r in rows}
    assert shard_of[13] == shard_of[14] and shard_of[0] == shard_of[1]
    assert sharding.shard(none).count() == 0


def test_differencing_balances():
    rng = random.Random(5)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    total = [0] * 8
    for s, final in zip(sizes, sharding.difference([[s] + [0] * 7 for s in sizes], 8)):
        total[final[0]] += s
    assert max(total) - min(total) <= 10


def test_fingerprints(odd, none):
    rows = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(odd, min_share=0.1, max_share=1.0, bucket_rows=4).collect()}
    n = len(ODD)
    for i, text in enumerate(ODD):
        text, follows = text or "", ODD[(i - 1) % n] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[13]["fingerprint"] == rows[14]["fingerprint"] and rows[14]["near_next"] == 1
    assert fingerprint.edited_fingerprints(none).count() == 0


PAGE = """<html><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies for things you like.</p></div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> words.<br><p>Second one.</article><section id="comments"><p>Nice article, thanks.</p></section><footer>&copy; me"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE)], "page_id long, url string, html string")
    want = "Title & more\nFirst paragraph with bold words.\nSecond one."
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_model.extract(pages).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: (want, len(want))}


def _brute_links(texts, n=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").split()
        k = min(n, max(1, len(w)))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity}


def test_near_join(spark, none):
    rng = random.Random(1)
    texts = [None, "", "a b", "a b"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
        for _ in range(6):
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r for r in near_join.near_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=4).collect()}
    links = _brute_links(texts)
    degree = Counter(i for pair in links for i in pair)
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert {i: r["n_links"] for i, r in got.items()} == {i: degree[i] for i in range(len(texts))}
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(root))
    assert near_join.near_join(none).count() == 0


def test_recall_of_banding():
    bands, rows = near_join.bands_and_rows(0.8, 0.99995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99995


def test_toxicity(spark, odd, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(40)) + (" moronic scumbag" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == y for i, _, y in rows if i >= 300) >= 98
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert scored[13] == scored[14] and scored[0] == scored[1] and all(0 <= s <= 1 for s in scored.values())
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def _brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, none):
    for r in quality.judge(odd, []).collect():
        counts = _brute_counts(ODD[r["doc_id"]] or "")
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert (tuple(r[c] for c in quality.COUNTS), r["base_failed"], r["kept"]) == (counts, failed, not failed)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" + ("###" if i % 5 == 0 else "") for _ in range(80)), int(i % 5 != 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    rules = quality.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    assert rules
    assert {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()} == {i: y == 1 for i, _, y in rows}
    assert docs.where(quality.kept(F.col("text"), rules)).count() == sum(y for *_, y in rows)
    assert quality.judge(none, quality.learn(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_language(spark, odd, none):
    rng = random.Random(6)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word("aeioustr" if i % 2 else "öäßkzwch") for _ in range(30)), "x" if i % 2 else "y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id < 150"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    seen = {r["doc_id"]: r for r in language.predict(odd, model).collect()}
    assert seen[0]["lang_pred"] == seen[1]["lang_pred"] == seen[2]["lang_pred"] == "und"
    assert seen[13]["score"] == pytest.approx(seen[14]["score"])
    assert language.predict(none, model).count() == 0
