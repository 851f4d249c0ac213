"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import map_rows

LETTER = re.compile(r"[^\W\d_]")
MAX_N = 3
UNDECIDED = "und"
#: Multipliers of the hash, one for each place in an n-gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


class Model(NamedTuple):
    """Languages in order, in blocks that a worker holds one at a time."""

    languages: list[list[str]]
    log_prior: list[np.ndarray]
    log_prob: list[Broadcast]  # buckets x languages of a block
    bits: int


def _blocks(texts: list[str], size: int) -> Iterator[tuple[int, list[str], int]]:
    """Runs of about ``size`` characters: the index of the first text, the texts, and how many
    characters at their end only look ahead. A longer text comes in several runs by itself; each
    has the next two characters too, so that no n-gram is lost or counted twice."""
    start = 0
    while start < len(texts):
        if len(texts[start]) > size:
            shown = _shown(texts[start])
            for at in range(0, len(shown), size):
                yield start, [shown[at : at + size + MAX_N - 1]], max(0, min(len(shown) - at - size, MAX_N - 1))
            start += 1
            continue
        end, n = start, 0
        while end < len(texts) and n + len(texts[end]) <= size:
            n += len(texts[end])
            end += 1
        yield start, [_shown(t) for t in texts[start:end]], 0
        start = end


def _shown(text: str) -> str:
    """A text in lower case; its edges count as a space each."""
    return f" {text} ".lower()


def bucket_blocks(shown: list[str], bits: int, ahead: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to 3, the bucket of the n-gram at each character of the texts (2 ** ``bits``: none
    there), and each text's first position. None starts in the last ``ahead`` characters."""
    points = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, shown), dtype=np.int64, count=len(shown))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    last = starts + lengths - 1
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(MAX_N):
        moved = points if n == 0 else np.concatenate([points[n:], np.zeros(min(n, len(points)), dtype=np.uint32)])[: len(points)]
        h = (h ^ moved) * MULTIPLIERS[n]
        bucket = ((h ^ (h >> np.uint32(15))) & np.uint32((1 << bits) - 1)).astype(np.int64)
        for k in range(max(n, ahead)):  # n-grams that would reach beyond the text, or belong to the next run
            bucket[np.maximum(last - k, 0)] = 1 << bits
        yield bucket, starts


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = 3_000,
    bits: int = 16,
    smoothing: float = 0.1,
    block: int = 32,
    max_languages: int = 20_000,
    run_chars: int = 1_000_000,
) -> Model:
    """Count n-grams in about ``max_docs`` documents of each language, chosen by a hash of the id.

    Executors add up their documents' buckets, and the driver gets 2 ** ``bits`` counts a language,
    for ``block`` languages at a time; each block is a broadcast of its own, which is all that a
    worker holds at a time. ``max_languages`` bounds the names that the driver holds; more (there
    are some 8,000 languages) are no languages, and an error. Rows of null text, language or id
    teach nothing.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    spark = docs.sparkSession
    model = Model([], [], [], bits)
    names, total = sorted(sizes), sum(sizes.values())
    for at in range(0, len(names), block):
        some = names[at : at + block]
        share = F.element_at(F.create_map(*[F.lit(x) for lang in some for x in (lang, min(1.0, max_docs / sizes[lang]))]), F.col("lang"))
        drawn = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30)) < share * (1 << 30)
        counts = _counts(known.where(F.col("lang").isin(some) & drawn), some, bits, run_chars) + smoothing
        log_prob = np.vstack([np.log(counts) - np.log(counts.sum(0)), np.zeros(len(some))]).astype(np.float32)
        sent = spark.sparkContext.broadcast(log_prob)
        model.languages.append(some)
        model.log_prior.append(np.log([sizes[lang] / total for lang in some]))
        model.log_prob.append(sent)
    return model


def _counts(drawn: DataFrame, languages: list[str], bits: int, run_chars: int) -> np.ndarray:
    """Of each language the number of n-grams in each bucket; at most buckets x languages rows come."""
    index = {lang: i for i, lang in enumerate(languages)}

    def count(texts, langs) -> Iterator[tuple]:
        for label in sorted(set(langs)):
            total = np.zeros((1 << bits) + 1, dtype=np.int64)
            for _, run, ahead in _blocks([t for t, x in zip(texts, langs) if x == label], run_chars):
                for bucket, _ in bucket_blocks(run, bits, ahead):
                    total += np.bincount(bucket, minlength=len(total))
            for b in np.flatnonzero(total[:-1]).tolist():
                yield index[label], b, int(total[b])

    counted = map_rows(drawn, ["text", "lang"], "lang int, bucket int, n long", count).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    counts = np.zeros((1 << bits, len(languages)))
    counts[got["bucket"], got["lang"]] = got["n"]
    return counts


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", run_chars: int = 1_000_000) -> DataFrame:
    """Id, lang_pred and score (posterior probability, 0 to 1) of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go
    to the language that sorts first. A longer text than ``run_chars`` characters is added up in
    runs, so memory does not grow with it. Rows of null ids and repeated rows are predicted one by
    one, an empty table gives no rows, and other columns are not read.
    """

    def run(keys, texts) -> Iterator[tuple]:
        n = len(texts)
        best, score, name = np.full(n, -np.inf), np.zeros(n), [UNDECIDED] * n
        plain = [t or "" for t in texts]
        for languages, prior, sent in zip(model.languages, model.log_prior, model.log_prob):
            total = np.tile(prior, (n, 1))
            matrix = sent.value
            for start, block, ahead in _blocks(plain, run_chars):
                for bucket, starts in bucket_blocks(block, model.bits, ahead):
                    total[start : start + len(block)] += np.add.reduceat(matrix[bucket], starts, axis=0, dtype=np.float64)
            if len(model.languages) > 1:  # only the next batch needs it again
                del matrix
                sent.__dict__.pop("_value", None)
            top = total.argmax(1)
            high = total[np.arange(n), top]
            # the sum of all probabilities so far, in units of the best one
            joint = np.maximum(best, high)
            score = score * np.exp(np.maximum(best - joint, -700)) + np.exp(np.maximum(total - joint[:, None], -700)).sum(1)
            for i in np.flatnonzero(high > best).tolist():
                name[i] = languages[top[i]]
            best = joint
        for i, text in enumerate(plain):
            if not model.languages or LETTER.search(text) is None:
                yield keys[i], UNDECIDED, 0.0
            else:
                yield keys[i], name[i], float(1 / score[i])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, lang_pred string, score double", run)
