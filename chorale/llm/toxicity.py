"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.storage import materialize
from chorale.llm.common import built, map_rows, sliced, trim

MIN_N, MAX_N = 3, 6
#: Longer words are worked out anew each time, so that a memory of n words has a bound in bytes.
LONGEST_KEPT = 64
#: Weights are rounded to multiples of 1 / EXACT.
EXACT = float(1 << 30)
#: Multipliers of the hash, one for each place in an n-gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint32)


def words(text: str) -> set[str]:
    return set(text.lower().split())


def gram_runs(words_: list[str], bits: int, run_chars: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hash bucket of every character n-gram of the words, and the place of its word in the list.

    A word's edges count as a character each. The n-grams come in runs of about ``run_chars``
    characters; a longer word is cut, each piece with the characters that its last n-grams need.
    """
    start = 0
    while start < len(words_):
        end, size = start, 0
        while end < len(words_) and size < run_chars:
            size += len(words_[end]) + 2
            end += 1
        if size < 2 * run_chars:
            shown = [f"<{w}>" for w in words_[start:end]]
            lengths = np.fromiter(map(len, shown), dtype=np.int64, count=len(shown))
            yield _buckets("".join(shown), np.arange(start, end), lengths, lengths, bits)
        else:  # the last word is long by itself
            yield from gram_runs_of_one(words_[start:end], start, bits, run_chars)
        start = end


def gram_runs_of_one(some: list[str], start: int, bits: int, run_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words piece by piece; a piece has the characters that n-grams which start in it need."""
    for k, word in enumerate(some, start):
        shown = f"<{word}>"
        for at in range(0, max(1, len(shown) - MIN_N + 1), run_chars):
            piece = shown[at : at + run_chars + MAX_N - 1]
            yield _buckets(piece, np.array([k]), np.array([len(piece)]), np.array([run_chars]), bits)


def _buckets(shown: str, owners: np.ndarray, lengths: np.ndarray, own: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and owners of the n-grams that start in the first ``own`` characters of each piece of ``shown``."""
    points = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - place  # characters from here to the piece's end
    left[place >= np.repeat(own, lengths)] = 0  # the next piece has what starts here
    owner = np.repeat(owners, lengths)
    h = np.zeros(len(points), dtype=np.uint32)
    buckets, words_ = [], []
    for n in range(1, MAX_N + 1):
        moved, later = np.zeros(len(points), dtype=np.uint32), points[n - 1 :]
        moved[: len(later)] = later
        h = (h ^ moved) * MULTIPLIERS[n - 1]
        if n >= MIN_N:
            whole = left >= n
            buckets.append(((h ^ (h >> np.uint32(15))) & np.uint32((1 << bits) - 1))[whole])
            words_.append(owner[whole])
    return np.concatenate(buckets), np.concatenate(words_)


class Model(NamedTuple):
    bits: int
    weights: np.ndarray  # of every bucket; ratio and coefficient multiplied
    bias: float


class Rows(NamedTuple):
    """Documents as a sparse matrix: ``count`` of distinct words with the gram ``bucket``, in row order."""

    label: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    size: np.ndarray  # buckets of each document


def fit_linear(rows: Rows, ratios: np.ndarray, w: np.ndarray, b: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on counts scaled by ``ratios``, from ``w`` and ``b`` on by gradient steps of
    adaptive size. Both classes weigh the same."""
    used, column = np.unique(rows.bucket, return_inverse=True)
    value = rows.count * ratios[rows.bucket]
    y = rows.label.astype(np.float64)
    owner = np.repeat(np.arange(len(y)), rows.size)
    balance = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    out, v = w.copy(), w[used]
    m1, m2 = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, value * v[column], minlength=len(y)) + b
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        g = np.append(np.bincount(column, value * e[owner], minlength=len(v)) + penalty * v, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        d = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        v, b = v - d[:-1], b - d[-1]
    out[used] = v
    return out, b


def log_count_ratios(without: np.ndarray, with_: np.ndarray, clean: int, toxic: int, smoothing: float, doubt: float) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket, nearer to 0 by ``doubt`` standard errors."""
    a, b = smoothing * toxic / (clean + toxic), smoothing * clean / (clean + toxic)
    ratio = np.log((with_ + a) / (toxic + 2 * a)) - np.log((without + b) / (clean + 2 * b))
    error = np.sqrt(1 / (with_ + a) - 1 / (toxic + 2 * a) + 1 / (without + b) - 1 / (clean + 2 * b))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - doubt * error, 0.0)


def _features(sample: DataFrame, text_col: str, bits: int, limit: int = 50_000) -> DataFrame:
    """Label and, as packed numbers, the buckets of each document and the n-grams of its distinct words
    in them. At most ``limit`` short words are remembered."""
    token = uuid.uuid4().hex

    def run(labels_, texts) -> Iterator[tuple]:
        known: dict[str, np.ndarray] = built(token, dict)
        for label, text in zip(labels_, texts):
            found = words(text or "")
            new = [w for w in found if w not in known]
            here = {w: [] for w in new}
            for bucket, owner in gram_runs(new, bits):
                order = np.argsort(owner, kind="stable")
                ends = np.flatnonzero(np.diff(owner[order], append=-1)) + 1
                for some, last in zip(np.split(bucket[order].astype("<i4"), ends[:-1]), owner[order][ends - 1].tolist()):
                    here[new[last]].append(some)
            here = {w: np.concatenate(x) if x else np.zeros(0, dtype="<i4") for w, x in here.items()}
            every = [known[w] if w in known else here[w] for w in found]
            bucket, count = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0), np.zeros(0))
            yield label, bucket.astype("<i4").tobytes(), np.minimum(count, 65535).astype("<u2").tobytes()
            if len(known) + len(here) <= limit:
                known.update((w, x) for w, x in here.items() if len(w) <= LONGEST_KEPT)

    return map_rows(sample, ["label", text_col], "label int, bucket binary, count binary", run)


def _tally(features: DataFrame, bits: int) -> np.ndarray:
    """Documents of each class that have a bucket: 2 x buckets. A task adds up its own, so the driver gets a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), dtype="<i4")
        for batch in batches:
            for label, bucket in zip(batch.column("label").to_pylist(), batch.column("bucket")):
                total[label, np.frombuffer(bucket.as_buffer(), dtype="<i4")] += 1
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    total = np.zeros((2, 1 << bits))
    for row in features.select("label", "bucket").mapInArrow(run, "total binary").collect():
        total += np.frombuffer(row["total"], dtype="<i4").reshape(2, -1)
    return total


def _mixed(features: DataFrame, ratios: np.ndarray, w: np.ndarray, b: float, penalty: float, steps: int, held: int) -> tuple[np.ndarray, float]:
    """The mean, by documents, of the models that tasks learn from their own documents, ``held`` gram counts at a time."""
    sent = features.sparkSession.sparkContext.broadcast((ratios, w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, w, b = sent.value
        total, bias, n = np.zeros(len(w)), 0.0, 0
        rows: list[tuple] = []

        def learn() -> None:
            nonlocal total, bias, n
            label, bucket, count = zip(*rows)
            size = np.array([len(x) for x in bucket])
            some = Rows(np.array(label), np.concatenate(bucket), np.concatenate(count).astype(np.float64), size)
            v, c = fit_linear(some, ratios, w, b, penalty, steps)
            total, bias, n = total + len(rows) * v, bias + len(rows) * c, n + len(rows)
            rows.clear()

        waiting = 0
        for batch in batches:
            for label, bucket, count in zip(*[c.to_pylist() for c in batch.columns]):
                bucket, count = np.frombuffer(bucket, dtype="<i4"), np.frombuffer(count, dtype="<u2")
                told = ratios[bucket] != 0
                rows.append((label, bucket[told], count[told]))
                waiting += len(rows[-1][1])
                if waiting >= held:
                    learn()
                    waiting = 0
        if rows:
            learn()
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["n", "total", "bias"])

    total, bias, n = np.zeros(len(w)), 0.0, 0
    for row in features.select("label", "bucket", "count").mapInArrow(run, "n long, total binary, bias double").collect():
        total, bias, n = total + np.frombuffer(row["total"]), bias + row["bias"], n + row["n"]
    return total / n, bias / n


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: int = 8_000,
    bits: int = 18,
    smoothing: float = 2.0,
    doubt: float = 1.0,
    penalty: float = 1e-4,
    rounds: int = 2,
    steps: int = 100,
    part_docs: int = 1_000,
    held: int = 1_000_000,
) -> Model:
    """Learn from at most ``max_docs`` labelled documents, half of each class where there are enough.

    Which ones is decided by a hash of the id; labels of null ids, null labels and documents without
    a label teach nothing. Every bucket of the 2 ** ``bits`` has a log-count ratio, from the documents
    of each class that have an n-gram in it, drawn towards 0 by ``doubt`` times its standard error;
    ``smoothing`` counts are shared among the classes by size. The classifier learns on the counts of
    distinct words of every bucket whose ratio is not 0, scaled by the ratio: about ``part_docs``
    documents to a task, ``held`` gram counts at a time, and the tasks' models are averaged after each
    of the ``rounds``. Up to ``part_docs`` documents it is one model. The driver gets vectors of
    2 ** ``bits`` numbers, a few for each task, and never texts or lists as long as texts. Without
    documents of both classes the model is a bias.
    """
    held_labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    order = F.xxhash64(F.lit("toxicity"), id_col)
    chosen = None
    for label in (0, 1):
        some = held_labels.where(F.col("label") == label).orderBy(order, id_col).limit(max_docs // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = materialize(docs.select(id_col, text_col).join(F.broadcast(chosen), id_col), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(bits, np.zeros(1 << bits), 4.0 if toxic else -4.0)
    parts = max(1, math.ceil((clean + toxic) / part_docs))
    features = materialize(_features(sample.repartition(parts), text_col, bits), "toxicity-features").coalesce(parts)
    without, with_ = _tally(features, bits)
    ratios = log_count_ratios(without, with_, clean, toxic, smoothing, doubt)
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        w, b = _mixed(features, ratios, w, b, penalty, steps, held)
    weights = np.round(w * ratios * EXACT) / EXACT
    return Model(bits, weights, float(b))


class Scorer:
    """Scores of texts; sums of short words are remembered, ``limit`` of them at most.

    Weights are multiples of 1 / `EXACT`, so that sums of them are exact and equal texts get equal
    scores in whatever order their words come.
    """

    def __init__(self, model: Model, limit: int = 150_000, run_chars: int = 1_000_000):
        self.model, self.limit, self.run_chars, self.known = model, limit, run_chars, {}

    def _learn(self, new: list[str]) -> dict[str, float]:
        total = np.zeros(len(new))
        for bucket, owner in gram_runs(new, self.model.bits):
            total += np.bincount(owner, self.model.weights[bucket], minlength=len(new))
        return dict(zip(new, total.tolist()))

    def __call__(self, texts: list[str | None]) -> Iterator[float]:
        start = 0
        while start < len(texts):
            end, size, found = start, 0, []
            while end < len(texts) and size < self.run_chars:
                found.append(words(texts[end] or ""))
                size += len(texts[end] or "")
                end += 1
            start, known = end, self.known
            here = self._learn(list(set().union(*found).difference(known)))
            known.update(here)
            for some in found:
                z = sum(map(known.__getitem__, some)) + self.model.bias
                yield 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))
            full = len(known) > self.limit  # then what is known stays, as common words come first
            for w in here:
                if full or len(w) > LONGEST_KEPT:
                    del known[w]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score from 0 to 1 and predicted (1 from 0.5 on) of every whole text.

    Null and empty texts have no n-grams and get the score of the bias alone. A word counts once in
    a text of any length. Equal texts have equal scores. Repeated rows and rows of null ids are
    scored one by one, an empty table gives no rows, and other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    token = uuid.uuid4().hex

    def run(keys, texts) -> Iterator[tuple]:
        scorer = built(token, lambda: Scorer(sent.value))
        for key, s in zip(keys, scorer(texts)):
            yield key, s, int(s >= 0.5)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, score double, predicted int", run)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose texts score under 0.5.

    Null texts count as empty; ids are not read, so rows of null or repeated ids are kept or dropped
    each by its own text, and an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    token = uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = built(token, lambda: Scorer(sent.value))
        for batch in sliced(batches):
            yield batch.filter(pa.array([s < 0.5 for s in scorer(batch.column(at).to_pylist())], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
