"""I-Match fingerprints: hashes of a document's terms within an inverse-document-frequency band."""

from __future__ import annotations

import bisect
import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.common import built, map_rows

NO_TERMS = "-"


def terms(text: str) -> set[str]:
    return set(text.lower().split())


def document_frequencies(docs: DataFrame, text_col: str, held_terms: int = 400_000) -> DataFrame:
    """Term and number of documents with it, over all documents; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(terms(text.as_py() or ""))
                if len(held) > held_terms:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    return docs.select(text_col).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])


def lexicon(docs: DataFrame, text_col: str, min_share: float, max_share: float) -> list[str]:
    """Terms of the band. At most (mean distinct terms of a document) / ``min_share`` have so high
    a document frequency, whatever the number of documents."""
    n = docs.count()
    least = max(2, math.ceil(n * min_share))
    most = max(least, math.floor(n * max_share))
    return [r[0] for r in document_frequencies(docs, text_col).where(F.col("df").between(least, most)).select("term").collect()]


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Lexicon:
    """Which of the randomised subsets hold a term is a bit mask made from the term's hash.

    The first subset is the whole lexicon. The others come in levels that keep 1/8, 1/16, 1/32 ...
    of the terms, so that a short document has terms in some and a long one still agrees with its
    near copies in others. There are 64 subsets at most.
    """

    def __init__(self, words: list[str], levels: int, each: int):
        self.shifts = [0, *(level + 3 for level in range(levels) for _ in range(each))]
        self.words = {w: i for i, w in enumerate(words)}
        self.keys = self.words.keys()
        self.hashes, self.masks = self._of(words)

    def _of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
        masks = np.zeros(len(words), dtype=np.uint64)
        for i, shift in enumerate(self.shifts):
            mixed = _spread(h + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1)))
            kept = mixed & np.uint64((1 << shift) - 1) == 0
            masks |= kept.astype(np.uint64) << np.uint64(i)
        return h, masks

    def fingerprint(self, text: str) -> list[str]:
        found = terms(text)
        inside = found & self.keys
        if inside:
            at = [self.words[w] for w in inside]
            h, masks = self.hashes[at], self.masks[at]
        else:  # no term of the band: all its terms stand in
            h, masks = self._of(list(found))
        order = np.argsort(h)
        h, masks = h[order], masks[order]
        out = []
        for i in range(len(self.shifts)):
            chosen = h[(masks >> np.uint64(i)) & np.uint64(1) == 1]
            out.append(xxhash.xxh32_hexdigest(chosen.tobytes()) if len(chosen) else NO_TERMS)
        return out


def likeness(a: list[str], b: list[str]) -> float:
    """Share of equal hashes among the subsets in which either document has terms; 1 if there are none."""
    both = [(x, y) for x, y in zip(a, b) if x != NO_TERMS or y != NO_TERMS]
    return sum(x == y for x, y in both) / len(both) if both else 1.0


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_share: float = 0.0005,
    max_share: float = 0.2,
    levels: int = 7,
    each: int = 9,
) -> DataFrame:
    """Id and fingerprint of every whole text (null: empty).

    The lexicon has the terms (lower-cased, between white space) whose document frequency is from
    ``min_share`` to ``max_share`` of all documents; see `lexicon` for its bound. A fingerprint
    is 1 + ``levels`` * ``each`` hashes, of the sorted terms in the lexicon and its subsets, or ``-``
    where the document has none there. A document without any term of the band is hashed from all
    its terms; an empty one has no hash at all. Equal texts have equal fingerprints.
    """
    token = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, min_share, max_share))

    def run(keys, texts) -> Iterator[tuple]:
        known = built(token, lambda: Lexicon(sent.value, levels, each))
        for key, text in zip(keys, texts):
            yield key, ".".join(known.fingerprint(text or ""))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, fingerprint string", run)


def with_next(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int, max_buckets: int) -> DataFrame:
    """Rows (bucket, tail, id, text) such that within a bucket, in order, each row's next document follows.

    The order is descending by id (null last), then by a hash of the text, then by the row's place
    in the table, so that no number of equal ids or rows makes a bucket large. Buckets are ranges of
    that order, cut at rows drawn at random, and a bucket's first row is such a cut; the task that
    deals a row to its bucket by a search among the cuts also copies each cut to the end of the bucket
    above (the topmost row to that of the lowest bucket). The driver holds the cuts, ``max_buckets``
    at most. Texts are shuffled and sorted as zstd frames, for they are all that the shuffle weighs.
    """
    n = docs.count()
    parts = min(max_buckets, max(1, math.ceil(n / bucket_rows)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("seq"))
    key = F.struct(F.col("id").isNotNull().alias("known"), "id", "h", "seq")
    first = rows.agg(F.max(key)).first()[0]
    drawn = rows.select(key.alias("key")).sample(min(1.0, 10 * parts / max(1, n)), seed=5).collect() if parts > 1 else []  # about ten keys a bucket
    drawn = sorted(tuple(r["key"]) for r in drawn)
    cuts = sorted({*[drawn[k * len(drawn) // parts] for k in range(1, parts)], *([tuple(first)] if first else [])}) if drawn or first else []
    sent = docs.sparkSession.sparkContext.broadcast(cuts)
    kind = rows.schema["id"].dataType.simpleString()
    names = ["bucket", "tail", "id", "text", "h", "seq"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, cuts = zstandard.ZstdCompressor(level=1), sent.value
        for batch in batches:
            out = []
            for key, text, h, seq in zip(*[c.to_pylist() for c in batch.columns]):
                frame = zstd.compress(text.encode())
                place = bisect.bisect_left(cuts, (key is not None, key, h, seq))
                bucket = len(cuts) - 1 - place
                out.append((bucket, 0, key, frame, h, seq))
                if cuts[place] == (key is not None, key, h, seq):
                    out.append((bucket - 1 if bucket else len(cuts) - 1, 1, key, frame, h, seq))
            types = [pa.int64(), pa.int32(), batch.schema.field("id").type, pa.binary(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    rows = rows.mapInArrow(deal, f"bucket long, tail int, id {kind}, text binary, h long, seq long")
    order = ["bucket", "tail", F.col("id").desc_nulls_last(), F.col("h").desc(), F.col("seq").desc()]
    return rows.repartitionById(max(1, len(cuts)), F.col("bucket").cast("int")).sortWithinPartitions(*order).drop("h", "seq")


def edited_fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_share: float = 0.0005,
    max_share: float = 0.2,
    levels: int = 7,
    each: int = 9,
    bucket_rows: int = 5_000,
    max_buckets: int = 10_000,
) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare it with those and the next document's.

    The next document is that of the next lower id; the lowest is followed by the highest. The
    edited text has the last half of its code points replaced by the first of the next document.
    Null texts count as empty and null ids as lowest; rows that share an id, or have none, go by
    their texts' hashes, and repeated rows each have a place of their own. A table of one row is its
    own next document; an empty one gives no rows; other columns are not read. Tables of more than
    ``max_buckets`` * ``bucket_rows`` rows have larger buckets, which are sorted and read as streams.
    ``docs`` is read several times and must give the same rows in the same order, as files do.
    """
    token = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, min_share, max_share))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = built(token, lambda: Lexicon(sent.value, levels, each))
        zstd = zstandard.ZstdDecompressor()
        held = None
        for batch in batches:
            out = []
            for bucket, tail, key, frame in zip(*[c.to_pylist() for c in batch.columns]):
                text = zstd.decompress(frame).decode()
                prints = known.fingerprint(text)
                if held is not None and held[0] == bucket and not held[1]:
                    half = len(held[3]) // 2
                    edited = held[3][: len(held[3]) - half] + text[:half]
                    changed = known.fingerprint(edited)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((held[2], len(held[3]), sha, ".".join(held[4]), ".".join(changed), likeness(held[4], changed), likeness(held[4], prints)))
                held = (bucket, tail, key, text, prints)
            columns = list(zip(*out)) if out else [()] * len(names)
            types = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    return with_next(docs, id_col, text_col, bucket_rows, max_buckets).mapInArrow(run, schema)
