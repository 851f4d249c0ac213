"""N-gram Jaccard join: MinHash banding proposes, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.joins import join_totals
from chorale.functions.storage import materialize
from chorale.llm.common import forget, map_rows, uncollected
from chorale.operators.graph import connected_components

MIX = np.uint64(0x9E3779B97F4A7C15)
ROW = "chorale_row"


def bands_and_rows(similarity: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """The fewest bands of ``rows`` rows that propose a pair of that similarity with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Distinct 64-bit hashes of a text's n-grams of words, in order."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        n = min(self.n, max(1, len(h)))
        if not len(h):
            return np.zeros(1, dtype=np.uint64)
        total = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            total = total * MIX + h[k : len(h) - n + 1 + k]
        return np.unique(_mix(total + np.uint64(n)))


class Banding:
    def __init__(self, bands: int, rows: int):
        draw = np.random.default_rng(20)
        self.bands, self.rows = bands, rows
        self.times = draw.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.array([(shingles * t).min() for t in self.times], dtype=np.uint64).reshape(self.bands, self.rows)
        total = np.zeros(self.bands, dtype=np.uint64)
        for r in range(self.rows):
            total = _mix(total * MIX + least[:, r])
        return (total + np.arange(self.bands, dtype=np.uint64) * MIX).view(np.int64)


def row_name(columns: list[str]) -> str:
    """`ROW`, or a longer name where a column has that one."""
    taken, name = {c.lower() for c in columns}, ROW
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, row_col: str = ROW) -> DataFrame:
    """``docs`` in a written table, with a number of its own for each row in the column ``row_col``."""
    return materialize(docs.withColumn(row_col, F.monotonically_increasing_id()), "rows")


def signatures(docs: DataFrame, row_col: str, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """Row, id, set_key (equal for equal n-gram sets), n-grams in the set and the band hashes of every document."""

    def run(numbers, keys, texts) -> Iterator[tuple]:
        forget()
        shingle, band = Shingler(n), Banding(bands, rows)
        with uncollected():
            for row, key, text in zip(numbers, keys, texts):
                s = shingle(text or "")
                yield row, key, xxhash.xxh128_digest(s.tobytes()), len(s), band(s).tolist()

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [row_col, id_col, text_col], f"row long, id {kind}, set_key binary, shingles long, bands array<long>", run)


def _links(sets: list[np.ndarray], copies: np.ndarray, pairs: np.ndarray, similarity: float) -> tuple[np.ndarray, list[int]]:
    """Linked documents of each set and a label for each, equal for linked sets.

    ``pairs`` tells which sets are compared. Common n-grams are counted by products of 0/1 matrices
    over slices of the n-grams that two sets or more have.
    """
    m = len(sets)
    if not pairs.any():
        return np.zeros(m), list(range(m))
    sizes = np.array([len(s) for s in sets])
    both = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    values, column, number = np.unique(both, return_inverse=True, return_counts=True)
    keep = number[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    common = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [at, at + width])
        grid = np.zeros((m, width), dtype=np.float32)
        grid[owner[low:high], column[low:high] - at] = 1
        common += grid @ grid.T
    close = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    close &= pairs
    label = np.arange(m)
    while True:  # each set takes the lowest label of its links, until none changes
        least = np.minimum(label, np.where(close, label[None, :], m).min(axis=1, initial=m))
        if (least := least[least]).tolist() == label.tolist():
            return close @ copies, label.tolist()
        label = least


def near_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.99995,
    block: int = 400,
    block_shingles: int = 2_000_000,
    row_col: str | None = None,
) -> DataFrame:
    """Id, class_id, copy_id and n_links of every document.

    Two documents are linked if the Jaccard similarity of their sets of n-grams of words (white
    space between them, case kept) is at least ``similarity``. n_links counts a document's links,
    copy_id is the lowest id of those with the same set, class_id the lowest id in the connected
    component. A text of fewer words has one n-gram, of all its words; null and empty texts are
    copies of each other. Rows are told apart by a number of their own, never by the id: a null id is
    no id of a class or of copies unless all its ids are null, and rows that share an id, or have
    none, are compared and linked each by its own text. ``row_col`` names a column of distinct longs
    in a table that reads the same every time (see `numbered`); without it, one is written here. An
    empty table gives no rows; other columns are not read.

    Equal sets are first reduced to one. Band hashes propose: the components of the buckets are the
    families within which links are sought. A family of up to ``block`` sets is compared whole, in
    one task, and so is a larger one of which the largest bucket holds half, for then nearly all its
    pairs are proposed. Any other large family is welded together by chains or by a passage that
    many texts share; in it the sets of each bucket are compared, and a pair that shares several
    buckets only in that of its first common band. Families and buckets are dealt in blocks of about
    ``block`` sets, fewer where the sets are so large that a block would have more than
    ``block_shingles`` n-grams, and each pair of blocks is a task that compares full n-gram sets; so
    a group of any size is compared without gathering it. Only counts and labels leave a task,
    never pairs.
    """
    bands, rows = bands_and_rows(similarity, recall)
    if row_col is None:
        docs = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    else:
        docs = docs.select(F.col(row_col).alias(ROW), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, ROW, "id", "text", n, bands, rows), "signatures")
    sets = signed.groupBy("set_key").agg(F.min("row").alias("node"), F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("shingles").alias("shingles"), F.min("bands").alias("bands"))
    sets = materialize(sets, "sets")  # a set is known by the number of its first row
    n_rows, n_sets = signed.count(), sets.count()
    members = materialize(_families(sets, n_sets * bands).join(sets.select("node", "copies", "shingles", "bands"), "node"), "members")
    groups = materialize(_groups(members, n_sets, bands, block, block_shingles), "groups")
    of_node = groups.groupBy("node").agg(F.collect_list(F.struct("kind", "grp", "blocks")).alias("groups"))
    texts = docs.select(F.col(ROW).alias("node"), "text").join(members.select("node", "copies", "bands").join(of_node, "node"), "node")
    placed = texts.select("node", "copies", "bands", "text", F.explode("groups").alias("g")).select("node", "copies", "bands", "text", "g.*")
    placed = placed.withColumn("mine", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "mine").alias("a"), F.greatest(k, "mine").alias("b")))
    dealt = placed.withColumn("pair", F.explode(other)).select("kind", "grp", "pair.a", "pair.b", "node", "copies", "mine", F.when(F.col("kind") == BUCKET, F.col("bands")).alias("bands"), "text")
    dealt = dealt.repartition("kind", "grp", "a", "b").sortWithinPartitions("kind", "grp", "a", "b", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingle = Shingler(n)
        names = ["node", "low", "links"]

        def out(key, held) -> pa.RecordBatch:
            nodes, copies, mine, banded, found = zip(*held)
            pairs = _proposed(key, np.array(mine), banded)
            links, label = _links(found, np.array(copies), pairs, similarity)
            return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([nodes[k] for k in label], pa.int64()), pa.array(links.astype(np.int64))], names=names)

        key, held = None, []
        with uncollected():
            for batch in batches:
                for kind, grp, a, b, node, copies, mine, banded, text in zip(*[c.to_pylist() for c in batch.columns]):
                    if key != (kind, grp, a, b):
                        if len(held) > 1:
                            yield out(key, held)
                        key, held = (kind, grp, a, b), []
                    held.append((node, copies, mine, banded, shingle(text or "")))
            if len(held) > 1:
                yield out(key, held)

    compared = materialize(dealt.mapInArrow(compare, "node long, low long, links long"), "compared")
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(compared.where("node <> low").select(F.col("node").alias("src"), F.col("low").alias("dst")).distinct())
    classes = materialize(joined.join(sets.select("node", "rep"), "node"), "classes")
    lowest = classes.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    classes = join_totals(classes, lowest, "component", "n", n_sets).select("node", "class_id")
    found = sets.join(links, "node", "left").join(classes, "node", "left")
    found = found.select("set_key", F.col("rep").alias("copy_id"), F.coalesce("class_id", "rep").alias("class_id"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = join_totals(signed.select("id", "set_key"), materialize(found, "found"), "set_key", "copies", n_rows)
    return found.select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links")


FAMILY, BUCKET = 0, 1


def _families(sets: DataFrame, n_bands: int) -> DataFrame:
    """node, component of every set that shares a bucket with another: each is tied to its bucket's lowest."""
    keyed = sets.select("node", F.explode("bands").alias("band"))
    lowest = keyed.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("m")).where("m > 1")
    edges = join_totals(keyed, lowest, "band", "m", n_bands).where("node <> low")
    return connected_components(edges.select(F.col("node").alias("src"), F.col("low").alias("dst")).distinct())


def _groups(members: DataFrame, n_sets: int, bands: int, block: int, block_shingles: int) -> DataFrame:
    """node, kind, grp, blocks: the families and buckets in which each set is compared."""
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("shingles") / F.lit(block_shingles))).cast("int").alias("blocks")
    family = members.groupBy("component").agg(F.count("*").alias("size"), blocks)
    member = join_totals(members, family, "component", "size", n_sets).select("component", "node", "shingles", "bands", "size", "blocks")
    keyed = member.where("blocks > 1").select("component", "node", "shingles", "size", F.posexplode("bands").alias("t", "band"))
    bucket = keyed.groupBy("band").agg(
        F.min("component").alias("component"), F.min("size").alias("size"), F.min("t").alias("t"), F.count("*").alias("m"), blocks,
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("one"), F.bit_xor(F.xxhash64(F.lit("x"), "node")).alias("two"),
    ).where("m > 1")
    bucket = materialize(bucket, "buckets")
    welded = bucket.groupBy("component").agg((F.max("m") * 2 < F.min("size")).alias("welded")).where("welded").select("component")
    whole = member.join(welded, "component", "left_anti").select("node", F.lit(FAMILY).alias("kind"), F.col("component").alias("grp"), "blocks")
    # Buckets of the same sets as one of an earlier band have no pair of their own.
    kept = bucket.join(welded, "component").groupBy("component", "m", "one", "two").agg(F.min_by(F.struct("band", "blocks"), F.struct("t", "band")).alias("b"))
    kept = kept.select("b.*", "m")
    parts = join_totals(keyed.select("node", "band"), kept, "band", "m", n_sets * bands)
    return whole.unionByName(parts.select("node", F.lit(BUCKET).alias("kind"), F.col("band").alias("grp"), "blocks"))


def _proposed(key: tuple, mine: np.ndarray, banded: tuple) -> np.ndarray:
    """Which pairs a task compares: sets of one block with those of the other, and in a bucket such as share no earlier band."""
    kind, grp, a, b = key
    first, second = mine == a, mine == b
    pairs = (first[:, None] & second[None, :]) | (second[:, None] & first[None, :])
    np.fill_diagonal(pairs, False)
    if kind == BUCKET:
        bands = np.array(banded, dtype=np.int64)
        for band in bands.T[: banded[0].index(grp)]:
            pairs &= band[:, None] != band[None, :]
    return pairs
