"""Best-fit packing of tokenised documents, certified by dual-feasible lower bounds."""

from __future__ import annotations

import functools
import gc
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.functions.storage import materialize
from chorale.llm.common import built, map_rows

PIECES = "`{id}` {kind}, piece int, start long, length long, ids_crc32 long"


#: Longer strings are worked out anew each time, so that a memory of n strings has a bound in bytes.
LONGEST_KEPT = 64


class ChunkEncoder:
    """Token ids of whole texts as little-endian bytes, with a bounded memory of white-space chunks.

    The first chunks and units that are met are remembered, as common ones come early.

    The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are
    its chunks' ids in order. A new chunk of simple letters is lower-cased and cut into the
    pre-tokenizer's units here, and the library's model encodes each new unit; any other chunk goes
    to the library as it is, and so do whole texts with separators that only Python takes for
    white space.
    """

    odd = ("\x1c", "\x1d", "\x1e", "\x1f")
    simple_below = "\u0130"  # below it, lower-casing goes character by character and NFC changes nothing
    not_simple = frozenset("²³¹¼½¾<")  # numbers that Python takes for letters; the start of special tokens
    unit = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str, max_chunks: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.max_chunks = max_chunks
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.split = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        shown = unit if unit.isascii() and unit.isalpha() else self.split(unit)[0][0]
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            if "<" in chunk:
                return self._whole(chunk)
        elif max(chunk) >= self.simple_below or not self.not_simple.isdisjoint(chunk):
            return self._whole(chunk)
        lower = chunk.lower()
        out = []
        for unit in (lower,) if lower.isalpha() else self.unit.findall(lower):
            ids = self.units.get(unit)
            if ids is None:
                ids = self._unit(unit)
                if len(unit) <= LONGEST_KEPT and len(self.units) < self.max_chunks:
                    self.units[unit] = ids
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in self.odd):
            return self._whole(text)
        chunks = text.split()
        found = list(map(self.known.get, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    chunk = chunks[i]
                    found[i] = ids = self._chunk(chunk)
                    if len(chunk) <= LONGEST_KEPT and len(self.known) < self.max_chunks:
                        self.known[chunk] = ids
        return b"".join(found)


def encoder(path: str, max_chunks: int) -> ChunkEncoder:
    return built((path, max_chunks, "chunks"), lambda: ChunkEncoder(path, max_chunks))


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, max_length: int, end_id: int, max_chunks: int) -> DataFrame:
    """A row for each piece of at most ``max_length`` tokens of each document's ids and end id."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(keys, texts) -> Iterator[tuple]:
        gc.disable()  # the memory of chunks holds no cycles, and walking it costs as much as filling it
        encode = encoder(tokenizer, max_chunks)
        if texts and encode(texts[0] or "") != encode._whole(texts[0] or ""):
            raise RuntimeError("chunked encoding differs from the library's")
        for key, text in zip(keys, texts):
            ids = encode(text or "") + end
            for k, at in enumerate(range(0, len(ids), 4 * max_length)):
                part = ids[at : at + 4 * max_length]
                yield key, k, at // 4, len(part) // 4, zlib.crc32(part)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], PIECES.format(id=id_col, kind=kind), cut)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs. ``counts[n]`` is the number of items of length n, n from 0 to capacity.

    The best of three families of dual-feasible functions: the identity, the threshold functions
    (items over capacity - e fill a bin, items under e are free) and the rounding functions of k.
    """
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    below = np.concatenate([[0], np.cumsum(counts * size)])
    number = np.concatenate([[0], np.cumsum(counts)])
    for e in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - e + 1])
        middle = int(below[capacity - e + 1] - below[e])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's free space. ``lengths`` is in descending order.

    One bit for each amount of free space tells whether a bin has it, so that the tightest bin is
    found without a search.
    """
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    free: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0
    for i, n in enumerate(lengths.tolist()):
        fits = has >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                has ^= 1 << space
        else:
            b, space = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        free[b] = left = space - n
        by_space[left].append(b)
        has |= 1 << left
        if left == 0:
            by_space[0].clear()
            has &= ~1
    return bins, offsets, np.array(free, dtype=np.int64)


def _pack_part(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack a partition. Its bound certifies it where no packing of its pieces has fewer bins; then all
    its bins stand but the emptiest, else only the full ones. The others' pieces go on."""
    rows = rows.sort_values(["length", *rows.columns.drop(["part", "length"])], ascending=False, kind="stable", ignore_index=True)
    lengths = rows["length"].to_numpy()
    bins, offsets, free = best_fit_decreasing(lengths, capacity)
    goes_on = free > 0
    if len(free) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
        goes_on &= np.arange(len(free)) == free.argmax()
    return rows.assign(bin=bins, offset=offsets, gap=free[bins], goes_on=goes_on[bins])


def _histogram(df: DataFrame, capacity: int) -> np.ndarray:
    """At most ``capacity`` rows reach the driver."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in df.groupBy("length").count().collect():
        counts[n] = c
    return counts


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    part_rows: int = 8_000,
    max_rounds: int = 8,
    max_chunks: int = 150_000,
) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the method finds.

    A document is its ids and ``end_id``. Only longer ones are cut, into pieces of ``capacity``.
    Pieces are dealt to partitions by hash, each packed best fit decreasing. A dual-feasible bound
    certifies a partition whose bins are as few as any packing of its pieces needs: its bins stand,
    but for the emptiest. Of a partition that is not certified only the full bins stand. The pieces
    of the other bins are exchanged: dealt anew, to fewer partitions and among other neighbours, and
    packed again, until a round needs as many bins as were opened for it; that round is dropped. The
    same bound over all lengths certifies the whole and ends the work. Where it does not yet, as the
    certificates of partitions speak of their own pieces only, the pieces of all bins with free
    space are exchanged in the same way.

    Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the free space ``gap``
    of its sequence. Null and empty texts give one piece of one token (the end id). Repeated rows
    are packed as often as they occur; an empty table gives no rows; other columns are not read.
    """
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, max_chunks)
    return pack_pieces(pieces, capacity, part_rows, max_rounds)


def pack_pieces(pieces: DataFrame, capacity: int, part_rows: int, max_rounds: int = 8) -> DataFrame:
    """The pieces, of any columns with a ``length`` of 1 to ``capacity``, and the sequence_id, offset and
    gap that `pack` gives them. Equal rows are told apart by a number, so they too are dealt evenly."""
    names = pieces.columns
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", part long, bin long, offset long, gap long, goes_on boolean"
    need = lower_bound(_histogram(pieces, capacity), capacity)
    turns = iter(range(max_rounds))

    def rounds(todo: DataFrame, opened: int | None, beside: int, flag: str) -> tuple[DataFrame, int]:
        """``todo``, now in ``opened`` bins, packed until a round saves nothing, and all bins there are then.

        ``beside`` counts the bins that stand already, and ``flag`` tells which pieces of a round go
        on to the next.
        """
        stands: list[DataFrame] = []  # pieces in bins that no later round opens
        last, total = todo, beside + (opened or 0)
        for turn in turns:
            parts = max(1, math.ceil(todo.count() / part_rows))
            dealt = todo.select(*names, "row", F.pmod(F.xxhash64(F.lit(turn), "row"), F.lit(parts)).alias("part"))
            packed = materialize(dealt.groupBy("part").applyInPandas(lambda rows: _pack_part(rows, capacity), placed), f"packed{turn}")
            packed = packed.withColumn("sequence_id", F.lit(turn << 56) + F.shiftleft("part", 32) + F.col("bin"))
            bins, open_bins = packed.where("offset = 0").agg(F.count("*"), F.count_if(F.expr(flag))).first()
            if opened is not None and bins >= opened:
                break
            if opened is not None and last is not todo:
                stands.append(last.where(f"not ({flag})"))
            last, total = packed, beside + bins
            if total <= need or open_bins < 2:
                break
            beside, opened, todo = total - open_bins, open_bins, packed.where(flag)
        return functools.reduce(DataFrame.unionByName, stands, last), total

    out = [*names, "sequence_id", "offset", "gap"]
    if pieces.isEmpty():
        return pieces.select(*names, *[F.lit(0).cast("long").alias(c) for c in out[len(names) :]])
    result, total = rounds(pieces, None, 0, "goes_on")
    if total > need:
        open_bins = result.where("gap > 0 and offset = 0").count()
        again, _ = rounds(result.where("gap > 0"), open_bins, total - open_bins, "gap > 0")
        result = result.where("gap = 0").unionByName(again)
    return result.select(*out)
