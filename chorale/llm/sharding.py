"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chorale.functions.storage import materialize


def difference(vectors: Sequence[Sequence[int]], lanes: int) -> list[list[int]]:
    """For each vector of ``lanes`` sums, the final lane of each of its entries.

    The two partial partitions of the largest spread are combined, one in descending and the other
    in ascending order, until one is left.
    """
    if not vectors:
        return []
    parts: list[tuple] = []  # of each partial partition: what made it
    heap = []
    for k, v in enumerate(vectors):
        order = sorted(range(lanes), key=lambda i: (-v[i], i))
        sums = [v[i] for i in order]
        parts.append((k, order))
        heap.append((sums[-1] - sums[0], k, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, big = heapq.heappop(heap)
        _, b, small = heap[0]
        both = [x + y for x, y in zip(big, reversed(small))]
        order = sorted(range(lanes), key=both.__getitem__, reverse=True)
        sums = [both[i] for i in order]
        parts.append((a, b, order))
        heapq.heapreplace(heap, (sums[-1] - sums[0], len(parts) - 1, sums))
    out: list[list[int]] = [[]] * len(vectors)
    todo = [(heap[0][1], list(range(lanes)))]
    while todo:
        part, to = todo.pop()
        made = parts[part]
        if len(made) == 2:
            k, order = made
            final = [0] * lanes
            for place, i in enumerate(order):
                final[i] = to[place]
            out[k] = final
        else:
            a, b, order = made
            back = [0] * lanes
            for place, i in enumerate(order):
                back[i] = to[place]
            todo.append((a, back))
            todo.append((b, back[::-1]))
    return out


def place(vectors: DataFrame, lanes: int, at_once: int) -> DataFrame:
    """chunk, lane, shard for ``vectors`` (chunk, sums: one for each lane), by differencing ``at_once`` at a time.

    Tasks difference batches of vectors, and each batch leaves one vector, which is placed in the
    same way, until as many are left as one batch has; those are differenced on the driver. So the
    driver never gets more than ``at_once`` vectors, and no task more than about twice as many.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    if n <= at_once:
        rows = vectors.orderBy("chunk").collect()
        final = difference([r["sums"] for r in rows], lanes)
        return spark.createDataFrame([(r["chunk"], lane, to) for r, row in zip(rows, final) for lane, to in enumerate(row)], "chunk long, lane int, shard int")
    batches = math.ceil(n / at_once)

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", ignore_index=True)
        final = np.array(difference(rows["sums"].tolist(), lanes))
        total = np.zeros(lanes, dtype=np.int64)
        np.add.at(total, final.ravel(), np.concatenate(rows["sums"].tolist()))
        return rows.assign(to=final.tolist(), total=[total.tolist()] * len(rows))[["chunk", "to", "batch", "total"]]

    dealt = vectors.withColumn("batch", F.pmod(F.xxhash64("chunk"), F.lit(batches)))
    combined = materialize(dealt.groupBy("batch").applyInPandas(combine, "chunk long, to array<int>, batch long, total array<long>"), "combined")
    above = combined.groupBy("batch").agg(F.first("total").alias("sums"))  # equal in all rows of a batch
    placed = place(above.select(F.col("batch").alias("chunk"), "sums"), lanes, at_once)
    flat = combined.select("chunk", "batch", F.posexplode("to").alias("lane", "to"))
    up = placed.select(F.col("chunk").alias("batch"), F.col("lane").alias("to"), "shard")
    return flat.join(up, ["batch", "to"]).select("chunk", "lane", "shard")


def shard(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_groups: int = 40_000,
    bucket_rows: int = 20_000,
    at_once: int = 1_000,
) -> DataFrame:
    """Put every row into a shard so that the shards' bytes are near equal; law ``bytes``.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows of equal text, null and
    empty taken as equal, form a group that stays together. Groups are summed before anything else;
    each task differences its own groups, at most ``chunk_groups`` at a time, and leaves one vector
    of shard sums; the vectors are differenced in the same way, ``at_once`` at a time (see `place`).

    Id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null).
    Slots are given within buckets of about ``bucket_rows`` rows, after the counts of the buckets
    before. Repeated rows and rows of null ids get a slot each, and their number makes no bucket
    large, as buckets go by a number of the row; an empty table gives no rows; other columns are not
    read. A text of any length is one group; a group larger than a shard's share makes its shard larger.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "sizes")
    n = rows.count()
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held, count = 0, [], 0

        def out() -> pd.DataFrame:
            nonlocal made, held, count
            all_ = pd.concat(held).sort_values(["bytes", "group"], ascending=False, ignore_index=True)
            zeros = [0] * (shards - 1)
            lanes = [final[0] for final in difference([[b, *zeros] for b in all_["bytes"].tolist()], shards)]
            chunk = TaskContext.get().partitionId() * 1_000_000 + made
            made, held, count = made + 1, [], 0
            return all_.assign(chunk=chunk, lane=lanes)

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= chunk_groups:
                yield out()
        if count:
            yield out()

    laid = materialize(groups.mapInPandas(lay, "group binary, bytes long, chunk long, lane int"), "lanes")
    sums = laid.groupBy("chunk", "lane").agg(F.sum("bytes").alias("bytes")).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("lane", "bytes"))).alias("by_lane"))
    every = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.coalesce(F.try_element_at("by_lane", k), F.lit(0).cast("long")))
    places = place(sums.select("chunk", every.alias("sums")), shards, at_once)
    dealt = rows.join(laid.join(places, ["chunk", "lane"]).select("group", "shard"), "group")
    buckets = max(1, math.ceil(n / bucket_rows))
    dealt = materialize(dealt.select("id", "size", "text_crc32", "row", "shard", F.pmod(F.xxhash64("row"), F.lit(buckets)).alias("bucket")), "dealt")
    before = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = before.select("shard", "bucket", (F.sum("rows").over(W.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before"))
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("id", "row"))
    return (
        dealt.withColumn("inside", inside)
        .join(before, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("inside") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
