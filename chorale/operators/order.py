"""Order of aligned rows inside a conversation: majority votes, repair, votes again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chorale.functions.storage import materialize
from chorale.operators.align import row_mode

KEY = ["conversation_id", "date", "sender", "message_media"]


def greater(a: dict[str, int], b: dict[str, int]) -> bool:
    """Whether ``a`` stands behind ``b``: more holders that have both put it behind than do not (equal
    orders count as not). Without a common holder the highest orders decide."""
    both = a.keys() & b.keys()
    if not both:
        return max(a.values(), default=0) > max(b.values(), default=0)
    behind = sum(a[h] > b[h] for h in both)
    return behind > len(both) - behind


def compare(a: dict[str, int], b: dict[str, int]) -> int:
    """-1, 0 or 1; 0 where neither stands behind the other."""
    return greater(a, b) - greater(b, a)


def standings(orders: list[dict[str, int]], block: int = 256) -> np.ndarray:
    """Of each row of a minute, how many others it stands behind less how many stand behind it.

    Votes may be circular, and this number orders them all the same. Rows are compared ``block`` with
    all at a time, so memory grows with a minute's rows and not with their pairs.
    """
    holders = sorted({h for r in orders for h in r})
    values = np.array([[r.get(h, np.nan) for h in holders] for r in orders], dtype=np.float64).reshape(len(orders), len(holders))
    here = ~np.isnan(values)
    top = np.nanmax(np.where(here.any(1)[:, None], values, 0.0), axis=1) if holders else np.zeros(len(orders))
    out = np.zeros(len(orders), dtype=np.int64)

    def behind(some: slice, others: slice) -> np.ndarray:
        votes = np.zeros((len(orders[some]), len(orders[others])), dtype=np.int32)
        common = np.zeros_like(votes)
        for k in range(len(holders)):
            votes += values[some, k, None] > values[None, others, k]
            common += here[some, k, None] & here[None, others, k]
        return np.where(common > 0, 2 * votes > common, top[some, None] > top[None, others])

    every = slice(None)
    for at in range(0, len(orders), block):
        some = slice(at, at + block)
        out[some] += behind(some, every).sum(1)
        out[some] -= behind(every, some).sum(0)
    return out


def repair(rows: list[dict[str, int]]) -> list[dict[str, int]]:
    """In row order, where a holder lags behind the row's maximum, that value and all of the holder's
    values as high or higher rise by the difference. Returns the orders after all rows.

    A holder's column is a sorted list of values with a growing suffix sum: a Fenwick tree over value
    ranks.
    """
    holders = sorted({h for r in rows for h in r})
    ranks = {h: {v: i for i, v in enumerate(sorted({r[h] for r in rows if h in r}), 1)} for h in holders}
    trees = {h: [0] * (len(ranks[h]) + 1) for h in holders}

    def value(h: str, v: int) -> int:
        i, total = ranks[h][v], v
        while i:
            total += trees[h][i]
            i -= i & -i
        return total

    for r in rows:
        now = {h: value(h, v) for h, v in r.items()}
        top = max(now.values(), default=0)
        for h, v in now.items():
            if v < top:
                i = ranks[h][r[h]]
                while i < len(trees[h]):
                    trees[h][i] += top - v
                    i += i & -i
    return [{h: value(h, v) for h, v in r.items()} for r in rows]


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (the key, sources and orders) with their position in the conversation, from 0.

    Only minutes of several rows go to Python, for their votes; everything else is a sort.
    """
    counted = rows.withColumn("same", F.count("*").over(W.partitionBy("conversation_id", "date")))
    several = counted.where("same > 1").select(*KEY, "sources", F.map_keys("orders").alias("holders"), F.map_values("orders").alias("values"))
    kinds = {f.name: f.dataType.simpleString() for f in several.schema}
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", standing long"

    def vote(minute: pd.DataFrame) -> pd.DataFrame:
        return minute.assign(standing=standings([dict(zip(h, v)) for h, v in zip(minute["holders"], minute["values"])]))

    voted = several.groupBy("conversation_id", "date").applyInPandas(vote, schema)
    voted = voted.select(*KEY, "sources", F.map_from_arrays("holders", "values").alias("orders"), "standing")
    single = counted.where("same = 1").select(*KEY, "sources", "orders", F.lit(0).cast("long").alias("standing"))
    top = F.coalesce(F.array_max(F.map_values("orders")), F.lit(0))
    w = W.partitionBy("conversation_id").orderBy("date", "standing", top, "sender", "message_media")
    return single.unionByName(voted).select(*KEY, "sources", "orders", (F.row_number().over(w) - 1).cast("long").alias("position"))


def order_rows(aligned: DataFrame) -> DataFrame:
    """The key, sources, position (from 0), order_number and the order flags of every aligned row.

    Rows go by date, then votes; ties by highest order, sender and message. Orders are then repaired
    and the rows sorted once more by the repaired ones. A row is out of order if one of its holders
    falls against a neighbour that the holder has too; its order number is the most frequent one
    among holders that are in order, or among all if none is.

    Repair carries its shifts from a conversation's first row to its last, so it runs in one task a
    conversation; that task gets numbers only, no text.
    """
    first = materialize(_placed(aligned.select(*KEY, "sources", "orders")), "placed")
    numbers = first.select("conversation_id", "position", F.map_keys("orders").alias("holders"), F.map_values("orders").alias("values"))
    kind = first.schema["conversation_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        fixed = repair([dict(zip(h, map(int, v))) for h, v in zip(rows["holders"], rows["values"])])
        return rows.assign(values=[[f[h] for h in hs] for f, hs in zip(fixed, rows["holders"])])

    fixed = numbers.groupBy("conversation_id").applyInPandas(run, f"conversation_id {kind}, position long, holders array<string>, values array<long>")
    repaired = first.drop("orders").join(fixed, ["conversation_id", "position"])
    placed = _placed(repaired.select(*KEY, "sources", F.map_from_arrays("holders", "values").alias("orders")))
    return _flags(placed)


def _flags(placed: DataFrame) -> DataFrame:
    w = W.partitionBy("conversation_id").orderBy("position")
    before, after = F.lag("orders").over(w), F.lead("orders").over(w)
    near = placed.select("*", before.alias("before"), after.alias("after"))

    def in_order(h, v):
        return (F.coalesce(v - F.try_element_at("before", h), F.lit(0)) >= 0) & (F.coalesce(v - F.try_element_at("after", h), F.lit(0)) <= 0)

    kept = F.map_values(F.map_filter("orders", in_order))
    every = F.map_values("orders")
    number = F.coalesce(F.when(F.size(kept) > 0, row_mode(kept)), row_mode(every), F.lit(0))
    flagged = near.select(*KEY, "sources", "position", number.cast("long").alias("order_number"), (F.size(kept) < F.size(every)).alias("any_out_of_order"))
    same = F.count("*").over(W.partitionBy("conversation_id", "order_number")) > 1
    flagged = flagged.withColumn("no_unique_order", same)
    return flagged.withColumn("unknown_order", F.col("any_out_of_order") | F.col("no_unique_order"))
