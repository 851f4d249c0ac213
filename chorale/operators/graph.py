"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chorale.functions.joins import join_totals
from chorale.functions.storage import materialize


#: Edges that one task settles without rounds: 16 MB of longs.
AT_ONCE = 1_000_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """``node`` and ``component`` (the lowest node of it) for every node of the edges.

    Alternates large-star and small-star: in each, every node hands its neighbours to the lowest of
    them, so that components shrink to stars in few rounds. Each round is two aggregates and joins of
    linear size, written to the shared folder so that lineage stays short. A node with many
    neighbours, as the middle of a star is, is joined where its edges lie (see `join_totals`). Null
    ends are left out; self-edges only name a node. The work ends when all components are stars, or,
    where nodes are whole numbers, when no more than ``at_once`` edges are left: one task settles those,
    as a round has a dozen jobs however few edges it has.
    """
    given = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    given = materialize(given.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    nodes = given.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    numbers = isinstance(given.schema["low"].dataType, IntegralType) and given.schema["low"].dataType == given.schema["high"].dataType
    if numbers and given.count() <= at_once:
        return _settled(given)
    now = given.where("low <> high")
    for _ in range(max_rounds):
        size, unsettled = _state(now)
        if not unsettled:
            break
        if numbers and size <= at_once:
            now = _settled(now).select(F.col("component").alias("low"), F.col("node").alias("high")).where("low <> high")
            break
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(now.select(F.col("high").alias("u"), F.col("low").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_totals(both, least, "u", "n", 2 * size).where("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low <> high").distinct()
        down = large.select(F.col("high").alias("u"), F.col("low").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_totals(down, least, "u", "n", 2 * size).select("m", F.explode(F.array("u", "v")).alias("high")).where("m <> high")
        now = materialize(small.select(F.col("m").alias("low"), "high").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("high").agg(F.min("low").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["high"], "left").select("node", F.coalesce("component", "node").alias("component"))


def _settled(edges: DataFrame) -> DataFrame:
    """node, component of every node of few edges of whole numbers, in a written table."""
    kind = edges.schema["low"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if held:
            low, high = (np.concatenate(x) for x in zip(*held))
            nodes, component = lowest_of_component(low, high)
            yield pa.record_batch([pa.array(nodes), pa.array(component)], names=["node", "component"])

    return materialize(edges.select("low", "high").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"), "settled")


def lowest_of_component(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and of each the lowest of its component.

    A label is a node of the same component, never a higher one. Each edge hands the lower label of
    its ends to the other's label, then labels are followed to their ends; every pass merges trees.
    """
    nodes, at = np.unique(np.concatenate([low, high]), return_inverse=True)
    a, b = at[: len(low)], at[len(low) :]
    label = np.arange(len(nodes))
    while not np.array_equal(la := label[a], lb := label[b]):
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while not np.array_equal(up := label[label], label):
            label = up
    return nodes, nodes[label]


def _state(edges: DataFrame) -> tuple[int, int]:
    """Edges, and nodes that are no middle and no end of a star: with two lower neighbours, or with both lower and higher ones."""
    ends = edges.select(F.col("low").alias("u"), F.lit(0).alias("up")).unionByName(edges.select(F.col("high").alias("u"), F.lit(1).alias("up")))
    by_node = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return tuple(by_node.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("n") > F.col("ups")))).first())
