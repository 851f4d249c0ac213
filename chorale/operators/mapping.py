"""Groups of members: merging with groups known before, holder renames, the inverse lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.operators.graph import connected_components


def star_edges(groups: DataFrame, group: str = "group_id", member: str = "member") -> DataFrame:
    """src, dst: every member with the lowest of its group; a single member is an edge to itself.

    The components are those of all pairs of a group, at the cost of a row a member. Null members
    and null groups are left out.
    """
    known = groups.select(F.col(group).alias("g"), F.col(member).alias("dst")).where("g is not null and dst is not null")
    lowest = known.groupBy("g").agg(F.min("dst").alias("src"))
    return known.join(lowest, "g").select("src", "dst").distinct()


def merge_groups(known: DataFrame, found: DataFrame, group: str = "group_id", member: str = "member") -> DataFrame:
    """member, component of the groups known before and the new ones; those that share a member become one."""
    edges = star_edges(known, group, member).unionByName(star_edges(found, group, member))
    return connected_components(edges.distinct()).select(F.col("node").alias(member), "component")


def rename_holders(labels: DataFrame, renames: DataFrame, holder: str = "data_holder") -> DataFrame:
    """``holder`` becomes new_name where ``renames`` (old_name, new_name) has it; of several new names the first in order."""
    r = renames.groupBy(F.col("old_name").alias("_old")).agg(F.min("new_name").alias("_new"))
    return labels.join(r, labels[holder] == r["_old"], "left").withColumn(holder, F.coalesce("_new", holder)).drop("_old", "_new")


def inverse(mapping: DataFrame) -> DataFrame:
    """data_holder, label, canonical of ``mapping`` (canonical, members: structs of holder and label).

    A label that stands under several names gets the one that sorts first.
    """
    flat = mapping.select("canonical", F.explode("members").alias("m")).select("m.*", "canonical")
    return flat.groupBy("data_holder", "label").agg(F.min("canonical").alias("canonical"))
