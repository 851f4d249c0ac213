"""Which exports are of one conversation, and which labels are one contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.operators import identity, mapping, overlap
from chorale.operators.graph import connected_components
from chorale.operators.parsing import DELETED, OMITTED


def eligible_for_chats(min_length: int = 30) -> Column:
    """Texts that tell conversations apart: of a sender, no attachment, neither deleted nor left out, long enough."""
    return ~F.col("message").isin(DELETED + OMITTED) & (F.col("media") == "") & (F.col("sender") != "") & (F.length("message") >= min_length)


def eligible_for_authors(min_length: int = 10) -> Column:
    """Texts that tell authors apart: of a sender, no attachment, not deleted, long enough."""
    return ~F.col("message").isin(DELETED) & (F.col("media") == "") & (F.col("sender") != "") & (F.length("message") >= min_length)


def chat_groups(messages: DataFrame, threshold: float = 0.1, min_length: int = 30, by_minute: bool = True) -> DataFrame:
    """file, component: exports that share over ``threshold`` of the smaller one's texts, each with its minute.

    Every file of ``messages`` is in a group, alone if it must; a component is its lowest file.
    """
    text = F.concat(F.date_format("date", "dd-MM-yyyy HH:mm"), F.col("message")) if by_minute else F.col("message")
    elements = messages.where(eligible_for_chats(min_length)).select("file", text.alias("element"))
    alone = messages.select(F.col("file").alias("src"), F.col("file").alias("dst")).distinct()
    edges = overlap.links(elements, "file", "element", threshold).unionByName(alone)
    return connected_components(edges).select(F.col("node").alias("file"), "component")


def author_groups(messages: DataFrame, groups: DataFrame | None = None, threshold: float = 0.5, min_length: int = 10) -> DataFrame:
    """conversation_id, data_holder, label, component: labels that say the same, or stand together in ``groups``.

    Labels of one conversation are linked if they share over ``threshold`` of the smaller one's texts.
    ``groups`` (conversation_id, group_id, data_holder, label), such as `announcements.label_groups`
    gives, adds labels that stand for one person. Every sender is in a group, alone if it must.
    """
    label = F.struct("conversation_id", "data_holder", F.col("sender").alias("label"))
    said = messages.where(eligible_for_authors(min_length)).select(label.alias("label"), F.struct("conversation_id", "message").alias("element"))
    alone = messages.where(F.col("sender") != "").select(label.alias("src"), label.alias("dst")).distinct()
    edges = overlap.links(said, "label", "element", threshold).unionByName(alone)
    if groups is not None:
        member = F.struct("conversation_id", "data_holder", "label")
        edges = edges.unionByName(mapping.star_edges(groups.select("group_id", member.alias("member"))))
    return connected_components(edges).select("node.conversation_id", "node.data_holder", "node.label", F.to_json("component").alias("component"))


def contact_table(members: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """conversation_id, canonical, data_holder, label of ``members`` (see `author_groups`); groups of one name are one contact."""
    return identity.contacts(members, identity.canonical_names(members, manual=manual))
