"""Alignment of several exports of one conversation, windows and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["conversation_id", "date", "sender", "message_media"]


def message_media(media: Column, message: Column) -> Column:
    """The media if there is one, else the message; null if both are empty."""
    return F.coalesce(F.nullif(media, F.lit("")), F.nullif(message, F.lit("")))


def align(messages: DataFrame) -> DataFrame:
    """One row for each (conversation_id, date, sender, message_media), nulls equal, with the orders of its holders.

    A chain of full outer joins that keeps the first row of a key after each step has the same
    result as this one aggregate; rows with equal keys in one export collapse to their first.
    ``orders`` maps a holder to its order, ``sources`` names the holders in order.
    """
    first = messages.groupBy(*KEY, "data_holder").agg(F.min("original_order").alias("first_order"))
    pairs = F.array_sort(F.collect_list(F.struct("data_holder", "first_order")))
    out = first.groupBy(*KEY).agg(pairs.alias("pairs"))
    return out.select(*KEY, F.map_from_entries("pairs").alias("orders"), F.array_join(F.transform("pairs", lambda x: x["data_holder"]), ",").alias("sources"))


def first_match(aligned: DataFrame, messages: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``columns`` of the first source row with the same message_media; one row a key before the join."""
    first = F.min_by(F.struct(*columns), F.struct("data_holder", "original_order")).alias("first")
    right = messages.groupBy("conversation_id", "message_media").agg(first)
    right = right.select(F.col("conversation_id").alias("c"), F.col("message_media").alias("mm"), *[F.col(f"first.{c}").alias(c) for c in columns])
    on = (aligned["conversation_id"] == right["c"]) & aligned["message_media"].eqNullSafe(right["mm"])
    return aligned.join(right, on, "left").drop("c", "mm")


def file_window(messages: DataFrame, start: Column, end: Column) -> DataFrame:
    """Strictly between start and end; null bounds are open."""
    return messages.where((start.isNull() | (F.col("date") > start)) & (end.isNull() | (F.col("date") < end)))


def conversation_window(merged: DataFrame, start: Column, end: Column) -> DataFrame:
    """After start, up to and with end; null bounds are open."""
    return merged.where((start.isNull() | (F.col("date") > start)) & (end.isNull() | (F.col("date") <= end)))


def order_flags(ordered: DataFrame, partition: list[str], position: str, order: str) -> DataFrame:
    """Whether a row's order number falls against its neighbours' or is not unique, and either."""
    w = W.partitionBy(*partition).orderBy(position)
    back = F.coalesce(F.col(order) - F.lag(order).over(w), F.lit(0)) < 0
    ahead = F.coalesce(F.col(order) - F.lead(order).over(w), F.lit(0)) > 0
    same = F.count("*").over(W.partitionBy(*partition, order)) > 1
    return ordered.withColumn("any_out_of_order", back | ahead).withColumn("no_unique_order", same).withColumn("unknown_order", F.col("any_out_of_order") | F.col("no_unique_order"))


def row_mode(orders: Column) -> Column:
    """Most frequent non-null element of an array; among equals the one seen first."""
    present = F.filter(orders, lambda x: x.isNotNull())
    tally = F.transform(F.array_distinct(present), lambda v: F.struct((-F.size(F.filter(present, lambda x: x == v))).alias("n"), F.array_position(present, v).alias("at"), v.alias("v")))
    return F.array_min(tally)["v"]
