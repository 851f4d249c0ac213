"""Writes merged conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered() -> Column:
    """``dd-MM-yyyy HH:mm - [sender: ]message``."""
    who = F.when(F.col("sender") != "", F.concat("sender", F.lit(": "))).otherwise("")
    return F.concat(F.date_format("date", "dd-MM-yyyy HH:mm"), F.lit(" - "), who, F.coalesce("message", F.lit("")))


def write_text(merged: DataFrame, path: str, position: str = "position") -> None:
    """A folder of text lines for each conversation, in order; conversations are written in parallel."""
    lines = merged.repartition("conversation_id").sortWithinPartitions("conversation_id", position)
    lines.select("conversation_id", rendered().alias("value")).write.mode("overwrite").partitionBy("conversation_id").text(path)


def write_csv(merged: DataFrame, path: str) -> None:
    merged.write.mode("overwrite").csv(path, header=True)
