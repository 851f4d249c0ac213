"""Numbers for the accountability report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holder_overview(messages: DataFrame) -> DataFrame:
    """Messages, texts, media, announcements, first and last date of each holder, in one pass."""
    media, note = F.col("media") != "", F.col("sender") == ""
    return messages.groupBy("data_holder").agg(
        F.count("*").alias("n_messages"),
        F.count_if(~media & ~note).alias("n_text"),
        F.count_if(media).alias("n_media"),
        F.count_if(note).alias("n_announcements"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def before_after(messages: DataFrame, kept) -> DataFrame:
    """Text and media counts of each holder, before and after a window."""
    media = F.col("media") != ""
    return messages.groupBy("data_holder").agg(
        F.count_if(media).alias("n_media_before"),
        F.count_if(~media).alias("n_text_before"),
        F.count_if(media & kept).alias("n_media_after"),
        F.count_if(~media & kept).alias("n_text_after"),
    )


def totals(messages: DataFrame, kept, *by: str) -> DataFrame:
    """Messages before and after a window, for each value of ``by`` or for all."""
    return messages.groupBy(*by).agg(F.count("*").alias("n_before"), F.count_if(kept).alias("n_after"))


def timeline(spans: DataFrame) -> DataFrame:
    """Adds the days before, in and after the selection of each holder.

    ``spans`` has first_date, start_selection, end_selection and last_date. Whole days, rounded
    down, so a negative part of a day counts as one; null where a date is.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    days = lambda a, b: F.floor((micros(b) - micros(a)) / 86_400_000_000).cast("long")
    return spans.select(
        "*",
        days("first_date", "start_selection").alias("pre_selection"),
        days("start_selection", "end_selection").alias("selection"),
        days("end_selection", "last_date").alias("post_selection"),
    )


def selection(overview: DataFrame, chats: DataFrame) -> DataFrame:
    """The overview of holders that have a chat in the configuration, with its window (start_selection, end_selection)."""
    windows = chats.groupBy("data_holder").agg(F.min("start_date").alias("start_selection"), F.max("end_date").alias("end_selection"))
    return overview.join(windows, "data_holder")


def statistics(before_after_: DataFrame, overview: DataFrame) -> DataFrame:
    """All numbers of each holder in one row; where both have one, the overview's counts."""
    shared = [c for c in before_after_.columns if c in overview.columns and c != "data_holder"]
    return before_after_.drop(*shared).join(overview, "data_holder", "full")


def attachments(merged: DataFrame, files: DataFrame) -> DataFrame:
    """day, name, places: for each attachment that merged messages show, all places of the file.

    ``files`` is a file table (path_self, path_other, chosen_location, external_location); files that
    no message shows have a null day and name.
    """
    shown = merged.where(~F.col("media").isin("", "<Media weggelaten>")).select(F.to_date("date").alias("day"), F.regexp_replace("media", r"^.*[/\\]", "").alias("name"), F.col("media").alias("path_other"))
    places = F.sort_array(F.collect_set(F.struct("path_self", "chosen_location", "external_location"))).alias("places")
    return files.join(shown.distinct(), "path_other", "left").groupBy("day", "name").agg(places)


def attachment_counts(merged: DataFrame, files: DataFrame) -> DataFrame:
    """n_original, n_merged: places inside the conversation's directories, and attachments shown from their chosen place."""
    shown = merged.where(~F.col("media").isin("", "<Media weggelaten>")).select(F.col("media").alias("path_other"))
    original = files.where(~F.col("external_location")).agg(F.countDistinct("path_self").alias("n_original"))
    chosen = files.where("chosen_location").join(shown, "path_other").agg(F.count("*").alias("n_merged"))
    return original.withColumn("k", F.lit(1)).join(chosen.withColumn("k", F.lit(1)), "k").drop("k")  # a row each


def media_after(before_after_: DataFrame) -> DataFrame:
    """n_media_after of all holders together."""
    return before_after_.agg(F.coalesce(F.sum("n_media_after"), F.lit(0)).alias("n_media_after"))
