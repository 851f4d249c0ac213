"""A conversation's configuration: JSON files and the small tables made from them."""

from __future__ import annotations

import json
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chorale.functions.names import slugs

#: The fields of a file's entry, and how days are written.
FILE_FIELDS = "phone_os string, datetime_format string, datetime_certain boolean, example_date_1 string, example_date_2 string, start_date string, end_date string, load boolean, data_holder string"
DAY = "%d-%m-%Y"


def load_config(path: str) -> dict[str, Any] | None:
    """The configuration with contact lists as sets of tuples; None if ``path`` is no .json."""
    if not path.endswith(".json"):
        return None
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    if "mapping" in config:
        config["mapping"] = {name: {tuple(m) for m in members} for name, members in config["mapping"].items()}
    return config


def save_config(config: dict[str, Any], path: str) -> None:
    """Dates as dd-mm-yyyy, sets as sorted lists."""

    def plain(value):
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, (set, frozenset)):
            return sorted(plain(v) for v in value)
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        return value.strftime(DAY) if isinstance(value, (date, datetime)) else value

    Path(path).write_text(json.dumps(plain(config), indent=4), encoding="utf-8")


def tables(spark: SparkSession, config: dict[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chats (file and its fields), contacts (canonical, data_holder, label) and phone book (number, name).

    Members without a label are left out; absent parts give empty tables.
    """
    names = [f.split()[0] for f in FILE_FIELDS.split(", ")]
    chats = [(file, *[entry.get(n) for n in names]) for file, entry in config.get("files", {}).items()]
    contacts = [(name, *m) for name, members in config.get("mapping", {}).items() for m in members if len(m) == 2]
    book = list(config.get("phone_book", {}).items())
    return (
        spark.createDataFrame(chats, f"file string, {FILE_FIELDS}"),
        spark.createDataFrame(contacts, "canonical string, data_holder string, label string"),
        spark.createDataFrame(book, "number string, name string"),
    )


def chat_entries(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Adds start_date and end_date (the day after the last message) to each chat; null without messages."""
    spans = messages.groupBy("file").agg(F.to_date(F.min("date")).alias("low"), F.date_add(F.to_date(F.max("date")), 1).alias("high"))
    day = lambda c: F.date_format(c, "dd-MM-yyyy")
    return chats.join(spans, "file", "left").withColumn("start_date", day("low")).withColumn("end_date", day("high")).drop("low", "high")


def conversation_id(chats: DataFrame) -> DataFrame:
    """Adds id: four characters made from the lowest file of a chat's component, so runs agree."""
    lowest = chats.groupBy("component").agg(F.substring(F.sha2(F.min("file"), 256), 1, 4).alias("id"))
    return chats.join(lowest, "component")


def build_config(name: str, entries: DataFrame) -> dict[str, Any]:
    """The configuration of one conversation; its chats, a row a file, are read by the driver."""
    known = [f.split()[0] for f in FILE_FIELDS.split(", ") if f.split()[0] in entries.columns]
    rows = entries.select("file", *known).orderBy("file").collect()
    return {"conversation_name": name, "files": {r["file"]: {n: r[n] for n in known} for r in rows}}


def labelled_chats(files: DataFrame) -> DataFrame:
    """``files`` (file) with a data_holder ``Chat 000``, ``Chat 001`` and so on, by path, and load."""
    k = F.row_number().over(W.orderBy("file")) - 1  # a folder's exports, which a person has to go through
    return files.select("file", F.format_string("Chat %03d", k).alias("data_holder"), F.lit(True).alias("load"))


def conversation_configs(chats: DataFrame, contacts: DataFrame, book: DataFrame, names: DataFrame) -> DataFrame:
    """conversation_id, file_name, config: the configuration of every conversation as JSON, made where its rows are.

    ``chats`` has conversation_id, file and the fields of a file's entry; ``contacts``
    conversation_id, canonical, data_holder, label; ``book`` conversation_id, number, name; ``names``
    conversation_id, topic, name. The file's name is a slug of the id and the topic.
    """
    fields = [c for c in chats.columns if c not in ("conversation_id", "file")]
    files = chats.groupBy("conversation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", F.struct(*fields))))).alias("files"))
    members = contacts.groupBy("conversation_id", "canonical").agg(F.array_sort(F.collect_set(F.array("data_holder", "label"))).alias("m"))
    members = members.groupBy("conversation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical", "m")))).alias("mapping"))
    numbers = book.groupBy("conversation_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("number", "name")))).alias("phone_book"))
    every = names.join(files, "conversation_id", "left").join(members, "conversation_id", "left").join(numbers, "conversation_id", "left")
    config = F.struct(F.col("name").alias("conversation_name"), "files", "mapping", "phone_book")
    named = F.concat(slugs(F.concat_ws("_", F.lit("config"), F.col("conversation_id").cast("string"), "topic")), F.lit(".json"))
    return every.select("conversation_id", named.alias("file_name"), F.to_json(config).alias("config"))


def messages_to_json(messages: DataFrame) -> DataFrame:
    """file, messages: each export's parsed messages as JSON, dates to the second."""
    row = F.struct("original_order", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"), "sender", "message", "media")
    return messages.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("messages"))


def messages_from_json(stored: DataFrame) -> DataFrame:
    """The messages that `messages_to_json` wrote."""
    rows = F.from_json("messages", "array<struct<original_order:long,date:timestamp_ntz,sender:string,message:string,media:string>>", {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})
    return stored.select("file", F.explode(rows).alias("m")).select("file", "m.*")
