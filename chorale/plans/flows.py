"""The whole run: labels, announcements, attachments, alignment, order, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.operators import align, announcements, grouping, identity, media, order

MERGED = ["conversation_id", "position", "date", "sender", "message", "media", "sources", "unknown_order", "media_to", "hash"]


def resolve(messages: DataFrame, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Contacts (conversation_id, canonical, data_holder, label) and phone book (conversation_id, number, name) of messages.

    Labels meet by what they say and by the announcements that name them.
    """
    told = announcements.extract(messages.where(F.col("sender") == ""))
    contacts = grouping.contact_table(grouping.author_groups(messages, announcements.label_groups(told)), manual)
    return contacts, _books(contacts)


def _books(contacts: DataFrame) -> DataFrame:
    number = F.replace(F.col("label"), F.lit(" "), F.lit(""))
    rows = contacts.select("conversation_id", number.alias("number"), F.col("canonical").alias("name"))
    return rows.where(F.col("number").rlike(r"^\+*\d+\+*$")).groupBy("conversation_id", "number").agg(F.min("name").alias("name"))


def normalise(messages: DataFrame, contacts: DataFrame, book: DataFrame) -> DataFrame:
    """``messages`` with canonical senders, and announcements as canonical sentences of canonical names.

    ``contacts`` and ``book`` may have a conversation_id; then a label counts in its conversation only.
    """
    told = announcements.extract(messages, sender="sender")
    for column in ("sender", "admin", "name"):
        told = identity.apply_labels(told, contacts, book, column)
    message = F.coalesce(announcements.canonical(), F.col("message"))
    return told.withColumn("message", message).select(*messages.columns)


def reconcile(
    messages: DataFrame,
    contacts: DataFrame,
    book: DataFrame,
    digests: DataFrame | None = None,
    chats: DataFrame | None = None,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """One ordered, attributed table of the exports of all conversations.

    ``messages`` has conversation_id, date, sender, message, media, data_holder and original_order;
    ``chats`` conversation_id, data_holder and the window of an export (start, end; null is open).
    Windows of exports apply before alignment; what a row shows is looked up among all messages; the
    conversation's window (after ``start``, up to and with ``end``) comes last, so it drops rows but
    changes no order. A conversation without rows in its windows has none in the result.
    """
    rows = normalise(messages, contacts, book)
    if digests is None:
        rows = rows.withColumn("media_to", F.lit("")).withColumn("hash", F.lit(None).cast("string"))
    else:
        rows = media.canonical_attachments(rows, digests)
    rows = rows.withColumn("message_media", align.message_media(F.col("media"), F.col("message")))
    inside = rows
    if chats is not None:
        windows = chats.groupBy("conversation_id", "data_holder").agg(F.min("start").alias("_start"), F.max("end").alias("_end"))
        inside = align.file_window(rows.join(windows, ["conversation_id", "data_holder"], "left"), F.col("_start"), F.col("_end"))
    ordered = order.order_rows(align.align(inside))
    merged = align.first_match(ordered, rows, ["message", "media", "media_to", "hash"])
    none = F.lit(None).cast("timestamp_ntz")
    return align.conversation_window(merged, none if start is None else start, none if end is None else end).select(*MERGED)
