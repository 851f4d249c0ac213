"""From raw export text to messages: dialect, dates, segments, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A date and time in an export, and the marks of attachments and omissions.
DATETIME = r"(\d{1,4})([-/])(\d{1,2})[-/](\d{1,4})(,?\s?)(\d{1,2}):(\d{1,2}):?(\d{0,2})\s?(PM|AM)?"
ATTACHED = r"(?dm)<bijgevoegd: (.*\.[a-zA-Z\d]{1,5})>|^(.*) \(file attached\)|^(.*) \(bestand bijgevoegd\)|<Media omitted>|<Media weggelaten>"
DELETED = ["U hebt dit bericht verwijderd.", "Dit bericht is verwijderd.", "Dit bericht is verwijderd", "You deleted this message", "This message was deleted", "Gemist spraakgesprek"]
OMITTED = ["<Media weggelaten>", "<Media omitted>", "afbeelding weggelaten", "video weggelaten"]
NO_MEDIA = "<Media weggelaten>"
INVISIBLE = "[‎‪ ‬﻿]"


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def phone_os(first_line: Column) -> Column:
    """iphone: starts with a bracket; android: starts with a digit and has a dash in its first 18 characters."""
    return F.when(first_line.startswith("["), "iphone").when(F.substring(first_line, 1, 18).contains("-") & first_line.rlike(r"^\d"), "android").otherwise("unknown")


def lines(files: DataFrame) -> DataFrame:
    """file, pos, line of whole texts (file, body): line ends made equal, invisible marks removed, leading blank lines dropped."""
    body = F.regexp_replace(F.regexp_replace("body", "\r\n?", "\n"), INVISIBLE, "")
    body = F.regexp_replace(body, r"^(?:[ \t]*\n)+", "")
    return files.select("file", F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))


def token(os: Column, line: Column) -> Column:
    """The text before a line's content that may be a date; null where there is none."""
    android = F.when(line.contains(" - "), F.substring_index(line, " - ", 1))
    iphone = F.nullif(F.regexp_extract(line, r"^\[([^\]]*)\]", 1), F.lit(""))
    return F.when(os == "iphone", iphone).otherwise(android)


def rest(os: Column, line: Column) -> Column:
    iphone = F.regexp_replace(line, r"^\[[^\]]*\] ?", "")
    return F.when(os == "iphone", iphone).otherwise(F.expr("substring(line, instr(line, ' - ') + 3)"))


def infer_formats(lined: DataFrame) -> DataFrame:
    """file, phone_os, datetime_format (a Java pattern), datetime_certain from all dated lines of each file.

    A part of four digits is the year, one over 12 no month, one over 31 no day. Where the order of
    day and month stays open, the part with as many or more distinct values is the day, and the
    format is not certain.
    """
    first = lined.groupBy("file").agg(phone_os(F.min_by("line", "pos")).alias("phone_os"))
    tokens = lined.join(first, "file").select("file", "phone_os", "pos", token(F.col("phone_os"), F.col("line")).alias("t"))
    part = lambda k: F.regexp_extract("t", f"^{DATETIME}$", k)
    parts = tokens.where(F.col("t").rlike(f"^{DATETIME}$")).select("file", "phone_os", "pos", *[part(k).alias(f"p{k}") for k in (1, 2, 3, 4, 5, 8, 9)])
    number = lambda k: F.max(F.col(f"p{k}").cast("int"))
    s = parts.groupBy("file", "phone_os").agg(
        number(1).alias("m1"), number(3).alias("m3"), number(4).alias("m4"),
        F.max(F.length("p1")).alias("l1"), F.max(F.length("p4")).alias("l4"),
        F.countDistinct("p1").alias("n1"), F.countDistinct("p3").alias("n3"),
        F.min_by("p2", "pos").alias("sep"), F.min_by("p5", "pos").alias("gap"), F.max(F.length("p8")).alias("seconds"), F.max(F.length("p9")).alias("half"),
    )
    year_first = (F.col("l1") == 4) | (F.col("m1") > 31)
    day_first = F.when(F.col("m1") > 12, True).when(F.col("m3") > 12, False).otherwise(F.col("n1") >= F.col("n3"))
    certain = year_first | (F.col("m1") > 12) | (F.col("m3") > 12)
    year = F.when(F.col("l4") == 4, "yyyy").otherwise("yy")
    date = F.when(year_first, F.concat_ws("", F.lit("yyyy"), "sep", F.lit("M"), "sep", F.lit("d"))).when(
        day_first, F.concat_ws("", F.lit("d"), "sep", F.lit("M"), "sep", year)
    ).otherwise(F.concat_ws("", F.lit("M"), "sep", F.lit("d"), "sep", year))
    time = F.concat(F.when(F.col("half") > 0, "h:m").otherwise("H:m"), F.when(F.col("seconds") > 0, ":s").otherwise(""), F.when(F.col("half") > 0, " a").otherwise(""))
    found = s.select("file", F.concat(date, "gap", time).alias("datetime_format"), certain.alias("datetime_certain"))
    return first.join(found, "file", "left")


def parse_date(t: Column, pattern: Column) -> Column:
    """Minute of a date token, null where it does not follow the pattern."""
    return F.date_trunc("minute", F.try_to_timestamp(t, pattern)).cast("timestamp_ntz")


def media(message: Column, file: Column) -> Column:
    """Path of the first attachment that a message names, the omission mark, or nothing.

    What stands before ``(file attached)`` is sought from the front of its line only, so a message is
    read once, however long it is.
    """
    named = strip(F.concat(*[F.regexp_extract(message, ATTACHED, k) for k in (1, 2, 3)]))
    folder = F.when(file.endswith(".zip"), file).otherwise(F.regexp_replace(file, r"/[^/]*$", ""))
    return F.when(named != "", F.concat_ws("/", folder, named)).when(message.rlike(ATTACHED), NO_MEDIA).otherwise("")


def messages(lined: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages of exports whose format is known: a dated line opens one, undated lines go on.

    A dated line without a colon is an announcement, with an empty sender; undated lines after it
    become one more message with the sender and date of the user message before. Messages that
    speak of end-to-end encryption are dropped; their order numbers stay used.
    """
    os, line = F.col("phone_os"), F.col("line")
    dated = lined.join(chats.select("file", "phone_os", "datetime_format", "data_holder"), "file")
    dated = dated.withColumn("date", parse_date(token(os, line), F.col("datetime_format")))
    w = W.partitionBy("file").orderBy("pos")
    dated = dated.withColumn("rest", F.when(F.col("date").isNotNull(), rest(os, line)))
    dated = dated.withColumn("is_user", F.col("date").isNotNull() & F.col("rest").contains(":"))
    dated = dated.withColumn("is_note", F.col("date").isNotNull() & ~F.col("rest").contains(":"))
    dated = dated.withColumn("undated_after_note", F.col("date").isNull() & F.lag("is_note").over(w))
    opens = F.col("date").isNotNull() | F.coalesce("undated_after_note", F.lit(False))
    dated = dated.withColumn("segment", F.sum(opens.cast("int")).over(w))
    dated = dated.withColumn("user", F.last(F.when(F.col("is_user"), F.struct("date", F.substring_index("rest", ":", 1).alias("sender"))), ignorenulls=True).over(w))
    body = F.when(F.col("is_user"), F.expr("substring(rest, instr(rest, ':') + 1)")).when(F.col("is_note"), F.col("rest")).otherwise(line)
    grouped = dated.where("segment > 0").groupBy("file", "data_holder", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", body.alias("b")))), lambda x: x["b"]), "\n").alias("message"),
        F.min_by(F.struct("is_note", "user", "date"), "pos").alias("h"),
    )
    note = F.col("h.is_note")
    out = grouped.select(
        "file", "data_holder",
        F.coalesce(F.col("h.date"), F.col("h.user.date")).alias("date"),
        F.when(note, "").otherwise(strip(F.coalesce(F.col("h.user.sender"), F.lit("")))).alias("sender"),
        strip(F.col("message")).alias("message"),
        (F.row_number().over(W.partitionBy("file").orderBy("segment")) - 1).cast("long").alias("original_order"),
        note.alias("note"),
    )
    out = out.where(~F.col("message").contains("end-to-end"))
    return out.withColumn("media", F.when(F.col("note"), "").otherwise(media(F.col("message"), F.col("file")))).drop("note")
