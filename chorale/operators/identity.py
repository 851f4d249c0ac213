"""Contacts: canonical names, phone book, label lookups, holder names and pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Name particles that are written in lower case.
PARTICLES = ["aan", "af", "bij", "de", "den", "der", "d'", "het", "'t", "in", "onder", "op", "over", "'s", "te", "ten", "ter", "tot", "uit", "uijt", "van", "ver", "voor"]


def name_weight(label: Column) -> Column:
    """Length without digits, plus signs and blanks."""
    return F.length(F.regexp_replace(label, r"[\d+\s]", ""))


def clean_name(label: Column) -> Column:
    """White space collapsed, particles in lower case."""
    words = F.split(F.regexp_replace(label, r"(?U)\s+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(PARTICLES), F.lower(w)).otherwise(w)), " ")


def canonical_names(members: DataFrame, group: str = "component", label: str = "label", manual: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """group, canonical: the cleaned label of the highest weight; among equals the one that sorts first.

    A label that is one of ``paths`` (path) weighs nothing. Where ``manual`` (Name_from, Name_to) has
    the cleaned name, the name it is to be given stands instead; of several the one that sorts first.
    """
    weight = name_weight(F.col(label))
    if paths is not None:
        known = paths.select(F.col("path").alias("_path")).distinct()
        members = members.join(known, members[label] == known["_path"], "left")
        weight = F.when(F.col("_path").isNotNull(), 0).otherwise(weight)
    best = F.min_by(F.col(label), F.struct(-weight, F.col(label)))
    names = members.groupBy(group).agg(best.alias("best")).select(group, clean_name(F.col("best")).alias("canonical"))
    if manual is None:
        return names
    to = manual.groupBy(F.col("Name_from").alias("_from")).agg(F.min("Name_to").alias("_to"))
    return names.join(to, names["canonical"] == to["_from"], "left").select(group, F.coalesce("_to", "canonical").alias("canonical"))


def contacts(members: DataFrame, names: DataFrame, group: str = "component") -> DataFrame:
    """``members`` with their group's canonical name instead of the group, so that groups of one name are one contact."""
    return members.join(names, group).drop(group).distinct()


def phone_book(members: DataFrame, canonical: str = "canonical", label: str = "label", order: str | None = None) -> DataFrame:
    """number, name for labels that are phone numbers once blanks go.

    Of a number's names the one of the lowest ``order`` wins, where contacts have an order, else the
    one that sorts first.
    """
    number = F.replace(F.col(label), F.lit(" "), F.lit(""))
    first = F.min("name") if order is None else F.min_by("name", F.struct("at", "name"))
    rows = members.select(number.alias("number"), F.col(canonical).alias("name"), (F.lit(0) if order is None else F.col(order)).alias("at"))
    return rows.where(F.col("number").rlike(r"^\+*\d+\+*$")).groupBy("number").agg(first.alias("name"))


def apply_labels(rows: DataFrame, contacts: DataFrame, book: DataFrame, column: str) -> DataFrame:
    """``column`` becomes the contact's canonical name, else the phone book's, else it stays.

    All labels are replaced at once, so replacements do not chain. Contacts and books that have a
    conversation_id count in that conversation only. Of several names of a label the one that sorts
    first counts.
    """
    here = lambda t: [F.col("conversation_id").alias("_c")] if "conversation_id" in t.columns else []
    within = lambda t, on: on & rows["conversation_id"].eqNullSafe(t["_c"]) if "_c" in t.columns else on
    key = [*(["_c"] if here(contacts) else []), "_holder", "_label"]
    c = contacts.select(*here(contacts), F.col("data_holder").alias("_holder"), F.col("label").alias("_label"), "canonical").groupBy(*key).agg(F.min("canonical").alias("_canonical"))
    b = book.select(*here(book), F.col("number").alias("_number"), "name")
    b = b.groupBy(*[x for x in b.columns if x != "name"]).agg(F.min("name").alias("_name"))
    out = rows.join(c, within(c, (rows["data_holder"] == c["_holder"]) & (rows[column] == c["_label"])), "left").drop(*key)
    out = out.join(b, within(b, F.replace(out[column], F.lit(" "), F.lit("")) == b["_number"]), "left")
    return out.withColumn(column, F.coalesce("_canonical", "_name", column)).drop("_canonical", "_c", "_number", "_name")


def holder_suffixes(chats: DataFrame, holder: str, order: str) -> DataFrame:
    """Adds unique_holder: a number after the name of a holder that has several chats."""
    w = W.partitionBy(holder)
    k = F.row_number().over(w.orderBy(order))
    return chats.withColumn("unique_holder", F.when(F.count("*").over(w) > 1, F.concat_ws(" ", holder, k.cast("string"))).otherwise(F.col(holder)))


def pseudonyms(rows: DataFrame, partition: str, sender: str, order: str, prefix: str = "Deelnemer") -> DataFrame:
    """partition, sender, pseudonym numbered by first appearance; the empty sender stays empty."""
    first = rows.where(F.col(sender) != "").groupBy(partition, sender).agg(F.min(order).alias("first"))
    k = F.dense_rank().over(W.partitionBy(partition).orderBy("first", sender))
    return first.select(partition, sender, F.concat_ws(" ", F.lit(prefix), k.cast("string")).alias("pseudonym"))


def participants(messages: DataFrame) -> DataFrame:
    """conversation_id, participant, pseudonym: holders are ``Functionaris n`` in order of name, other
    senders ``Deelnemer n`` by first appearance. The empty sender has no pseudonym."""
    holders = messages.select("conversation_id", F.col("data_holder").alias("participant")).where("participant is not null").distinct()
    n = F.row_number().over(W.partitionBy("conversation_id").orderBy("participant"))
    holders = holders.withColumn("pseudonym", F.concat(F.lit("Functionaris "), n.cast("string")))
    senders = messages.select("conversation_id", "date", "data_holder", "original_order", F.col("sender").alias("participant"))
    others = senders.join(holders.select("conversation_id", "participant"), ["conversation_id", "participant"], "left_anti")
    first = others.select("conversation_id", F.struct("date", "data_holder", "original_order").alias("at"), "participant")
    return holders.unionByName(pseudonyms(first, "conversation_id", "participant", "at").withColumnRenamed("sender", "participant"))


def anonymise(rows: DataFrame, people: DataFrame, chats: DataFrame, columns: tuple[str, ...] = ("data_holder", "sender")) -> DataFrame:
    """``rows`` with pseudonyms for people and neutral paths for media.

    A medium's base name becomes ``bijlage_i.ext``, numbered by path within a conversation; its folder
    becomes the pseudonym of the holder whose chat (conversation_id, file, data_holder) lies there,
    or ``Ander gesprek``; the sentinel of left-out media and empty paths stay. Names in announcements
    are replaced where they stand as whole words.
    """
    out = rows
    for c in columns:
        if c in rows.columns:
            known = people.select("conversation_id", F.col("participant").alias(c), F.col("pseudonym").alias("_p"))
            out = out.join(known, ["conversation_id", c], "left").withColumn(c, F.coalesce("_p", c)).drop("_p")
    if "message" in rows.columns:
        names = people.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct(F.length("participant").alias("n"), "participant", "pseudonym")), asc=False).alias("_names"))
        out = out.join(names, "conversation_id", "left")
        told = F.aggregate("_names", F.col("message"), lambda m, x: F.replace(m, x["participant"], x["pseudonym"]))
        out = out.withColumn("message", F.when((F.col("sender") == "") & F.col("_names").isNotNull(), told).otherwise(F.col("message"))).drop("_names")
    if "media" not in rows.columns:
        return out.select(*rows.columns)
    real = ~F.col("media").isin("", "<Media weggelaten>")
    files = out.where(real).select("conversation_id", "media").distinct()
    i = F.row_number().over(W.partitionBy("conversation_id").orderBy("media")).cast("string")
    files = files.select("*", F.concat(F.lit("bijlage_"), i, F.regexp_extract("media", r"(\.[^./\\]*)$", 1)).alias("_name"), F.regexp_replace("media", r"[/\\][^/\\]*$", "").alias("_folder"))
    folder = F.when(F.col("file").endswith(".zip"), F.col("file")).otherwise(F.regexp_replace("file", r"[/\\][^/\\]*$", ""))
    owners = chats.select("conversation_id", folder.alias("_folder"), F.col("data_holder").alias("participant")).join(people, ["conversation_id", "participant"])
    owners = owners.groupBy("conversation_id", "_folder").agg(F.min("pseudonym").alias("_owner"))
    files = files.join(owners, ["conversation_id", "_folder"], "left")
    files = files.select("conversation_id", "media", F.concat_ws("/", F.coalesce("_owner", F.lit("Ander gesprek")), "_name").alias("_to"))
    out = out.join(files, ["conversation_id", "media"], "left").withColumn("media", F.coalesce("_to", "media")).drop("_to")
    return out.select(*rows.columns)


def conversation_names(people: DataFrame, topics: DataFrame, prefix: str = "") -> DataFrame:
    """conversation_id, topic, name: two contacts give ``A - B``, else the latest topic counts; the name has the prefix.

    ``people`` has conversation_id and canonical, ``topics`` conversation_id and topic. A topic loses
    the prefix if it has it; without contacts and topic it is empty.
    """
    two = people.select("conversation_id", "canonical").distinct().groupBy("conversation_id").agg(F.sort_array(F.collect_list("canonical")).alias("names"))
    both = two.join(topics, "conversation_id", "full")
    bare = F.when(F.col("topic").startswith(prefix), F.expr(f"substring(topic, {len(prefix) + 1})")).otherwise(F.col("topic"))
    topic = F.when(F.size("names") == 2, F.array_join("names", " - ")).otherwise(F.coalesce(bare, F.lit("")))
    return both.select("conversation_id", topic.alias("topic")).withColumn("name", F.concat(F.lit(prefix), "topic"))
