"""Attachments: digests, canonical files, collisions of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chorale.operators.parsing import NO_MEDIA


def canonical_by_digest(files: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """hash, canonical path: of files with one digest, the last path in order."""
    return files.groupBy(digest).agg(F.max(path).alias("canonical"))


def collisions(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """name, n_hashes of names that stand for several digests or one."""
    return rows.where(F.col(digest).isNotNull()).groupBy(name).agg(F.countDistinct(digest).alias("n_hashes"))


def rename_collisions(rows: DataFrame, partition: str, name: str, digest: str) -> DataFrame:
    """Adds new_name: where a name stands for several digests, a number before its last dot.

    Numbers run over the colliding digests of a partition, in the order of the digests.
    """
    several = collisions(rows, name, digest).where("n_hashes > 1").select(name)
    hit = rows.join(several, name, "left_semi").select(partition, name, digest).distinct()
    hit = hit.withColumn("k", F.dense_rank().over(W.partitionBy(partition).orderBy(digest)))
    out = rows.join(hit, [partition, name, digest], "left")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return out.withColumn("new_name", F.when(F.col("k").isNotNull(), F.concat(stem, F.lit("_"), F.col("k").cast("string"), suffix)).otherwise(F.col(name))).drop("k")


def included_directories(chats: DataFrame) -> DataFrame:
    """parent: the archive itself or the folder of the text, of every chat that is loaded."""
    parent = F.when(F.col("file").endswith(".zip"), F.col("file")).otherwise(F.regexp_replace("file", r"/[^/]*$", ""))
    return chats.where("load").select(parent.alias("parent")).distinct()


def file_table(files: DataFrame, directories: DataFrame, canonical: DataFrame) -> DataFrame:
    """path_self, parent, hash, path_other, chosen_location, external_location.

    All places, anywhere, of digests that occur in an included directory, each with the chosen path
    of its digest. ``files`` has path, parent and hash; ``canonical`` hash and canonical.
    """
    inside = directories.select(F.col("parent").alias("_inside")).where("_inside is not null").distinct()
    placed = files.join(inside, files["parent"] == inside["_inside"], "left")
    wanted = placed.where("_inside is not null").select("hash").distinct()
    found = placed.join(wanted, "hash", "left_semi").join(canonical, "hash")
    return found.select(F.col("path").alias("path_self"), "parent", "hash", F.col("canonical").alias("path_other"), (F.col("path") == F.col("canonical")).alias("chosen_location"), F.col("_inside").isNull().alias("external_location"))


def anonymous_names(files: DataFrame, partition: str, path: str = "path", prefix: str = "bijlage") -> DataFrame:
    """partition, path, new_name: ``bijlage_i.ext``, numbered by path within the partition."""
    known = files.select(partition, path).where(F.col(path).isNotNull()).distinct()
    i = F.row_number().over(W.partitionBy(partition).orderBy(path))
    return known.withColumn("new_name", F.concat(F.lit(f"{prefix}_"), i.cast("string"), F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def canonical_attachments(messages: DataFrame, digests: DataFrame) -> DataFrame:
    """``messages`` with one path for all copies of a file, and hash and media_to.

    ``digests`` has path and hash; the last path of a digest stands for all. A message with an
    attachment becomes ``<bijgevoegd: NAME>``, one whose attachment was left out the sentinel. Where
    one such message of a conversation stands for files of several digests, each gets a number before
    the last dot of its name, in the order of the digests, and media_to is its path under that name;
    else media_to is empty. hash is null without a digest.
    """
    known = digests.groupBy(F.col("path").alias("_path")).agg(F.max("hash").alias("hash"))
    chosen = canonical_by_digest(digests).select(F.col("hash").alias("_hash"), F.col("canonical").alias("_canonical"))
    real = ~F.col("media").isin("", NO_MEDIA) & F.col("media").isNotNull()
    out = messages.join(known, messages["media"] == known["_path"], "left").join(chosen, F.col("hash") == F.col("_hash"), "left")
    out = out.withColumn("media", F.when(real, F.coalesce("_canonical", "media")).otherwise(F.col("media"))).drop("_path", "_hash", "_canonical")
    name = F.regexp_replace("media", r"^.*[/\\\\]", "")
    told = lambda n: F.concat(F.lit("<bijgevoegd: "), n, F.lit(">"))
    out = out.withColumn("message", F.when(real, told(name)).when(F.col("media") == NO_MEDIA, NO_MEDIA).otherwise(F.col("message")))
    several = out.where(real & F.col("hash").isNotNull()).select("conversation_id", "message", "hash").distinct()
    several = several.withColumn("_n", F.count("*").over(W.partitionBy("conversation_id", "message"))).where("_n > 1")
    several = several.withColumn("_k", F.dense_rank().over(W.partitionBy("conversation_id").orderBy("hash")).cast("string")).drop("_n")
    out = out.join(several, ["conversation_id", "message", "hash"], "left")
    renamed = F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.col("_k"), F.regexp_extract(name, r"(\.[^.]*)$", 1))
    hit = F.col("_k").isNotNull()
    out = out.withColumn("media_to", F.when(hit, F.concat(F.regexp_extract("media", r"^(.*[/\\\\])", 1), renamed)).otherwise(""))
    return out.withColumn("message", F.when(hit, told(renamed)).otherwise(F.col("message"))).drop("_k")
