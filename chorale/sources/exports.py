"""Reads exported chats and digests of files; any path that Spark's readers reach will do."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def read_exports(spark: SparkSession, root: str) -> DataFrame:
    """file, body, error of every .txt and .zip below ``root``; a zip's body is its first .txt member.

    Archives of other messengers (``iMessage`` in the path) are no exports and give no row. A file
    that cannot be read has an error and no body.
    """
    return _read(_files(spark, root, "*.{txt,zip}"))


def read_listed(spark: SparkSession, chats: DataFrame) -> DataFrame:
    """file, body, error of the chats (file, load) that are to be loaded; a null ``load`` counts as yes.

    Only these files are opened. A doubled ``.zip.zip`` stands for the archive itself and keeps its
    name; a file that is not there has an error. The list is a configuration, so the driver holds it.
    """
    wanted = chats.where(F.coalesce("load", F.lit(True))).select("file", archive(F.col("file")).alias("path")).distinct()
    paths = sorted({r["path"] for r in wanted.collect()})
    if not paths:
        return spark.createDataFrame([], "file string, body string, error string")
    listed = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    there = [p for p in paths if _exists(spark, p)]
    found = _read(listed.load(there)) if there else spark.createDataFrame([], "file string, body string, error string")
    plain = found.withColumn("path", F.regexp_replace("file", "^file:(//)?(?=/)", "")).drop("file")
    read = wanted.join(plain, "path", "left")
    lost = F.when(F.col("body").isNull() & F.col("error").isNull(), "no such file").otherwise(F.col("error"))
    return read.select("file", "body", lost.alias("error"))


def archive(file: Column) -> Column:
    """The archive that a doubled ending names; other paths as they are."""
    return F.when(file.endswith(".zip.zip"), F.concat(F.substring_index(file, ".zip", 1), F.lit(".zip"))).otherwise(file)


def is_export(file: Column) -> Column:
    """Texts, and archives that are not another messenger's."""
    return file.endswith(".txt") | file.endswith(".zip") & ~file.contains("iMessage")


def unread(chats: DataFrame, read: DataFrame) -> DataFrame:
    """Chats that ``read`` does not have with the same file and datetime_format."""
    return chats.join(read.select("file", "datetime_format").distinct(), ["file", "datetime_format"], "left_anti")


def errors(read: DataFrame) -> DataFrame:
    """file, error of what could not be read, for the error report."""
    return read.where("error is not null").select("file", "error")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    if path.endswith(".zip"):
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            names = [n for n in z.namelist() if n.endswith(".txt")]
                            if not names:
                                raise ValueError("no text in the archive")
                            content = z.read(names[0])
                    rows.append((path, content.decode("utf-8"), None))
                except (ValueError, zipfile.BadZipFile) as e:
                    rows.append((path, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "body", "error"])

    return files.where(is_export(F.col("path"))).select("path", "content").mapInPandas(run, "file string, body string, error string")


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """path, parent, hash of every file, and of the members of archives that hold a text."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                rows.append((path, path.rsplit("/", 1)[0], hashlib.sha256(content).hexdigest()))
                if path.endswith(".zip") and zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = z.namelist()
                        if any(n.endswith(".txt") for n in names):
                            rows += [(f"{path}/{n}", path, hashlib.sha256(z.read(n)).hexdigest()) for n in names if not n.endswith((".txt", ".zip", "/"))]
            yield pd.DataFrame(rows, columns=["path", "parent", "hash"])

    return _files(spark, root, "*").select("path", "content").mapInPandas(members, "path string, parent string, hash string")


def new_digests(known: DataFrame, found: DataFrame) -> DataFrame:
    """Digests of paths that are not known yet."""
    return found.join(known.select("path"), "path", "left_anti")


def data_holder(path: Column) -> Column:
    """The folder of an archive, else the folder above a text's folder."""
    parts = F.split(path, "/")
    return F.when(path.endswith(".zip"), F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(-3)))
