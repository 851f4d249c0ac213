"""Copies the attachments of merged conversations into a folder."""

from __future__ import annotations

import os
import shutil
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: stands for an attachment that was left out of an export.
OMITTED = "<Media weggelaten>"


def copy_plan(rows: DataFrame, media: str = "media", media_to: str = "media_to") -> DataFrame:
    """media, archive, member, target of every attachment, each once.

    The archive is the path up to the first ``.zip`` (a doubled ending counts once), null for plain
    files. The target is the base name of ``media_to``, or of ``media`` where that is null or empty.
    """
    path = rows[media]
    name = F.coalesce(F.nullif(rows[media_to], F.lit("")), path)
    inside = F.regexp_extract(path, r"^(.*?\.zip)(?:\.zip)?[/\\](.+)$", 1)
    plan = rows.where(path.isNotNull() & ~path.isin("", OMITTED)).select(
        path.alias("media"),
        F.nullif(inside, F.lit("")).alias("archive"),
        F.nullif(F.regexp_extract(path, r"^(.*?\.zip)(?:\.zip)?[/\\](.+)$", 2), F.lit("")).alias("member"),
        F.regexp_replace(name, r"^.*[/\\]", "").alias("target"),
    )
    return plan.distinct()


def copy_media(plan: DataFrame, folder: str) -> DataFrame:
    """media, target, outcome: ``copied``, ``substituted``, ``ambiguous`` or ``missing``.

    ``folder`` and the sources must be mounted on every executor. An archive is opened once in a
    task; a hot one may be shared by several. A contact card that an archive lacks is replaced by
    the only member whose name contains its stem. Copies are renamed into place, so a task that
    runs again leaves whole files. Nothing is copied before the result is used.
    """
    spread = plan.repartition(F.col("archive"), F.pmod(F.xxhash64("media"), F.lit(16))).sortWithinPartitions("archive", "media")

    def member_of(z: zipfile.ZipFile, name: str) -> tuple[str | None, str]:
        names = z.namelist()
        if name in names:
            return name, "copied"
        like = [n for n in names if name[:-4] in n] if name.endswith(".vcf") else []
        return (like[0], "substituted") if len(like) == 1 else (None, "ambiguous" if like else "missing")

    def place(source, target: str) -> None:
        part = f"{target}.{os.getpid()}.part"
        with open(part, "wb") as out:
            shutil.copyfileobj(source, out)
        os.replace(part, target)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        opened, z = None, None
        for pdf in batches:
            done = []
            for media, archive, member, target in zip(pdf["media"], pdf["archive"], pdf["member"], pdf["target"]):
                outcome = "missing"
                try:
                    if os.path.isfile(media) or archive is None:
                        with open(media, "rb") as source:
                            place(source, os.path.join(folder, target))
                        outcome = "copied"
                    else:
                        if archive != opened:
                            opened, z = archive, None
                            z = zipfile.ZipFile(archive)
                        if z is not None:
                            found, outcome = member_of(z, member)
                            if found is not None:
                                with z.open(found) as source:
                                    place(source, os.path.join(folder, target))
                except (FileNotFoundError, IsADirectoryError, PermissionError, zipfile.BadZipFile):
                    outcome = "missing"
                done.append((media, target, outcome))
            yield pd.DataFrame(done, columns=["media", "target", "outcome"])

    return spread.mapInPandas(run, "media string, target string, outcome string")
