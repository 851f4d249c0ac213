"""Joins whose hot keys meet in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_totals(rows: DataFrame, totals: DataFrame, key: str, rows_of_key: str, n_rows: int, hot_keys: int = 10_000, least_hot: int = 500) -> DataFrame:
    """Inner join of ``rows`` with ``totals``, which has one row a key and in ``rows_of_key`` how many rows the key has.

    A key with more than ``least_hot`` rows and more than one in ``hot_keys`` of the ``n_rows`` rows
    is hot. There are ``hot_keys`` hot keys at most, so their totals are broadcast and their rows stay
    where they are; all other rows are shuffled on the key. Null keys join nothing.
    """
    limit = max(least_hot, n_rows // hot_keys)
    names = [c for c in totals.columns if c != key]
    hot = totals.where(F.col(rows_of_key) > limit).select(key, F.struct(*names).alias("hot_totals"))
    marked = rows.join(F.broadcast(hot), key, "left")  # both branches use the one broadcast
    found = marked.where("hot_totals is not null").select(*rows.columns, "hot_totals.*")
    rest = marked.where("hot_totals is null").drop("hot_totals")
    return found.unionByName(rest.join(totals.where(F.col(rows_of_key) <= limit), key))
