"""Names that are safe in paths and identifiers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def slug(text: str | None) -> str | None:
    """Lower-case ASCII words joined by single hyphens; null stays null.

    Letters lose their accents, other characters go; blanks and hyphens between words become one
    hyphen, and no hyphen or underscore is left at an end.
    """
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if c.isascii()).lower()
    words = (re.sub(r"\W", "", w) for w in re.split(r"[\s-]+", plain))
    return re.sub(r"-+", "-", "-".join(words)).strip("-_")


@F.pandas_udf(StringType())
def slugs(names: pd.Series) -> pd.Series:
    """``slug`` of a column; Spark has no function that decomposes characters."""
    return names.map(slug, na_action="ignore")
