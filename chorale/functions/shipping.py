"""Gives executors this package's code."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Send the package to executors as a zip, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="chorale-code-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(ROOT.rglob("*.py")):
            out.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shipped(query: Callable) -> Callable:
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
