"""Ordered data on Spark: operators, sources, functions, plans."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Sends this package to the workers of a session whose workers don't have it installed."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tempograph-"), "tempograph.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
