"""Column names that a user's table doesn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so (whatever the case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
