"""Names for helper columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def fresh(df: DataFrame | Iterable[str], *names: str) -> list[str]:
    """Each name, with underscores before it until ``df`` (or a list of names) has no column of that name (case is ignored, as Spark does)."""
    taken = {c.lower() for c in (df.columns if hasattr(df, "columns") else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
