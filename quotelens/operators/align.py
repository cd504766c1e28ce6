"""Columns of new rows in the order of the training columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(rows: DataFrame, columns: list[str], fill: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and exactly ``columns`` in their order: those that ``rows``
    lacks, or where it has NULL, are ``fill`` (0 for indicators, -1 for label
    codes); others go."""
    have = set(rows.columns)
    value = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(fill))) if c in have else F.lit(float(fill)) for c in columns]
    return rows.select(*keep, *[v.alias(c) for v, c in zip(value, columns)])
