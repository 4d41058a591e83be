"""The shared folder's tables, and what may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.sources.shared import Workspace, shared_root, unused  # noqa: F401  used from here by the operators

BROADCAST_BYTES = 48 << 20


def small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, a written table, marked for broadcast if its rows have few bytes together; else it is joined by a shuffle."""
    total = df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
