"""Broadcast only what is counted to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many bytes, and left to Spark's own choice above.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df hinted for broadcast if a count of its rows shows that it is small; one more job over df, which should be cheap."""
    return F.broadcast(df) if df.limit(BROADCAST_BYTES // row_bytes + 1).count() * row_bytes <= BROADCAST_BYTES else df
