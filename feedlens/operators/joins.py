"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes in memory up to which a dimension is broadcast.
DEFAULT_BROADCAST_BYTES = 64 << 20
# Of a row in a broadcast hash table, beside its values: its key's place, its pointer, its header and null bits.
ROW_BYTES = 64


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate of a frame; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def held_bytes(df: DataFrame) -> int:
    """Bytes that the rows of a frame take in memory: one distributed aggregate, of one row.

    The planner's estimate is no bound of them: files are compressed, by thirty
    times and more where values repeat, and a join's is the product of its sides.
    """
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(wide, F.lit(0)).cast("long")).alias("text")).first()
    return found["n"] * (ROW_BYTES + 8 * len(df.columns)) + (found["text"] or 0)


def broadcast_if_small(dim: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``dim`` if its rows take at most ``max_bytes`` in memory, else leave it to the planner.

    Beyond the bound the join stays a shuffle join (sort-merge, with AQE's skew
    split for hot keys).
    """
    return F.broadcast(dim) if held_bytes(dim) <= max_bytes else dim
