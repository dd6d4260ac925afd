"""Broadcast helpers: a side is broadcast only behind a bound.

Two kinds of bound exist in the engine:

* structural: the side is the output of ``orderBy(...).limit(n)`` or an aggregate over a bounded
  key set, so its row count is at most ``n`` whatever the input size (``broadcast_bounded``);
* measured: a dimension (retailers, collections, a vocabulary) whose row count is checked with a
  ``limit(max_rows + 1).count()`` before the join is planned. Above the bound the plain join is
  returned and the planner (AQE) chooses a shuffle join (``broadcast_if_small``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default ceiling for a measured broadcast (rows). Dimensions of this engine are far smaller.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_bounded(df: DataFrame) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction (top-k output, tiny dimension
    keyed by a bounded id space). Callers state the bound where they call it."""
    return F.broadcast(df)


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; scans at most max_rows + 1 rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after the row count is checked; otherwise leave the choice to AQE."""
    return F.broadcast(df) if fits(df, max_rows) else df
