"""Joins against a side that is usually small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.session import settle

#: Most bytes of a side that is sent to all executors, measured on its rows.
BROADCAST_BYTES = 16 << 20


def _bytes(df: DataFrame) -> int:
    """Bytes of a frame's rows in memory, from one pass: fixed widths, and the length of every text or nested value."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string") if kind in ("string", "binary") else F.to_json(F.struct(f"`{c}`"))), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    row = sum(wide, F.lit(8 * len(df.columns) + 16)).cast("long")
    return df.agg(F.sum(row)).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join to ``small`` without shuffling ``big``, if ``small`` proves to be small.

    ``small`` is computed once and measured; up to ``max_bytes`` it is broadcast. Beyond that both sides are
    shuffled on the key and adaptive execution splits hot keys. The rows are the same either way.
    """
    small = settle(small)
    if _bytes(small) <= max_bytes:
        small = F.broadcast(small)
    return big.join(small, list(on), how)
