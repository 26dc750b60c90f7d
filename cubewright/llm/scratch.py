"""Written tables of the operators, and rows without those that a written table names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, owned, scratch_root

__all__ = ["BROADCAST_ROWS", "Scratch", "owned", "scratch_root", "without_rows"]

#: Row numbers that :func:`without_rows` broadcasts at most; more of them meet the rows in a shuffle.
BROADCAST_ROWS = 2_000_000


def without_rows(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``dropped``, a written table of that one column.

    Up to ``BROADCAST_ROWS`` keys are broadcast, so that wide rows stay where they are.
    """
    few = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped, key, "left_anti")
