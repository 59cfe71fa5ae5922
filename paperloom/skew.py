"""Joins that stay balanced when one value stands on a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A value with more than one in so many of all rows is hot; there are at most this many
#: of them, which bounds what ``split_join`` broadcasts.
HOT_PARTS = 2000


def hot_values(rows: DataFrame, column: str, total: int) -> DataFrame:
    """Values of ``column`` on more than 1/HOT_PARTS of all ``total`` rows: HOT_PARTS at most."""
    return rows.groupBy(column).count().where(F.col("count") > max(1000, total // HOT_PARTS)).select(column)


def split_join(rows: DataFrame, table: DataFrame, on: str, hot: DataFrame | None) -> DataFrame:
    """Join ``rows`` with ``table`` (unique ``on``), hot values through a broadcast of bounded size."""
    if hot is None:
        return rows.join(table, on)
    small = F.broadcast(hot)
    warm = rows.join(small, on, "left_anti").join(table.join(small, on, "left_anti"), on)
    return warm.unionByName(rows.join(F.broadcast(table.join(small, on, "left_semi")), on))
