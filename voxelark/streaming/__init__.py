"""An extension: the additive cell aggregates over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import with_cell


def voxel_counts(stream: DataFrame, depth: int, time: str = "ts", late: str = "1 hour", width: str = "1 hour", unit=("u", "v"), value: str = "value") -> DataFrame:
    """Counts and sums per time window and cell, kept up as rows come in; rows later than ``late`` are dropped."""
    axes = ("i", "j", "k")[: len(unit)]
    rows = with_cell(stream.withWatermark(time, late), depth, unit, axes)
    return rows.groupBy(F.window(time, width), "d", *axes).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum"))
