"""Operators on rows in an order, which is a column and never the rows' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def without_runs(df: DataFrame, keys, order, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    before, at = F.lag(value).over(_by(keys, order)), F.row_number().over(_by(keys, order))
    return df.withColumns({"_before": before, "_at": at}).filter((F.col("_at") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_at")


def filled_down(df: DataFrame, keys, order, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to this row: a vertically merged cell."""
    return df.withColumn(name, F.last(value, True).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def preceding(df: DataFrame, keys, order, value: Column, name: str) -> DataFrame:
    """The last value that isn't null before this row: the paragraph that names a table."""
    return df.withColumn(name, F.last(value, True).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, -1)))


def following(df: DataFrame, keys, order, value: Column, name: str) -> DataFrame:
    """The least value after this row: the next bit table."""
    # Backwards: a frame from here to the end would be counted anew for each row.
    back = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn(name, F.min(value).over(back.rowsBetween(Window.unboundedPreceding, -1)))


def on_first_row(df: DataFrame, keys, order, columns) -> DataFrame:
    """Values of a table on its first row only."""
    first = F.row_number().over(_by(keys, order)) == 1
    return df.withColumns({c: F.when(first, F.col(c)) for c in columns})


def progress(df: DataFrame, keys, order, begin: int = 50, share: int = 30) -> DataFrame:
    w = _by(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("progress", (begin + F.floor(share * F.row_number().over(w) / n)).cast("long"))
