"""Interquartile-range outliers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions.numbers import to_number
from brickledger.operators.quantiles import approximate_quantiles, exact_quantiles


class Bounds(NamedTuple):
    """The lowest and highest value that is not an outlier, over ``n`` values."""

    n: int
    low: float
    high: float


def iqr_bounds(df: DataFrame, column: str, factor: float = fixed.IQR_FACTOR, approx: bool = False) -> Bounds | None:
    """Runs the jobs of an exact quantile over one column, or the one job of a sketch; None without any value."""
    quantiles = approximate_quantiles if approx else exact_quantiles
    found = quantiles(df, to_number(df, column), [0.25, 0.75]).get("")
    if found is None:
        return None
    spread = found[0.75] - found[0.25]
    return Bounds(found["n"], found[0.25] - factor * spread, found[0.75] + factor * spread)


def is_inlier(
    df: DataFrame, column: str, factor: float = fixed.IQR_FACTOR, min_values: int = fixed.IQR_MIN_ROWS, approx: bool = False
) -> Column:
    """True for NULL values, values inside the bounds, and any value where there are under ``min_values``."""
    bounds = iqr_bounds(df, column, factor, approx)
    if bounds is None or bounds.n < min_values:
        return F.lit(True)
    value = to_number(df, column)
    return value.isNull() | value.between(bounds.low, bounds.high)


def remove_price_outliers(
    df: DataFrame, column: str = "unit_price", factor: float = fixed.IQR_FACTOR, min_values: int = fixed.IQR_MIN_ROWS,
    approx: bool = False,
) -> DataFrame:
    """Drop rows outside the interquartile bounds, which go into the filter as two numbers.

    Tables of fewer than ``min_values`` values stay as they are; 0 turns that off.  ``approx`` takes the quartiles from a
    sketch, in one job and with a rank error of :data:`quantiles.SKETCH_RANK_ERROR`.
    """
    if column not in df.columns:
        return df
    return df.filter(is_inlier(df, column, factor, min_values, approx))


def price_outliers(
    df: DataFrame, column: str = "unit_price", min_rows: int = fixed.MIN_ROWS, approx: bool = False
) -> DataFrame:
    """One row: how many values there are, the bounds, and how many lie outside; empty under ``min_rows`` values."""
    bounds = iqr_bounds(df, column, approx=approx) or Bounds(0, None, None)
    value = to_number(df, column)
    outside = (value < bounds.low) | (value > bounds.high) if bounds.n else F.lit(False)
    return df.agg(
        F.count(value).alias("valid_rows"),
        F.count_if(outside).alias("outlier_rows"),
    ).select(
        "*", F.lit(bounds.low).cast("double").alias("low"), F.lit(bounds.high).cast("double").alias("high")
    ).filter(F.col("valid_rows") >= min_rows)
