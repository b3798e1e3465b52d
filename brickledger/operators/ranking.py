"""Global top-k in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of map tasks; each group's best rows are found by one task.
_GROUPS = 1024


def first_rows(df: DataFrame, order: list, rows: int, by: str | None = None, most: Column | None = None) -> DataFrame:
    """The first ``rows`` rows in ``order``, of each value of ``by`` if given, with their ``__rank`` from 1.

    Every map task sends its first rows, as many as asked for, to one of 1024 tasks, which do the same for the final
    one.  So the final task receives 1024 times the rows asked for at most, however many map tasks there are.
    ``most`` is a column with a smaller number of rows for a value of ``by``.
    """
    keys = [by] if by else []
    group = F.pmod(F.spark_partition_id(), F.lit(_GROUPS))
    place = F.row_number().over(Window.partitionBy(*keys, "__group").orderBy(*order))
    near = df.withColumn("__group", group).withColumn("__rank", place).filter(F.col("__rank") <= rows).drop("__rank", "__group")
    final = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    best = near.withColumn("__rank", F.row_number().over(final)).filter(F.col("__rank") <= rows)
    return best if most is None else best.filter(F.col("__rank") <= most)
