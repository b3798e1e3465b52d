"""Column profile of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions.text import is_blank, is_text
from brickledger.operators.ranking import first_rows


def column_profile(
    df: DataFrame, samples: int = fixed.PROFILE_SAMPLES, row_id: str = "row_id",
    sample_chars: int | None = None,
) -> DataFrame:
    """One row per column: position, name, dtype, share filled, first values, share with '|' and '/'.

    The table is read once.  Counts are observed on the way; filled cells are turned into (column, row, text), of which
    every task sends its first ``samples`` per column, in row order.  A few short texts per column come to the driver.
    """
    columns = [c for c in df.columns if c != row_id]
    measures, cells = [F.count(F.lit(1)).alias("n")], []
    for i, name in enumerate(columns):
        cell, filled = F.col(f"`{name}`"), ~is_blank(df, name, ())
        measures.append(F.count_if(filled).alias(f"f{i}"))
        if is_text(df, name):
            measures.append(F.count_if(cell.contains("|")).alias(f"p{i}"))
            measures.append(F.count_if(cell.contains("/")).alias(f"d{i}"))
        text = cell.cast("string")
        if sample_chars is not None:
            text = F.substring(text, 1, sample_chars)
        cells.append(F.when(filled, F.struct(F.lit(i).alias("column"), text.alias("text"))))
    counted = Observation()
    seen = df.observe(counted, *measures)
    filled_cells = seen.select(F.col(row_id).alias("row"), F.inline(F.array_compact(F.array(*cells)))) if cells else seen.limit(0)
    firsts: list[list[str]] = [[] for _ in columns]
    if columns:
        best = first_rows(filled_cells, ["row"], max(samples, 1), "column")
        for found in best.select("column", "__rank", "text").orderBy("column", "__rank").collect():
            if samples:
                firsts[found["column"]].append(found["text"])
    else:
        seen.write.format("noop").mode("overwrite").save()
    counted = {"n": 0, **counted.get}
    rows = []
    for i, name in enumerate(columns):
        filled = counted.get(f"f{i}", 0)
        text = is_text(df, name) and filled > 0
        rows.append((
            i, name, df.schema[name].dataType.simpleString(),
            filled / counted["n"] if counted["n"] else None, firsts[i],
            counted[f"p{i}"] / filled if text else None, counted[f"d{i}"] / filled if text else None,
        ))
    schema = (
        "position int, name string, dtype string, non_null_ratio double, samples array<string>, "
        "pipe_like_ratio double, slash_like_ratio double"
    )
    profile = df.sparkSession.createDataFrame(rows if counted["n"] else [], schema)
    return profile.withColumn("non_null_ratio", F.round("non_null_ratio", 4))


def top_profile(profile: DataFrame, columns: int = fixed.PROFILE_MAX_COLUMNS) -> DataFrame:
    """The columns most like '|'-separated lists, at most ``columns`` of them."""
    return profile.orderBy(F.coalesce("pipe_like_ratio", F.lit(0.0)).desc(), "position").limit(columns)
