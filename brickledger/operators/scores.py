"""Weak description scores: pick rows to be scored elsewhere, and write the scores back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.operators.ranking import first_rows

HINTS = {"subway": "description_hint_subway", "school": "description_hint_school"}


def _draw(seed: int) -> Column:
    """A repeatable random number of a row as text; by its id, so that it does not depend on how the table is split up."""
    return F.md5(F.concat(F.col("row_id").cast("string"), F.lit(f"-{seed}")))


def sample_for_scoring(
    df: DataFrame,
    share: float | None = fixed.SCORING_SHARE,
    rows: int | None = None,
    seed: int = fixed.SCORING_SEED,
    snippet_chars: int | None = None,
    min_rows: int = fixed.MIN_ROWS,
) -> DataFrame:
    """A repeatable random sample of (row_id, snippet): a share of the rows, or a number of them.

    A share is a filter on the draw, without a shuffle, and grows with the table.  ``rows`` asks for the rows of least
    draw in place of a share; there may be fewer than ``min_rows`` of them, then there are none.  Texts are whole unless
    ``snippet_chars`` cuts them.
    """
    text = F.coalesce(F.col("description_raw"), F.lit(""))
    if snippet_chars is not None:
        text = F.substring(text, 1, snippet_chars)
    drawn = df.select("row_id", text.alias("snippet"), _draw(seed).alias("__draw"))
    if rows is None:
        below = f"{min(int((1.0 if share is None else share) * 16**8), 16**8):09x}"
        return drawn.filter(F.concat(F.lit("0"), F.substring("__draw", 1, 8)) < below).select("row_id", "snippet")
    least = first_rows(drawn, ["__draw", "row_id"], rows)
    there = F.count("*").over(Window.partitionBy(F.lit(0)))  # of the sample
    return least.withColumn("__there", there).filter(F.col("__there") >= min(min_rows, rows)).select("row_id", "snippet")


def apply_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Left-join (row_id, subway, school) scores, cut to 0..1; rows without a score keep theirs or NULL."""
    clamped = scores.groupBy("row_id").agg(*[
        F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(s).cast("double"), F.lit(0.0)))))
        .alias(f"__{s}")
        for s in HINTS
    ])
    joined = df.join(clamped, "row_id", "left")
    hints = {
        hint: F.coalesce(F.col(f"__{s}"), F.col(hint).cast("double") if hint in df.columns else F.lit(None))
        for s, hint in HINTS.items()
    }
    return joined.withColumns(hints).drop(*[f"__{s}" for s in HINTS])
