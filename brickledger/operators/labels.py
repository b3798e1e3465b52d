"""Labels read out of listing text.  Narrow projections over one joined text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions import cells
from brickledger.functions.numbers import to_number
from brickledger.functions.text import ascii_digits, contains_any, first_match, joined_text, pinned
from brickledger.operators.cleaning import finalize


def _telling_text(df: DataFrame) -> Column:
    """The joined text without its house info, the last of it, where that is in the usual form.

    Such a cell is digits, room counts, an area, compass points, a decoration, storey, year and building type only: no
    tag's word is in it, and no tag's pattern that begins before it ends in it.
    """
    if "house_info_raw" not in df.columns:
        return joined_text(df, fixed.LABEL_TEXT_COLUMNS)
    others = joined_text(df, [c for c in fixed.LABEL_TEXT_COLUMNS if c != "house_info_raw"])
    info = F.coalesce(F.col("house_info_raw").cast("string"), F.lit(""))
    return F.concat(others, F.lit(" "), F.when(info.rlike(fixed.USUAL_HOUSE_INFO), F.lit("")).otherwise(info))


def text_labels(df: DataFrame) -> DataFrame:
    """Add the tag columns and layout_normalized; fill a missing build year from the text."""
    kept = df.columns
    text = F.col("__said")
    new = {
        "tag_near_subway": cells.near_subway(text),
        "tag_near_bus": contains_any(text, fixed.BUS),
        "tag_has_balcony": contains_any(text, fixed.BALCONY),
        "tag_lighting": contains_any(text, fixed.LIGHTING),
        "tag_subway_station_hint": pinned(cells.station_hint(text)),
        "tag_elevator": contains_any(text, fixed.ELEVATOR),
        "layout_normalized": pinned(cells.layout(F.col("layout").cast("string"))) if "layout" in kept else F.lit(""),
    }
    if "build_year" in kept:
        year = ascii_digits(first_match(F.col("__text"), fixed.YEAR_TEXT)).try_cast("double")
        plausible = F.when(year.between(*fixed.BUILD_YEAR_RANGE), year)
        new["build_year"] = F.coalesce(to_number(df, "build_year"), plausible)
    texts = {"__text": joined_text(df, fixed.LABEL_TEXT_COLUMNS), "__said": pinned(_telling_text(df))}
    work = df.withColumns(texts).withColumns(new)
    return work.select(*kept, *[c for c in new if c not in kept])


def rule_features(df: DataFrame) -> DataFrame:
    """Text labels, then the numeric clean-up of :func:`finalize`."""
    return df.transform(text_labels).transform(finalize)
