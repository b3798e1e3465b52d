"""Row-level cleaning.  Every operator here is a narrow projection: no shuffle, no driver work, no Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions import cells, numbers
from brickledger.functions.text import first_match, is_blank, is_text, let, matches, pinned, pinned_number, strip
from brickledger.schema import require_columns, require_standard


def split_delimited(df: DataFrame, source: str, delimiter: str, outputs: list[str]) -> DataFrame:
    """Split a cell into standard columns: trimmed, missing parts NULL, surplus parts dropped."""
    require_columns(df, [source])
    require_standard(outputs)
    parts = F.split(F.col(source).cast("string"), re.escape(delimiter))
    return df.withColumns({name: strip(F.get(parts, F.lit(i))) for i, name in enumerate(outputs)})


def split_slash_part(df: DataFrame, source: str, index: int, output: str) -> DataFrame:
    """The index-th non-empty '/'-separated part, NULL when there are fewer."""
    require_columns(df, [source])
    require_standard([output])
    parts = F.filter(F.transform(F.split(F.col(source).cast("string"), "/"), strip), lambda p: p != "")
    return df.withColumn(output, F.get(parts, F.lit(index)))


def floor_band(df: DataFrame, source: str = "floor") -> DataFrame:
    if source not in df.columns:
        return df
    return df.withColumn("floor_band", cells.floor_band(F.col(source).cast("string")))


def normalize_decoration(df: DataFrame, source: str, output: str = "decoration") -> DataFrame:
    require_columns(df, [source])
    require_standard([output])
    return df.withColumn(output, cells.decoration(F.col(source).cast("string")))


def _followers(df: DataFrame, source: str) -> Column:
    return numbers.followers(F.col(source)) if is_text(df, source) else numbers.to_number(df, source)


def coerce_followers(df: DataFrame, source: str, output: str = "followers") -> DataFrame:
    require_columns(df, [source])
    require_standard([output])
    return df.withColumn(output, _followers(df, source))


# --- Composite cells -------------------------------------------------------------------------------

# A house-info cell is a list of '|'-separated parts.  Per staging column, in order of precedence: the
# pattern of a part it accepts, and how the accepted part becomes a value.  Every orientation word has
# one of the four compass characters, so those are enough to accept a part.
_HOUSE_INFO = (
    (
        "layout_str",
        rf"[^|]*?{fixed.LAYOUT_CELL}[^|]*",
        lambda p: F.when(p.rlike(fixed.USUAL_LAYOUT), p).otherwise(
            F.regexp_replace(first_match(p, fixed.LAYOUT_CELL, 0), r"(?U)\s+", "")
        ),
    ),
    (
        "area_m2_str",
        rf"[^|]*?{fixed.AREA_CELL}[^|]*",
        lambda p: F.when(p.rlike(fixed.USUAL_AREA), p).otherwise(F.concat(first_match(p, fixed.AREA_CELL), F.lit("平米"))),
    ),
    (
        "orientation_str",
        rf"(?=[^|]{{1,{fixed.ORIENTATION_MAX_CHARS}}}?\s*\|)[^|]*?[东南西北][^|]*",
        lambda p: cells.first_word(p, fixed.ORIENTATIONS),
    ),
    (
        "decoration_str",
        "[^|]*?(?:" + "|".join(w for _, words in fixed.HOUSE_INFO_DECORATIONS for w in words) + ")[^|]*",
        lambda p: cells.labelled(p, fixed.HOUSE_INFO_DECORATIONS),
    ),
    (
        "build_year",
        rf"(?=[^|]*?[年建]|[^|]{{1,8}}?\s*\|)[^|]*?{fixed.YEAR_CELL}[^|]*",
        lambda p: F.when(p.rlike(fixed.USUAL_YEAR), F.substring(p, 1, 4)).otherwise(first_match(p, fixed.YEAR_CELL)),
    ),
    (
        "building_type_str",
        "[^|]*?(?:" + "|".join(fixed.BUILDING_TYPES) + ")[^|]*",
        lambda p: cells.first_word(p, fixed.BUILDING_TYPES),
    ),
    ("floor_text", "[^|]*?[层楼共][^|]*", lambda p: p),
)


def _fill_blank(df: DataFrame, column: str, value: Column) -> Column:
    """``value`` where the column is blank or absent, else the column; the column keeps its type."""
    if column not in df.columns:
        return value
    kind = df.schema[column].dataType
    filler = value if is_text(df, column) else value.try_cast(kind)
    return F.when(is_blank(df, column), filler.cast(kind)).otherwise(F.col(column))


def _without_part(text: Column, part: Column) -> Column:
    """'|a|b|c|' without its first part equal to ``part``; unchanged where ``part`` is NULL."""
    at = F.position(F.concat(F.lit("|"), part, F.lit("|")), text)
    rest = F.concat(F.substr(text, F.lit(1), at), F.substr(text, at + F.length(part) + 2))
    return F.coalesce(rest, text)


def _part_accepted(part: Column) -> list[Column]:
    """For each column of _HOUSE_INFO whether it accepts a part, a stripped one."""
    short = lambda chars: F.char_length(part) <= chars
    return [
        matches(part, fixed.LAYOUT_CELL), matches(part, fixed.AREA_CELL),
        short(fixed.ORIENTATION_MAX_CHARS) & part.rlike("[东南西北]"),
        part.rlike("|".join(w for _, words in fixed.HOUSE_INFO_DECORATIONS for w in words)),
        (part.rlike("[年建]") | short(8)) & matches(part, fixed.YEAR_CELL),
        part.rlike("|".join(fixed.BUILDING_TYPES)), part.rlike("[层楼共]"),
    ]


def _folded(df: DataFrame) -> DataFrame:
    """The cell's parts by one fold: each goes to the first column that is still free and accepts it."""
    names = [name for name, _, _ in _HOUSE_INFO]
    none = F.struct(*[F.lit(None).cast("string").alias(name) for name in names])

    def step(taken: Column, part: Column) -> Column:
        place = F.lit(None).cast("int")
        for i, accepted in reversed(list(enumerate(_part_accepted(part)))):
            place = F.when(taken[names[i]].isNull() & accepted, i).otherwise(place)
        return let(place, lambda at: F.struct(*[F.when(at == i, part).otherwise(taken[name]).alias(name) for i, name in enumerate(names)]))

    usual, raw = F.col("__usual"), F.when(F.col("__usual").isNull(), F.col("house_info_raw").cast("string"))
    parts = F.filter(F.transform(F.split(raw, r"\|"), strip), lambda part: part != "")
    work = _usual_parts(df).withColumn("__parts", F.aggregate(parts, none, step))
    return work.withColumns({
        f"__{name}": F.coalesce(F.get(usual, F.lit(fixed.USUAL_PARTS.index(name))), F.col(f"__parts.{name}")) for name in names
    })


def _usual_parts(df: DataFrame) -> DataFrame:
    """``__usual``: the parts of a cell that has them all in the usual order, else NULL."""
    raw = F.col("house_info_raw").cast("string")
    return df.withColumn("__usual", F.when(raw.rlike(fixed.USUAL_HOUSE_INFO), F.split(raw, r"\|")))


def _chained(df: DataFrame) -> DataFrame:
    """The cell's parts by patterns over the whole cell, each over what the columns before left over."""
    left, raw = F.col("__left"), F.when(F.col("__usual").isNull(), F.col("house_info_raw").cast("string"))
    work = _usual_parts(df).withColumn("__left", F.concat(F.lit("|"), raw, F.lit("|")))
    for name, accepts, _ in _HOUSE_INFO:
        work = work.withColumn(f"__found_{name}", first_match(left, rf"\|(\s*{accepts})(?=\|)"))
        work = work.withColumn("__left", _without_part(left, F.col(f"__found_{name}")))
    return work.withColumns({
        f"__{name}": F.coalesce(F.get("__usual", F.lit(fixed.USUAL_PARTS.index(name))), strip(F.col(f"__found_{name}")))
        for name, _, _ in _HOUSE_INFO
    })


def expand_house_info(df: DataFrame, all_columns: bool = False) -> DataFrame:
    """Take the '|'-separated house_info_raw apart into staging columns, filling blanks only.

    Each part belongs to the first column, in order of precedence, that is still free and accepts it.  There are two
    ways with the same result.  ``all_columns``: one fold over the parts, the faster one where all columns are asked
    for.  Else, as that is the same, each column in turn takes its first acceptable part out of the text that the
    columns before it left over: then a column needs no more than the steps up to its own.

    The parts are pinned: later filters are not rewritten into copies of these expressions, which refer to each other
    many times over.
    """
    if "house_info_raw" not in df.columns:
        return df
    kept = df.columns
    work = _folded(df) if all_columns else _chained(df)
    work = work.select(*kept, *[pinned(F.col(f"__{name}")).alias(f"__{name}") for name, _, _ in _HOUSE_INFO])
    values = {name: _fill_blank(df, name, value(F.col(f"__{name}"))) for name, _, value in _HOUSE_INFO}
    if "layout_str" not in kept:
        values["layout_str"] = pinned(values["layout_str"])  # for small generated methods
    return work.withColumns(values).select(*kept, *[n for n in values if n not in kept])


def expand_follow_info(df: DataFrame) -> DataFrame:
    """Followers and publishing time out of follow_info_raw, filling blanks only.

    The time is what follows the first '/' (of either width); without one, what follows the first '|'.
    """
    if "follow_info_raw" not in df.columns:
        return df
    raw = F.col("follow_info_raw").cast("string")
    after_slash = first_match(raw, r"(?s)^[^/／]*[/／]\s*(.*?)\s*$")
    after_pipe = first_match(raw, r"(?s)^[^/／|]*\|\s*([^/／]*?)\s*$")
    published = F.replace(F.coalesce(after_slash, after_pipe), F.lit("／"), F.lit("/"))
    kept = df.columns
    work = df.withColumn("__published", published)
    values = {
        "followers": _fill_blank(df, "followers", _followers(df, "follow_info_raw")),
        "publish_time_raw": _fill_blank(df, "publish_time_raw", F.col("__published")),
        "listing_time": _fill_blank(df, "listing_time", F.col("__published")),
    }
    return work.withColumns(values).select(*kept, *[n for n in values if n not in kept])


def expand_composites(df: DataFrame, all_columns: bool = False) -> DataFrame:
    """Both composite cells; ``all_columns`` as in :func:`expand_house_info`."""
    return expand_house_info(df, all_columns).transform(expand_follow_info)


# --- Promotion, numbers ----------------------------------------------------------------------------


def promote_staging(df: DataFrame) -> DataFrame:
    """Fill blank canonical columns from their staging columns."""
    for source, target in fixed.STAGING_PAIRS:
        if source not in df.columns:
            continue
        if target not in df.columns:
            df = df.withColumn(target, F.col(source))
            continue
        value = F.col(source)
        if target == "area_m2" and is_text(df, source):
            value = numbers.area_m2(value)
        kind = df.schema[target].dataType
        usable = is_blank(df, target) & ~is_blank(df, source, fixed.NULL_WORDS)
        df = df.withColumn(target, F.when(usable, value.cast(kind)).otherwise(F.col(target)))
    return df


_TEXT_PARSERS = {
    "unit_price": numbers.unit_price_yuan,
    "total_price": numbers.total_price_wan,
    "area_m2": numbers.area_m2,
}


def parse_numeric_text(df: DataFrame, rescale_small_unit_price: bool = False) -> DataFrame:
    """Parse price and area columns that are still text; numeric columns stay as they are."""
    parsed = {}
    for name, parser in _TEXT_PARSERS.items():
        if name in df.columns and is_text(df, name):
            options = {"rescale_small": rescale_small_unit_price} if name == "unit_price" else {}
            parsed[name] = parser(F.col(name), **options)
    return df.withColumns(parsed) if parsed else df


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns as DOUBLE; what is not a number becomes NULL."""
    present = {c: numbers.to_number(df, c) for c in fixed.NUMERIC_COLUMNS if c in df.columns}
    return df.withColumns(present) if present else df


def fill_unit_price(df: DataFrame) -> DataFrame:
    """Missing unit price = total price (10 000 yuan) / area."""
    if not {"total_price", "area_m2"} <= set(df.columns):
        return df
    derived = F.try_divide(numbers.to_number(df, "total_price") * 10_000, numbers.to_number(df, "area_m2"))
    if "unit_price" in df.columns:
        derived = F.coalesce(numbers.to_number(df, "unit_price"), derived)
    return df.withColumn("unit_price", derived)


def _pin_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: pinned_number(F.col(c)) for c in fixed.NUMERIC_COLUMNS if c in df.columns})


def finalize(df: DataFrame) -> DataFrame:
    """Promote staging columns, parse text numbers, coerce, fill the unit price.

    Numbers are pinned where they are parsed, so that the parsing is a projection generated on its own.
    """
    return (
        df.transform(promote_staging)
        .transform(parse_numeric_text)
        .transform(coerce_numeric)
        .transform(_pin_numbers)
        .transform(fill_unit_price)
    )
