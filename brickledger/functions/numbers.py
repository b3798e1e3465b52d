"""Column expressions that turn listing text into numbers.  All of them run JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickledger import fixed
from brickledger.functions.text import ascii_digits, contains_any, filled, first_match, strip

# What counts as a plain number.  The guard is needed because a SQL cast also takes '1d' or '0x1p3'.
_PLAIN = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def no_nan(number: Column) -> Column:
    return F.nanvl(number, F.lit(None).cast("double"))


def plain_number(text: Column) -> Column:
    """Text that is a number as a whole, else NULL."""
    return filled(F.regexp_extract(strip(text), _PLAIN, 0)).try_cast("double")


def _usual(text: Column, unit: str) -> Column:
    """The number of a cell that is nothing but ASCII digits and a unit, as most are, else NULL."""
    return filled(F.regexp_extract(text, rf"^([0-9]++(?:\.[0-9]++)?){unit}$", 1)).try_cast("double")


def _captured(text: Column, pattern: str) -> Column:
    # NULL where nothing matches: casting empty text costs an exception for each cell.
    return ascii_digits(first_match(text, pattern)).try_cast("double")


def _cleaned(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(""))


def to_number(df: DataFrame, column: str) -> Column:
    """A column as DOUBLE; text that is not a plain number and NaN become NULL."""
    c = F.col(column)
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return plain_number(c)
    number = c.cast("double")
    return no_nan(number) if isinstance(kind, (T.DoubleType, T.FloatType)) else number


def first_number(text: Column) -> Column:
    return _captured(_cleaned(text), fixed.NUMBER)


def area_m2(text: Column) -> Column:
    """'89平米' -> 89.0"""
    return F.coalesce(_usual(text, "平米"), plain_number(text), first_number(text))


def unit_price_yuan(text: Column, rescale_small: bool = False) -> Column:
    """'17190元/平米' -> 17190.0, '1.7万/㎡' -> 17000.0.

    ``rescale_small`` reads plain numbers between 50 and 800 as 万 per m².
    """
    s = _cleaned(text)
    plain = plain_number(text)
    if rescale_small:
        plain = F.when((plain > 50) & (plain < 800), plain * 10_000).otherwise(plain)
    per_area = _captured(s, fixed.UNIT_PRICE)
    in_wan = first_match(s, fixed.UNIT_PRICE, 2).isNotNull() | (
        s.contains("万") & s.contains("元") & s.contains("/")
    )
    loose_wan = s.contains("万") & contains_any(s, ("㎡", "平米", "m²", "M²"))
    any_number = _captured(s, fixed.NUMBER)
    return F.coalesce(
        _usual(text, "元/平米"),
        F.when(plain.isNotNull(), plain)
        .when(per_area.isNotNull(), per_area * F.when(in_wan, 10_000.0).otherwise(1.0))
        .when(loose_wan, any_number * 10_000)
        .otherwise(any_number)
    )


def total_price_wan(text: Column) -> Column:
    """'153万' -> 153.0; a number without 万 above 50 000 is taken as yuan."""
    s = _cleaned(text)
    number = F.coalesce(plain_number(text), _captured(s, fixed.NUMBER))
    return F.coalesce(
        _usual(text, "万"),
        F.when(
            s.contains("万"),
            F.coalesce(_captured(s, fixed.TOTAL_PRICE_WAN), _captured(s, fixed.NUMBER)),
        )
        .when(number > fixed.TOTAL_PRICE_YUAN_FROM, number / 10_000)
        .otherwise(number)
    )


def followers(text: Column) -> Column:
    """'1.2万' -> 12000.0, '3千' -> 3000.0: the first number with the unit that follows it."""
    unit = first_match(text, fixed.FOLLOWERS, 2)
    scale = F.when(unit.isin("万", "w", "W"), 10_000.0).when(unit == "千", 1_000.0).otherwise(1.0)
    return _captured(text, fixed.FOLLOWERS) * scale
