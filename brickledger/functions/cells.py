"""Column expressions for single listing cells: floor band, decoration, layout, rooms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions.text import ascii_digits, contains_any, filled, first_match, let, matches, strip


def labelled(text: Column, labels) -> Column:
    """Label of the first (label, words) entry that has a word in the text, else NULL."""
    return F.coalesce(*[F.when(contains_any(text, words), label) for label, words in labels])


def first_word(text: Column, words) -> Column:
    """The first of ``words``, in list order, that the text contains, else NULL."""
    return F.coalesce(*[F.when(text.contains(w), w) for w in words])


def floor_band(text: Column) -> Column:
    """低层/中层/高层 from the wording or from 'n/total', else 未知."""
    s = strip(text)
    word = F.substring(F.regexp_extract(text, fixed.FLAGS + fixed.FLOOR_WORD, 1), 1, 1)
    said = F.element_at(F.create_map(*[F.lit(v) for band in ("低层", "中层", "高层") for v in (band[0], band)]), word)
    current = ascii_digits(first_match(s, fixed.FLOOR_RATIO, 1)).try_cast("double")
    total = ascii_digits(first_match(s, fixed.FLOOR_RATIO, 2)).try_cast("double")

    def of_share(share: Column) -> Column:
        return F.when(share <= 1 / 3, "低层").when(share <= 2 / 3, "中层").when(share.isNotNull(), "高层")

    usual = F.try_divide(*[F.substring_index(text, "/", at).try_cast("double") for at in (1, -1)])
    odd = let(total, lambda n: F.when(n > 0, current / n))
    counted = let(F.when(text.rlike(fixed.USUAL_FLOOR_RATIO), usual).otherwise(odd), of_share)
    return F.coalesce(said, F.when(text.contains("/"), counted), F.lit(fixed.UNKNOWN))


def decoration(text: Column, max_chars: int | None = None) -> Column:
    """The label of a decoration, else the trimmed text, cut to ``max_chars`` if that is given."""
    s = strip(text)
    return F.coalesce(
        labelled(s, fixed.DECORATIONS),
        F.nullif(s if max_chars is None else F.substring(s, 1, max_chars), F.lit("")),
        F.lit(fixed.UNKNOWN),
    )


def _count(digits: Column) -> Column:
    """Digits without leading zeros, as text."""
    return F.regexp_replace(ascii_digits(digits), "^0+(?!$)", "")


def layout(text: Column, max_chars: int | None = None) -> Column:
    """'N室M厅' where it can be told, else the trimmed text, cut to ``max_chars`` if that is given, '' for NULL."""
    t = strip(text)
    packed = F.replace(t, F.lit(" "), F.lit(""))
    rooms = F.coalesce(*[F.when(matches(t, p), F.lit(str(n))) for n, p in fixed.ROOM_WORDS])
    halls = F.coalesce(_count(first_match(t, fixed.HALL_COUNT)), F.lit("1"))
    exact = F.concat(
        _count(first_match(packed, fixed.LAYOUT_ROOMS_HALLS, 1)), F.lit("室"),
        _count(first_match(packed, fixed.LAYOUT_ROOMS_HALLS, 2)), F.lit("厅"),
    )
    return F.coalesce(
        F.when(text.rlike(fixed.USUAL_LAYOUT), text),
        exact,
        F.concat(rooms, F.lit("室"), halls, F.lit("厅")),
        t if max_chars is None else F.substring(t, 1, max_chars),
        F.lit(""),
    )


def max_rooms(text: Column) -> Column:
    """Largest n over all 'n室' in the text, 0 when there is none.

    A text that begins with the only 'n室' in it, as most do, and one without 室 need no search for all of them.
    """
    lone = filled(F.regexp_extract(text, fixed.LONE_ROOM_COUNT, 1)).try_cast("double")
    found = F.regexp_extract_all(text, F.lit(fixed.FLAGS + fixed.ROOM_COUNT), F.lit(1))
    counts = F.transform(found, lambda n: ascii_digits(n).try_cast("double"))
    return F.coalesce(lone, F.when(text.contains("室"), F.array_max(counts)), F.lit(0.0))


def near_subway(text: Column) -> Column:
    positive = (
        fixed.SUBWAY_KEYWORD, fixed.SUBWAY_STATION_DISTANCE, fixed.SUBWAY_LINE_DISTANCE,
        fixed.SUBWAY_INLINE_DISTANCE, fixed.SUBWAY_WALK,
    )
    said = reduce(lambda a, b: a | b, [matches(text, p) for p in positive])
    return contains_any(text, fixed.SUBWAY_MARKS) & said & ~matches(text, fixed.SUBWAY_NEGATION)


def station_hint(text: Column) -> Column:
    """First station name in the text, longer names first at the same place, '' for none."""
    names = "|".join(sorted(fixed.SUBWAY_STATIONS, key=len, reverse=True))
    return F.regexp_extract(text, f"({names})", 1)


def area_band(area: Column) -> Column:
    """Label of the right-closed area band, NULL outside all bands."""
    return F.coalesce(
        *[F.when((area > low) & (area <= high), label) for label, low, high in fixed.AREA_BANDS]
    )


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("bigint")
