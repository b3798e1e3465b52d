"""Column helpers for free text: trimming, blank tests, concatenation, keyword tests."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickledger import fixed

# Unicode white space; SQL trim alone only removes the ASCII space.
_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WIDE_DIGITS = "０１２３４５６７８９"


def pinned(value: Column) -> Column:
    """The same text, computed where it stands.

    Filters on a computed column would be pushed below its computation and repeat it, many times over where columns
    build on each other.  They stop at an expression that counts as not deterministic, as the number of the partition
    does; unlike other barriers this one goes when the column is not asked for, and keeps code generation.  The value
    is no branch of a condition, as what repeats in branches is computed each time.

    The zero goes through a lambda, which has no generated code.  So the projection is generated on its own, in small
    methods: within the code of its stage all cells would be parsed in one method, which from 8,000 bytes on the JVM
    does not compile but interprets.  The lambda is over a literal array, as one made anew for each cell costs more than
    the rest.
    """
    return F.elt(_nought() + 1, value)


def _nought() -> Column:
    return F.exists(F.array(F.lit(0)), lambda n: F.spark_partition_id() < n).cast("int")


def pinned_number(value: Column) -> Column:
    """:func:`pinned` for DOUBLE values."""
    return value + _nought()


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, however often the body names it; without code generation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACE))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, _WIDE_DIGITS, "0123456789")


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group of the first match, NULL when there is none."""
    return filled(F.regexp_extract(text, fixed.FLAGS + pattern, group))


def filled(text: Column) -> Column:
    """The text, NULL where it is empty; computed once, while ``nullif`` in a branch of a condition computes it twice."""
    return F.get(F.array_remove(F.array(text), F.lit("")), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(fixed.FLAGS + pattern)


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _any_case(words) -> list[str]:
    """All upper- and lower-case spellings: looking one up is much cheaper than lower-casing every cell."""
    return sorted({"".join(s) for w in words for s in product(*[{c.lower(), c.upper()} for c in w])})


def is_blank(df: DataFrame, column: str, words=fixed.BLANK_WORDS) -> Column:
    """True where a cell holds nothing: NULL, NaN, or for text one of ``words``."""
    return blank(F.col(f"`{column}`"), df.schema[column].dataType, words)


def blank(c: Column, kind: T.DataType, words=fixed.BLANK_WORDS) -> Column:
    """:func:`is_blank` of a column of the given type."""
    if isinstance(kind, T.StringType) and words:
        return strip(F.coalesce(c, F.lit(""))).isin(*_any_case(words))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast(kind)).isNull()
    return c.isNull()


def meaningful(df: DataFrame, column: str) -> Column:
    """True where a cell says something; never NULL."""
    return ~is_blank(df, column, fixed.MEANINGLESS_WORDS)


def joined_text(df: DataFrame, columns) -> Column:
    """The given columns that exist, joined by one space, NULL as empty text."""
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns]
    return F.concat_ws(" ", *present) if present else F.lit("")
