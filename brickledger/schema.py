"""Standard columns and header spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickledger import fixed

_STANDARD = frozenset(fixed.STANDARD_COLUMNS)
_KEY_BY_HEADER = {header: key for key, headers in fixed.HEADER_ALIASES.items() for header in headers}


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def require_standard(columns) -> None:
    unknown = [c for c in columns if c not in _STANDARD]
    if unknown:
        raise ValueError(f"not a standard column: {', '.join(unknown)}")


def normalize_header(name: str) -> str:
    """Standard key for a known header, else the header without spaces."""
    packed = str(name).strip().replace(" ", "")
    return _KEY_BY_HEADER.get(packed, packed)


def canonicalize_headers(df: DataFrame) -> DataFrame:
    """Rename known headers.  Headers that mean the same column are merged, the leftmost value first."""
    sources: dict[str, list[str]] = {}
    for column in df.columns:
        sources.setdefault(normalize_header(column), []).append(column)
    return df.select(*[
        F.coalesce(*[F.col(f"`{c}`") for c in columns]).alias(key) for key, columns in sources.items()
    ])


def rename_standard(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns to standard keys; both sides are checked."""
    require_columns(df, mapping)
    require_standard(mapping.values())
    return df.withColumnsRenamed(mapping)
