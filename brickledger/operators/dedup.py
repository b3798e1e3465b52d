"""Duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickledger import fixed

ROW_ORDER = ("ingest_file", "row_id")
#: Registers of the distinct-count sketch (a power of two), and how far off it may be: seven standard errors.
_SKETCH_SIZE = 14
_SKETCH_ERROR = 7 * 1.04 / 2 ** (_SKETCH_SIZE / 2)

#: The column with a row's number, and up to so many rows their marks, a bit for each, are broadcast (128 MB).
ROW_NUMBER, MOST_MARKED = "__row", 1 << 30
_MARKS, _MASK = 1 << 15, 64
MOST_BLOCKS = MOST_MARKED // _MARKS


def resolve_dedup_keys(df: DataFrame, min_non_null_ratio: float = fixed.DEDUP_MIN_FILLED) -> list[str] | None:
    """The columns that tell listings apart, or None for whole rows.

    Small jobs that bring one row to the driver: the listing number and source file are counted first,
    the other columns, which may have to be parsed, only where those do not decide.  Whether listing numbers differ
    enough is told by a sketch in the first of these jobs; they are only counted exactly, which shuffles them all, where
    the limit lies within the sketch's error.
    """
    tagged, numbered = "ingest_file" in df.columns, "listing_id" in df.columns
    # Sketches pass over empty text, so none is.
    number = F.concat(F.lit("#"), F.col("listing_id").cast("string")) if numbered else F.lit(None).cast("string")
    counted = df.agg(
        F.count("*").alias("n"),
        (F.count("ingest_file") if tagged else F.lit(0)).alias("files"),
        (F.count("listing_id") if numbered else F.lit(0)).alias("numbers"),
        F.hll_sketch_estimate(F.hll_sketch_agg(number, _SKETCH_SIZE)).alias("about"),
    ).first()
    n = counted["n"]
    if not n:
        return None
    if counted["numbers"] and counted["numbers"] / n >= min_non_null_ratio:
        if counted["files"]:
            return ["ingest_file", "listing_id"]
        least = max(1, int(fixed.DEDUP_MIN_DISTINCT * n))
        about = counted["about"]
        if abs(about - least) <= _SKETCH_ERROR * max(about, least):
            about = df.agg(F.count_distinct("listing_id")).first()[0]
        if about >= least:
            return ["listing_id"]
    candidates = [c for c in fixed.DEDUP_PREFERENCE if c in df.columns]
    filled = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in candidates]).first()
    usable = [c for c in candidates if filled[c] / n >= min_non_null_ratio]
    keys = (["ingest_file"] if counted["files"] else []) + usable
    return keys if len(keys) >= 2 else None


def drop_duplicates_first(df: DataFrame, keys: list[str] | None) -> DataFrame:
    """Keep the first row per key, by source file and row id; NULL keys are equal.

    Every map task drops all but its first row per key before the shuffle, so a key that holds a third
    of all rows reaches its reducer as one row per map task.
    """
    content = [c for c in df.columns if c != "row_id"]
    use = [c for c in keys or [] if c in df.columns] or content
    order = [c for c in ROW_ORDER if c in df.columns and c not in use] or [
        c for c in content if c not in use
    ]
    if not order:
        return df.distinct()
    first = F.row_number().over(Window.partitionBy(*use).orderBy(*order))
    return df.withColumn("__nth", first).filter("__nth = 1").drop("__nth")


def orders_rows(df: DataFrame, keys: list[str]) -> bool:
    """Whether source file or row id say which row of a key is first, so that no other column is needed for that."""
    return any(c in df.columns and c not in keys for c in ROW_ORDER)


def first_marks(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that :func:`drop_duplicates_first` keeps of a stored table, as bits by their number, some 32,768 to a row.

    ``df`` has a different number in :data:`ROW_NUMBER` for each row, as monotonically_increasing_id gives them.  Only keys,
    order and numbers are shuffled; :func:`marked_rows` then reads the rows without a shuffle.
    """
    order = [c for c in ROW_ORDER if c in df.columns and c not in keys]
    narrow = df.select(*[c for c in df.columns if c in keys], *order, ROW_NUMBER)
    place = F.row_number().over(Window.partitionBy(*[c for c in keys if c in df.columns]).orderBy(*order, ROW_NUMBER))
    first = narrow.withColumn("__nth", place).filter("__nth = 1").select(ROW_NUMBER)
    # Masks are combined in each task before they are sent, and of one number each mask is sent once.
    masks = first.groupBy(F.shiftright(ROW_NUMBER, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({ROW_NUMBER} & 63))")).alias("mask"))
    block, within = F.shiftright("at", 9), F.col("at").bitwiseAND(F.lit(_MARKS // _MASK - 1)).cast("int")
    found = masks.groupBy(block.alias("__block")).agg(F.map_from_entries(F.collect_list(F.struct(within, "mask"))).alias("masks"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(_MARKS // _MASK - 1)), lambda i: F.coalesce(F.element_at("masks", i), F.lit(0)))
    return found.select("__block", filled.alias("__masks"))


def marked_rows(df: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of a table that :func:`first_marks` marked, without their number."""
    kept = [c for c in df.columns if c != ROW_NUMBER]
    mask = F.get("__masks", F.shiftright(ROW_NUMBER, 6).bitwiseAND(F.lit(_MARKS // _MASK - 1)).cast("int"))
    rows = df.withColumn("__block", F.shiftright(ROW_NUMBER, 15)).join(F.broadcast(marks), "__block")
    return rows.filter(F.getbit(mask, F.col(ROW_NUMBER).bitwiseAND(F.lit(_MASK - 1)).cast("int")) == 1).select(*kept)
