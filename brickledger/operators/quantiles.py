"""Exact quantiles without ever holding all values in one place.

The built-in exact percentile merges every distinct value into one buffer in one task.  Here values are
counted per distinct value first (a shuffle with map-side combine, so a value that fills a third of the
table is one row per map task).  The wanted ranks are then narrowed down: a histogram over logarithmic
buckets, of which a DOUBLE has a few million at most, then histograms of equal slices of the few buckets
that hold a wanted rank, until such a piece has at most ``sortable`` distinct values, which one task
can sort.  Both bucket functions are monotone, so the answer is exact.  Each step brings back two rows
per quantile; with prices one histogram and one sort are enough.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch and the rank error that goes with it: of all values by that share at most, with 99 % confidence.
SKETCH_SIZE, SKETCH_RANK_ERROR = 1000, 0.0033
_PER_E_FOLD = 1024
_OFFSET = 1024 * 800
_SLICES = 4096
#: Distinct values that one task may sort.
SORTABLE = 1_000_000
#: Groups whose results one call may bring to the driver.
MAX_GROUPS = 10_000


def value_counts(df: DataFrame, value: Column, by: Column) -> DataFrame:
    """Rows per group and value.  NULL and NaN are dropped by their count, after the aggregation: a filter
    on the value would be pushed down and have it computed twice."""
    number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    rows = df.select(by.alias("g"), number.alias("v"))
    return rows.groupBy("g", "v").agg(F.count("v").alias("c")).filter("c > 0")


def _log_bucket(v: Column) -> Column:
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(799.0)) * _PER_E_FOLD) + _OFFSET
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def _ranked(rows: DataFrame, piece: str, place: str) -> DataFrame:
    """Add how many values lie below each row of its piece."""
    before = Window.partitionBy(piece).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _histogram(rows: DataFrame, piece: str, place: Column) -> DataFrame:
    cells = rows.groupBy(piece, place.alias("place")).agg(
        F.sum("c").alias("n"), F.count("*").alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    return _ranked(cells, piece, "place")


def _holding(ranked: DataFrame, wanted: dict) -> list:
    """The rows in which wanted ranks fall, with the key of the wanted rank."""
    asked = F.array(*[
        F.struct(F.lit(key).alias("key"), F.lit(piece).alias("of"), F.lit(rank).alias("rank"))
        for key, (piece, rank) in wanted.items()
    ])
    here = F.filter(asked, lambda w: (w["of"] == F.col("piece")) & (w["rank"] >= F.col("below")) & (w["rank"] < F.col("below") + F.col("n")))
    return ranked.withColumn("here", here).filter(F.size("here") > 0).withColumn("w", F.explode("here")).drop("here").collect()


def _in_piece(pieces: list) -> Column:
    """Number of the (group, low, high) piece a row is in, else NULL."""
    return F.coalesce(*[
        F.when((F.col("g") == g) & F.col("v").between(low, high), F.lit(k))
        for k, (g, low, high) in enumerate(pieces)
    ])


def exact_quantiles(
    df: DataFrame, value: Column, probabilities: list[float], by: Column | None = None, sortable: int = SORTABLE,
    max_groups: int = MAX_GROUPS,
) -> dict[object, dict]:
    """Linearly interpolated quantiles: {group: {"n": values, probability: quantile, ...}}.

    Meant for a handful of groups, whose results are driver-side numbers, more than ``max_groups`` are an error;
    without ``by`` the group is ''.
    """
    counts = value_counts(df, value, F.lit("") if by is None else by).persist()
    try:
        groups = counts.groupBy("g").agg(F.sum("c").alias("n")).limit(max_groups + 1).collect()
        if len(groups) > max_groups:
            raise ValueError(f"more than {max_groups} groups")
        totals = {r["g"]: r["n"] for r in groups}
        ranks = {}
        for g, n in totals.items():
            for q in probabilities:
                for rounded in (floor, ceil):
                    ranks[f"{len(ranks)}"] = (g, rounded((n - 1) * q))
        if not ranks:
            return {}
        found = _values_at(counts, ranks, sortable)
    finally:
        counts.unpersist()
    results, key = {}, iter(ranks)
    for g, n in totals.items():
        results[g] = {"n": n}
        for q in probabilities:
            low, high = found[next(key)], found[next(key)]
            place = (n - 1) * q
            results[g][q] = low if low == high else low + (high - low) * (place - floor(place))
    return results


def _values_at(counts: DataFrame, ranks: dict[str, tuple[object, int]], sortable: int) -> dict[str, float]:
    buckets = _histogram(counts.withColumnRenamed("g", "piece"), "piece", _log_bucket(F.col("v")))
    hits, groups = _holding(buckets, ranks), {key: g for key, (g, _) in ranks.items()}
    while True:
        pieces = sorted({(groups[r["w"]["key"]], r["low"], r["high"]) for r in hits})
        number = {piece: k for k, piece in enumerate(pieces)}
        wanted = {
            r["w"]["key"]: (
                number[(groups[r["w"]["key"]], r["low"], r["high"])], r["w"]["rank"] - r["below"]
            )
            for r in hits
        }
        rows = counts.withColumn("piece", _in_piece(pieces)).filter("piece IS NOT NULL")
        if max(r["distinct"] for r in hits) <= sortable:
            values = _ranked(rows.withColumn("n", F.col("c")), "piece", "v")
            return {r["w"]["key"]: r["v"] for r in _holding(values, wanted)}
        share = F.coalesce(*[
            F.when(F.col("piece") == k, F.try_divide(F.col("v") - low, F.lit(high - low)))
            for k, (_, low, high) in enumerate(pieces)
        ])
        hits = _holding(_histogram(rows, "piece", F.floor(share * _SLICES)), wanted)


def value_sketches(df: DataFrame, value: Column, by: Column | None = None, size: int = SKETCH_SIZE) -> DataFrame:
    """(g, n, low, high, sketch): a mergeable sketch of the values of each group, one read with map-side merge.

    Sketches may be written, one table for each part of the data, and merged later by :func:`merged_sketches`, so new
    data do not call for old data to be read again.  NULL and NaN are no values, infinite values are.
    """
    number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    rows = df.select((F.lit("") if by is None else by).alias("g"), number.alias("v"))
    found = rows.groupBy("g").agg(
        F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", size).alias("sketch")
    )
    return found.filter("n > 0")


def merged_sketches(sketches: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per group from any number of :func:`value_sketches`."""
    return sketches.groupBy("g").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", size).alias("sketch")
    )


def sketched_quantiles(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """(g, n, q0, q1, ...): a value for each probability whose rank is off by SKETCH_RANK_ERROR of n at most.

    The least and the largest value are exact.
    """
    def at(q: float) -> Column:
        ends = {0.0: F.col("low"), 1.0: F.col("high")}
        return ends[q] if q in ends else F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))

    return sketches.select("g", "n", *[at(q).alias(f"q{i}") for i, q in enumerate(probabilities)])


def approximate_quantiles(
    df: DataFrame, value: Column, probabilities: list[float], by: Column | None = None, max_groups: int = MAX_GROUPS
) -> dict[object, dict]:
    """:func:`exact_quantiles` from sketches: one job, values as :func:`sketched_quantiles` has them."""
    rows = sketched_quantiles(value_sketches(df, value, by), probabilities).limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise ValueError(f"more than {max_groups} groups")
    return {r["g"]: {"n": r["n"], **{q: r[f"q{i}"] for i, q in enumerate(probabilities)}} for r in rows}
