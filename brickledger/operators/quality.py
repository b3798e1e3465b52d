"""Data quality: one aggregation over the clean table, one count of the raw one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions.numbers import to_number
from brickledger.functions.text import is_blank, meaningful


def _share(condition: Column) -> Column:
    return F.count_if(condition) / F.nullif(F.count("*"), F.lit(0))


def _filled_share(df: DataFrame, column: str) -> Column:
    return _share(~is_blank(df, column, ())) if column in df.columns else F.lit(0.0)


def quality_metrics(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row of unrounded metrics; ratios of columns the table does not have are 0 or NULL."""
    metrics = {"clean_rows": F.count("*")}
    if "unit_price" in clean.columns:
        price, (low, high) = to_number(clean, "unit_price"), fixed.UNIT_PRICE_VALID
        metrics["unit_price_valid_ratio"] = _share((price > low) & (price < high))
    else:
        metrics["unit_price_valid_ratio"] = F.lit(0.0)
    metrics["total_price_non_null_ratio"] = _filled_share(clean, "total_price")
    metrics["area_m2_non_null_ratio"] = _filled_share(clean, "area_m2")
    named = [meaningful(clean, c) for c in ("district", "community") if c in clean.columns]
    metrics["geo_non_null_ratio"] = _share(named[0] | named[-1]) if named else F.lit(0.0)
    metrics["tag_near_subway_true_ratio"] = (
        _share(F.col("tag_near_subway").cast("boolean")) if "tag_near_subway" in clean.columns
        else F.lit(None).cast("double")
    )
    metrics["description_raw_non_empty_ratio"] = (
        _share(meaningful(clean, "description_raw")) if "description_raw" in clean.columns
        else F.lit(None).cast("double")
    )
    raw_rows = raw.agg(F.count("*")).scalar()
    counted = clean.agg(*[m.alias(name) for name, m in metrics.items()])
    return counted.select(raw_rows.alias("raw_rows"), "*").withColumn(
        "row_retention_ratio",
        F.when(F.col("clean_rows") == 0, None)
        .when(F.col("raw_rows") > 0, F.col("clean_rows") / F.col("raw_rows"))
        .otherwise(1.0),
    )


def _codes(named: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, code) for code, condition in named.items()]))


def quality_report(raw: DataFrame, clean: DataFrame, **limits) -> DataFrame:
    """One row: metrics (4 decimals), blocking ``failures``, ``warning_codes`` and ``passed``.

    The cleaning is deterministic, so a failed report is final: cleaning again would give it again.
    """
    limits = {**fixed.QUALITY_DEFAULTS, **limits}
    c = F.col
    some = c("clean_rows") > 0
    enough_raw = c("raw_rows") >= fixed.RETENTION_MIN_RAW_ROWS
    critical = some & enough_raw & (c("row_retention_ratio") < fixed.RETENTION_BLOCK)
    price, total, area = (
        c("unit_price_valid_ratio"), c("total_price_non_null_ratio"), c("area_m2_non_null_ratio")
    )
    pair = F.least(total, area)
    price_ok = (
        (price >= limits["min_unit_price_coverage"])
        | (pair >= fixed.DERIVABLE_SHARE)
    )
    failures = {"clean_empty": ~some, "row_retention_critical": critical}
    warnings = {
        "row_retention_low": (
            some & enough_raw & ~critical & (c("row_retention_ratio") < limits["min_retention_ratio"])
        ),
        "too_few_rows": (
            some & (c("clean_rows") < limits["min_rows"]) & (c("raw_rows") >= limits["min_rows"])
        ),
        "price_fields_weak": some & ~price_ok,
        "unit_price_sparse": some & price_ok & (price < fixed.UNIT_PRICE_SPARSE),
        "geo_sparse": some & (c("geo_non_null_ratio") < limits["min_geo_coverage"]),
        "tag_near_subway_sparse": (
            some & (F.round(c("tag_near_subway_true_ratio"), 4) < fixed.SUBWAY_SHARE_WARN)  # as the report shows it
        ),
    }
    metrics = quality_metrics(raw, clean).withColumns({
        "failures": _codes(failures), "warning_codes": _codes(warnings),
    })
    ratios = [name for name in metrics.columns if name.endswith("_ratio")]
    return metrics.withColumns(
        {name: F.round(name, 4) for name in ratios} | {"passed": F.size("failures") == 0}
    )
