"""The listing jobs: deterministic cleaning, labelling, quality, analysis, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.operators import analysis, cleaning, dedup, labels, outliers, quality
from brickledger.operators.ranking import first_rows
from brickledger.sources.files import slim_for_export


def parse_listings(raw: DataFrame, all_columns: bool = False) -> DataFrame:
    """All row-level parsing: composite cells, promotion, numbers, unit price.  No shuffle.

    ``all_columns`` is the faster way where all of them are needed, as for a table that is written.
    """
    return cleaning.expand_composites(raw, all_columns).transform(cleaning.finalize)


def deduplicate(parsed: DataFrame) -> DataFrame:
    return dedup.drop_duplicates_first(parsed, dedup.resolve_dedup_keys(parsed))


def _parsed(raw: DataFrame, folder: str | None) -> DataFrame:
    """The parsed listings; with a folder, written to its ``parsed`` table and read from there."""
    if folder is None:
        return parse_listings(raw)
    parsed = parse_listings(raw, all_columns=True)
    parsed.write.mode("overwrite").parquet(f"{folder}/parsed")
    return raw.sparkSession.read.schema(parsed.schema).parquet(f"{folder}/parsed")


def _unique(raw: DataFrame, folder: str) -> DataFrame:
    """:func:`deduplicate` of the parsed listings in the folder's table ``parsed``, where each row has a number."""
    numbered = parse_listings(raw, all_columns=True).withColumn(dedup.ROW_NUMBER, F.monotonically_increasing_id())
    rows, n_rows = _write_counted(numbered, f"{folder}/parsed", compression="zstd")
    plain = rows.drop(dedup.ROW_NUMBER)
    keys = dedup.resolve_dedup_keys(plain)
    if not keys or not dedup.orders_rows(plain, keys) or n_rows > dedup.MOST_MARKED:
        return dedup.drop_duplicates_first(plain, keys)
    marks, blocks = _write_counted(dedup.first_marks(rows, keys), f"{folder}/first")
    if blocks > dedup.MOST_BLOCKS:  # of few rows each, as many small tasks wrote them
        return dedup.drop_duplicates_first(plain, keys)
    return dedup.marked_rows(rows, marks)


def clean_listings(raw: DataFrame, folder: str | None = None) -> DataFrame:
    """Parse, drop duplicates, drop price outliers, derive the floor band.

    Dedup keys and price bounds are decided by small jobs on the columns they need, so the wide rows are
    shuffled once, by dedup key.  With ``folder``, one that all executors share, the listings are parsed once into its
    table ``parsed`` and those jobs read their columns from it; where a source file or row id says which row is first, the
    wide rows are not shuffled at all (:func:`dedup.first_marks`).
    """
    unique = deduplicate(_parsed(raw, folder)) if folder is None else _unique(raw, folder)
    return unique.transform(outliers.remove_price_outliers).transform(cleaning.floor_band)


def clean_and_label(raw: DataFrame, folder: str | None = None) -> DataFrame:
    """The default job: :func:`clean_listings`, then rule-based text labels.

    The clean-up at the end of :func:`labels.rule_features` is left out, as it changes nothing in rows
    that have been through it already.
    """
    return clean_listings(raw, folder).transform(labels.text_labels)


def stage_counts(raw: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows after each stage that can drop rows, and whether it dropped the most; ``folder`` as in clean_listings.

    Rows that have dedup keys are told apart and counted by the keys, the order and the price: no other column is parsed,
    or written to the folder.  Keys are resolved on the listings before, which parses what it counts only.
    """
    lazy = parse_listings(raw)
    keys = dedup.resolve_dedup_keys(lazy)
    needed = [c for c in lazy.columns if c in {*dedup.ROW_ORDER, *(keys or []), "unit_price"}]
    if not keys or not set(dedup.ROW_ORDER) - set(keys) & set(needed):  # other columns tell rows apart or put them in order
        return _stage_counts(_parsed(raw, folder), keys)
    narrow = lazy.select(*needed)
    if folder is not None:
        narrow.write.mode("overwrite").parquet(f"{folder}/parsed")
        narrow = raw.sparkSession.read.schema(narrow.schema).parquet(f"{folder}/parsed")
    return _stage_counts(narrow, keys)


def _stage_counts(parsed: DataFrame, keys: list[str] | None) -> DataFrame:
    unique = dedup.drop_duplicates_first(parsed, keys)
    kept = outliers.is_inlier(unique, "unit_price") if "unit_price" in unique.columns else F.lit(True)
    after = unique.agg(F.count("*").alias("dedup"), F.count_if(kept).alias("iqr"))
    return _stage_rows(after.select(parsed.agg(F.count("*")).scalar().alias("input"), "*"))


def _stage_rows(counts: DataFrame) -> DataFrame:
    """One row per stage from the counts input, dedup and iqr."""
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(stage).alias("stage"), F.col(stage).alias("rows"),
                 (F.col(before) - F.col(stage)).alias("dropped"))
        for i, (stage, before) in enumerate((("input", "input"), ("dedup", "input"), ("iqr", "dedup")))
    ]
    most = F.greatest(F.col("input") - F.col("dedup"), F.col("dedup") - F.col("iqr"))
    largest = (F.col("dropped") == F.col("most")) & (F.col("dropped") > 0)
    earlier = (F.col("stage") == "iqr") & (F.col("input") - F.col("dedup") == F.col("most"))
    return counts.withColumn("most", most).select("input", "dedup", "most", F.inline(F.array(*rows))).select(
        "position", "stage", "rows", "dropped", (largest & ~earlier).alias("largest_drop")
    )


def clean_and_assess(raw: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """The labelled listings and their one-row quality report."""
    clean = clean_and_label(raw)
    return clean, quality.quality_report(raw, clean, **limits)


def report_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("value")).select(F.lit("rows").alias("metric"), "value")


def report_sample(df: DataFrame, rows: int = fixed.REPORT_SAMPLE_ROWS) -> DataFrame:
    order = [c for c in dedup.ROW_ORDER if c in df.columns] or df.columns
    return first_rows(df, list(order), rows).orderBy("__rank").drop("__rank")


def write_report(clean: DataFrame, folder: str, tasks: list[str] | None = None) -> list[str]:
    """Write sample, summary, districts, task results, task status and facts as Parquet directories.

    A task that fails, while it is set up or while it runs, has its reason in ``plan_tasks``; the others are written.
    """
    errors: dict[str, str] = {}
    needed = dict(fixed.ANALYSIS_TASKS)
    planned = analysis.applicable_tasks(clean.columns) if tasks is None else tasks
    grouped = analysis.GroupedTasks(clean, [task for task in planned if set(needed[task]) <= set(clean.columns)])
    results = analysis.run_tasks(clean, tasks, errors, grouped)
    written = []

    def write(name: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        written.append(name)

    write("clean_sample", report_sample(clean))
    write("summary", report_summary(clean))
    if "district" in clean.columns:
        write("district", analysis.district_summary(clean))
    for key, result in results.items():
        try:
            write(f"tasks/{key}", result)
        except Exception as error:
            errors[key.rpartition("_")[0]] = analysis.error_text(error)
    grouped.close()
    write("plan_tasks", analysis.task_status(clean, tasks, errors))
    write("facts", analysis.summary_facts(clean, tasks, errors))
    return written


def _write_counted(df: DataFrame, path: str, **options: str) -> tuple[DataFrame, int]:
    """df as a table, read again, and the rows written, counted on the way."""
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path), counted.get.get("rows", 0)


def run_listing_job(raw: DataFrame, folder: str, tasks: list[str] | None = None) -> DataFrame:
    """Parse, deduplicate, clean, label, write, assess, analyse, report; returns the quality report.

    The parsed, the unique and the clean table are written once each, and what follows reads the columns it needs from
    them; the rows of each stage are counted as they are written, so rows are parsed and deduplicated once.
    """
    spark = raw.sparkSession
    parsed, n_parsed = _write_counted(parse_listings(raw, all_columns=True), f"{folder}/parsed")
    unique, n_unique = _write_counted(deduplicate(parsed), f"{folder}/unique")
    kept = unique.transform(outliers.remove_price_outliers).transform(cleaning.floor_band)
    clean, n_clean = _write_counted(kept.transform(labels.text_labels), f"{folder}/clean")
    counts = spark.createDataFrame([(n_parsed, n_unique, n_clean)], "input long, dedup long, iqr long")
    _stage_rows(counts).write.mode("overwrite").parquet(f"{folder}/stages")
    slim_for_export(clean).write.mode("overwrite").parquet(f"{folder}/export")
    quality.quality_report(parsed, clean).write.mode("overwrite").parquet(f"{folder}/quality")
    write_report(clean, folder, tasks)
    return spark.read.parquet(f"{folder}/quality")
