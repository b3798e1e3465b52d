"""Aggregate analyses of a clean listings table.

Every analysis is one grouped aggregation with map-side combine over two or three columns; nothing is
broadcast but the commonest layouts.  Run together (:func:`run_tasks`), all that group the table are one aggregation
over grouping sets.  Analyses of the task list give no rows for a table of fewer than ``min_rows`` rows, five unless
told otherwise; 0 turns that off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions import cells
from brickledger.functions.numbers import to_number
from brickledger.operators.outliers import price_outliers
from brickledger.operators.quantiles import approximate_quantiles, exact_quantiles, value_counts


def _pairs(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()]).dropna()


def _enough(rows: DataFrame, min_rows: int) -> Column:
    """Whether there are at least ``min_rows`` rows, which a count of at most that many tells."""
    if min_rows <= 0:
        return F.lit(True)
    return rows.select(F.lit(1)).limit(min_rows).agg(F.count("*")).scalar() >= min_rows


def _mean_price_by(df: DataFrame, min_rows: int, **key: Column) -> DataFrame:
    """Mean unit price per key.  Groups without a key or a price go by their count, after the
    aggregation: a filter in front of it would be pushed down and have both computed twice."""
    (name,) = key
    rows = df.select(key[name].alias(name), to_number(df, "unit_price").alias("price"))
    means = rows.groupBy(name).agg(
        F.avg("price").alias("unit_price"),
        F.count(F.when(F.col(name).isNotNull(), F.col("price"))).alias("__n"),
    )
    return means.filter("__n > 0").drop("__n").filter(_enough(df, min_rows))


def _band_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, label) for i, (label, _, _) in enumerate(fixed.AREA_BANDS)], "position int, band string"
    )


def _band_position(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(label) for label, _, _ in fixed.AREA_BANDS]), band)


# --- Fixed analyses --------------------------------------------------------------------------------


def district_summary(df: DataFrame) -> DataFrame:
    """Listings and mean unit price per district; the NULL district is a group with 0 listings."""
    price = to_number(df, "unit_price") if "unit_price" in df.columns else F.lit(None).cast("double")
    return df.groupBy("district").agg(
        F.count("district").alias("listings"), F.avg(price).alias("avg_unit_price")
    )


def price_quantiles(df: DataFrame, approx: bool = False) -> DataFrame:
    """Five-number summary of the unit price; ``approx`` takes the inner three from a sketch, in one read."""
    names = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "max": 1.0}
    found = (approximate_quantiles if approx else exact_quantiles)(df, to_number(df, "unit_price"), list(names.values())).get("")
    rows = [[found[q] for q in names.values()]] if found else []
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def area_buckets(df: DataFrame) -> DataFrame:
    """Listings per area band, zero for empty bands; areas outside all bands are left out."""
    counts = area_band_counts(df)
    bands = _band_table(df.sparkSession)
    return bands.join(F.broadcast(counts), "band", "left").select(  # both sides: five rows
        "position", "band", F.coalesce("listings", F.lit(0)).alias("listings")
    )


def area_band_counts(df: DataFrame) -> DataFrame:
    bands = df.select(cells.area_band(to_number(df, "area_m2")).alias("band")).groupBy("band")
    return bands.agg(F.count("band").alias("listings")).filter("listings > 0")


def decade_avg(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    """Mean unit price per building decade, given at least five listings with both values."""
    year, price = to_number(df, "build_year"), to_number(df, "unit_price")
    rows = df.select(cells.decade(year).alias("decade_start"), price.alias("price"))
    valid = F.count(F.when(F.col("decade_start").isNotNull(), F.col("price")))
    means = rows.groupBy("decade_start").agg(F.avg("price").alias("avg_unit_price"), valid.alias("__n")).filter("__n > 0")
    # The listings with both are those of all decades, which are few, so the table is not read again for them.
    everywhere = F.sum("__n").over(Window.partitionBy(F.lit(0)))
    return means.withColumn("__all", everywhere).filter(F.col("__all") >= min_rows).drop("__n", "__all")


# --- Task list -------------------------------------------------------------------------------------


def district_price_rank(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    means = _mean_price_by(df, min_rows, district=F.col("district"))
    return means.orderBy(F.desc("unit_price"), "district")


def top_layouts(df: DataFrame, layouts: int = fixed.TOP_LAYOUTS, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    """The commonest layouts among listings with a unit price; equal counts in layout order."""
    rows = df.select(F.col("layout").alias("category"), to_number(df, "unit_price").alias("price"))
    counted = rows.groupBy("category").agg(F.count("price").alias("n")).filter("category IS NOT NULL AND n > 0")
    return _commonest(counted.filter(_enough(df, min_rows)), layouts)


def _commonest(counted: DataFrame, layouts: int) -> DataFrame:
    return counted.orderBy(F.desc("n"), "category").limit(layouts).select("category")


def layout_price_box(
    df: DataFrame, layouts: int = fixed.TOP_LAYOUTS, min_rows: int = fixed.MIN_ROWS
) -> DataFrame:
    """(category, unit_price) of all listings of the commonest layouts, of which there are ``layouts``."""
    return _of_layouts(df, top_layouts(df, layouts, min_rows))


def _of_layouts(df: DataFrame, layouts: DataFrame) -> DataFrame:
    priced = _pairs(df, category=F.col("layout"), unit_price=to_number(df, "unit_price"))
    return priced.join(F.broadcast(layouts), "category", "left_semi")  # as many rows as asked for


def layout_box_stats(
    df: DataFrame, layouts: int = fixed.TOP_LAYOUTS, min_rows: int = fixed.MIN_ROWS, approx: bool = False
) -> DataFrame:
    """Five-number summary per layout of :func:`layout_price_box`; ``approx`` as in :func:`price_quantiles`."""
    names = {"min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "max": 1.0}
    found = (approximate_quantiles if approx else exact_quantiles)(
        layout_price_box(df, layouts, min_rows), F.col("unit_price"), list(names.values()), F.col("category")
    )
    rows = [[category, s["n"], *[s[q] for q in names.values()]] for category, s in found.items()]
    schema = "category string, listings bigint, " + ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame(rows, schema)


def area_band_price(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    means = _mean_price_by(df, min_rows, band=cells.area_band(to_number(df, "area_m2")))
    return _in_band_order(means)


def _in_band_order(bands: DataFrame) -> DataFrame:
    return bands.orderBy(_band_position(F.col("band")))


def area_band_share(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    """Listings per non-empty area band, given at least ``min_rows`` listings with an area."""
    area = to_number(df, "area_m2")
    rows = df.select(area.alias("area"), cells.area_band(area).alias("band"))
    counts = rows.groupBy("band").agg(F.count("band").alias("count")).filter(F.col("count") > 0)
    return _in_band_order(counts.filter(_enough(rows.filter("area IS NOT NULL"), min_rows)))


def decoration_price(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    return _mean_price_by(df, min_rows, decoration=F.col("decoration"))


def floor_band_price(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    return _mean_price_by(df, min_rows, floor_band=F.col("floor_band"))


def age_price_trend(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    return _mean_price_by(df, min_rows, decade_start=cells.decade(to_number(df, "build_year")))


def community_followers(
    df: DataFrame, communities: int = fixed.TOP_COMMUNITIES, min_rows: int = fixed.MIN_ROWS
) -> DataFrame:
    """The communities with most followers, of which there are ``communities``."""
    pairs = df.select("community", to_number(df, "followers").alias("f"))
    sums = pairs.groupBy("community").agg(
        F.sum("f").alias("followers"),
        F.count(F.when(F.col("community").isNotNull(), F.col("f"))).alias("__n"),
    )
    return _most_followed(sums.filter("__n > 0").drop("__n").filter(_enough(df, min_rows)), communities)


def _most_followed(sums: DataFrame, communities: int) -> DataFrame:
    return sums.orderBy(F.desc("followers"), "community").limit(communities)


def total_area_scatter(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    """All pairs; none if the table is smaller, which a count of at most ``min_rows`` rows tells."""
    pairs = _pairs(df, area_m2=to_number(df, "area_m2"), total_price=to_number(df, "total_price"))
    return pairs.filter(_enough(df, min_rows))


def price_histogram(df: DataFrame, min_rows: int = fixed.MIN_ROWS) -> DataFrame:
    """Counts of 10 to 40 equal unit-price bins by bin centre, empty bins included; infinite prices are no values.

    Prices are counted per distinct value once; the range and then the bins, at most 40 rows, come from
    those counts, so the table is read once.
    """
    counts = value_counts(df, to_number(df, "unit_price"), F.lit("")).filter(F.abs("v") < float("inf")).persist()
    try:
        n, lo, hi = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.min("v"), F.max("v")).first()
        if n < max(1, min_rows):
            return df.sparkSession.createDataFrame([], "bin double, count bigint")
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        fewest, most = fixed.HISTOGRAM_BINS
        bins = min(most, max(fewest, n // 5))
        edges = [lo + i * ((hi - lo) / bins) for i in range(bins)] + [hi]
        # The bin by division can be off by one at an edge; the edges decide.
        edge = F.array(*[F.lit(e) for e in edges])
        guess = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        exact = (
            F.when(F.col("v") < F.get(edge, F.col("i")), F.col("i") - 1)
            .when((F.col("v") >= F.get(edge, F.col("i") + 1)) & (F.col("i") < bins - 1), F.col("i") + 1)
            .otherwise(F.col("i"))
        )
        filled = counts.withColumn("i", guess).groupBy(exact.alias("i")).agg(F.sum("c").alias("n")).collect()
    finally:
        counts.unpersist()
    by_bin = {r["i"]: r["n"] for r in filled}
    rows = [((edges[i] + edges[i + 1]) / 2, by_bin.get(i, 0)) for i in range(bins)]
    return df.sparkSession.createDataFrame(rows, "bin double, count bigint")


TASKS = {
    "district_price_rank": district_price_rank,
    "layout_price_box": layout_price_box,
    "area_band_price": area_band_price,
    "area_band_share_pie": area_band_share,
    "decoration_price_compare": decoration_price,
    "floor_band_price": floor_band_price,
    "building_age_price_trend": age_price_trend,
    "community_followers_rank": community_followers,
    "total_area_scatter": total_area_scatter,
    "unit_price_histogram": price_histogram,
    "price_outlier_flag": price_outliers,
}


#: The analyses as they are here; one put in the place of another in TASKS is run itself and not taken from the groups.
_OWN_TASKS = dict(TASKS)


def applicable_tasks(columns) -> list[str]:
    """All tasks whose columns are there, in fixed order."""
    return [name for name, needed in fixed.ANALYSIS_TASKS if set(needed) <= set(columns)]


# --- All grouped analyses in one read ----------------------------------------------------------------


class GroupedTasks:
    """The analyses that group the table, from one aggregation over grouping sets, which is kept until :meth:`close`.

    With ``folder``, one that all executors share, the groups are written to its table ``groups`` at once and read from
    there.  So they must be where several results go into one plan: Spark then renames columns of all results but the
    first, does not know the kept aggregation again, and would read the whole table for each.

    The table is read once: a set for each key and one for the whole table, with all counts and sums that the analyses
    need.  Each analysis then takes its set, a few rows for all keys but layout and community.
    """

    KEYS = {
        "district": ("district", lambda df: F.col("district")),
        "layout": ("layout", lambda df: F.col("layout")),
        "decoration": ("decoration", lambda df: F.col("decoration")),
        "floor_band": ("floor_band", lambda df: F.col("floor_band")),
        "band": ("area_m2", lambda df: cells.area_band(to_number(df, "area_m2"))),
        "decade_start": ("build_year", lambda df: cells.decade(to_number(df, "build_year"))),
        "community": ("community", lambda df: F.col("community")),
    }
    NEEDS = {
        "district_price_rank": "district", "layout_price_box": "layout", "area_band_price": "band", "area_band_share_pie": "band",
        "decoration_price_compare": "decoration", "floor_band_price": "floor_band", "building_age_price_trend": "decade_start",
        "community_followers_rank": "community",
    }

    def __init__(self, df: DataFrame, tasks: list[str], min_rows: int = fixed.MIN_ROWS, folder: str | None = None):
        self.df, self.min_rows = df, min_rows
        self.keys = [key for key in self.KEYS if key in {self.NEEDS.get(task) for task in tasks}]
        numbers = {"price": "unit_price", "followers": "followers", "area": "area_m2"}
        rows = df.select(
            *[self.KEYS[key][1](df).alias(key) for key in self.keys],
            *[(to_number(df, c) if c in df.columns else F.lit(None).cast("double")).alias(f"__{name}") for name, c in numbers.items()],
        )
        measures = [
            F.grouping_id().alias("__set"), F.count("*").alias("__n"), F.avg("__price").alias("unit_price"),
            F.count("__price").alias("__prices"), F.sum("__followers").alias("followers"), F.count("__followers").alias("__followed"),
            F.count("__area").alias("__areas"),
        ]
        sets = [[F.col(key)] for key in self.keys] + [[]]
        sums = rows.groupingSets(sets, *[F.col(key) for key in self.keys]).agg(*measures)
        if folder is None:
            self.sums = sums.persist()
        else:
            sums.write.mode("overwrite").parquet(f"{folder}/groups")
            self.sums = df.sparkSession.read.schema(sums.schema).parquet(f"{folder}/groups")

    def close(self) -> None:
        self.sums.unpersist()

    def _of(self, key: str, counted: str) -> DataFrame:
        """The groups of a key that have one, and something counted."""
        everything = (1 << len(self.keys)) - 1
        bit = 1 << (len(self.keys) - 1 - self.keys.index(key))
        return self.sums.filter((F.col("__set") == everything - bit) & F.col(key).isNotNull() & (F.col(counted) > 0))

    def _enough(self, counted: str = "__n") -> Column:
        if self.min_rows <= 0:
            return F.lit(True)
        everything = self.sums.filter(F.col("__set") == (1 << len(self.keys)) - 1)
        return F.coalesce(everything.agg(F.max(counted)).scalar(), F.lit(0)) >= self.min_rows

    def _means(self, key: str) -> DataFrame:
        return self._of(key, "__prices").select(key, "unit_price").filter(self._enough())

    def result(self, task: str) -> DataFrame:
        key = self.NEEDS[task]
        if task == "district_price_rank":
            return self._means(key).orderBy(F.desc("unit_price"), "district")
        if task == "layout_price_box":
            counted = self._of(key, "__prices").select(F.col(key).alias("category"), F.col("__prices").alias("n"))
            return _of_layouts(self.df, _commonest(counted.filter(self._enough()), fixed.TOP_LAYOUTS))
        if task == "area_band_price":
            return _in_band_order(self._means(key))
        if task == "area_band_share_pie":
            return _in_band_order(self._of(key, "__n").select(key, F.col("__n").alias("count")).filter(self._enough("__areas")))
        if task == "community_followers_rank":
            sums = self._of(key, "__followed").select(key, "followers")
            return _most_followed(sums.filter(self._enough()), fixed.TOP_COMMUNITIES)
        return self._means(key)


def run_tasks(
    df: DataFrame, tasks: list[str] | None = None, errors: dict[str, str] | None = None, grouped: GroupedTasks | None = None
) -> dict[str, DataFrame]:
    """One DataFrame per planned task whose columns are there, keyed '<task>_<position>'.

    All tasks that group the table share one aggregation, see :class:`GroupedTasks`; give one as ``grouped`` to close it
    when the results are written.  A task that fails while it is set up ends up in ``errors`` with its reason, if that
    is given; the others go on.
    """
    planned = applicable_tasks(df.columns) if tasks is None else tasks
    needed = dict(fixed.ANALYSIS_TASKS)
    able = [name for name in planned if set(needed[name]) <= set(df.columns)]
    if grouped is None and any(name in GroupedTasks.NEEDS for name in able):
        grouped = GroupedTasks(df, able)
    results = {}
    for i, name in enumerate(planned):
        if name not in able:
            continue
        try:
            shared = grouped and name in GroupedTasks.NEEDS and TASKS[name] is _OWN_TASKS[name]
            results[f"{name}_{i}"] = grouped.result(name) if shared else TASKS[name](df)
        except Exception as error:
            if errors is None:
                raise
            errors[name] = error_text(error)
    return results


def error_text(error: Exception) -> str:
    """The first line of an error with its kind."""
    return f"{type(error).__name__}: {(str(error).strip().splitlines() or [''])[0]}"


def _task_counts(df: DataFrame, planned: list[str], errors: dict[str, str]) -> tuple[list[Column], list[Column]]:
    """Aggregates named n, v0, v1, ... and, from those, one (position, task, reason) struct per task."""
    needed = dict(fixed.ANALYSIS_TASKS)

    def filled(*columns: str) -> Column:
        tests = [to_number(df, c) if c in fixed.NUMERIC_COLUMNS else F.col(c) for c in columns]
        test = tests[0].isNotNull()
        for other in tests[1:]:
            test &= other.isNotNull()
        return F.count_if(test)

    counts = [F.count("*").alias("n")]
    rows = []
    for i, name in enumerate(planned):
        present = set(needed[name]) <= set(df.columns)
        least = {"district_price_rank": 1, "area_band_share_pie": fixed.MIN_ROWS,
                 "unit_price_histogram": fixed.MIN_ROWS, "price_outlier_flag": fixed.MIN_ROWS}.get(name, 0)
        counts.append((filled(*needed[name]) if present else F.lit(0)).alias(f"v{i}"))
        reason = F.lit("missing columns") if not present else (
            F.lit(errors[name]) if name in errors
            else F.when(F.col("n") < fixed.MIN_ROWS, "too few rows").when(F.col(f"v{i}") < least, "too few values")
        )
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("task"), reason.alias("reason")))
    return counts, rows


_NO_TASKS = "position int, task string, ok boolean, reason string"


def task_status(
    df: DataFrame, tasks: list[str] | None = None, errors: dict[str, str] | None = None
) -> DataFrame:
    """One row per planned task: position, task, whether it gives a result, and why not.

    All row counts the tasks depend on come from one aggregation; ``errors`` has the reasons of tasks that failed.
    """
    planned = applicable_tasks(df.columns) if tasks is None else tasks
    if not planned:
        return df.sparkSession.createDataFrame([], _NO_TASKS)
    counts, rows = _task_counts(df, planned, errors or {})
    status = df.agg(*counts).select(F.inline(F.array(*rows)))
    return status.select("position", "task", F.col("reason").isNull().alias("ok"), "reason")


def status_by_columns(df: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """:func:`task_status` of parts of the table's columns, as (variant, position, task, ok, reason).

    One aggregation has the counts of all: a task's count is the same wherever its columns are there.
    """
    counts, offered = _task_counts(df, applicable_tasks(df.columns), {})
    states = dict(zip(applicable_tasks(df.columns), offered))
    rows = [
        F.struct(F.lit(name).alias("variant"), F.lit(i).alias("position"), F.lit(task).alias("task"), states[task]["reason"].alias("reason"))
        for name, columns in variants.items() for i, task in enumerate(applicable_tasks(columns))
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], f"variant string, {_NO_TASKS}")
    status = df.agg(*counts).select(F.inline(F.array(*rows)))
    return status.select("variant", "position", "task", F.col("reason").isNull().alias("ok"), "reason")


def summary_facts(
    df: DataFrame, tasks: list[str] | None = None, errors: dict[str, str] | None = None
) -> DataFrame:
    """The numbers of a written summary as (section, rank, label, value) rows.

    The table is read three times: for one aggregate with all counts and the mean, for the price quantiles, and for
    one aggregate by district.
    """
    spark = df.sparkSession
    planned = applicable_tasks(df.columns) if tasks is None else tasks
    counts, states = _task_counts(df, planned, errors or {})
    price = to_number(df, "unit_price") if "unit_price" in df.columns else F.lit(None).cast("double")
    measures = [*counts, F.avg(price).alias("mean")]
    if "area_m2" in df.columns:
        band = cells.area_band(to_number(df, "area_m2"))
        measures += [F.count_if(band == label).alias(f"b{i}") for i, (label, _, _) in enumerate(fixed.AREA_BANDS)]

    def fact(section: str, rank, label, value: Column) -> Column:
        made = {"section": F.lit(section), "rank": rank if isinstance(rank, Column) else F.lit(rank),
                "label": label if isinstance(label, Column) else F.lit(label), "value": value.cast("double")}
        return F.struct(*[c.alias(name) for name, c in made.items()])

    facts = [fact("overview", 1, "rows", F.col("n"))]
    if "unit_price" in df.columns:
        facts.append(fact("price", 6, "mean", F.col("mean")))
    done = F.size(F.filter(F.array(*[s["reason"] for s in states]), lambda r: r.isNull())) if states else F.lit(0)
    facts += [fact("tasks", 1, "ok", done), fact("tasks", 2, "total", F.lit(len(states)))]
    if "area_m2" in df.columns:
        # Largest first, equal ones in band order.
        bands = F.array_sort(F.array(*[
            F.struct((-F.col(f"b{i}")).alias("minus"), F.lit(i).alias("i"), F.lit(label).alias("band"))
            for i, (label, _, _) in enumerate(fixed.AREA_BANDS)
        ]))
        facts += [fact("area_bands", k + 1, bands[k]["band"], -bands[k]["minus"]) for k in range(3)]
    parts = [df.agg(*measures).select(F.inline(F.array(*facts)))]
    if "unit_price" in df.columns:
        names = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0}
        found = exact_quantiles(df, price, list(names.values())).get("")
        rows = [("price", i + 1, name, float(found[q])) for i, (name, q) in enumerate(names.items())] if found else []
        parts.append(spark.createDataFrame(rows, "section string, rank int, label string, value double"))
    if "district" in df.columns:
        order = (F.desc("listings"), F.asc_nulls_last("district"))
        top = district_summary(df).orderBy(*order).limit(5)
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        name = F.coalesce("district", F.lit(""))
        both = F.array(
            fact("district_listings", F.col("rank"), name, F.col("listings")),
            fact("district_price", F.col("rank"), name, F.col("avg_unit_price")),
        )
        parts.append(top.select(F.inline(both)))
    return reduce(DataFrame.union, parts)
