"""Dedup, quantiles, outliers, analyses, quality and profile."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickledger.operators import analysis, dedup, outliers, profile, quality, quantiles


def test_dedup_keys(spark):
    one = spark.createDataFrame([(100.0, i) for i in range(50)], "total_price double, other int")
    assert dedup.resolve_dedup_keys(one) is None
    two = spark.createDataFrame([("金堂", 80.0)] * 20, "district string, total_price double")
    assert set(dedup.resolve_dedup_keys(two)) == {"district", "total_price"}
    files = spark.createDataFrame([(f, str(i), 1.0) for f in "ab" for i in range(3)],
                                  "ingest_file string, listing_id string, total_price double")
    assert dedup.resolve_dedup_keys(files) == ["ingest_file", "listing_id"]
    assert dedup.drop_duplicates_first(files, ["ingest_file", "listing_id"]).count() == 6
    assert dedup.resolve_dedup_keys(files.filter("ingest_file = 'a'").drop("ingest_file")) == ["listing_id"]
    assert dedup.resolve_dedup_keys(files.drop("ingest_file")) == ["listing_id", "total_price"]
    untagged = files.withColumn("ingest_file", F.lit(None).cast("string"))
    assert dedup.resolve_dedup_keys(untagged) == ["listing_id", "total_price"]
    assert dedup.resolve_dedup_keys(files.limit(0)) is None


def test_dedup_keeps_first_row_and_takes_nulls_as_equal(spark):
    rows = [("b", None, "3"), ("a", None, "2"), ("a", "x", "9"), ("a", None, "1"), ("a", "x", "8")]
    df = spark.createDataFrame(rows, "ingest_file string, listing_id string, row_id string")
    kept = dedup.drop_duplicates_first(df, ["ingest_file", "listing_id"]).collect()
    assert sorted(r["row_id"] for r in kept) == ["1", "3", "8"]
    whole = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "c string, row_id string")
    assert sorted(r["row_id"] for r in dedup.drop_duplicates_first(whole, None).collect()) == ["1", "3"]
    assert dedup.drop_duplicates_first(whole.select("c"), None).count() == 2


@pytest.mark.parametrize("sortable", [1_000_000, 3])
def test_quantiles_against_numpy(spark, sortable):
    rng = random.Random(1)
    data = {
        "skewed": [7.25] * 300 + [rng.lognormvariate(9, 1) for _ in range(500)],
        "mixed": [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 6) for _ in range(301)] + [0.0] * 5,
        "one": [3.5],
    }
    rows = [(g, v) for g, values in data.items() for v in values] + [("skewed", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = quantiles.exact_quantiles(df, F.col("v"), probabilities, F.col("g"), sortable)
    for g, values in data.items():
        assert found[g]["n"] == len(values)
        assert np.allclose([found[g][q] for q in probabilities], np.quantile(values, probabilities), rtol=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), F.col("v"), [0.5]) == {}


def test_quantiles_with_infinities(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),), (2.0,), (3.0,)], "v double")
    found = quantiles.exact_quantiles(df, F.col("v"), [0.0, 0.25, 0.5, 1.0])[""]
    assert [found[q] for q in (0.0, 0.25, 0.5, 1.0)] == [float("-inf"), 1.0, 2.0, float("inf")]


def test_iqr(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(100, 120), 5000]] + [(None,)], "unit_price double")
    assert outliers.remove_price_outliers(df).count() == 21
    few = df.filter("unit_price IS NULL OR unit_price < 105 OR unit_price = 5000")
    assert outliers.remove_price_outliers(few).count() == few.count()
    row = outliers.price_outliers(df).first()
    assert (row["valid_rows"], row["outlier_rows"]) == (21, 1)
    assert outliers.price_outliers(df.limit(3)).count() == 0
    assert outliers.remove_price_outliers(df.withColumnRenamed("unit_price", "p"), "unit_price").count() == 22


@pytest.fixture(scope="module")
def market(spark):
    rows = [
        ("海淀区", 70000.0, "2室", 60.0, 2005, "A", 5.0), ("海淀区", 72000.0, "2室", 60.5, 2012, "B", 7.0),
        ("朝阳区", 65000.0, "3室", 101.0, 1999, "A", None), ("朝阳区", None, "3室", 20000.0, 2001, "B", 1.0),
        (None, 66000.0, "2室", 0.0, None, "C", 4.0), ("西城区", 64000.0, None, None, 2005, None, 9.0),
    ]
    return spark.createDataFrame(
        rows, "district string, unit_price double, layout string, area_m2 double, build_year int, "
              "community string, followers double")


def test_fixed_analyses(market):
    summary = {r["district"]: tuple(r[1:]) for r in analysis.district_summary(market).collect()}
    assert summary == {"海淀区": (2, 71000.0), "朝阳区": (2, 65000.0), None: (0, 66000.0), "西城区": (1, 64000.0)}
    assert analysis.district_summary(market.drop("unit_price")).filter("avg_unit_price IS NOT NULL").count() == 0
    assert tuple(analysis.price_quantiles(market).first()) == (64000.0, 65000.0, 66000.0, 70000.0, 72000.0)
    assert [r["listings"] for r in analysis.area_buckets(market).orderBy("position").collect()] == [1, 1, 1, 0, 0]
    assert analysis.decade_avg(market).count() == 0


def test_task_analyses(market):
    ranked = [tuple(r) for r in analysis.district_price_rank(market).collect()]
    assert ranked == [("海淀区", 71000.0), ("朝阳区", 65000.0), ("西城区", 64000.0)]
    assert {tuple(r) for r in analysis.layout_price_box(market).collect()} == {
        ("2室", 70000.0), ("2室", 72000.0), ("2室", 66000.0), ("3室", 65000.0)}
    box = {r["category"]: r for r in analysis.layout_box_stats(market).collect()}
    assert (box["2室"]["listings"], box["2室"]["p50"]) == (3, 70000.0)
    assert [tuple(r) for r in analysis.area_band_price(market).collect()] == [
        ("<=60", 70000.0), ("60-90", 72000.0), ("90-120", 65000.0)]
    assert [tuple(r) for r in analysis.area_band_share(market).collect()] == [("<=60", 1), ("60-90", 1), ("90-120", 1)]
    assert {tuple(r) for r in analysis.age_price_trend(market).collect()} == {
        (2000, 67000.0), (2010, 72000.0), (1990, 65000.0)}
    assert [tuple(r) for r in analysis.community_followers(market).collect()] == [("B", 8.0), ("A", 5.0), ("C", 4.0)]
    assert analysis.district_price_rank(market.limit(4)).count() == 0
    assert analysis.district_price_rank(market.limit(4), min_rows=0).count() == 2
    assert analysis.total_area_scatter(market.limit(4).withColumn("total_price", F.lit(1.0))).count() == 0
    assert analysis.community_followers(market, communities=1).count() == 1
    assert analysis.layout_price_box(market, layouts=1).count() == 3


def test_histogram_leaves_out_infinite_prices(spark, market):
    more = market.union(market.limit(1).withColumn("unit_price", F.lit(float("inf"))))
    bins = analysis.price_histogram(more).collect()
    assert sum(r["count"] for r in bins) == 5 and bins == analysis.price_histogram(market).collect()


def test_failing_task_has_its_reason_and_others_go_on(spark, market, tmp_path, monkeypatch):
    from brickledger.plans import etl

    def eager(df):
        raise ValueError("no way\nat all")

    def lazy(df):
        return df.select(F.raise_error(F.lit("not now")).alias("x"))

    monkeypatch.setitem(analysis.TASKS, "district_price_rank", eager)
    monkeypatch.setitem(analysis.TASKS, "area_band_price", lazy)
    etl.write_report(market, str(tmp_path))
    state = {r["task"]: (r["ok"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/plan_tasks").collect()}
    assert state["district_price_rank"] == (False, "ValueError: no way")
    assert state["area_band_price"][0] is False and "not now" in state["area_band_price"][1]
    assert state["unit_price_histogram"] == (True, None)
    assert spark.read.parquet(f"{tmp_path}/tasks/unit_price_histogram_6").count() == 10
    facts = {r["label"]: r["value"] for r in spark.read.parquet(f"{tmp_path}/facts").collect() if r["section"] == "tasks"}
    assert facts["total"] - facts["ok"] >= 2


def test_two_level_top_rows(spark):
    from brickledger.operators.ranking import first_rows

    df = spark.range(20_000).selectExpr("id * 7919 % 20000 as v", "id % 3 as g").repartition(1000)
    top = first_rows(df, ["v"], 5)
    assert [(r["v"], r["__rank"]) for r in top.orderBy("__rank").collect()] == [(i, i + 1) for i in range(5)]
    by = first_rows(df, [F.desc("v")], 4, "g", F.col("g") + 1)
    want = {g: sorted((i * 7919 % 20000 for i in range(g, 20_000, 3)), reverse=True)[: g + 1] for g in range(3)}
    got = {}
    for r in by.orderBy("g", "__rank").collect():
        got.setdefault(r["g"], []).append(r["v"])
    assert got == want
    # Every task of the first level passes on five rows at most: the last one gets 1024 times that at most.
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_applicable_and_status(spark, market):
    assert analysis.applicable_tasks(market.columns) == [
        "district_price_rank", "layout_price_box", "area_band_price", "area_band_share_pie",
        "building_age_price_trend", "community_followers_rank", "unit_price_histogram", "price_outlier_flag"]
    status = {r["task"]: (r["ok"], r["reason"]) for r in analysis.task_status(
        market, ["district_price_rank", "area_band_share_pie", "floor_band_price"]).collect()}
    assert status == {"district_price_rank": (True, None), "area_band_share_pie": (True, None),
                      "floor_band_price": (False, "missing columns")}
    assert not analysis.task_status(market.limit(4)).filter("ok").count()
    assert list(analysis.run_tasks(market))[0] == "district_price_rank_0"


@pytest.mark.parametrize("values", [
    [float(v) for v in range(1, 61)], [5.0] * 12, [0.1 * v for v in range(137)] + [13.6] * 40])
def test_histogram_against_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "unit_price double")
    counts, edges = np.histogram(values, bins=min(40, max(10, len(values) // 5)))
    out = analysis.price_histogram(df).collect()
    assert [r["count"] for r in out] == list(counts)
    assert np.allclose([r["bin"] for r in out], (edges[:-1] + edges[1:]) / 2)


def test_summary_facts(market):
    facts = {(r["section"], r["rank"]): (r["label"], r["value"]) for r in analysis.summary_facts(market).collect()}
    assert facts["overview", 1] == ("rows", 6.0) and facts["price", 3] == ("median", 66000.0)
    assert facts["district_listings", 1] == ("朝阳区", 2.0) and facts["district_listings", 4] == ("", 0.0)
    assert facts["area_bands", 1] == ("<=60", 1.0) and facts["tasks", 2] == ("total", 8.0)


def frame(spark, n, price=50000.0, **more):
    df = spark.range(n).select(F.lit("海淀区").alias("district"), F.lit(price).alias("unit_price"),
                               F.lit(400.0).alias("total_price"), F.lit(80.0).alias("area_m2"))
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_quality(spark):
    def codes(raw_rows, clean, **limits):
        row = quality.quality_report(spark.range(raw_rows), clean, **limits).first()
        return row["passed"], list(row["failures"]), list(row["warning_codes"])

    assert codes(40, frame(spark, 40)) == (True, [], [])
    assert codes(200, frame(spark, 3)) == (False, ["row_retention_critical"], ["too_few_rows"])
    assert codes(40, frame(spark, 40, price=1.0)) == (True, [], ["unit_price_sparse"])
    assert codes(40, frame(spark, 40).drop("total_price", "area_m2").withColumn("unit_price", F.lit(1.0))) == (
        True, [], ["price_fields_weak"])
    assert codes(40, frame(spark, 40, tag_near_subway=False)) == (True, [], ["tag_near_subway_sparse"])
    assert codes(10, frame(spark, 0)) == (False, ["clean_empty"], [])
    assert codes(40, frame(spark, 40).withColumn("district", F.lit("待定"))) == (True, [], ["geo_sparse"])
    row = quality.quality_report(spark.range(80), frame(spark, 60)).first()
    assert (row["row_retention_ratio"], row["geo_non_null_ratio"], row["tag_near_subway_true_ratio"]) == (0.75, 1.0, None)


def test_profile(spark):
    df = spark.createDataFrame([("1", None, 1.5), ("2", "a|b", None), ("3", "x/y", 2.5), ("4", "q", 3.5), ("5", "z", 4.5)],
                               "row_id string, t string, v double")
    out = {r["name"]: r for r in profile.column_profile(df, samples=2).collect()}
    assert (out["t"]["non_null_ratio"], out["t"]["samples"], out["t"]["pipe_like_ratio"]) == (0.8, ["a|b", "x/y"], 0.25)
    assert (out["v"]["samples"], out["v"]["pipe_like_ratio"], out["v"]["dtype"]) == (["1.5", "2.5"], None, "double")
    assert [r["name"] for r in profile.top_profile(profile.column_profile(df), 1).collect()] == ["t"]
    assert profile.column_profile(df.limit(0)).count() == 0


def test_grouped_tasks_are_the_analyses_in_one_read(spark):
    from verification.queries import parsed
    rows = parsed(spark, "/root/testdata/sf0.001").limit(3000).cache()
    shared = analysis.GroupedTasks(rows, list(analysis.GroupedTasks.NEEDS))
    fresh = analysis.run_tasks(rows, grouped=shared)
    for key, found in fresh.items():
        name = key.rpartition("_")[0]
        if name in analysis.GroupedTasks.NEEDS and name != "layout_price_box":
            alone = analysis.TASKS[name](rows)
            round_ = lambda df: [tuple(round(c, 6) if isinstance(c, float) else c for c in r) for r in df.collect()]
            assert found.columns == alone.columns and sorted(round_(found), key=str) == sorted(round_(alone), key=str)
    assert sorted(map(str, fresh["layout_price_box_1"].collect())) == sorted(map(str, analysis.layout_price_box(rows).collect()))
    assert shared.sums.is_cached and "Expand" in shared.sums._jdf.queryExecution().optimizedPlan().toString()
    shared.close()
    few = rows.limit(4)
    assert all(df.count() == 0 for key, df in analysis.run_tasks(few).items() if key.rpartition("_")[0] in analysis.GroupedTasks.NEEDS)


def test_groups_do_not_meet_in_one_task(spark):
    from verification.queries import parsed
    rows = parsed(spark, "/root/testdata/sf0.001")
    for job in (analysis.decoration_price, analysis.floor_band_price, analysis.community_followers):
        plan = job(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan


def test_quantile_sketches_keep_their_rank_error(spark):
    import random
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 2) for _ in range(60_000)] + [5.0] * 20_000
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "part int, v double").repartition(8)
    wanted = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found = quantiles.approximate_quantiles(df, F.col("v"), wanted)[""]
    parts = quantiles.value_sketches(df, F.col("v"), F.col("part"))
    merged = quantiles.sketched_quantiles(quantiles.merged_sketches(parts.withColumn("g", F.lit("all"))), wanted).first()
    order = sorted(values)
    for i, q in enumerate(wanted):
        for value in (found[q], merged[f"q{i}"]):
            less, upto = sum(v < value for v in order), sum(v <= value for v in order)
            slack = quantiles.SKETCH_RANK_ERROR * len(order) + 1
            assert less - slack <= q * len(order) <= upto + slack
    assert (found[0.0], found[1.0], found["n"]) == (order[0], order[-1], len(order))
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert quantiles.approximate_quantiles(odd, F.col("v"), wanted) == {}
    exact, about = outliers.iqr_bounds(df, "v"), outliers.iqr_bounds(df, "v", approx=True)
    assert exact.n == about.n and abs(exact.high - about.high) < 0.05 * exact.high


@pytest.mark.parametrize("distinct, want", [(919, None), (920, ["listing_id"]), (921, ["listing_id"]), (1000, ["listing_id"]), (400, None)])
def test_distinct_numbers_at_the_border(spark, distinct, want):
    df = spark.createDataFrame([(f"{i % distinct}",) for i in range(1000)], "listing_id string")
    assert dedup.resolve_dedup_keys(df) == want
    small = spark.createDataFrame([("",), ("a",), ("b",), ("c",)], "listing_id string")
    assert dedup.resolve_dedup_keys(small) == ["listing_id"]


def test_subway_warning_goes_by_the_ratio_shown(spark):
    near = (F.col("id") < 29_996).alias("tag_near_subway")
    clean = spark.range(100_000).select(F.lit("x").alias("district"), F.lit(9e3).alias("unit_price"), near)
    row = quality.quality_report(clean, clean).first()
    assert row["tag_near_subway_true_ratio"] == 0.3 and "tag_near_subway_sparse" not in row["warning_codes"]
    less = spark.range(100_000).select("*", (F.col("id") < 29_994).alias("tag_near_subway"))
    assert "tag_near_subway_sparse" in quality.quality_report(less, less).first()["warning_codes"]


def test_marks_keep_the_rows_that_come_first(spark, tmp_path):
    """As :func:`dedup.drop_duplicates_first`, over numbers of several tasks and blocks, with NULL keys and equal rows."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([None, *map(str, range(400))]), f"{rng.randrange(900):04d}", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows * 2, "ingest_file string, listing_id string, row_id string, v double").repartition(3)
    numbers = F.monotonically_increasing_id() * 97  # blocks of few rows
    df.withColumn(dedup.ROW_NUMBER, numbers).write.parquet(f"{tmp_path}/t")
    stored, keys = spark.read.parquet(f"{tmp_path}/t"), ["ingest_file", "listing_id"]
    kept = dedup.marked_rows(stored, dedup.first_marks(stored, keys))
    same = dedup.drop_duplicates_first(df, keys).select(*keys, "row_id")
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.select(*keys, "row_id").collect())) == sorted(map(repr, same.collect()))


def test_stored_listings_are_not_shuffled_to_drop_duplicates(spark, tmp_path):
    from brickledger.plans import etl
    from verification.queries import raw

    rows = raw(spark, "/root/testdata/sf0.001")
    plans = [etl.clean_listings(rows, f"{tmp_path}/a"), etl.clean_and_label(rows, f"{tmp_path}/b")]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in text and "BroadcastHashJoin" in text
    whole = etl.clean_listings(rows)
    assert plans[0].columns == whole.columns and plans[0].count() == whole.count()
    assert plans[0].exceptAll(whole).count() == 0
