"""Search behaviour."""

import random

import pytest

from brickledger.operators import batch_search, search
from brickledger.operators.search import SearchIntent

FREE_TEXT = ("location_raw", "listing_title", "community", "description_raw", "house_info_raw", "follow_info_raw")


def table(spark, rows, schema, blank=()):
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("") for c in blank if c not in df.columns}) if blank else df


def names(df, column="community"):
    return [r[column] for r in df.collect()]


def test_keywords():
    assert search.geo_keywords("新都区") == ["新都区", "新都"]
    assert search.geo_keywords("锦江") == ["锦江", "锦江区"]
    assert {"郫都", "郫县", "郫"} <= set(search.geo_keywords("郫县"))
    assert search.geo_keywords("成都市") == ["成都市"] and search.geo_keywords("  ") == []


def test_max_rows_is_checked():
    with pytest.raises(ValueError):
        SearchIntent(max_rows=0)


def test_short_district_matches_full_name(spark):
    df = table(spark, [("新都", 1.0), ("新都", 2.0), ("武侯区", 3.0)], "district string, unit_price double", FREE_TEXT)
    out = search.search_listings(df, SearchIntent(True, district_contains="新都区", max_rows=10))
    assert names(out, "unit_price") == [1.0, 2.0]


def test_hard_tags(spark):
    df = table(spark, [("新都区", "A", True, True, 1e4), ("新都区", "B", True, None, 9e3), ("新都区", "C", False, True, 8e3)],
               "district string, community string, tag_near_subway boolean, tag_lighting boolean, unit_price double", FREE_TEXT)
    intent = SearchIntent(True, district_contains="新都", require_tag_near_subway=True, require_tag_lighting=True)
    assert names(search.search_listings(df, intent)) == ["A"]
    none = SearchIntent(True, require_tag_has_balcony=True)
    assert search.search_listings(df, none).count() == 0
    assert search.search_outcome(df, none).first()["reason"] == "no_column:tag_has_balcony"
    outcome = search.search_outcome(df, intent).first()
    assert (outcome["reason"], outcome["results"], outcome["hard_tags"]) == (None, 1, "tag_near_subway,tag_lighting")
    dark = search.search_outcome(df.filter("community = 'B'"), intent).first()
    assert dark["reason"] == "no_row:tag_lighting"


def test_no_district_match_is_empty(spark):
    df = table(spark, [("锦江区", 1.0)], "district string, unit_price double", FREE_TEXT)
    intent = SearchIntent(True, district_contains="成华")
    assert search.search_listings(df, intent).count() == 0
    assert search.search_outcome(df, intent).first()["reason"] == "no_district_match"


def test_nothing_requested(spark):
    df = table(spark, [("A",)], "district string")
    assert search.search_listings(df, SearchIntent()).count() == 0
    assert search.search_outcome(df, SearchIntent()).first()["reason"] == "not_requested"


def test_layout_subway_and_year_scores(spark):
    rows = [("温江区", "两室一厅", "2室1厅", True, "凤溪河", 2010, 1e4), ("温江区", "三室两厅", "3室2厅", False, "", 2000, 12e3)]
    df = table(spark, rows, "district string, layout string, layout_normalized string, tag_near_subway boolean, "
                            "tag_subway_station_hint string, build_year int, unit_price double")
    intent = SearchIntent(True, district_contains="温江", near_subway=True, layout_contains="2室", min_build_year=2005)
    out = search.search_listings(df, intent).collect()
    assert [(r["layout_normalized"], r["score"]) for r in out] == [
        ("2室1厅", 120.0 + 75 + 55 + 45 + 110), ("3室2厅", 120.0 + 18 + 110)]
    absent = SearchIntent(True, district_contains="温江", near_subway=True, subway_station_contains="不存在的站")
    assert search.search_listings(df, absent).count() == 2


def test_district_in_location_text(spark):
    df = table(spark, [("武侯区", "大源板块成都高新南区", 11e3), ("锦江区", "", 9e3)],
               "district string, location_raw string, unit_price double", ("listing_title", "community"))
    out = search.search_listings(df, SearchIntent(True, district_contains="高新")).collect()
    assert [(r["district"], round(r["score"], 4)) for r in out] == [("武侯区", 146.4)]


def test_price_above_maximum_lowers_the_score_only(spark):
    df = table(spark, [("高新", 15e3, 200.0), ("高新", 11e3, 100.0), ("高新", None, 90.0)],
               "district string, unit_price double, total_price double", FREE_TEXT)
    intent = SearchIntent(True, district_contains="高新", max_unit_price=1e4, min_total_price_wan=95.0)
    out = search.search_listings(df, intent).collect()
    assert [(r["unit_price"], r["score"]) for r in out] == [(11e3, 188.75), (15e3, 166.75), (None, 120.0)]


def test_parking_and_absurd_rows_go_unless_nothing_else_is_left(spark):
    df = table(spark, [("高新区", "A", "产权车位转让", ""), ("高新区", "B", "精装", "3室2厅"), ("高新区", "C", "", "20室9厅"),
                       ("锦江区", "D", "停车位", "")],
               "district string, community string, description_raw string, layout string", FREE_TEXT)
    assert names(search.search_listings(df, SearchIntent(True, district_contains="高新"))) == ["B"]
    only = search.search_listings(df, SearchIntent(True, district_contains="锦江")).collect()
    assert [(r["community"], r["score"]) for r in only] == [("D", 120.0 - 600)]
    hard = SearchIntent(True, district_contains="高新", require_tag_lighting=True)
    tagged = df.selectExpr("*", "community = 'A' AS tag_lighting")
    assert search.search_listings(tagged, hard).count() == 0


def test_text_counts_where_the_tag_is_false(spark):
    df = table(spark, [("高新区", "A", "临近地铁1号线", False, 2e4), ("高新区", "B", "南北通透", False, 1e4)],
               "district string, community string, description_raw string, tag_near_subway boolean, unit_price double")
    out = search.search_listings(df, SearchIntent(True, district_contains="高新", near_subway=True, lighting_preferred=True))
    assert [(r["community"], r["score"]) for r in out.collect()] == [("A", 170.0), ("B", 155.0)]
    false = SearchIntent(True, district_contains="高新", near_subway=False)
    assert names(search.search_listings(df, false)) == ["B", "A"]


def test_keywords_are_literal_and_nulls_are_empty(spark):
    df = table(spark, [("区", "A.B(1)", "r1"), ("区", "AxB1", "r2"), ("区", None, "r3")],
               "district string, community string, row_id string")
    out = search.search_listings(df, SearchIntent(True, community_contains="a.b(1)")).collect()
    assert [(r["row_id"], r["score"]) for r in out] == [("r1", 128.25), ("r2", 0.0), ("r3", 0.0)]
    assert [r["score"] for r in search.search_listings(df, SearchIntent(True, community_contains="nan")).collect()] == [0.0] * 3


def test_batch_equals_single_searches(spark):
    rng = random.Random(3)
    rows = [(f"{i:04d}", rng.choice(["高新区", "锦江区", "新都", None]), rng.choice(["A", "B"]),
             rng.choice(["地铁", "车位", "阳台 采光", None]), rng.choice(["2室1厅", "12室1厅", "3室2厅", None]),
             rng.choice([1e4, 2e4, None]), rng.choice([True, False, None])) for i in range(300)]
    df = table(spark, rows, "row_id string, district string, community string, description_raw string, layout string, "
                            "unit_price double, tag_near_subway boolean").repartition(5)
    intents = {f"{i}": SearchIntent(
        needs_row_samples=i != 3, district_contains=rng.choice([None, "高新", "锦江", "青羊"]), near_subway=rng.choice([None, True]),
        layout_contains=rng.choice([None, "2室"]), has_balcony=rng.choice([None, True]), max_rows=rng.choice([1, 7, 40]),
        require_tag_near_subway=rng.choice([True, False])) for i in range(18)}
    batch = {}
    for r in batch_search.search_batch(df, intents).collect():
        batch.setdefault(r["intent_id"], []).append((r["rank"], r["row_id"], r["score"]))
    for key in ("0", "1", "2", "3", "16", "17"):
        single = [(i + 1, r["row_id"], r["score"]) for i, r in enumerate(search.search_listings(df, intents[key]).collect())]
        assert sorted(batch.get(key, [])) == single


def _listings(spark, n):
    rng = random.Random(5)
    rows = [(f"{i:05d}", rng.choice(["高新区", "锦江区", "新都", "郫都区", None]), rng.choice(["A", "B花园"]), rng.choice(["地铁 高新", "车位", "阳台", None]),
             rng.choice([1e4, 2e4, None]), rng.choice([50.0, 150.0]), rng.choice([2000, 2015, None])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id string, district string, community string, description_raw string, unit_price double, "
                                       "total_price double, build_year int").repartition(4)


def test_ten_thousand_searches_are_a_table(spark):
    rng = random.Random(6)
    intents = {f"{i}": SearchIntent(
        needs_row_samples=True, district_contains=rng.choice(["高新", " 锦江 ", "青羊", "郫县", "郫", f"新{i % 50}", "新都", f"街{i}"]),
        community_contains=rng.choice([None, " ", "花园", f"x{i}"]), min_unit_price=rng.choice([None, 15e3]), max_unit_price=rng.choice([None, 9e3 + i]),
        max_total_price_wan=rng.choice([None, 100.0]), min_build_year=rng.choice([None, 2005]), max_rows=rng.choice([1, 3])) for i in range(10_000)}
    df = _listings(spark, 1000).cache()
    batch = {}
    for r in batch_search.search_batch(df, intents).collect():
        batch.setdefault(r["intent_id"], []).append((r["rank"], r["row_id"], r["score"]))
    some = rng.sample(sorted(intents), 6) + [k for k, i in intents.items() if i.district_contains == "郫"][:1]
    for key in some:
        single = [(i + 1, r["row_id"], r["score"]) for i, r in enumerate(search.search_listings(df, intents[key]).collect())]
        assert sorted(batch.get(key, [])) == single
    found = {r["intent_id"]: r.asDict() for r in batch_search.search_outcomes(df, {k: intents[k] for k in some}).collect()}
    for key in some:
        assert found[key] == {**search.search_outcome(df, intents[key]).first().asDict(), "intent_id": key}


def test_plan_does_not_grow_with_the_searches(spark):
    df = _listings(spark, 10)
    lines = []
    for n in (2, 500):
        found = batch_search.search_batch(df, {f"{i}": SearchIntent(True, district_contains=f"区{i}") for i in range(n)})
        lines.append(found._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert lines[0] == lines[1]


def test_searches_with_few_columns_over_odd_tables(spark):
    df = table(spark, [("新都", "A"), (None, "新都 B"), ("锦江", "C")], "district string, listing_title string")
    asked = spark.createDataFrame([("x", True, "新都"), ("y", True, None), ("z", None, "新都"), ("w", True, "")],
                                  "intent_id string, needs_row_samples boolean, district_contains string")
    found = {(r["intent_id"], r["rank"], r["listing_title"]) for r in batch_search.search_batch(df, asked).collect()}
    assert {f for f in found if f[0] == "x"} == {("x", 1, "新都 B"), ("x", 2, "A")} and {f[0] for f in found} == {"x", "y", "w"}
    assert sum(f[0] == "y" for f in found) == 3
    assert batch_search.search_batch(df, asked.limit(0)).count() == 0 and batch_search.search_outcomes(df, asked.limit(0)).count() == 0
    empty = {r["intent_id"]: r["reason"] for r in batch_search.search_outcomes(df.limit(0), asked).collect()}
    assert empty == {"x": "empty_table", "y": "empty_table", "z": "not_requested", "w": "empty_table"}
    # Without a column that could name a district, every listing is in every district.
    no_geo = df.select(df.listing_title.alias("description_raw"))
    assert batch_search.search_batch(no_geo, asked.filter("intent_id = 'x'")).count() == 3
    for wrong in ([("a", 1), ("a", 2)], [("a", 0)], [(None, 1)]):
        with pytest.raises(ValueError):
            batch_search.search_batch(df, spark.createDataFrame([(i, True, n) for i, n in wrong], "intent_id string, needs_row_samples boolean, max_rows int"))


def test_keywords_of_a_column(spark):
    names_ = ["新都区", "锦江", "郫县", "成都市", "高新南区", "天府新区", "县", "区区"]
    df = spark.createDataFrame([(n,) for n in names_], "d string")
    found = {r["d"]: r["k"] for r in df.select("d", batch_search.keywords(df.d).alias("k")).collect()}
    assert found == {n: search.geo_keywords(n) for n in names_}


def test_display(spark):
    df = table(spark, [("x" * 200, 1.0, "hidden", None)], "community string, unit_price double, description_raw string, layout string")
    shown = search.display(df, 160)
    assert shown.columns == ["community", "layout", "unit_price"] and len(shown.first()["community"]) == 160
    assert len(search.display(df).first()["community"]) == 200
    assert '"layout":null' in search.display_json(df).first()["listing"]


def test_batch_meets_wishes_before_searches(spark):
    """Listings that go on to the searches do not grow with the table, and limits that lie at a number keep their sides."""
    rng = random.Random(8)
    limits = [100.0 / 1.2, 100.0, 110.0, 120.0, 132.0]
    intents = {f"{i}": SearchIntent(
        True, district_contains=rng.choice(["高新", "锦江"]), max_unit_price=rng.choice([None, *limits]), min_unit_price=rng.choice([None, *limits]),
        min_build_year=rng.choice([None, 2008, 2016]), max_rows=rng.choice([1, 2, 3])) for i in range(60)}
    rows = [(rng.choice(["高新区", "锦江区"]), rng.choice([90.0, 100.0, 110.0, 120.0, 132.0, 150.0, None]), rng.choice([2000, 2008, 2016, None]))
            for _ in range(1200)]
    sizes = []
    for n in (600, 1200):
        df = spark.createDataFrame([(f"{i:05d}", *row) for i, row in enumerate(rows[:n])], "row_id string, district string, unit_price double, build_year int")
        asked = batch_search._asked(batch_search.intent_table(spark, intents))
        wishes = batch_search._wishes(asked)
        sizes.append(batch_search._first_alike(search._Listings(df), asked, wishes, df.columns).count())
    assert sizes[0] <= sizes[1] <= 2 * 7 * 4 * 3 and sizes[1] < 1.2 * sizes[0]
    batch = {}
    for r in batch_search.search_batch(df, intents).collect():
        batch.setdefault(r["intent_id"], []).append((r["rank"], r["row_id"], r["score"]))
    for key in [*intents][:5]:
        single = [(i + 1, r["row_id"], r["score"]) for i, r in enumerate(search.search_listings(df, intents[key]).collect())]
        assert sorted(batch[key]) == single


def _ranked(df, intents):
    batch = {}
    for r in batch_search.search_batch(df, intents).collect():
        batch.setdefault(r["intent_id"], []).append((r["rank"], r["row_id"], r["score"]))
    return batch


def test_listings_meet_only_wishes_that_they_have_a_word_of(spark):
    """Wishes that differ in words share the listings that have none of them; equal rows are listed once each."""
    rows = [(f"{i:04d}", "高新区", f"C{i % 30:02d}苑", ["地铁 C05苑", None, "南熏大道"][i % 3], ["3室2厅", "2室1厅", None][i % 3], 9e3 + i % 50)
            for i in range(300)]
    df = spark.createDataFrame([*rows, *rows[:40]], "row_id string, district string, community string, description_raw string, "
                                                    "layout string, unit_price double").repartition(3)
    asked_for = {f"{i}": SearchIntent(True, district_contains="高新", community_contains=f"c{i:02d}苑", max_unit_price=9e3 + i, max_rows=1) for i in range(30)}
    asked = batch_search._asked(batch_search.intent_table(spark, asked_for))
    found = batch_search._first_alike(search._Listings(df, lowered=True), asked, batch_search._wishes(asked), df.columns)
    # For each wish one listing by its community, one by its text and one by both at most, and one for all without a word.
    assert found.count() <= 3 * 30 + 1
    words = {f"w{i}": SearchIntent(
        True, district_contains=[None, "高新"][i % 2], community_contains=[None, "C05苑", "苑"][i % 3], layout_contains=[None, "3室"][i // 3 % 2],
        subway_station_contains=[None, "南熏大道"][i // 6 % 2], max_unit_price=9e3 + 2 * i, max_rows=1 + i % 4) for i in range(12)}
    batch = _ranked(df, {**asked_for, **words})
    for key in ("0", "5", "29", *words):
        intent = {**asked_for, **words}[key]
        assert sorted(batch[key]) == [(i + 1, r["row_id"], r["score"]) for i, r in enumerate(search.search_listings(df, intent).collect())]


def test_upper_limits_on_the_unit_price_tell_no_listings_apart(spark):
    """The cheapest of those alike have the points, if any; listings without a price come before those above all prices."""
    prices = [100.0 + i for i in range(60)] + [None, None, 2e18, 3e18]
    df = spark.createDataFrame([(f"{i:03d}", "锦江区", p) for i, p in enumerate(prices)], "row_id string, district string, unit_price double")
    intents = {f"{i}": SearchIntent(True, district_contains="锦江", max_unit_price=40.0 + 3 * i, max_rows=2) for i in range(40)}
    intents["all"] = SearchIntent(True, district_contains="锦江", max_unit_price=2.5e18, max_rows=70)
    few = {k: v for k, v in intents.items() if k != "all"}
    asked = batch_search._asked(batch_search.intent_table(spark, few))
    found = batch_search._first_alike(search._Listings(df, lowered=True), asked, batch_search._wishes(asked), df.columns)
    assert found.count() == 2 + 2
    batch = _ranked(df, intents)
    for key in ("0", "20", "39", "all"):
        assert sorted(batch[key]) == [(i + 1, r["row_id"], r["score"]) for i, r in enumerate(search.search_listings(df, intents[key]).collect())]
