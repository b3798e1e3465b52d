"""What the shared steps of the listings' queries leave out, and that their results stay the same."""

import pytest
from pyspark.sql import functions as F

from brickledger.functions import cells
from brickledger.operators import cleaning, dedup, search
from brickledger.plans import etl
from verification import queries

SMALL = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_without_letters_are_found_without_lower_case(spark):
    assert "lower(" not in optimized(queries.search_score(spark, SMALL))
    rows = spark.createDataFrame(
        [("高新区", "BUILDING小区1", "TOD 地铁"), ("高新", "Building小区2", "İ车位"), (None, "x", "Tod")],
        "district string, community string, description_raw string",
    )
    scores = {word: [r.score for r in search.score_rows(rows, search.SearchIntent(True, **{field: word})).collect()]
              for field, word in (("district_contains", "高新区"), ("community_contains", "building小区1"), ("subway_station_contains", "tod"))}
    assert scores["高新区"] == [120.0, -480.0, 0.0]
    assert scores["building小区1"] == [95.0 + 95.0 * 0.35, -600.0, 0.0]
    assert scores["tod"] == [100.0, -600.0, 100.0]


@pytest.mark.parametrize("text, rooms", [
    ("3室2厅", 3), ("12室9厅|89平米", 12), ("3室1厅 12室", 12), ("共 4 室", 4), ("４室", 4), ("四室", 0), ("003室\n2厅\n", 3), ("-5室", 5),
    ("", 0), (None, 0), ("9" * 400 + "室", float("inf")),
])
def test_most_rooms(spark, text, rooms):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cells.max_rooms(F.col("t"))).first()[0] == rooms


def test_texts_with_one_room_count_are_not_searched_for_all(spark):
    assert "^([0-9]++)室" in optimized(queries.search_score(spark, SMALL))


@pytest.mark.parametrize("text, band", [
    ("1/3", "低层"), ("2/3", "中层"), ("33/33", "高层"), (" 4 / 6 ", "中层"), ("１/９", "低层"), ("5/0", "未知"), ("0/0", "未知"), ("1/33\n", "低层"),
    ("1/2/3", "未知"), ("/", "未知"), ("中楼层(共26层)", "未知"), (" 低层(共6层)", "低层"), (None, "未知"),
])
def test_floor_bands(spark, text, band):
    df = spark.createDataFrame([(text,)], "floor string")
    assert cleaning.floor_band(df).first().floor_band == band


def test_usual_floors_are_divided_without_a_search_for_their_parts(spark):
    assert "substring_index(" in optimized(queries.QUERIES["floor_band"](spark, SMALL))


def test_parts_of_house_info_are_trimmed_once(spark):
    rows = spark.createDataFrame([(" 精装 | 3室2厅 |89平米",), ("3室2厅|89平米|南|精装|低楼层(共6层)|2016年建|板楼",)], "house_info_raw string")
    names = ["layout_str", "area_m2_str", "decoration_str", "building_type_str"]
    for all_columns in (False, True):
        found = cleaning.expand_house_info(rows, all_columns)
        assert [tuple(r) for r in found.select(names).collect()] == [("3室2厅", "89平米", "精装", None), ("3室2厅", "89平米", "精装", "板楼")]
    assert ", trim(__" not in found._jdf.queryExecution().analyzed().toString()


def test_stage_counts_write_what_they_count_only(spark, tmp_path):
    raw = queries.raw(spark, SMALL)
    found = [tuple(r) for r in etl.stage_counts(raw, str(tmp_path)).collect()]
    assert set(spark.read.parquet(f"{tmp_path}/parsed").columns) == {"row_id", "ingest_file", "listing_id", "unit_price"}
    whole = etl.parse_listings(raw)
    assert found == [tuple(r) for r in etl._stage_counts(whole, dedup.resolve_dedup_keys(whole)).collect()]


@pytest.mark.parametrize("columns", [("district", "total_price"), ("total_price",), ("row_id", "community", "total_price"), ("ingest_file", "listing_id")])
def test_stage_counts_of_tables_with_few_columns(spark, tmp_path, columns):
    raw = queries.raw(spark, SMALL, *columns)
    whole = etl.parse_listings(raw)
    expected = [tuple(r) for r in etl._stage_counts(whole, dedup.resolve_dedup_keys(whole)).collect()]
    assert [tuple(r) for r in etl.stage_counts(raw, str(tmp_path)).collect()] == expected
    assert [tuple(r) for r in etl.stage_counts(raw).collect()] == expected
