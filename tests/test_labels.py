"""Text labels."""

import pytest

from brickledger.operators import labels, scores

CASES = [
    ("出门即地铁4号线凤溪河站", True), ("普通住宅绿化好", False), ("地铁房精装", True), ("TOD综合体", True),
    ("步行8分钟到地铁站", True), ("距南熏大道站600米", True), ("步行5分钟到公交站", False), ("无地铁公交便利", False),
    ("距火车站600米", False), ("距公交站 300米", False), ("暂无 地铁", False), ("距３号线500米", True), ("factoday", False),
]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    return sorted(labels.text_labels(spark.createDataFrame(rows, "i int, description_raw string")).collect())


def test_near_subway(labelled):
    assert [r["tag_near_subway"] for r in labelled] == [expected for _, expected in CASES]


def test_station_hint_and_bus(labelled):
    assert labelled[0]["tag_subway_station_hint"] == "凤溪河" and labelled[1]["tag_subway_station_hint"] == ""
    assert labelled[5]["tag_subway_station_hint"] == "南熏大道"
    assert [i for i, r in enumerate(labelled) if r["tag_near_bus"]] == [6, 7, 9]


def test_other_tags_year_and_layout(spark):
    df = spark.createDataFrame([
        ("南北通透 带大阳台", "", "两室一厅", None), (None, "采光好全明户型 无电梯", None, 2001.0),
        ("建于2012年 2000米", None, "", None), ("1850年", "亮堂", "3室2厅", None),
    ], "description_raw string, location_raw string, layout string, build_year double")
    out = labels.text_labels(df).collect()
    assert [r["tag_has_balcony"] for r in out] == [True, False, False, False]
    assert [r["tag_lighting"] for r in out] == [True, True, False, True]
    assert [r["tag_elevator"] for r in out] == [False, True, False, False]
    assert [r["layout_normalized"] for r in out] == ["2室1厅", "", "", "3室2厅"]
    assert [r["build_year"] for r in out] == [None, 2001.0, 2012.0, None]


def test_without_any_text_column(spark):
    row = labels.rule_features(spark.createDataFrame([(1.0,)], "unit_price double")).first()
    assert row["tag_near_subway"] is False and row["layout_normalized"] == "" and row["unit_price"] == 1.0


def test_scores(spark):
    df = spark.createDataFrame([(str(i), f"d{i}") for i in range(6)], "row_id string, description_raw string")
    given = spark.createDataFrame([("1", 1.7, None), ("2", -1.0, 0.4)], "row_id string, subway double, school double")
    out = {r["row_id"]: tuple(r[2:]) for r in scores.apply_scores(df, given).collect()}
    assert out["1"] == (1.0, 0.0) and out["2"] == (0.0, 0.4) and out["3"] == (None, None) and len(out) == 6
    first = scores.sample_for_scoring(df, rows=3).collect()
    assert first == scores.sample_for_scoring(df.repartition(3), rows=3).collect() and len(first) == 3
    assert scores.sample_for_scoring(df.limit(4), rows=200).count() == 0
    some = spark.range(5000).selectExpr("string(id) AS row_id", "repeat('x', 900) AS description_raw")
    tenth = scores.sample_for_scoring(some, share=0.1)
    assert 400 < tenth.count() < 600 and tenth.filter("length(snippet) <> 900").count() == 0
    assert sorted(tenth.collect()) == sorted(scores.sample_for_scoring(some.repartition(7), share=0.1).collect())
    assert scores.sample_for_scoring(some, share=1.0).count() == 5000 and scores.sample_for_scoring(some, share=0.0).count() == 0
    assert scores.sample_for_scoring(some, share=1.0, snippet_chars=3).first()["snippet"] == "xxx"
