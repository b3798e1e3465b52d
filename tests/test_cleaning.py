"""Row-level cleaning on small literal cases."""

import pytest
from pyspark.sql import functions as F

from brickledger.functions import cells, numbers
from brickledger.operators import cleaning
from brickledger.schema import canonicalize_headers, normalize_header, rename_standard
from brickledger.sources.files import slim_for_export


def values(spark, cells_in, expression):
    rows = [(i, c) for i, c in enumerate(cells_in)]
    df = spark.createDataFrame(rows, "i int, c string").select("i", expression(F.col("c")).alias("v"))
    return [r["v"] for r in sorted(df.collect())]


def test_numbers_from_text(spark):
    assert values(spark, ["17190元/平米", "1.7万/㎡", "总价100万 17190元/平米", "1,234 元/m2", "-5", "1e4", "x", "", None,
                          "nan", "８９元/平米", "1d", "万元1.5㎡"], numbers.unit_price_yuan) == [
        17190.0, 17000.0, 171900000.0, 1234.0, -5.0, 10000.0, None, None, None, None, 89.0, 1.0, 1.5]
    assert values(spark, ["153万", "60000", "万2", "1,200万", "50000", "约 70000 元", None], numbers.total_price_wan) == [
        153.0, 6.0, 2.0, 1200.0, 50000.0, 7.0, None]
    assert values(spark, ["89平米", "91.68", "约1,000㎡", "none"], numbers.area_m2) == [89.0, 91.68, 1000.0, None]
    assert values(spark, ["1.2万", "3千", "100", "挂牌30天/关注1.2万", "2w人", "无"], numbers.followers) == [
        12000.0, 3000.0, 100.0, 30.0, 20000.0, None]
    assert values(spark, ["60", "900"], lambda c: numbers.unit_price_yuan(c, rescale_small=True)) == [600000.0, 900.0]


def test_coerce_numeric_takes_plain_numbers_only(spark):
    rows = [(" 12 ",), ("1e5",), (".5",), ("1d",), ("0x1p3",), ("NaN",), ("inf",), ("12平",), (None,)]
    out = cleaning.coerce_numeric(spark.createDataFrame(rows, "area_m2 string")).collect()
    assert [r[0] for r in out] == [12.0, 1e5, 0.5, None, None, None, float("inf"), None, None]
    nan = spark.createDataFrame([(float("nan"),), (2.0,)], "unit_price double")
    assert [r[0] for r in cleaning.coerce_numeric(nan).collect()] == [None, 2.0]


def test_floor_band(spark):
    assert values(spark, ["5/30", "高层", "2/10", "中楼层(共26层)", "15/30", "30/30", "3/0", " 10 / 30 ", "一楼顶楼", "", None],
                  cells.floor_band) == [
        "低层", "高层", "低层", "未知", "中层", "高层", "未知", "低层", "未知", "未知", "未知"]


def test_decoration(spark):
    assert values(spark, ["精装修 南北通透", "清水房", "普通装修", "豪华", "x" * 30, " ", None], cells.decoration) == [
        "精装", "毛坯", "简装", "豪装", "x" * 30, "未知", "未知"]
    assert values(spark, ["x" * 30], lambda t: cells.decoration(t, 20)) == ["x" * 20]


def test_layout(spark):
    assert values(spark, ["两室一厅", "3室2厅", "二房一厅", "三室两厅", "12房", "十三室", "4 室 02 厅", "开间", "y" * 90, "", None],
                  cells.layout) == [
        "2室1厅", "3室2厅", "2室1厅", "3室1厅", "2室1厅", "3室1厅", "4室2厅", "开间", "y" * 90, "", ""]
    assert values(spark, ["y" * 90], lambda t: cells.layout(t, 80)) == ["y" * 80]


def test_house_info_parts_go_to_the_first_free_column_that_accepts_them(spark):
    df = spark.createDataFrame([
        ("3室2厅|89平米|南|精装|中楼层(共26层)|2016年建|板楼",),
        (" 2 室 1厅 | 75㎡ || 朝南北 |2010|共6层|砖混 2005建|x楼",),
        ("nan",), ("",), (None,),
        ("2016年板楼|2017年板楼|2018年板楼",),
        ("南北通透大户型带花园非常不错的房子哦|东|西",),
        ("90平米|80平米|1室1厅|2室2厅",),
    ], "house_info_raw string")
    out = cleaning.expand_house_info(df).drop("house_info_raw").collect()
    names = cleaning.expand_house_info(df).drop("house_info_raw").columns
    assert names == ["layout_str", "area_m2_str", "orientation_str", "decoration_str", "build_year",
                     "building_type_str", "floor_text"]
    assert [tuple(r) for r in out] == [
        ("3室2厅", "89平米", "南", "精装", "2016", "板楼", "中楼层(共26层)"),
        ("2室1厅", "75平米", "南北", None, "2010", "砖混", "共6层"),
        (None,) * 7, (None,) * 7, (None,) * 7,
        (None, None, None, None, "2016", "板楼", "2018年板楼"),
        (None, None, "东", None, None, None, None),
        ("1室1厅", "90平米", None, None, None, None, None),
    ]


def test_house_info_against_a_part_by_part_fold(spark):
    import random
    import re

    from brickledger import fixed

    orient, deco = fixed.ORIENTATIONS, [w for _, ws in fixed.HOUSE_INFO_DECORATIONS for w in ws]

    def accepted(part):
        year = re.search(fixed.YEAR_CELL, part)
        tests = {
            "layout_str": re.search(fixed.LAYOUT_CELL, part),
            "area_m2_str": re.search(fixed.AREA_CELL, part),
            "orientation_str": len(part) <= 16 and any(o in part for o in orient),
            "decoration_str": any(w in part for w in deco),
            "build_year": year and ("年" in part or "建" in part or len(part) <= 8),
            "building_type_str": any(w in part for w in fixed.BUILDING_TYPES),
            "floor_text": any(w in part for w in "层楼共"),
        }
        return [k for k, v in tests.items() if v]

    pool = ["3室2厅", "1 室 1 厅", "89平米", "75.5㎡", "南", "东南 精装", "毛坯2001年建", "2010", "板楼2012年", "塔板结合", "中楼层(共26层)",
            "共6层", "豪华装修别墅1999", "x", "", " ", "20 05 年", "朝北3室1厅", "2008年建成的一套非常漂亮的房子"]
    rng = random.Random(5)
    rows = [(i, "|".join(rng.choices(pool, k=rng.randint(0, 8)))) for i in range(400)]
    out = cleaning.expand_house_info(spark.createDataFrame(rows, "i int, house_info_raw string"))
    got = {r["i"]: {k for k in out.columns[2:] if r[k] is not None} for r in out.collect()}
    floors = {r["i"]: r["floor_text"] for r in out.collect()}
    for i, text in rows:
        taken = {}
        for part in (p.strip() for p in text.split("|")):
            free = [k for k in accepted(part) if part and k not in taken]
            if free:
                taken[free[0]] = part
        assert got[i] == set(taken), text
        assert floors[i] == taken.get("floor_text"), text


def test_follow_info(spark):
    df = spark.createDataFrame([("6人关注 / 11天以前发布",), ("1.2万人关注／昨天",), ("5人|上周",), ("7人/",), ("8人",), (None,)],
                               "follow_info_raw string")
    out = cleaning.expand_follow_info(df).collect()
    assert [(r["followers"], r["listing_time"], r["publish_time_raw"]) for r in out] == [
        (6.0, "11天以前发布", "11天以前发布"), (12000.0, "昨天", "昨天"), (5.0, "上周", "上周"), (7.0, None, None),
        (8.0, None, None), (None, None, None)]


def test_expand_fills_blanks_only(spark):
    df = spark.createDataFrame([("4室2厅", "nan", "1室1厅|40平米|南|毛坯|低层|2000年建|塔楼", 1990.0)],
                               "layout_str string, decoration_str string, house_info_raw string, build_year double")
    row = cleaning.expand_composites(df).first()
    assert (row["layout_str"], row["decoration_str"], row["build_year"]) == ("4室2厅", "毛坯", 1990.0)


def test_finalize_promotes_and_fills_unit_price(spark):
    df = spark.createDataFrame([("153万", "89平米", None), ("100万", "none", "9000元/平米"), ("10", "0", None)],
                               "total_price string, area_m2_str string, unit_price string")
    out = cleaning.finalize(df).collect()
    assert out[0]["area_m2"] == 89.0 and abs(out[0]["unit_price"] - 1530000 / 89) < 1e-9
    assert (out[1]["area_m2"], out[1]["unit_price"]) == (None, 9000.0)
    assert (out[2]["area_m2"], out[2]["unit_price"]) == (0.0, None)


def test_promote_keeps_target_and_takes_only_usable_sources(spark):
    df = spark.createDataFrame([("", "南"), ("北", "南"), (None, "null"), ("nan", "东")],
                               "orientation string, orientation_str string")
    assert [r["orientation"] for r in cleaning.promote_staging(df).collect()] == ["南", "北", None, "东"]
    empty = spark.createDataFrame([("a", None, None)], "listing_id string, area_m2 double, area_m2_str string")
    assert cleaning.promote_staging(empty).first()["area_m2"] is None


def test_splits(spark):
    df = spark.createDataFrame([("朝阳区|2室1厅|精装",), ("海淀区| 3室 ",), (None,), ("a||c|d",)], "blob string")
    out = cleaning.split_delimited(df, "blob", "|", ["district", "layout", "decoration"]).drop("blob").collect()
    assert [tuple(r) for r in out] == [("朝阳区", "2室1厅", "精装"), ("海淀区", "3室", None), (None,) * 3, ("a", "", "c")]
    slash = spark.createDataFrame([("挂牌30天/关注1.2万/浏览99",), ("/ /x//y",), (None,)], "t string")
    out = cleaning.split_slash_part(slash, "t", 1, "followers").collect()
    assert [r["followers"] for r in out] == ["关注1.2万", "y", None]
    with pytest.raises(ValueError):
        cleaning.split_delimited(df, "blob", "|", ["nonsense"])
    with pytest.raises(ValueError):
        cleaning.split_slash_part(df, "missing", 0, "followers")


def test_headers(spark):
    assert normalize_header(" 建筑 面积 ") == "area_m2" and normalize_header("备注 一") == "备注一"
    df = spark.createDataFrame([(None, "b", "x"), ("a", "c", "y")], "`城区` string, `区域` string, other string")
    assert [tuple(r) for r in canonicalize_headers(df).collect()] == [("b", "x"), ("a", "y")]
    assert rename_standard(df, {"other": "floor"}).columns == ["城区", "区域", "floor"]
    for bad in ({"missing": "floor"}, {"other": "nonsense"}):
        with pytest.raises(ValueError):
            rename_standard(df, bad)


def test_slim_export(spark):
    wide = spark.createDataFrame([], "area_m2 double, area_m2_str string, layout string, layout_normalized string, "
                                     "listing_time string, publish_time_raw string, house_info_raw string")
    assert slim_for_export(wide).columns == ["area_m2", "layout_normalized", "listing_time", "house_info_raw"]
    assert slim_for_export(wide.select("area_m2_str", "layout")).columns == ["area_m2_str", "layout"]


def test_both_ways_of_taking_house_info_apart_are_one(spark):
    import random
    rng = random.Random(11)
    parts = ["3室2厅", " 2 室 1 厅 ", "89平米", "100.5㎡", "南", "东南 西北", "南向很长很长很长很长很长很长的说明", "精装", "毛坯", "2016年建", "2016", "12016建",
             "板楼", "塔楼", "中楼层(共26层)", "低层", "共6层", "", " ", "其他", "nan", "3室2厅 精装", "南 2010年", "板楼 2003年 精装 南", "　"]
    cells = ["|".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(1500)] + [None, "|", "||", "南|南|南", "精装|简装|2010年建|2011年建"]
    df = spark.createDataFrame([(c, "清水" if i % 9 == 0 else None) for i, c in enumerate(cells)], "house_info_raw string, decoration_str string")
    folded, chained = cleaning.expand_house_info(df, all_columns=True), cleaning.expand_house_info(df)
    assert folded.columns == chained.columns
    for a, b in zip(folded.collect(), chained.collect()):
        assert a == b


def test_usual_house_info_gives_the_parts_that_the_search_finds(spark, monkeypatch):
    """Cells in the usual order go by place, all others by the search for parts; both ways of the search agree."""
    usual = ["3室2厅|89平米|南|精装|中楼层(共26层)|2016年建|板楼", "10室9厅|7.5平米|东南|毛坯|低层(共6层)|1999年建|塔板结合"]
    odd = ["板楼|2016年建|中楼层(共26层)|精装|南|89平米|3室2厅", "3室2厅|89平米|南|精装|中楼层(共2010层)|2016年建|板楼", None, "",
           "3室2厅|89平米|南|精装|2016年建|板楼", " 3室2厅|89平米|南|精装|中楼层(共26层)|2016年建|板楼 "]
    df = spark.createDataFrame([(c,) for c in usual + odd], "house_info_raw string")
    matched = df.filter(F.col("house_info_raw").rlike(cleaning.fixed.USUAL_HOUSE_INFO))
    assert {r[0] for r in matched.collect()} == set(usual)
    found = [sorted(map(str, cleaning.expand_house_info(df, whole).collect())) for whole in (False, True)]
    monkeypatch.setattr(cleaning.fixed, "USUAL_HOUSE_INFO", "x^")
    searched = [sorted(map(str, cleaning.expand_house_info(df, whole).collect())) for whole in (False, True)]
    assert found == searched and found[0] == found[1]
