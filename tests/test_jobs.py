"""File reading, the listing jobs, and the driver contract."""

import pytest

import __spark_entry__ as entry
from brickledger.plans import etl
from brickledger.sources import files
from verification.compare import compare

SMALL = "/root/testdata/sf0.001"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))


def test_files_of_different_encodings_and_headers(spark, tmp_path):
    write(tmp_path / "b.csv", "城区,总价,编号\n海淀,100,001\n朝阳,NA,002\n")
    write(tmp_path / "a.CSV", "﻿区域,价格,备注\n西城,\"1,200万\",\"说\"\"好\"\"\"\n")
    write(tmp_path / "gbk.csv", "城区,区域,总价\n,房山,90\n大兴,x,null\n", "gbk")
    write(tmp_path / "broken.xlsx", "not a spreadsheet")
    write(tmp_path / "empty.csv", "\n")
    rows, found = files.read_listing_files(spark, str(tmp_path))
    got = {(r["ingest_file"], r["district"], r["total_price"], r["listing_id"], r["备注"]) for r in rows.collect()}
    assert got == {("b", "海淀", "100", "001", None), ("b", "朝阳", None, "002", None), ("a", "西城", "1,200万", None, "说\"好\""),
                   ("gbk", "房山", "90", None, None), ("gbk", "大兴", None, None, None)}
    state = {r["name"]: (r["encoding"], r["ok"], r["reason"]) for r in found.collect()}
    assert state["gbk.csv"] == ("GB18030", True, None) and state["b.csv"] == ("UTF-8", True, None)
    assert state["broken.xlsx"][1:] == (False, "spreadsheet files are not supported")
    assert state["empty.csv"][1:] == (False, "empty file")
    order = [r["listing_id"] for r in rows.filter("ingest_file = 'b'").orderBy("row_id").collect()]
    assert order == ["001", "002"]


def test_every_file_has_a_row_and_its_own_identity(spark, tmp_path):
    for folder, header in (("2024", "编号,总价"), ("2025", "房源编号,城区")):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "x.csv", f"{header}\n1,5\n")
    write(tmp_path / "a.csv", "编号\n7\n")
    write(tmp_path / "_b.csv", "编号\n8\n")
    (tmp_path / "zero.csv").write_bytes(b"")
    (tmp_path / "odd name%.csv").write_bytes(b"\xff\x20\x81\x20\n1\n")
    rows, found = files.read_listing_files(spark, str(tmp_path), recursive=True)
    assert {(r["ingest_file"], r["listing_id"]) for r in rows.collect()} == {
        ("2024/x", "1"), ("2025/x", "1"), ("a", "7"), ("_b", "8"), ("odd name%", None)}
    assert rows.select("row_id").distinct().count() == 5
    assert etl.clean_listings(rows).count() == 5
    state = {r["name"]: r["reason"] for r in found.collect()}
    assert state == {
        "2024/x.csv": None, "2025/x.csv": None, "a.csv": None, "zero.csv": "empty file",
        "_b.csv": None, "odd name%.csv": None,
    }
    write(tmp_path / "a.CSV", "编号\n9\n")
    tagged = files.read_listing_files(spark, str(tmp_path))[0].collect()
    assert {(r["ingest_file"], r["listing_id"]) for r in tagged} == {("a.csv", "7"), ("a.CSV", "9"), ("_b", "8"), ("odd name%", None)}
    (tmp_path / "a.CSV").unlink()
    flat, listed = files.read_listing_files(spark, str(tmp_path))
    assert {r["ingest_file"] for r in flat.collect()} == {"a", "_b", "odd name%"} and listed.count() == 4


def test_names_with_signs_are_read(spark, tmp_path):
    write(tmp_path / "a b%c+房源.csv", "编号\n7\n")
    rows, _ = files.read_listing_files(spark, str(tmp_path))
    assert [(r["ingest_file"], r["listing_id"]) for r in rows.collect()] == [("a b%c+房源", "7")]


def test_no_readable_file_is_an_error(spark, tmp_path):
    write(tmp_path / "only.xlsx", "nope")
    with pytest.raises(ValueError):
        files.read_listing_files(spark, str(tmp_path))


def test_cleaning_jobs(spark, tmp_path):
    row = ("A", "2室1厅|90平米|南|精装|中层(共20层)|2015年建|板楼", "300万", None)
    df = spark.createDataFrame([row, row], "district string, house_info_raw string, total_price string, unit_price string")
    out = etl.clean_listings(df).collect()
    assert len(out) == 1 and out[0]["floor_band"] == "中层" and abs(out[0]["unit_price"] - 3e6 / 90) < 1e-9
    labelled = etl.clean_and_label(df, str(tmp_path)).first()
    assert labelled["layout_normalized"] == "2室1厅" and labelled["tag_near_subway"] is False
    stages = {r["stage"]: (r["rows"], r["dropped"], r["largest_drop"]) for r in etl.stage_counts(df).collect()}
    assert stages == {"input": (2, 0, False), "dedup": (1, 1, True), "iqr": (1, 0, False)}


def test_rows_with_one_usable_column_are_not_collapsed(spark):
    rows = [("金堂", 85.5, f"房源{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "district string, total_price double, house_info_raw string")
    clean, report = etl.clean_and_assess(df)
    assert clean.count() == 100 and report.first()["passed"]


def test_listing_job_end_to_end(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    text = "城区,小区,户型,建筑面积,总价,单价\n" + "".join(f"海淀区,X{i},2室1厅,{80 + i},650万,\n" for i in range(8))
    write(raw / "a.csv", text + "海淀区,X1,2室1厅,81,650万,\n", "utf-8-sig")
    rows, _ = files.read_listing_files(spark, str(raw))
    report = etl.run_listing_job(rows, str(tmp_path / "out")).first()
    stages = {r["stage"]: r["rows"] for r in spark.read.parquet(str(tmp_path / "out" / "stages")).collect()}
    assert stages == {"input": 9, "dedup": 8, "iqr": 8}
    assert report["passed"] and (report["raw_rows"], report["clean_rows"]) == (9, 8)
    rank = spark.read.parquet(str(tmp_path / "out" / "tasks" / "district_price_rank_0")).first()
    assert rank["district"] == "海淀区"
    assert spark.read.parquet(str(tmp_path / "out" / "clean_sample")).count() == 8
    export = spark.read.parquet(str(tmp_path / "out" / "export"))
    assert "layout" not in export.columns and "layout_normalized" in export.columns


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_parsing_is_pruned_and_filters_stay_short(spark):
    from verification.queries import parsed, raw
    rows = etl.parse_listings(raw(spark, SMALL))
    assert "regexp" not in _plan(rows.groupBy().count()).lower()
    price = _plan(parsed(spark, SMALL).select("unit_price"))
    assert not any(name in price for name in ("floor_text", "decoration", "followers", "building_type", "floor_band"))
    assert _plan(parsed(spark, SMALL).filter("decoration = 'x'")).lower().count("regexp_extract") < 120


def test_entry(spark):
    assert {r["district"] for r in entry.entry(spark).collect()} == {"锦江区", "武侯区", "高新区", "新都", "温江区", "双流区"}
    from verification.oracle import ORACLE
    from verification.queries import QUERIES
    assert set(ORACLE) == set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", ["src_union", "dedup_first", "etl_stage_counts", "quality_report", "price_histogram",
                                 "search_batch", "summary_facts"])
def test_query_agrees_with_sql(spark, key):
    assert compare(spark, SMALL, key) == ""


def test_entry_without_what_the_subpackage_needs():
    """A missing dependency of the subpackage leaves the listings' queries."""
    import subprocess
    import sys
    code = (
        "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; from verification.queries import QUERIES; "
        "assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(QUERIES)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_stages_are_counted_as_they_are_written(spark, tmp_path):
    """One dedup shuffle: the job's stage rows are those of the counts on their own."""
    from verification.queries import raw
    rows = raw(spark, SMALL).limit(2000).cache()
    etl.run_listing_job(rows, str(tmp_path))
    alone = {tuple(r) for r in etl.stage_counts(rows).collect()}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/stages").collect()} == alone
    assert {r[1]: r[2] for r in alone}["dedup"] == spark.read.parquet(f"{tmp_path}/unique").count()
    etl.run_listing_job(rows.limit(0), f"{tmp_path}/none")
    assert {r["rows"] for r in spark.read.parquet(f"{tmp_path}/none/stages").collect()} == {0}


def test_grouped_results_in_one_plan_read_the_table_once(spark):
    from verification.queries import QUERIES
    plan = QUERIES["grouped_tasks"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
