import pytest
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.operators import labels
from verification import queries

#: The JVM interprets methods from this size on for ever.
COMPILED_BYTES = 8000


def method_sizes(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("key", ["finalize", "search_display", "search_topk", "decade_avg", "floor_band_price", "export_slim"])
def test_methods_are_small_enough_to_be_compiled(spark, key):
    assert max(method_sizes(queries.QUERIES[key](spark, "/root/testdata/sf0.001"))) < COMPILED_BYTES


def test_tags_are_the_same_where_house_info_is_in_the_usual_form(spark):
    texts = [
        "", None, "距地铁", "距南熏大道站", "距1号线", "步行5分钟到", "tod", "TOD", "暂无", "号", "地铁 12", "近地铁双阳台 采光好", "电", "建于2012年",
    ]
    info = "12室3厅|89平米|东南西北|精装|中楼层(共26层)|2016年建|塔板结合"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, description_raw string")
    rows = rows.withColumn("build_year", F.lit(None).cast("double")).withColumn("layout", F.lit("3室2厅"))
    usual = labels.text_labels(rows.withColumn("house_info_raw", F.lit(info)))
    # The same text in one column, which is never in the usual form.
    text = F.concat(F.coalesce("description_raw", F.lit("")), F.lit(" " + info))
    whole = labels.text_labels(rows.withColumn("description_raw", text))
    tags = ["row_id", "build_year", "layout_normalized", *[c for c in usual.columns if c.startswith("tag_")]]
    assert usual.select(tags).orderBy("row_id").collect() == whole.select(tags).orderBy("row_id").collect()
    assert "__said" not in usual.columns and fixed.USUAL_HOUSE_INFO.endswith("$")
