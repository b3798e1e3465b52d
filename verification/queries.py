"""The registered queries: every operator over whole tables of a scale-factor directory."""

from __future__ import annotations

import tempfile
from functools import partial, reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions import numbers
from brickledger.operators import (
    analysis, batch_search, cleaning, dedup, labels, outliers, profile, quality, quantiles, scores, search,
)
from brickledger.plans import etl
from brickledger.schema import canonicalize_headers, rename_standard
from brickledger.sources import files
from brickledger.sources.derived import listings

INTENTS = {
    "a": search.SearchIntent(
        needs_row_samples=True, district_contains="高新区", layout_contains="3室", near_subway=True,
        max_unit_price=30000.0, min_build_year=2008, max_rows=40,
    ),
    "b": search.SearchIntent(
        needs_row_samples=True, district_contains="锦江", has_balcony=True, lighting_preferred=True,
        min_total_price_wan=100.0, max_total_price_wan=200.0, require_tag_near_subway=True, max_rows=25,
    ),
    "c": search.SearchIntent(
        needs_row_samples=True, community_contains="building小区1", subway_station_contains="南熏大道",
        min_unit_price=20000.0, require_tag_has_balcony=True,
    ),
    "d": search.SearchIntent(needs_row_samples=True, district_contains="成华", max_rows=10),
}


def raw(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return listings(spark, d, columns) if columns else listings(spark, d)


def parsed(spark: SparkSession, d: str, *columns: str, all_columns: bool = False) -> DataFrame:
    return etl.parse_listings(raw(spark, d, *columns), all_columns).transform(cleaning.floor_band)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d, all_columns=True).transform(labels.text_labels)


def rule_features(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d, all_columns=True).transform(labels.rule_features)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Four decimals, as sums of floating-point numbers depend on their order."""
    return df.withColumns({c: F.round(c, 4) for c in columns})


# --- Sources, sinks, schema ------------------------------------------------------------------------

_FILE_COLUMNS = ("row_id", "listing_id", "district", "total_price", "unit_price", "description_raw")
_FILE_HEADERS = {
    "UTF-8": ("行号", "房源编号", "城区", "总价", "单价", "描述"),
    "GB18030": ("行号", "编号", "区域", "挂牌价", "单价", "描述"),
}


def _scratch(spark: SparkSession) -> str:
    """A new folder below the session's shared one; below a temporary one only where the session has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = "file://" + tempfile.mkdtemp(prefix="brickledger-")
    return f"{shared.rstrip('/')}/listings-{uuid4()}"


def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """Write listings as UTF-8 and GB18030 files with different headers, then read them all back."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    folder, rows = _scratch(spark), raw(spark, d, *_FILE_COLUMNS, "ingest_file")
    for encoding, headers in _FILE_HEADERS.items():
        batches = ("batch_0", "batch_1") if encoding == "UTF-8" else ("batch_2", "batch_3")
        part = rows.filter(F.col("ingest_file").isin(*batches)).select(
            *[F.col(c).alias(h) for c, h in zip(_FILE_COLUMNS, headers)]
        )
        part.write.csv(f"{folder}/{encoding}", header=True, encoding=encoding, escape='"')
    back, _ = files.read_listing_files(spark, folder, recursive=True)
    return back.select(F.col("行号").alias("source_row"), *_FILE_COLUMNS[1:])


def src_union(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of files, each with a column the other does not have."""
    folder = _scratch(spark)
    orders, parts = table(spark, d, "orders"), table(spark, d, "part")
    orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("房源编号"), F.col("o_orderstatus").alias("标题"),
        F.col("o_custkey").alias("关注人数"),
    ).write.csv(f"{folder}/a", header=True)
    parts.select(
        F.concat(F.lit("p"), "p_partkey").alias("编号"), F.col("p_name").alias("标题"),
        F.col("p_brand").alias("小区"),
    ).write.csv(f"{folder}/b", header=True)
    back, _ = files.read_listing_files(spark, folder, recursive=True)
    return back.select("listing_id", "listing_title", "followers", "community")


def src_file_status(spark: SparkSession, d: str) -> DataFrame:
    """Files by state and encoding, and the rows read from them: four plain ones, one whose name Spark's readers pass
    over, one with bytes of no encoding, and two that hold no table."""
    folder = _scratch(spark)
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("房源编号"), F.col("o_orderstatus").alias("标题")
    )
    orders.repartition(4, "房源编号").write.csv(f"{folder}/2024", header=True)
    names = [[f"{r[0]},{r[1]}" for r in table(spark, d, t).select(f"{t[0]}_{t}key", f"{t[0]}_name").collect()] for t in ("nation", "region")]
    hidden, odd = ["\n".join(["房源编号,标题", *lines, ""]).encode() for lines in names]  # 25 and 5 rows at every size
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    contents = {"2024/_x.csv": hidden, "zero.csv": b"", "a.xlsx": b"PK", "odd.csv": odd.replace(b"A", b"\x81\x20")}
    for name, content in contents.items():
        stream = system.create(hadoop.Path(f"{folder}/{name}"))
        stream.write(bytearray(content))
        stream.close()
    rows, found = files.read_listing_files(spark, folder, recursive=True)
    counts = rows.groupBy("ingest_file").agg(F.count("*").alias("rows"))
    state = found.withColumn("ingest_file", F.regexp_replace("name", r"\.csv$", "")).join(counts, "ingest_file", "left")
    said = [F.coalesce(c, F.lit("")).alias(c) for c in ("reason", "encoding")]
    return state.groupBy("ok", *said).agg(F.count("*").alias("files"), F.sum(F.coalesce("rows", F.lit(0))).alias("rows"))


def src_ingest_file(spark: SparkSession, d: str) -> DataFrame:
    tagged = [
        files.tag_source_file(table(spark, d, name)).select("ingest_file")
        for name in ("lineitem", "orders", "customer")
    ]
    return tagged[0].union(tagged[1]).union(tagged[2]).groupBy("ingest_file").agg(F.count("*").alias("rows"))


def schema_alias(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "district", "community", "total_price", "listing_id")
    return canonicalize_headers(rows.select(
        "row_id", F.col("district").alias("城区"), F.col("community").alias(" 区 域 "),
        F.col("total_price").alias("挂牌价"), F.col("listing_id").alias("编号"), F.lit("x").alias("备注"),
    ))


def schema_rename(spark: SparkSession, d: str) -> DataFrame:
    return rename_standard(
        table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"),
        {"o_orderkey": "listing_id", "o_totalprice": "total_price"},
    )


def export_slim(spark: SparkSession, d: str) -> DataFrame:
    return files.slim_for_export(labelled(spark, d))


def report_sample(spark: SparkSession, d: str) -> DataFrame:
    return etl.report_sample(raw(spark, d))


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    return etl.report_summary(raw(spark, d, "row_id"))


# --- Row-level -------------------------------------------------------------------------------------


def split_delimited(spark: SparkSession, d: str) -> DataFrame:
    outputs = ["layout", "area_m2_str", "orientation", "decoration", "floor_text"]
    return cleaning.split_delimited(raw(spark, d, "row_id", "house_info_raw"), "house_info_raw", "|", outputs)


def split_slash(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    return cleaning.split_slash_part(pages, "url", 2, "location_raw")


def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 4 WHEN 0 THEN ' ' || o_custkey || '.50' WHEN 1 THEN '-' || o_custkey || 'e1' "
        "WHEN 2 THEN o_custkey || 'd' ELSE 'NaN' END AS area_m2",
        "o_orderpriority AS build_year",
        "CASE WHEN o_custkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS unit_price",
        "o_custkey AS followers",
    )
    return cleaning.coerce_numeric(orders)


def _shuffled_parts(rows: DataFrame) -> DataFrame:
    """The parts of every other listing's house info the other way round."""
    parts = F.array_join(F.reverse(F.split("house_info_raw", r"\|")), "|")
    odd = F.element_at(F.split("row_id", "-"), 2).cast("int") % 2 == 1
    return rows.withColumn("house_info_raw", F.when(odd, parts).otherwise(F.col("house_info_raw")))


def expand_house_info(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.expand_house_info(_shuffled_parts(raw(spark, d, "row_id", "house_info_raw")), all_columns=True)


def parse_area(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.expand_house_info(raw(spark, d, "row_id", "house_info_raw"))
    return rows.select("row_id", numbers.area_m2(F.col("area_m2_str")).alias("area_m2"))


def expand_follow_info(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.expand_follow_info(raw(spark, d, "row_id", "follow_info_raw"))


def promote_staging(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "layout", "floor", "house_info_raw")
    return cleaning.promote_staging(cleaning.expand_house_info(rows))


def _one_number(source: str, parser, output: str, spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "row_id", source).select("row_id", parser(F.col(source)).alias(output))


def fill_unit_price(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "total_price", "unit_price", "listing_id").withColumn(
        "area_m2", F.length("listing_id").cast("double") * 10 - 50
    )
    return cleaning.fill_unit_price(cleaning.parse_numeric_text(rows).drop("listing_id"))


def coerce_followers(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.coerce_followers(raw(spark, d, "row_id", "follow_info_raw"), "follow_info_raw")


def floor_band(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.floor_band(raw(spark, d, "row_id", "floor"))


def normalize_decoration(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.normalize_decoration(raw(spark, d, "row_id", "description_raw"), "description_raw")


def finalize(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "house_info_raw", "total_price", "unit_price")
    return cleaning.finalize(cleaning.expand_house_info(rows, all_columns=True))


# --- Tables ----------------------------------------------------------------------------------------


def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    columns = ("ingest_file", "listing_id", "community", "layout", "total_price", "unit_price", "district")
    rows = []
    for name, dropped in (("with_file", ()), ("without_file", ("ingest_file",)),
                          ("without_number", ("listing_id",))):
        kept = [c for c in columns if c not in dropped]
        keys = dedup.resolve_dedup_keys(raw(spark, d, *kept)) or []
        rows += [(name, i, key) for i, key in enumerate(keys)]
    return spark.createDataFrame(rows, "case string, position int, key string")


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "ingest_file", "listing_id", "total_price")
    return dedup.drop_duplicates_first(rows, ["ingest_file", "listing_id"])


def _stored(df: DataFrame) -> DataFrame:
    """df as a table, read again: for columns that several jobs need and that take long to parse."""
    folder = _scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def iqr_filter(spark: SparkSession, d: str) -> DataFrame:
    return outliers.remove_price_outliers(_stored(parsed(spark, d).select("row_id", "unit_price")))


def etl_clean(spark: SparkSession, d: str) -> DataFrame:
    return etl.clean_listings(raw(spark, d), _scratch(spark))


def etl_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return etl.stage_counts(raw(spark, d), _scratch(spark))


def default_clean(spark: SparkSession, d: str) -> DataFrame:
    return etl.clean_and_label(raw(spark, d), _scratch(spark))


# --- Labels ----------------------------------------------------------------------------------------


def _label(column: str, spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "description_raw", "house_info_raw")
    return labels.text_labels(rows).select("row_id", column)


def layout_normalized(spark: SparkSession, d: str) -> DataFrame:
    rows = cleaning.promote_staging(cleaning.expand_house_info(
        raw(spark, d, "row_id", "layout", "house_info_raw")
    ))
    return labels.text_labels(rows).select("row_id", "layout", "layout_normalized")


def build_year_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "description_raw").withColumn("build_year", F.lit(None).cast("double"))
    return labels.text_labels(rows).select("row_id", "build_year")


def score_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "description_raw")
    return scores.sample_for_scoring(rows, rows=fixed.SCORING_ROWS, snippet_chars=fixed.SCORING_SNIPPET_CHARS)


def score_share(spark: SparkSession, d: str) -> DataFrame:
    """One row in a hundred, with its whole text."""
    return scores.sample_for_scoring(raw(spark, d, "row_id", "description_raw"))


def score_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "total_price")
    given = raw(spark, d, "row_id", "total_price").select(
        "row_id",
        (numbers.total_price_wan(F.col("total_price")) / 300).alias("subway"),
        F.expr("CASE WHEN row_id LIKE '%-1' THEN -1.0 WHEN row_id NOT LIKE '%-2' THEN 0.5 END").alias("school"),
    )
    return scores.apply_scores(rows, given)


# --- Quality, profile ------------------------------------------------------------------------------


def _quality_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    clean = dedup.drop_duplicates_first(labelled(spark, d), ["ingest_file", "listing_id"])
    return raw(spark, d, "row_id"), clean


def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    metrics = quality.quality_metrics(*_quality_tables(spark, d))
    return rounded(metrics, *[c for c in metrics.columns if c.endswith("_ratio")])


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    report = quality.quality_report(*_quality_tables(spark, d))
    return report.withColumns({c: F.concat_ws(",", c) for c in ("failures", "warning_codes")})


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d)
    return rounded(profile.column_profile(rows, sample_chars=fixed.PROFILE_SAMPLE_CHARS), "pipe_like_ratio", "slash_like_ratio").withColumn(
        "samples", F.concat_ws("#", "samples")
    )


def profile_top(spark: SparkSession, d: str) -> DataFrame:
    top = profile.top_profile(profile.column_profile(raw(spark, d)), 4)
    return top.select("name", "dtype", F.round("pipe_like_ratio", 4).alias("pipe_like_ratio"))


# --- Analyses --------------------------------------------------------------------------------------


def _analysis(job, *round_columns: str, columns: tuple[str, ...] = ()):
    """An analysis of the parsed listings, of all or only the given raw columns."""
    return lambda spark, d: rounded(job(parsed(spark, d, *columns)), *round_columns)


def quantiles_by_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Prices per file sketched apart and merged: values, and whether the quartiles' ranks are as near as promised."""
    rows = _stored(parsed(spark, d).select("ingest_file", "unit_price"))
    wanted = [0.25, 0.5, 0.75]
    apart = quantiles.value_sketches(rows, F.col("unit_price"), F.col("ingest_file"))
    merged = quantiles.merged_sketches(apart.withColumn("g", F.lit("")))
    found = quantiles.sketched_quantiles(merged, wanted).select(F.array("q0", "q1", "q2").alias("q"))
    q = F.col("q")
    ranks = rows.crossJoin(F.broadcast(found)).agg(  # one row
        F.count("unit_price").alias("n"),
        *[F.count_if(F.col("unit_price") < q[i]).alias(f"less{i}") for i in range(3)],
        *[F.count_if(F.col("unit_price") <= q[i]).alias(f"upto{i}") for i in range(3)],
    )
    near = quantiles.SKETCH_RANK_ERROR * F.col("n") + 1
    cells = [
        F.struct(F.lit(p).alias("probability"), "n", ((F.col(f"less{i}") <= p * F.col("n") + near) & (F.col(f"upto{i}") >= p * F.col("n") - near)).alias("near"))
        for i, p in enumerate(wanted)
    ]
    return ranks.select(F.inline(F.array(*cells)))


def grouped_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The results of all analyses that group the table, from one read, as (task, key, value)."""
    rows = parsed(spark, d, all_columns=True)
    shared = analysis.GroupedTasks(rows, list(analysis.GroupedTasks.NEEDS), folder=_scratch(spark))
    values = {"area_band_share_pie": "count", "community_followers_rank": "followers"}
    parts = []
    for task, key in analysis.GroupedTasks.NEEDS.items():
        if task != "layout_price_box":
            value = F.round(F.col(values.get(task, "unit_price")).cast("double"), 4)
            parts.append(shared.result(task).select(F.lit(task).alias("task"), F.col(key).cast("string").alias("key"), value.alias("value")))
    return reduce(DataFrame.union, parts)


def _without_some(rows: DataFrame) -> DataFrame:
    """No decoration, next to no areas: tasks that need them can't give a result."""
    return rows.drop("decoration").withColumn("area_m2", F.when(F.col("area_m2") > 10_000, F.col("area_m2")))


def task_status(spark: SparkSession, d: str) -> DataFrame:
    return analysis.task_status(_without_some(parsed(spark, d)), list(analysis.TASKS))


def applicable_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The tasks offered for the whole table and for parts of its columns, with their state."""
    rows = parsed(spark, d)
    variants = {"all": rows, "no_price": rows.drop("unit_price"), "no_area": rows.drop("area_m2", "floor_band")}
    return analysis.status_by_columns(rows, {name: some.columns for name, some in variants.items()}).drop("reason")


# --- Search ----------------------------------------------------------------------------------------

_FOUND = ["row_id", "district", "community", "layout_normalized", "total_price", "unit_price", "score"]


ASKED = ("锦江区", "武侯", "高新区", "新都", "温江区", "双流区", "成华")


def geo_keywords(spark: SparkSession, d: str) -> DataFrame:
    """How many listings each keyword of each district asked for finds."""
    words = [(asked, word) for asked in ASKED for word in search.geo_keywords(asked)]
    counts = raw(spark, d, "district").agg(*[
        F.count_if(F.col("district").contains(word)).alias(f"c{i}") for i, (_, word) in enumerate(words)
    ])
    rows = [
        F.struct(F.lit(asked).alias("asked"), F.lit(word).alias("keyword"), F.col(f"c{i}").alias("listings"))
        for i, (asked, word) in enumerate(words)
    ]
    return counts.select(F.inline(F.array(*rows)))


def search_geo(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "district", "community")
    return search.mark_candidates(rows, search.SearchIntent(district_contains="新都区"))


def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = raw(spark, d, "row_id", "district", "community", "description_raw", "house_info_raw")
    return search.mark_candidates(rows, search.SearchIntent(district_contains="温江")).select("row_id", "district")


def search_noise(spark: SparkSession, d: str) -> DataFrame:
    """With parking lots and absurd layouts among others, and where there is nothing else."""
    rows = raw(spark, d, "row_id", "description_raw", "house_info_raw")
    absurd = F.concat(F.lit("12室9厅"), F.substring_index("house_info_raw", "厅", -1))
    rows = rows.withColumn("house_info_raw", F.when(F.col("row_id").endswith("7"), absurd).otherwise(F.col("house_info_raw")))
    only = rows.filter(F.col("row_id").endswith("7"))
    return search.drop_noise(rows).withColumn("table", F.lit("all")).union(
        search.drop_noise(only).withColumn("table", F.lit("noise"))
    )


def search_hard(spark: SparkSession, d: str) -> DataFrame:
    intent = search.SearchIntent(require_tag_near_subway=True, require_tag_has_balcony=True)
    return search.require_tags(labelled(spark, d), intent).select("row_id")


def search_score(spark: SparkSession, d: str) -> DataFrame:
    scored = search.score_rows(labelled(spark, d), INTENTS["a"])
    return rounded(scored.select("row_id", "score"), "score")


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_listings(labelled(spark, d), INTENTS["a"])
    return rounded(found.select(*_FOUND), "score")


def search_listings(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_listings(labelled(spark, d), INTENTS["b"])
    return rounded(found.select(*_FOUND), "score")


#: Many small searches beside the four above.
MANY = {
    f"m{i}": search.SearchIntent(
        needs_row_samples=True, district_contains=ASKED[i % len(ASKED)], max_unit_price=15000.0 + 500 * i, max_rows=1 + i % 5,
    )
    for i in range(40)
}


def search_batch(spark: SparkSession, d: str) -> DataFrame:
    found = batch_search.search_batch(labelled(spark, d), {**INTENTS, **MANY})
    return rounded(found.select("intent_id", "rank", "row_id", "score"), "score")


def search_requests(spark: SparkSession, d: str) -> DataFrame:
    """One search per supplier: the searches are a table, too."""
    district = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("s_suppkey") % len(ASKED) + 1).cast("int"))
    requests = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("intent_id"), F.lit(True).alias("needs_row_samples"),
        district.alias("district_contains"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" Building小区"), F.col("s_suppkey") % 20)).alias("community_contains"),
        (F.lit(15000.0) + F.col("s_suppkey") % 97 * 200).alias("max_unit_price"),
        (F.col("s_suppkey") % 5 + 1).alias("max_rows"),
    )
    found = batch_search.search_batch(labelled(spark, d), requests)
    return rounded(found.select("intent_id", "rank", "row_id", "score"), "score")


OUTCOMES = {
    **INTENTS,
    "e": search.SearchIntent(district_contains="锦江"),
    "f": search.SearchIntent(needs_row_samples=True, require_tag_near_subway=True, require_tag_lighting=True),
}


def search_outcome(spark: SparkSession, d: str) -> DataFrame:
    return batch_search.search_outcomes(labelled(spark, d), OUTCOMES)


def search_json(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_listings(labelled(spark, d), INTENTS["b"])
    shown = found.select("row_id", "listing_id", "district", "community", "layout", "build_year", "tag_near_subway")
    return search.display_json(shown, fixed.DISPLAY_MAX_CHARS)


def search_display(spark: SparkSession, d: str) -> DataFrame:
    return search.display(labelled(spark, d), fixed.DISPLAY_MAX_CHARS)


QUERIES = {
    "src_csv": src_csv,
    "src_union": src_union,
    "src_file_status": src_file_status,
    "src_ingest_file": src_ingest_file,
    "schema_alias": schema_alias,
    "schema_rename": schema_rename,
    "export_slim": export_slim,
    "report_summary": report_summary,
    "report_sample": report_sample,
    "split_delimited": split_delimited,
    "split_slash": split_slash,
    "coerce_numeric": coerce_numeric,
    "expand_house_info": expand_house_info,
    "expand_follow_info": expand_follow_info,
    "promote_staging": promote_staging,
    "parse_unit_price": partial(_one_number, "unit_price", numbers.unit_price_yuan, "unit_price_yuan"),
    "parse_total_price": partial(_one_number, "total_price", numbers.total_price_wan, "total_price_wan"),
    "parse_area": parse_area,
    "fill_unit_price": fill_unit_price,
    "coerce_followers": coerce_followers,
    "floor_band": floor_band,
    "normalize_decoration": normalize_decoration,
    "finalize": finalize,
    "dedup_keys": dedup_keys,
    "dedup_first": dedup_first,
    "iqr_filter": iqr_filter,
    "etl_clean": etl_clean,
    "etl_stage_counts": etl_stage_counts,
    "default_clean": default_clean,
    "tag_subway": partial(_label, "tag_near_subway"),
    "tag_bus": partial(_label, "tag_near_bus"),
    "tag_balcony": partial(_label, "tag_has_balcony"),
    "tag_lighting": partial(_label, "tag_lighting"),
    "tag_station": partial(_label, "tag_subway_station_hint"),
    "tag_elevator": partial(_label, "tag_elevator"),
    "layout_normalized": layout_normalized,
    "build_year_fill": build_year_fill,
    "rule_features": rule_features,
    "score_sample": score_sample,
    "score_share": score_share,
    "score_apply": score_apply,
    "quality_metrics": quality_metrics,
    "quality_report": quality_report,
    "profile": column_profile,
    "profile_top": profile_top,
    "district_summary": _analysis(analysis.district_summary, "avg_unit_price"),
    "price_quantiles": _analysis(analysis.price_quantiles, "min", "p25", "p50", "p75", "max"),
    "area_buckets": _analysis(analysis.area_buckets),
    "decade_avg": _analysis(analysis.decade_avg, "avg_unit_price"),
    "district_price_rank": _analysis(analysis.district_price_rank, "unit_price"),
    "layout_price_box": _analysis(lambda df: analysis.layout_price_box(df, 5)),
    "layout_box_stats": _analysis(lambda df: analysis.layout_box_stats(df, 5), "min", "p25", "p50", "p75", "max"),
    "area_band_price": _analysis(analysis.area_band_price, "unit_price"),
    "area_band_share": _analysis(analysis.area_band_share),
    "decoration_price": _analysis(analysis.decoration_price, "unit_price"),
    "floor_band_price": _analysis(analysis.floor_band_price, "unit_price"),
    "age_price_trend": _analysis(analysis.age_price_trend, "unit_price"),
    "community_followers": _analysis(analysis.community_followers, columns=("community", "follow_info_raw")),
    "total_area_scatter": _analysis(analysis.total_area_scatter),
    "price_outliers": _analysis(outliers.price_outliers, "low", "high"),
    "price_histogram": _analysis(analysis.price_histogram, "bin"),
    "quantiles_by_sketch": quantiles_by_sketch,
    "grouped_tasks": grouped_tasks,
    "task_status": task_status,
    "applicable_tasks": applicable_tasks,
    "summary_facts": _analysis(analysis.summary_facts, "value"),
    "geo_keywords": geo_keywords,
    "search_geo": search_geo,
    "search_candidates": search_candidates,
    "search_noise": search_noise,
    "search_hard": search_hard,
    "search_score": search_score,
    "search_topk": search_topk,
    "search_listings": search_listings,
    "search_outcome": search_outcome,
    "search_batch": search_batch,
    "search_requests": search_requests,
    "search_json": search_json,
    "search_display": search_display,
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["district_price_rank"](spark, d)
