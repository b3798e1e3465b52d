"""Plain SQL over the same tables that gives the same rows as the registered queries.

Written on its own, from what the columns mean: house-info cells of these listings have their parts in a
fixed order, so positions stand in for the general parser.
"""

from __future__ import annotations

_Q = "CAST(l_quantity AS INT)"
_AREA = f"(30 + 3 * {_Q})"
_TOTAL = "CAST(floor(l_extendedprice / 250) AS BIGINT)"

_LISTINGS = f"""
SELECT
  l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
    || CAST(floor(l_extendedprice * 100) AS BIGINT) || '-' || {_Q} AS row_id,
  'batch_' || (l_suppkey % 4) AS ingest_file,
  l_orderkey || '-' || l_linenumber AS listing_id,
  CASE WHEN l_partkey % 17 <> 0 THEN
    ['锦江区', '武侯区', '高新区', '新都', '温江区', '双流区'][1 + c_nationkey % 6] END AS district,
  c_mktsegment || '小区' || (o_custkey % 20) AS community,
  CASE WHEN l_partkey % 11 = 0 THEN '三室两厅' END AS layout,
  (1 + l_linenumber % 5) || '室' || (1 + l_linenumber % 2) || '厅|' || {_AREA} || '平米|'
    || ['南', '东南', '南北'][1 + {_Q} % 3] || '|' || ['精装', '简装', '毛坯', '豪装'][1 + {_Q} % 4] || '|'
    || ['中楼层(共26层)', '低层(共6层)'][1 + {_Q} % 2] || '|' || (year(o_orderdate) + 10) || '年建|'
    || ['板楼', '塔楼'][1 + l_suppkey % 2] AS house_info_raw,
  CASE WHEN {_Q} % 9 = 0 THEN '1.2万人关注/' ELSE ({_Q} * 7) || '人关注 / ' END
    || (1 + {_Q} % 12) || '个月以前发布' AS follow_info_raw,
  {_TOTAL} || '万' AS total_price,
  CASE WHEN l_partkey % 3 <> 0 THEN
    CAST(floor(CAST({_TOTAL} AS DOUBLE) * 10000 / {_AREA}) AS BIGINT) || '元/平米' END AS unit_price,
  CASE WHEN l_linenumber % 2 = 0 THEN (1 + {_Q} % 33) || '/33' END AS floor,
  ['地铁房精装', 'TOD综合体', '距南熏大道站600米 双阳台', '步行5分钟到公交站', '无地铁公交便利',
   '产权车位转让', '采光好全明户型 无电梯', '建于2012年 电梯房', '', NULL][1 + l_partkey % 10] AS description_raw
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

_BAND = """CASE WHEN floor IS NULL THEN '未知'
  WHEN floor LIKE '%低层%' THEN '低层'
  WHEN regexp_matches(floor, '^[0-9]+/33$') THEN
    CASE WHEN CAST(split_part(floor, '/', 1) AS INT) <= 11 THEN '低层'
         WHEN CAST(split_part(floor, '/', 1) AS INT) <= 22 THEN '中层' ELSE '高层' END
  ELSE '未知' END"""

_FOLLOWERS = """CASE WHEN follow_info_raw LIKE '1.2万%' THEN 12000.0
  ELSE CAST(split_part(follow_info_raw, '人', 1) AS DOUBLE) END"""

_EXPANDED = f"""
SELECT *,
  split_part(house_info_raw, '|', 1) AS layout_str,
  split_part(house_info_raw, '|', 2) AS area_m2_str,
  split_part(house_info_raw, '|', 3) AS orientation_str,
  split_part(house_info_raw, '|', 4) AS decoration_str,
  split_part(house_info_raw, '|', 5) AS floor_text,
  replace(split_part(house_info_raw, '|', 6), '年建', '') AS build_year,
  split_part(house_info_raw, '|', 7) AS building_type_str,
  {_FOLLOWERS} AS followers,
  trim(split_part(follow_info_raw, '/', 2)) AS publish_time_raw,
  trim(split_part(follow_info_raw, '/', 2)) AS listing_time
FROM listings
"""

_PARSED = f"""
SELECT *, {_BAND} AS floor_band FROM (
  SELECT * REPLACE (
      coalesce(layout, layout_str) AS layout,
      coalesce(floor, floor_text) AS floor,
      CAST(build_year AS DOUBLE) AS build_year,
      CAST(replace(total_price, '万', '') AS DOUBLE) AS total_price,
      coalesce(CAST(replace(unit_price, '元/平米', '') AS DOUBLE),
               CAST(replace(total_price, '万', '') AS DOUBLE) * 10000
               / CAST(replace(area_m2_str, '平米', '') AS DOUBLE)) AS unit_price
    ),
    CAST(replace(area_m2_str, '平米', '') AS DOUBLE) AS area_m2,
    orientation_str AS orientation, decoration_str AS decoration, building_type_str AS building_type
  FROM expanded
)
"""

_UNIQUE = """
SELECT * FROM parsed
QUALIFY row_number() OVER (PARTITION BY ingest_file, listing_id ORDER BY row_id) = 1
"""

_BOUNDS = """
SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (
  SELECT quantile_cont(unit_price, 0.25) AS q1, quantile_cont(unit_price, 0.75) AS q3 FROM {table})
"""

_CLEAN = """
SELECT unique_rows.* FROM unique_rows, unique_bounds WHERE unit_price IS NULL OR unit_price BETWEEN low AND high
"""

_NORMAL_LAYOUT = "CASE WHEN layout = '三室两厅' THEN '3室1厅' ELSE layout END"

_TAGS = {
    "tag_near_subway": "coalesce(description_raw IN ('地铁房精装', 'TOD综合体', '距南熏大道站600米 双阳台'), false)",
    "tag_near_bus": "coalesce(description_raw LIKE '%公交%', false)",
    "tag_has_balcony": "coalesce(description_raw LIKE '%阳台%', false)",
    "tag_lighting": "coalesce(regexp_matches(description_raw, '采光|通透|全明'), false)",
    "tag_subway_station_hint": (
        "CASE WHEN description_raw LIKE '%南熏大道%' THEN '南熏大道' ELSE '' END"
    ),
    "tag_elevator": "coalesce(description_raw LIKE '%电梯%', false)",
}
_TAG_COLUMNS = ", ".join(f"{sql} AS {name}" for name, sql in _TAGS.items())

_CTES = {
    "listings": _LISTINGS,
    "expanded": _EXPANDED,
    "parsed": _PARSED,
    "unique_rows": _UNIQUE,
    "unique_bounds": _BOUNDS.format(table="unique_rows"),
    "parsed_bounds": _BOUNDS.format(table="parsed"),
    "clean": _CLEAN,
    "labelled": f"SELECT *, {_TAG_COLUMNS}, {_NORMAL_LAYOUT} AS layout_normalized FROM parsed",
    "labelled_unique": f"SELECT *, {_TAG_COLUMNS}, {_NORMAL_LAYOUT} AS layout_normalized FROM unique_rows",
    "labelled_clean": f"SELECT *, {_TAG_COLUMNS}, {_NORMAL_LAYOUT} AS layout_normalized FROM clean",
}
_NEEDS = {
    "listings": (),
    "expanded": ("listings",),
    "parsed": ("expanded",),
    "unique_rows": ("parsed",),
    "unique_bounds": ("unique_rows",),
    "parsed_bounds": ("parsed",),
    "clean": ("unique_rows", "unique_bounds"),
    "labelled": ("parsed",),
    "labelled_unique": ("unique_rows",),
    "labelled_clean": ("clean",),
}


def _sql(select: str, *tables: str, extra: dict[str, str] | None = None) -> str:
    """The select with the common tables it names, and the ones those need, in front."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for other in _NEEDS[name]:
            want(other)
        if name not in wanted:
            wanted.append(name)

    for name in tables:
        want(name)
    parts = [(name, _CTES[name]) for name in wanted] + list((extra or {}).items())
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts) + "\n" + select


_AREA_BAND = """CASE WHEN area_m2 > 0 AND area_m2 <= 60 THEN '<=60' WHEN area_m2 > 60 AND area_m2 <= 90 THEN '60-90'
  WHEN area_m2 > 90 AND area_m2 <= 120 THEN '90-120' WHEN area_m2 > 120 AND area_m2 <= 150 THEN '120-150'
  WHEN area_m2 > 150 AND area_m2 <= 10000 THEN '>150' END"""

_BANDS = "(VALUES (0, '<=60'), (1, '60-90'), (2, '90-120'), (3, '120-150'), (4, '>150')) AS b(position, band)"

_PRICE_BOX = """
SELECT layout AS category, unit_price FROM parsed WHERE unit_price IS NOT NULL AND layout IN (
  SELECT layout FROM parsed WHERE unit_price IS NOT NULL AND layout IS NOT NULL
  GROUP BY layout ORDER BY count(*) DESC, layout LIMIT 5)
"""


def _mean_by(key: str, alias: str) -> str:
    return _sql(
        f"SELECT {key} AS {alias}, round(avg(unit_price), 4) AS unit_price FROM parsed "
        f"WHERE unit_price IS NOT NULL AND ({key}) IS NOT NULL GROUP BY 1",
        "parsed",
    )


# --- Search ----------------------------------------------------------------------------------------

_GEO = "concat_ws('#', district, community)"
_TEXT = "lower(concat_ws(' ', description_raw, house_info_raw, follow_info_raw, community))"
_ROOMS = "CAST(split_part(layout_normalized, '室', 1) AS INT)"
_PARKING = "coalesce(description_raw LIKE '%车位%', false)"


def _points(*terms: tuple[str, str]) -> str:
    return " + ".join(["CAST(0 AS DOUBLE)"] + [
        f"CAST(CASE WHEN {condition} THEN {points} ELSE 0 END AS DOUBLE)" for condition, points in terms
    ])


_HIGH_TECH = "regexp_matches({0}, '高新')"
_JINJIANG = "regexp_matches({0}, '锦江')"
_SCORES = {
    "a": _points(
        (_HIGH_TECH.format(_GEO), "120"), (_HIGH_TECH.format(_TEXT), "26.4"),
        ("layout LIKE '%3室%' OR layout_normalized LIKE '%3室%'", "75"), (f"{_TEXT} LIKE '%3室%'", "15"),
        ("unit_price <= 30000", "55"), ("unit_price > 30000 AND unit_price <= 36000", "22"),
        (f"tag_near_subway AND regexp_matches({_TEXT}, '地铁|号线|轨道')", "85"),
        (f"tag_near_subway AND NOT regexp_matches({_TEXT}, '地铁|号线|轨道')", "55"),
        (f"NOT tag_near_subway AND regexp_matches({_TEXT}, '地铁|号线|轨道')", "50"),
        ("build_year >= 2008", "45"), ("build_year >= 2000 AND build_year < 2008", "18"),
        (_PARKING, "-600"), (f"{_ROOMS} BETWEEN 2 AND 6", "110"),
    ),
    "b": _points(
        (_JINJIANG.format(_GEO), "120"), (_JINJIANG.format(_TEXT), "26.4"),
        ("total_price <= 200", "55"), ("total_price > 200 AND total_price <= 230", "22"),
        ("total_price >= 100", "46.75"),
        (f"tag_has_balcony AND {_TEXT} LIKE '%阳台%'", "70"),
        ("tag_lighting", "65"),
        (_PARKING, "-600"),
    ),
    "c": _points(
        ("lower(community) LIKE '%building小区1%'", "95"), (f"{_TEXT} LIKE '%building小区1%'", "33.25"),
        ("unit_price >= 20000", "46.75"), (f"{_TEXT} LIKE '%南熏大道%'", "100"),
        (_PARKING, "-600"),
    ),
}
_PASSES = {
    "a": f"(regexp_matches({_GEO}, '高新') OR regexp_matches({_TEXT}, '高新')) AND NOT {_PARKING}",
    "b": f"regexp_matches({_GEO}, '锦江') AND NOT {_PARKING} AND tag_near_subway",
    "c": f"NOT {_PARKING} AND tag_has_balcony",
}
_MOST = {"a": 40, "b": 25, "c": 15}
_BEST = "score DESC, coalesce(unit_price, 1e18), ingest_file, row_id"


def _found(key: str) -> str:
    return (
        f"SELECT *, {_SCORES[key]} AS score FROM labelled WHERE {_PASSES[key]} "
        f"ORDER BY {_BEST} LIMIT {_MOST[key]}"
    )


def _search(key: str) -> str:
    return _sql(
        "SELECT row_id, district, community, layout_normalized, total_price, unit_price, "
        f"round(score, 4) AS score FROM ({_found(key)})", "labelled",
    )


_OUTCOME = """
SELECT '{key}' AS intent_id, count(*) AS table_rows, count(*) FILTER ({candidate}) AS candidates,
  count(*) FILTER (({candidate}) AND NOT {parking}) AS after_noise,
  count(*) FILTER (({candidate}) AND NOT {parking} AND {hard}) AS after_hard_tags,
  least(count(*) FILTER (({candidate}) AND NOT {parking} AND {hard}), {most}) AS results,
  CASE WHEN count(*) FILTER ({candidate}) = 0 THEN 'no_district_match' END AS reason, '{tags}' AS hard_tags
FROM labelled"""

_MANY = f"""
SELECT 'm' || i AS intent_id, row_id, row_number() OVER (PARTITION BY i ORDER BY {_BEST}) AS rank, score FROM (
  SELECT *, 120.0::DOUBLE + CASE WHEN unit_price <= high THEN 55 WHEN unit_price <= high * 1.2 THEN 22 ELSE 0 END AS score
  FROM labelled JOIN (
    SELECT i, ['锦江', '武侯', '高新', '新都', '温江', '双流', '成华'][1 + i % 7] AS stem, 15000.0::DOUBLE + 500 * i AS high
    FROM range(40) AS t(i)) ON contains(district, stem)
  WHERE NOT {_PARKING})
QUALIFY rank <= 1 + i % 5"""

_REQUESTS = f"""
SELECT intent_id, CAST(row_number() OVER (PARTITION BY intent_id ORDER BY {_BEST}) AS INT) AS rank, row_id, round(score, 4) AS score,
  most FROM (
  SELECT *, 120.0::DOUBLE
    + CASE WHEN contains(lower(community), part) THEN 128.25 ELSE 0 END
    + CASE WHEN unit_price <= high THEN 55 WHEN unit_price <= high * 1.2 THEN 22 ELSE 0 END AS score
  FROM labelled JOIN (
    SELECT 's' || s_suppkey AS intent_id, ['锦江', '武侯', '高新', '新都', '温江', '双流', '成华'][1 + s_suppkey % 7] AS stem,
      CASE WHEN s_suppkey % 3 = 0 THEN 'building小区' || s_suppkey % 20 END AS part,
      15000.0::DOUBLE + s_suppkey % 97 * 200 AS high, 1 + s_suppkey % 5 AS most
    FROM supplier) ON contains(district, stem)
  WHERE NOT {_PARKING})
QUALIFY rank <= most"""

_OUTCOMES = "\nUNION ALL\n".join(
    _OUTCOME.format(key=key, candidate=candidate, parking=_PARKING, hard=hard, most=most, tags=tags)
    for key, candidate, hard, most, tags in (
        ("a", f"regexp_matches({_GEO}, '高新')", "true", 40, ""),
        ("b", f"regexp_matches({_GEO}, '锦江')", "tag_near_subway", 25, "tag_near_subway"),
        ("c", "true", "tag_has_balcony", 15, "tag_has_balcony"),
        ("d", f"regexp_matches({_GEO}, '成华')", "true", 10, ""),
    )
)

# --- Profile and quality ---------------------------------------------------------------------------

_PROFILED = (
    "ingest_file", "listing_id", "district", "community", "layout", "house_info_raw", "follow_info_raw",
    "total_price", "unit_price", "floor", "description_raw",
)


def _profile_row(position: int, name: str) -> str:
    return f"""
SELECT {position} AS position, '{name}' AS name, 'string' AS dtype,
  round(count({name}) / count(*), 4) AS non_null_ratio,
  (SELECT string_agg(substring({name}, 1, 120), '#' ORDER BY row_id) FROM
    (SELECT row_id, {name} FROM listings WHERE {name} IS NOT NULL ORDER BY row_id LIMIT 3)) AS samples,
  round(count(*) FILTER (contains({name}, '|')) / count({name}), 4) AS pipe_like_ratio,
  round(count(*) FILTER (contains({name}, '/')) / count({name}), 4) AS slash_like_ratio
FROM listings"""


_PROFILE = "\nUNION ALL\n".join(_profile_row(i, name) for i, name in enumerate(_PROFILED))

_METRICS = """
SELECT (SELECT count(*) FROM listings) AS raw_rows, count(*) AS clean_rows,
  round(count(*) / (SELECT count(*) FROM listings), 4) AS row_retention_ratio,
  round(count(*) FILTER (unit_price > 30 AND unit_price < 600000) / count(*), 4) AS unit_price_valid_ratio,
  round(count(total_price) / count(*), 4) AS total_price_non_null_ratio,
  round(count(area_m2) / count(*), 4) AS area_m2_non_null_ratio,
  round(count(*) FILTER (district IS NOT NULL OR community IS NOT NULL) / count(*), 4) AS geo_non_null_ratio,
  round(count(*) FILTER (tag_near_subway) / count(*), 4) AS tag_near_subway_true_ratio,
  round(count(*) FILTER (description_raw <> '') / count(*), 4) AS description_raw_non_empty_ratio
FROM labelled_unique"""

_DISTRICT_FACTS = """
  SELECT district, count(district) AS listings, avg(unit_price) AS mean,
    row_number() OVER (ORDER BY count(district) DESC, district ASC NULLS LAST) AS place
  FROM parsed GROUP BY district"""

_FACTS = f"""
SELECT 'overview' AS section, 1 AS rank, 'rows' AS label, CAST(count(*) AS DOUBLE) AS value FROM parsed
UNION ALL SELECT 'price', 1, 'min', round(min(unit_price), 4) FROM parsed
UNION ALL SELECT 'price', 2, 'p25', round(quantile_cont(unit_price, 0.25), 4) FROM parsed
UNION ALL SELECT 'price', 3, 'median', round(quantile_cont(unit_price, 0.5), 4) FROM parsed
UNION ALL SELECT 'price', 4, 'p75', round(quantile_cont(unit_price, 0.75), 4) FROM parsed
UNION ALL SELECT 'price', 5, 'max', round(max(unit_price), 4) FROM parsed
UNION ALL SELECT 'price', 6, 'mean', round(avg(unit_price), 4) FROM parsed
UNION ALL SELECT 'district_listings', CAST(place AS INT), coalesce(district, ''), CAST(listings AS DOUBLE)
  FROM ({_DISTRICT_FACTS}) WHERE place <= 5
UNION ALL SELECT 'district_price', CAST(place AS INT), coalesce(district, ''), round(mean, 4)
  FROM ({_DISTRICT_FACTS}) WHERE place <= 5
UNION ALL SELECT 'area_bands', CAST(place AS INT), band, CAST(n AS DOUBLE) FROM (
  SELECT band, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0) DESC, position) AS place
  FROM {_BANDS} LEFT JOIN (SELECT {_AREA_BAND} AS band, count(*) AS n FROM parsed GROUP BY 1) USING (band)
) WHERE place <= 3
UNION ALL SELECT 'tasks', 1, 'ok', CASE WHEN count(*) < 5 THEN 0 ELSE 7
  + CAST(count(*) FILTER (district IS NOT NULL AND unit_price IS NOT NULL) > 0 AS INT)
  + CAST(count(area_m2) >= 5 AS INT) + 2 * CAST(count(unit_price) >= 5 AS INT) END FROM parsed
UNION ALL SELECT 'tasks', 2, 'total', 11"""

_HISTOGRAM = """
SELECT round((e0 + e1) / 2, 4) AS bin, count(v) AS count FROM (
  SELECT i, lo + i * (hi - lo) / bins AS e0, CASE WHEN i = bins - 1 THEN hi ELSE lo + (i + 1) * (hi - lo) / bins END AS e1
  FROM (SELECT *, unnest(range(CAST(bins AS BIGINT))) AS i FROM shape)
) LEFT JOIN (
  SELECT unit_price AS v, least(CAST(floor((unit_price - lo) / (hi - lo) * bins) AS BIGINT), CAST(bins AS BIGINT) - 1) AS i
  FROM parsed, shape WHERE unit_price IS NOT NULL
) USING (i) GROUP BY e0, e1"""
_SHAPE = """
SELECT min(unit_price) AS lo, max(unit_price) AS hi, least(40, greatest(10, count(unit_price) // 5)) AS bins FROM parsed
"""

_TASK_NAMES = (
    "district_price_rank", "layout_price_box", "area_band_price", "area_band_share_pie",
    "decoration_price_compare", "floor_band_price", "building_age_price_trend", "community_followers_rank",
    "total_area_scatter", "unit_price_histogram", "price_outlier_flag",
)

_LABEL_KEYS = {
    "tag_subway": "tag_near_subway", "tag_bus": "tag_near_bus", "tag_balcony": "tag_has_balcony",
    "tag_lighting": "tag_lighting", "tag_station": "tag_subway_station_hint", "tag_elevator": "tag_elevator",
}

_NEEDED = {
    "district_price_rank": ("district", "unit_price"), "layout_price_box": ("layout", "unit_price"),
    "area_band_price": ("area_m2", "unit_price"), "area_band_share_pie": ("area_m2",),
    "decoration_price_compare": ("decoration", "unit_price"), "floor_band_price": ("floor_band", "unit_price"),
    "building_age_price_trend": ("build_year", "unit_price"), "community_followers_rank": ("community", "followers"),
    "total_area_scatter": ("area_m2", "total_price"), "unit_price_histogram": ("unit_price",),
    "price_outlier_flag": ("unit_price",),
}


def _offered(variant: str, *missing: str) -> str:
    fitting = [name for name in _TASK_NAMES if not set(_NEEDED[name]) & set(missing)]
    rows = ", ".join(f"('{variant}', {i}, '{name}')" for i, name in enumerate(fitting))
    return (
        f"SELECT variant, position, task, (SELECT count(*) >= 5 FROM parsed WHERE unit_price IS NOT NULL AND district IS NOT NULL) "
        f"AS ok FROM (VALUES {rows}) AS t(variant, position, task)"
    )


_QUANTILE_COLUMNS = """round(min({c}), 4) AS "min", round(quantile_cont({c}, 0.25), 4) AS p25,
  round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS "max"
""".format(c="unit_price")

_KEYWORDS = {
    "锦江区": ("锦江区", "锦江"), "武侯": ("武侯", "武侯区"), "温江区": ("温江区", "温江"),
    "双流区": ("双流区", "双流"), "新都": ("新都", "新都区"), "成华": ("成华", "成华区"),
    "高新区": (
        "高新区", "高新", "成都高新", "成都高新区", "高新城南", "高新城南区", "新川科技园", "新川科技园区",
        "新川", "新川区",
    ),
}
_KEYWORD_ROWS = ", ".join(f"('{name}', '{word}')" for name, words in _KEYWORDS.items() for word in words)

_STAGES = """
SELECT position, stage, "rows", dropped,
  dropped > 0 AND row_number() OVER (ORDER BY dropped DESC, position) = 1 AS largest_drop FROM (
  SELECT 0 AS position, 'input' AS stage, (SELECT count(*) FROM listings) AS "rows", CAST(0 AS BIGINT) AS dropped
  UNION ALL SELECT 1, 'dedup', (SELECT count(*) FROM unique_rows),
    (SELECT count(*) FROM listings) - (SELECT count(*) FROM unique_rows)
  UNION ALL SELECT 2, 'iqr', (SELECT count(*) FROM clean),
    (SELECT count(*) FROM unique_rows) - (SELECT count(*) FROM clean))"""

_DEDUP_KEYS = """
SELECT "case", position, key FROM (VALUES
  ('with_file', 0, 'ingest_file', 0), ('with_file', 1, 'listing_id', 0),
  ('without_file', 0, 'listing_id', 0), ('without_file', 1, 'community', 1), ('without_file', 2, 'layout', 1),
  ('without_file', 3, 'total_price', 1), ('without_file', 4, 'unit_price', 1), ('without_file', 5, 'district', 1),
  ('without_number', 0, 'ingest_file', 0), ('without_number', 1, 'community', 0),
  ('without_number', 2, 'layout', 0), ('without_number', 3, 'total_price', 0),
  ('without_number', 4, 'unit_price', 0), ('without_number', 5, 'district', 0)
) AS t("case", position, key, only_if_numbers_repeat)
WHERE only_if_numbers_repeat = 0
   OR (SELECT count(DISTINCT listing_id) < floor(0.92 * count(*)) FROM listings)"""

_SCALED = "CAST(replace(total_price, '万', '') AS DOUBLE)"

ORACLE = {
    "src_csv": _sql(
        "SELECT row_id AS source_row, listing_id, district, total_price, unit_price, "
        "nullif(description_raw, '') AS description_raw FROM listings", "listings"
    ),
    "src_union": """
SELECT 'o' || o_orderkey AS listing_id, o_orderstatus AS listing_title, CAST(o_custkey AS VARCHAR) AS followers,
  CAST(NULL AS VARCHAR) AS community FROM orders
UNION ALL SELECT 'p' || p_partkey, p_name, NULL, p_brand FROM part""",
    "src_file_status": """
SELECT true AS ok, '' AS reason, 'UTF-8' AS encoding, 5 AS files,
  (SELECT count(*) FROM orders) + (SELECT count(*) FROM nation) AS "rows"
UNION ALL SELECT true, '', 'GBK, bytes replaced', 1, count(*) FROM region
UNION ALL SELECT false, 'spreadsheet files are not supported', '', 1, 0
UNION ALL SELECT false, 'empty file', '', 1, 0""",
    "src_ingest_file": """
SELECT 'lineitem' AS ingest_file, count(*) AS "rows" FROM lineitem
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer""",
    "schema_alias": _sql(
        "SELECT row_id, coalesce(district, community) AS district, total_price, listing_id, 'x' AS \"备注\" "
        "FROM listings", "listings"
    ),
    "schema_rename": (
        "SELECT o_orderkey AS listing_id, o_totalprice AS total_price, o_orderstatus FROM orders"
    ),
    "export_slim": _sql(
        "SELECT * EXCLUDE (area_m2_str, layout_str, orientation_str, floor_text, decoration_str, "
        "building_type_str, publish_time_raw, layout) FROM labelled", "labelled"
    ),
    "report_summary": _sql("SELECT 'rows' AS metric, count(*) AS value FROM listings", "listings"),
    "report_sample": _sql("SELECT * FROM listings ORDER BY ingest_file, row_id LIMIT 5000", "listings"),
    "split_delimited": _sql(
        "SELECT row_id, house_info_raw, layout_str AS layout, area_m2_str, orientation_str AS orientation, "
        "decoration_str AS decoration, floor_text FROM expanded", "expanded"
    ),
    "split_slash": """
SELECT page_id, url, list_filter(string_split(url, '/'), lambda p: p <> '')[3] AS location_raw
FROM pages""",
    "coerce_numeric": """
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 0.5e0 WHEN 1 THEN -10e0 * o_custkey END AS area_m2,
  CAST(NULL AS DOUBLE) AS build_year,
  CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS unit_price,
  CAST(o_custkey AS DOUBLE) AS followers
FROM orders""",
    "expand_house_info": _sql(
        "SELECT row_id, CASE WHEN CAST(split_part(row_id, '-', 2) AS INT) % 2 = 1 "
        "THEN array_to_string(list_reverse(string_split(house_info_raw, '|')), '|') ELSE house_info_raw END AS house_info_raw, "
        "layout_str, area_m2_str, orientation_str, decoration_str, build_year, building_type_str, floor_text FROM expanded",
        "expanded",
    ),
    "expand_follow_info": _sql(
        "SELECT row_id, follow_info_raw, followers, publish_time_raw, listing_time FROM expanded", "expanded"
    ),
    "promote_staging": _sql(
        "SELECT row_id, coalesce(layout, layout_str) AS layout, coalesce(floor, floor_text) AS floor, "
        "house_info_raw, layout_str, area_m2_str, orientation_str, decoration_str, build_year, "
        "building_type_str, floor_text, area_m2_str AS area_m2, orientation_str AS orientation, "
        "decoration_str AS decoration, building_type_str AS building_type FROM expanded", "expanded"
    ),
    "parse_unit_price": _sql(
        "SELECT row_id, CAST(replace(unit_price, '元/平米', '') AS DOUBLE) AS unit_price_yuan FROM listings",
        "listings",
    ),
    "parse_total_price": _sql(f"SELECT row_id, {_SCALED} AS total_price_wan FROM listings", "listings"),
    "parse_area": _sql(
        "SELECT row_id, CAST(replace(area_m2_str, '平米', '') AS DOUBLE) AS area_m2 FROM expanded", "expanded"
    ),
    "fill_unit_price": _sql(
        "SELECT row_id, total_price, coalesce(unit_price, total_price * 10000 / nullif(area_m2, 0)) AS unit_price, "
        f"area_m2 FROM (SELECT row_id, {_SCALED} AS total_price, "
        "CAST(replace(unit_price, '元/平米', '') AS DOUBLE) AS unit_price, "
        "CAST(length(listing_id) AS DOUBLE) * 10 - 50 AS area_m2 FROM listings)", "listings"
    ),
    "coerce_followers": _sql(
        f"SELECT row_id, follow_info_raw, {_FOLLOWERS} AS followers FROM listings", "listings"
    ),
    "floor_band": _sql(f"SELECT row_id, floor, {_BAND} AS floor_band FROM listings", "listings"),
    "normalize_decoration": _sql(
        "SELECT row_id, description_raw, CASE WHEN description_raw IS NULL OR description_raw = '' THEN '未知' "
        "WHEN description_raw LIKE '%精装%' THEN '精装' ELSE description_raw END AS decoration "
        "FROM listings", "listings"
    ),
    "finalize": _sql(
        "SELECT row_id, house_info_raw, total_price, unit_price, layout_str, area_m2_str, orientation_str, "
        "decoration_str, build_year, building_type_str, floor_text, area_m2, layout_str AS layout, "
        "orientation, floor_text AS floor, decoration, building_type FROM parsed", "parsed"
    ),
    "dedup_keys": _sql(_DEDUP_KEYS, "listings"),
    "dedup_first": _sql(
        "SELECT row_id, ingest_file, listing_id, total_price FROM listings QUALIFY row_number() OVER "
        "(PARTITION BY ingest_file, listing_id ORDER BY row_id) = 1", "listings"
    ),
    "iqr_filter": _sql(
        "SELECT row_id, unit_price FROM parsed, parsed_bounds WHERE unit_price IS NULL OR unit_price "
        "BETWEEN low AND high", "parsed", "parsed_bounds"
    ),
    "etl_clean": _sql("SELECT * FROM clean", "clean"),
    "etl_stage_counts": _sql(_STAGES, "clean"),
    "default_clean": _sql("SELECT * FROM labelled_clean", "labelled_clean"),
    **{
        key: _sql(f"SELECT row_id, {_TAGS[column]} AS {column} FROM listings", "listings")
        for key, column in _LABEL_KEYS.items()
    },
    "layout_normalized": _sql(
        f"SELECT row_id, layout, {_NORMAL_LAYOUT} AS layout_normalized FROM parsed", "parsed"
    ),
    "build_year_fill": _sql(
        "SELECT row_id, CASE WHEN description_raw LIKE '%2012%' THEN CAST(2012 AS DOUBLE) END AS build_year "
        "FROM listings", "listings"
    ),
    "rule_features": _sql("SELECT * FROM labelled", "labelled"),
    "score_sample": _sql(
        "SELECT row_id, substring(coalesce(description_raw, ''), 1, 400) AS snippet FROM listings "
        "ORDER BY md5(row_id || '-42'), row_id LIMIT 200", "listings"
    ),
    "score_share": _sql(
        "SELECT row_id, coalesce(description_raw, '') AS snippet FROM listings WHERE md5(row_id || '-42') < '028f5c28'", "listings"
    ),
    "score_apply": _sql(
        f"SELECT row_id, total_price, least(1.0, {_SCALED} / 300) AS description_hint_subway, "
        "CASE WHEN row_id LIKE '%-1' OR row_id LIKE '%-2' THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END "
        "AS description_hint_school FROM listings", "listings"
    ),
    "quality_metrics": _sql(_METRICS, "labelled_unique", "listings"),
    "quality_report": _sql(
        "SELECT *, '' AS failures, CASE WHEN tag_near_subway_true_ratio < 0.3 THEN 'tag_near_subway_sparse' "
        f"ELSE '' END AS warning_codes, true AS passed FROM ({_METRICS})", "labelled_unique", "listings"
    ),
    "profile": _sql(_PROFILE, "listings"),
    "profile_top": _sql(
        f"SELECT name, dtype, pipe_like_ratio FROM ({_PROFILE}) ORDER BY pipe_like_ratio DESC, position LIMIT 4",
        "listings",
    ),
    "district_summary": _sql(
        "SELECT district, count(district) AS listings, round(avg(unit_price), 4) AS avg_unit_price "
        "FROM parsed GROUP BY district", "parsed"
    ),
    "price_quantiles": _sql(f"SELECT {_QUANTILE_COLUMNS} FROM parsed", "parsed"),
    "area_buckets": _sql(
        "SELECT position, band, coalesce(n, 0) AS listings FROM "
        f"{_BANDS} LEFT JOIN (SELECT {_AREA_BAND} AS band, count(*) AS n FROM parsed GROUP BY 1) USING (band)",
        "parsed",
    ),
    "decade_avg": _sql(
        "SELECT CAST(floor(build_year / 10) * 10 AS BIGINT) AS decade_start, "
        "round(avg(unit_price), 4) AS avg_unit_price FROM parsed "
        "WHERE build_year IS NOT NULL AND unit_price IS NOT NULL GROUP BY 1", "parsed"
    ),
    "district_price_rank": _mean_by("district", "district"),
    "layout_price_box": _sql(_PRICE_BOX, "parsed"),
    "layout_box_stats": _sql(
        f"SELECT category, count(*) AS listings, {_QUANTILE_COLUMNS} FROM ({_PRICE_BOX}) GROUP BY category",
        "parsed",
    ),
    "area_band_price": _mean_by(_AREA_BAND, "band"),
    "area_band_share": _sql(
        f"SELECT {_AREA_BAND} AS band, count(*) AS count FROM parsed WHERE area_m2 > 0 GROUP BY 1", "parsed"
    ),
    "decoration_price": _mean_by("decoration", "decoration"),
    "floor_band_price": _mean_by("floor_band", "floor_band"),
    "age_price_trend": _mean_by("CAST(floor(build_year / 10) * 10 AS BIGINT)", "decade_start"),
    "community_followers": _sql(
        "SELECT community, sum(followers) AS followers FROM parsed WHERE followers IS NOT NULL "
        "GROUP BY community ORDER BY sum(followers) DESC, community LIMIT 15", "parsed"
    ),
    "total_area_scatter": _sql("SELECT area_m2, total_price FROM parsed", "parsed"),
    "price_outliers": _sql(
        "SELECT count(unit_price) AS valid_rows, count(*) FILTER (unit_price < low OR unit_price > high) "
        "AS outlier_rows, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high "
        "FROM parsed, parsed_bounds", "parsed", "parsed_bounds"
    ),
    "price_histogram": _sql(_HISTOGRAM, "parsed", extra={"shape": _SHAPE}),
    "quantiles_by_sketch": _sql(
        "SELECT probability, (SELECT count(unit_price) FROM parsed) AS n, true AS near "
        "FROM (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) AS v(probability)", "parsed"
    ),
    "grouped_tasks": _sql(
        " UNION ALL ".join([
            *[
                f"SELECT '{task}' AS task, {key}::VARCHAR AS key, round(avg(unit_price), 4) AS value FROM parsed "
                f"WHERE {key} IS NOT NULL AND unit_price IS NOT NULL GROUP BY {key}"
                for task, key in (
                    ("district_price_rank", "district"), ("area_band_price", f"({_AREA_BAND})"), ("decoration_price_compare", "decoration"),
                    ("floor_band_price", "floor_band"), ("building_age_price_trend", "CAST(floor(build_year / 10) * 10 AS BIGINT)"),
                )
            ],
            f"SELECT 'area_band_share_pie', {_AREA_BAND}, count(*)::DOUBLE FROM parsed WHERE ({_AREA_BAND}) IS NOT NULL GROUP BY 2",
            "SELECT * FROM (SELECT 'community_followers_rank', community, sum(followers) FROM parsed WHERE followers IS NOT NULL "
            "GROUP BY community ORDER BY sum(followers) DESC, community LIMIT 15)",
        ]), "parsed"
    ),
    "task_status": _sql(
        "SELECT t.position, t.task, reason IS NULL AS ok, reason FROM (SELECT position, task, CASE "
        "WHEN task = 'decoration_price_compare' THEN 'missing columns' "
        "WHEN (SELECT count(*) FROM parsed) < 5 THEN 'too few rows' "
        "WHEN task = 'area_band_share_pie' AND (SELECT count(*) FROM parsed WHERE area_m2 > 10000) < 5 THEN 'too few values' "
        "END AS reason FROM (VALUES "
        + ", ".join(f"({i}, '{name}')" for i, name in enumerate(_TASK_NAMES))
        + ") AS v(position, task)) AS t", "parsed"
    ),
    "applicable_tasks": _sql(
        " UNION ALL ".join([_offered("all"), _offered("no_price", "unit_price"), _offered("no_area", "area_m2", "floor_band")]),
        "parsed",
    ),
    "summary_facts": _sql(_FACTS, "parsed"),
    "geo_keywords": _sql(
        "SELECT asked, keyword, count(l.district) AS listings "
        f"FROM (VALUES {_KEYWORD_ROWS}) AS k(asked, keyword) LEFT JOIN listings l ON contains(l.district, keyword) GROUP BY 1, 2",
        "listings",
    ),
    "search_geo": _sql(
        "SELECT row_id, district, community FROM listings WHERE district LIKE '%新都%' OR community LIKE '%新都%'",
        "listings",
    ),
    "search_candidates": _sql("SELECT row_id, district FROM listings WHERE district LIKE '%温江%'", "listings"),
    "search_noise": _sql(
        f"SELECT row_id, description_raw, house_info_raw, 'all' AS \"table\" FROM listings "
        f"WHERE NOT {_PARKING} AND NOT ends_with(row_id, '7') UNION ALL "
        "SELECT row_id, description_raw, '12室9厅' || split_part(house_info_raw, '厅', 2), 'noise' FROM listings "
        "WHERE ends_with(row_id, '7')", "listings"
    ),
    "search_hard": _sql(
        "SELECT row_id FROM labelled WHERE tag_near_subway AND tag_has_balcony", "labelled"
    ),
    "search_score": _sql(f"SELECT row_id, round({_SCORES['a']}, 4) AS score FROM labelled", "labelled"),
    "search_topk": _search("a"),
    "search_listings": _search("b"),
    "search_outcome": _sql(_OUTCOMES + """
UNION ALL SELECT 'e', count(*), count(*) FILTER (contains(district, '锦江')), count(*) FILTER (contains(district, '锦江') AND NOT """ + _PARKING + """),
  count(*) FILTER (contains(district, '锦江') AND NOT """ + _PARKING + """), 0, 'not_requested', '' FROM labelled
UNION ALL SELECT 'f', count(*), count(*), count(*) FILTER (NOT """ + _PARKING + """),
  count(*) FILTER (tag_near_subway AND tag_lighting), 0, 'no_row:tag_lighting', 'tag_near_subway,tag_lighting' FROM labelled""", "labelled"),
    "search_batch": _sql(
        " UNION ALL ".join([
            *[
                f"SELECT '{key}' AS intent_id, CAST(row_number() OVER (ORDER BY {_BEST}) AS INT) AS rank, row_id, "
                f"round(score, 4) AS score FROM ({_found(key)})" for key in _SCORES
            ],
            f"SELECT intent_id, CAST(rank AS INT), row_id, score FROM ({_MANY})",
        ]), "labelled"
    ),
    "search_requests": _sql(f"SELECT intent_id, rank, row_id, score FROM ({_REQUESTS})", "labelled"),
    "search_json": _sql(
        "SELECT to_json(struct_pack(district := district, community := community, layout := layout, build_year := build_year, "
        f"listing_id := listing_id, tag_near_subway := tag_near_subway))::VARCHAR AS listing FROM ({_found('b')})", "labelled"
    ),
    "search_display": _sql(
        "SELECT district, community, layout, layout_normalized, area_m2, total_price, unit_price, floor, "
        "floor_band, orientation, decoration, build_year, building_type, house_info_raw, follow_info_raw, "
        f"listing_id, {', '.join(_TAGS)} FROM labelled", "labelled"
    ),
}
