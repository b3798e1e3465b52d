"""Listings derived from order tables, one listing per line item.

Used by the registered queries, the benchmark and the tests, which have order tables and no listings.
Only the joins that the requested columns need are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_Q = "CAST(l_quantity AS INT)"
_AREA = f"(30 + 3 * {_Q})"
_TOTAL = "CAST(floor(l_extendedprice / 250) AS BIGINT)"


def _pick(selector: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {selector} {whens} END"


COLUMNS = {
    "row_id": (
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        f"CAST(floor(l_extendedprice * 100) AS BIGINT), {_Q})"
    ),
    "ingest_file": "'batch_' || (l_suppkey % 4)",
    "listing_id": "l_orderkey || '-' || l_linenumber",
    "district": "CASE WHEN l_partkey % 17 <> 0 THEN "
    + _pick("c_nationkey % 6", "锦江区", "武侯区", "高新区", "新都", "温江区", "双流区") + " END",
    "community": "c_mktsegment || '小区' || (o_custkey % 20)",
    "layout": "CASE WHEN l_partkey % 11 = 0 THEN '三室两厅' END",
    "house_info_raw": (
        f"(1 + l_linenumber % 5) || '室' || (1 + l_linenumber % 2) || '厅|' || {_AREA} || '平米|' || "
        f"{_pick(f'{_Q} % 3', '南', '东南', '南北')} || '|' || "
        f"{_pick(f'{_Q} % 4', '精装', '简装', '毛坯', '豪装')} || '|' || "
        f"{_pick(f'{_Q} % 2', '中楼层(共26层)', '低层(共6层)')} || '|' || "
        "(year(o_orderdate) + 10) || '年建|' || "
        f"{_pick('l_suppkey % 2', '板楼', '塔楼')}"
    ),
    "follow_info_raw": (
        f"CASE WHEN {_Q} % 9 = 0 THEN '1.2万人关注/' ELSE ({_Q} * 7) || '人关注 / ' END || "
        f"(1 + {_Q} % 12) || '个月以前发布'"
    ),
    "total_price": f"{_TOTAL} || '万'",
    "unit_price": (
        "CASE WHEN l_partkey % 3 <> 0 THEN "
        f"CAST(floor(CAST({_TOTAL} AS DOUBLE) * 10000 / {_AREA}) AS BIGINT) || '元/平米' END"
    ),
    "floor": f"CASE WHEN l_linenumber % 2 = 0 THEN (1 + {_Q} % 33) || '/33' END",
    "description_raw": _pick(
        "l_partkey % 10",
        "地铁房精装", "TOD综合体", "距南熏大道站600米 双阳台", "步行5分钟到公交站", "无地铁公交便利",
        "产权车位转让", "采光好全明户型 无电梯", "建于2012年 电梯房", "",
    ),
}
_FROM_CUSTOMER = {"district", "community"}
_FROM_ORDERS = _FROM_CUSTOMER | {"house_info_raw"}


def listings(spark: SparkSession, directory: str, columns=tuple(COLUMNS)) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    # By the key of the join, which needs this shuffle anyway for large tables.
    rows = table("lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    if _FROM_ORDERS & set(columns):
        orders = table("orders")
        # Customers go to the orders first: line items, the most rows by far, are then shuffled and sorted once and not twice.
        if _FROM_CUSTOMER & set(columns):
            orders = orders.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*[F.expr(COLUMNS[c]).alias(c) for c in columns])
