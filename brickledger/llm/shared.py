"""Helpers of this subpackage: the shared scratch folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="brickledger-"))
    return _own_folder[0]


def new_path(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """`columns` beside the whole input row as the struct `row`, so that no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b long): equal roots mean connected nodes.

    Each round moves every node to the neighbour (or itself) of the least hash, drawn anew each round, and
    contracts the edges; the number of nodes falls by a constant factor, so the rounds are logarithmic.  Only
    joins and minima by key: no neighbourhood is gathered, and a hot root is split by the skew join.
    """
    live = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    maps: list[DataFrame] = []
    while not live.isEmpty():
        priority = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("n"))
        both = live.union(live.select("b", "a"))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least(priority("a"), priority("b")))["n"].alias("to")))
        maps.append(step)
        live = written(
            live.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    total = maps[0].withColumnRenamed("to", "root")
    for step in maps[1:]:
        total = total.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return total


def class_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(node, first, class_id): `members` (node, first) with the least `first` reachable through `links` (a, b)."""
    rooted = written(
        members.join(components(links), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    return rooted.join(least, "root").select("node", "first", "class_id")
