"""Line dedup: repeated windows of three consecutive lines are found globally, later occurrences are removed.

Built-in functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickledger.functions.text import let
from brickledger.llm.shared import with_row

#: What counts as white space at the ends of a line.
BLANKS = " \t\r\x0b\x0c"
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(text: Column, size: int) -> Column:
    """One struct (digest, at) per `size` consecutive lines that are not blank; at: their places among all lines."""
    numbered = F.transform(_lines(text), lambda line, i: F.struct(F.btrim(line, F.lit(BLANKS)).alias("line"), i.alias("i")))

    def windows(full: Column) -> Column:
        return F.when(
            F.size(full) >= size,
            F.transform(
                F.sequence(F.lit(1), F.size(full) - (size - 1)),
                lambda i: let(
                    F.slice(full, i, size),
                    lambda w: F.struct(
                        F.unhex(F.md5(F.array_join(F.transform(w, lambda x: x["line"]), "\n"))).alias("digest"),
                        F.transform(w, lambda x: x["i"]).alias("at"),
                    ),
                ),
            ),
        )

    return let(F.filter(numbered, lambda x: x["line"] != ""), windows)


def remove_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(row, n_lines, n_removed, kept_text): every row of `docs` with its text less the repeated lines.

    A window is `size` consecutive lines, blank ones skipped, compared without white space at their ends by a
    128-bit digest.  Of equal windows the first by (doc_id, text hash, place) stays; each line that any later one
    covers goes, wherever windows overlap.  Blank lines stay.  `row` holds the input's columns.

    Null text: no lines, kept_text null.  Empty or shorter texts: unchanged.  Null doc_id: comes first, told apart by
    text.  Rows that repeat doc_id and text are one document and share its result.  Tables without rows give none.
    """
    base = with_row(docs, doc=F.col(doc_id), text=F.col(text), mark=F.xxhash64(F.col(text)))
    found = base.select("doc", "mark", F.explode(_windows(F.col("text"), size)).alias("w")).select(
        "doc", "mark", F.col("w.digest").alias("digest"), F.col("w.at").alias("at")
    )
    place = F.struct("doc", "mark", "at")
    first = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    later = found.join(first.select("digest", "first"), "digest").where(~F.col("first").eqNullSafe(place))
    covered = later.groupBy("doc", "mark").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))
    covered = covered.withColumnsRenamed({"doc": "gone_doc", "mark": "gone_mark"})
    joined = base.join(covered, (base["mark"] == F.col("gone_mark")) & base["doc"].eqNullSafe(F.col("gone_doc")), "left")
    lines = _lines(F.col("text"))

    def without(own: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")

    kept = let(lines, without)
    return joined.select(
        "row",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def op7_line_dedup(spark, sf_dir):
    """Every document with its number of lines, of removed lines, and the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_lines(docs).select("row.doc_id", "n_lines", "n_removed", F.col("kept_text").alias("text"))


ORACLE_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM lines),
w AS (
  SELECT doc_id, i AS i1, lead(i) OVER p AS i2, lead(i, 2) OVER p AS i3,
         t || chr(10) || lead(t) OVER p || chr(10) || lead(t, 2) OVER p AS win
  FROM trimmed WHERE t <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i1) AS r FROM w WHERE win IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM ranked WHERE r > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text,
         count(*) AS n_lines, count(g.i) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
