"""Reading directories of listing files, and writing results."""

from __future__ import annotations

import csv
import json
import re
from collections import Counter
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickledger import fixed
from brickledger.schema import normalize_header
from brickledger.functions.text import strip
from brickledger.sources.lines import RANGE_BYTES, LineRanges

_BOM = "﻿"
# GB18030 contains GBK and CP936, so every file that is not UTF-8 is read with it.
_OTHER_ENCODING = "GB18030"
#: What files that are neither are read with: what has no meaning in it becomes U+FFFD.
_LAST_ENCODING = "GBK, bytes replaced"
_CODECS = {"UTF-8": "utf-8", _OTHER_ENCODING: "gb18030", _LAST_ENCODING: "cp936"}
_EXTENSION = r"(?i)\.csv$"
_TABLES = (".csv", ".xls", ".xlsx")
_FILE_STATUS = (
    "path string, name string, length long, hidden boolean, encoding string, first_line binary, header string, reason string, ok boolean"
)


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]+$", "")


def tag_source_file(df: DataFrame) -> DataFrame:
    """Add ``ingest_file``, the name of the file a row was read from, without its extension."""
    return df.withColumn("ingest_file", file_stem(F.col("_metadata.file_name")))


def _offered(spark: SparkSession, path: str, recursive: bool) -> tuple[str, DataFrame]:
    """The folder's path and one row per table file in it: path, name below the folder, length.

    The listing is the file system's own, so names and empty files that Spark's readers skip are in it.  It is made
    on the driver, as Spark's file index is.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(root)
    if system.getFileStatus(root).isFile():
        root = root.getParent()
    listing, rows = system.listFiles(system.makeQualified(hadoop.Path(path)), recursive), []
    folder = root.toUri().getPath().rstrip("/")
    while listing.hasNext():
        status = listing.next()
        full = status.getPath().toUri().getPath()
        if full.lower().endswith(_TABLES):
            rows.append((status.getPath().toString(), full[len(folder) + 1:], status.getLen()))
    return root.toUri().getRawPath().rstrip("/"), spark.createDataFrame(rows, "path string, name string, length long")


def _below(folder: str) -> Column:
    """The path of a row's file below the folder; equal for no two files."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(folder) + "/", "")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))  # Spark escapes all but the plus sign


def _is_gb18030(line: Column) -> Column:
    """Whether the bytes of a line are GB18030: nothing is left when all its one, two and four byte codes go."""
    codes = r"[\x00-\x80\xff]+|[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][\x30-\x39][\x81-\xfe][\x30-\x39]"
    return F.regexp_replace(F.decode(line.cast("binary"), "ISO-8859-1"), codes, "") == ""


def _decoded(line: Column, encoding: str) -> Column:
    """Bytes as text, those that are none replaced; in Python, for the few files that Spark's readers do not decode."""
    codec = _CODECS[encoding]

    @F.pandas_udf("string")
    def decode(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: None if line is None else bytes(line).decode(codec, "replace"))

    return decode(line)


def _hidden_lines(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, value) of the lines of files that Spark's readers pass over for their names."""
    spark.dataSource.register(LineRanges)
    return spark.read.format("line_ranges").option("files", json.dumps(files)).option("rangeBytes", range_bytes).load()


def probe_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row per table file under a directory: path, name, length, encoding, header line, ok and why not.

    A single distributed pass over the lines decides the encoding: a file is UTF-8 when all its lines are, else
    GB18030 when all are that, else GBK with what has no meaning in it replaced.  Every file has a row and is read,
    whatever its name; spreadsheets and empty files say so in ``reason``.
    """
    folder, offered = _offered(spark, path, recursive)
    return _probed(spark, path, recursive, folder, offered).drop("hidden", "first_line")


def _probed(spark: SparkSession, path: str, recursive: bool, folder: str, offered: DataFrame) -> DataFrame:
    offered = offered.withColumns({
        "spreadsheet": F.lower("name").rlike(r"\.xlsx?$"), "hidden": F.col("name").rlike("(^|/)[_.]"),
    })
    files = spark.read.option("recursiveFileLookup", str(recursive).lower())
    meta = F.col("_metadata")
    # Spark writes paths with one or three slashes after the scheme.
    plain = lambda c: F.regexp_replace(c, "^([a-zA-Z0-9+.-]+:)/+", "$1/")
    parts = []
    tables = offered.filter("not spreadsheet and length > 0")
    if not tables.filter("not hidden").isEmpty():
        parts.append(files.option("pathGlobFilter", "*.[cC][sS][vV]").text(path).select(
            plain(meta["file_path"]).alias("file_path"),
            F.struct(meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
            F.col("value").cast("binary").alias("value"),
        ))
    hidden = [(r["path"], r["length"]) for r in tables.filter("hidden").collect()]
    if hidden:
        place = F.struct(F.lit(0).cast("long").alias("block"), F.col("start").alias("line")).alias("place")
        parts.append(_hidden_lines(spark, hidden).select(_encoded(plain("path")).alias("file_path"), place, "value"))
    if parts:
        content = reduce(DataFrame.union, parts).groupBy("file_path").agg(
            F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("utf8"), F.bool_and(_is_gb18030(F.col("value"))).alias("gb18030"),
            F.min_by("value", "place").alias("first_line"),
        )
    else:
        content = spark.createDataFrame([], "file_path string, utf8 boolean, gb18030 boolean, first_line binary")
    joined = offered.join(content, _encoded(plain("path")) == F.col("file_path"), "left")
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("gb18030"), _OTHER_ENCODING).when(F.col("utf8").isNotNull(), _LAST_ENCODING)
    decoded = reduce(
        lambda other, name: F.when(F.col("encoding") == name, _decoded(F.col("first_line"), name)).otherwise(other),
        _CODECS, F.lit(None).cast("string"),
    )
    reason = (
        F.when(F.col("spreadsheet"), "spreadsheet files are not supported")
        .when((F.col("length") == 0) | F.col("encoding").isNull(), "empty file")
        .when(F.length(strip(F.col("header"))) == 0, "empty file")
    )
    found = joined.withColumn("encoding", encoding).withColumn("header", F.regexp_replace(decoded, _BOM, ""))
    return found.select("path", "name", "length", "hidden", "encoding", "first_line", "header", reason.alias("reason")).withColumn(
        "ok", F.col("reason").isNull()
    )


def _encoded(path: Column) -> Column:
    """A path as in the hidden column file_path, where % and space are escaped."""
    return F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))


def _read_group(
    spark: SparkSession, paths: list[str], encoding: str, header: str, multi_line: bool, folder: str, alike: list[str]
) -> DataFrame:
    schema, columns = _cells(header)
    rows = spark.read.csv(
        paths, schema=schema, header=True, encoding=encoding, escape='"', multiLine=multi_line,
    )
    place = F.concat_ws("-", _place(F.col("_metadata.file_block_start"), 15), _place(F.monotonically_increasing_id(), 20))
    return _tagged(rows, columns, _below(folder), place, alike)


def _cells(header: str) -> tuple[T.StructType, dict[str, Column]]:
    """The schema of a file's cells, c0, c1, ..., and the standard columns they make."""
    names = next(csv.reader([header]))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    sources: dict[str, list[Column]] = {}
    for i, name in enumerate(names):
        cell = F.col(f"c{i}")
        known = F.when(~cell.isin(*fixed.CSV_NULL_CELLS), cell)
        sources.setdefault(normalize_header(name) or f"unnamed_{i}", []).append(known)
    return schema, {key: F.coalesce(*cells) for key, cells in sources.items()}


def _place(number: Column, digits: int) -> Column:
    return F.lpad(number.cast("string"), digits, "0")


def _tagged(rows: DataFrame, columns: dict[str, Column], name: Column, place: Column, alike: list[str]) -> DataFrame:
    """The columns with the file's name and a row id that follows the order of rows in it."""
    short = F.regexp_replace(name, _EXTENSION, "")
    ingest_file = F.when(name.isin(alike), name).otherwise(short) if alike else short
    columns = columns | {"ingest_file": ingest_file, "row_id": F.concat_ws("-", name, place)}
    return rows.select(*[c.alias(key) for key, c in columns.items()])


def _read_lines(
    lines: DataFrame, encoding: str, first_lines: list[bytes], header: str, alike: list[str]
) -> DataFrame:
    """Rows of files that Spark's CSV reader does not read, from their lines (name, place, value).

    A line equal to its group's first lines is a header; parsing is Spark's own.
    """
    schema, columns = _cells(header)
    body = lines.filter(~F.col("value").isin([bytearray(line) for line in first_lines]))
    text = body.select("name", "place", _decoded(F.col("value"), encoding).alias("text")).filter(F.length(strip(F.col("text"))) > 0)
    rows = text.select("name", "place", F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"'}).alias("row"))
    return _tagged(rows.select("name", "place", "row.*"), columns, F.col("name"), F.col("place"), alike)


def read_listing_files(
    spark: SparkSession, path: str, multi_line: bool = False, recursive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Union the listing files of a directory; returns (rows, files).

    Headers are mapped to standard columns per file, so files may spell them differently.  All cells are
    text; the cells CSV readers take as missing are NULL.  ``ingest_file`` is the file's path below the directory
    without .csv (kept where x.csv and x.CSV differ in nothing else), so its name where ``recursive`` is off, and ``row_id`` follows the order of rows in it; both tell
    equal names in different folders apart.  ``files`` has one row per file with its encoding and the reason why it was
    left out, if it was.  Files are read in groups of equal encoding and header, and stay splittable unless
    ``multi_line`` asks for line breaks inside quoted cells.

    Three kinds of files are read line by line and parsed by ``from_csv``, without line breaks inside cells: names that
    begin with _ or ., which Spark's readers pass over; files that are neither UTF-8 nor GB18030, whose odd bytes become
    U+FFFD; and GB18030 files where the session lacks spark.sql.legacy.javaCharsets=true, without which Spark refuses
    them.  The paths go to the driver, as they do for Spark's own file index.
    """
    folder, offered = _offered(spark, path, recursive)
    probed = _probed(spark, path, recursive, folder, offered).collect()
    files = spark.createDataFrame(probed, _FILE_STATUS).drop("hidden", "first_line")
    good = sorted((r for r in probed if r["ok"]), key=lambda r: (r["encoding"], r["header"], r["path"]))
    stems = Counter(re.sub(_EXTENSION, "", r["name"]) for r in good)
    alike = [r["name"] for r in good if stems[re.sub(_EXTENSION, "", r["name"])] > 1]
    able = {"UTF-8"} | ({_OTHER_ENCODING} if spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "true" else set())
    groups: dict[tuple[str, str, str], list] = {}
    for found in good:
        kind = "hidden" if found["hidden"] else "csv" if found["encoding"] in able else "lines"
        groups.setdefault((kind, found["encoding"], found["header"]), []).append(found)
    if not groups:
        raise ValueError(f"no readable table among the files under {path}")
    parts = []
    for (kind, encoding, header), members in groups.items():
        paths, first_lines = [r["path"] for r in members], list({bytes(r["first_line"]) for r in members})
        if kind == "csv":
            parts.append(_read_group(spark, paths, encoding, header, multi_line, folder, alike))
            continue
        if kind == "hidden":
            names = F.broadcast(spark.createDataFrame([(r["path"], r["name"]) for r in members], "path string, name string"))
            lines = _hidden_lines(spark, [(r["path"], r["length"]) for r in members]).join(names, "path")
            lines = lines.select("name", _place(F.col("start"), 36).alias("place"), "value")
        else:
            place = F.concat_ws("-", _place(F.col("_metadata.file_block_start"), 15), _place(F.monotonically_increasing_id(), 20))
            lines = spark.read.text(paths).select(_below(folder).alias("name"), place.alias("place"), F.col("value").cast("binary").alias("value"))
        parts.append(_read_lines(lines, encoding, first_lines, header, alike))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), files


def slim_for_export(df: DataFrame) -> DataFrame:
    """Without staging columns whose canonical column is there."""
    redundant = [a for a, b in fixed.EXPORT_REDUNDANT if a in df.columns and b in df.columns]
    return df.drop(*redundant)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, encoding="UTF-8", escape='"')
