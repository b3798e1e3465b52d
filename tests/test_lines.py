"""Lines by byte ranges, and files that Spark's own readers do not read."""

import io

import pytest

from brickledger.sources import files, lines

BODY = b"".join(b"%d,%s\r\n" % (i, b"x" * (i % 40)) for i in range(300))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("text", [BODY, b"one line", b"\n\na\n", b"", b"a\r\nb", b"long" * 500 + b"\nshort"])
def test_each_line_is_in_one_range(chunk, text):
    want, at = [], 0
    for line in text.split(b"\n"):
        want.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    if want[-1][1] == b"":
        want.pop()
    for size in (1, 3, 50, 1000, 10_000):
        found = []
        for begin in range(0, len(text), size):
            found += lines.lines_of(io.BytesIO(text), begin, min(begin + size, len(text)), chunk)
        assert found == want


def test_files_are_split_and_read_in_ranges(spark, tmp_path):
    path = tmp_path / "_a b%c.csv"
    path.write_bytes(BODY)
    read = files._hidden_lines(spark, [(f"file:{path}", len(BODY))], range_bytes=100)
    assert read.rdd.getNumPartitions() == -(-len(BODY) // 100)
    assert [bytes(r.value) for r in read.orderBy("start").collect()] == BODY.replace(b"\r", b"").splitlines()


def test_names_that_the_readers_skip_are_read(spark, tmp_path):
    (tmp_path / "_old").mkdir()
    (tmp_path / "_x.csv").write_bytes("城区,编号\n海淀,1\n\n\"朝,阳\",NA\n".encode())
    (tmp_path / ".y.csv").write_bytes("城区,编号\n房山,2\n".encode("gbk"))
    (tmp_path / "_old" / "z.csv").write_bytes("﻿编号\r\n3\r\n".encode())
    (tmp_path / "a.csv").write_bytes("编号\n4\n".encode())
    rows, found = files.read_listing_files(spark, str(tmp_path), recursive=True)
    got = {(r.ingest_file, r.district, r.listing_id) for r in rows.collect()}
    assert got == {("_x", "海淀", "1"), ("_x", "朝,阳", None), (".y", "房山", "2"), ("_old/z", None, "3"), ("a", None, "4")}
    assert rows.select("row_id").distinct().count() == 5
    assert {r.name: (r.encoding, r.ok) for r in found.collect()} == {
        "_x.csv": ("UTF-8", True), ".y.csv": ("GB18030", True), "_old/z.csv": ("UTF-8", True), "a.csv": ("UTF-8", True)}
    assert files.probe_files(spark, str(tmp_path)).count() == 3


def test_undecodable_bytes_are_replaced(spark, tmp_path):
    body = "城区,编号\n海淀,1\n".encode("gbk") + b"\xff\x20\x81\x20,2\n" + "朝阳,3\n".encode("gbk")
    (tmp_path / "odd.csv").write_bytes(body)
    (tmp_path / "_odd.csv").write_bytes(body)
    rows, found = files.read_listing_files(spark, str(tmp_path))
    want = [tuple(line.split(",")) for line in body.decode("cp936", "replace").split("\n")[1:] if line]
    for name in ("odd", "_odd"):
        got = rows.filter(rows.ingest_file == name).orderBy("row_id").collect()
        assert [(r.district, r.listing_id) for r in got] == want
    assert {(r.encoding, r.ok, r.reason) for r in found.collect()} == {("GBK, bytes replaced", True, None)}


def test_gb18030_without_the_session_setting(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("城区,编号\n海淀,\"1\"\"2\"\n".encode("gb18030"))
    old = spark.conf.get("spark.sql.legacy.javaCharsets")
    spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    try:
        rows, found = files.read_listing_files(spark, str(tmp_path))
        assert [(r.district, r.listing_id) for r in rows.collect()] == [("海淀", '1"2')] and found.first().ok
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", old)
