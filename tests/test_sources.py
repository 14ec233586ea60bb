import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from footfall import schema, session
from footfall.sources import csv_files, stored_pages
from footfall.sources.tables import read_months, read_table, write_by_month

ROWS = [
    ("1화 : 하나", '따옴표 "안" 쉼표, 포함', "독자(id***)", "5일 전", 3, 0),
    ("2화 : 둘", None, "b", "2024-03-01 10:00:00", 0, 1),
    ("3화 : 셋", "끝\\", "c", "3시간 전", 7, 2),
]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, schema.COMMENT_FILE).repartition(2)
    csv_files.write_csv_folder(df, f"{tmp_path}/out")
    back = csv_files.read_csv_folder(spark, f"{tmp_path}/out", schema.COMMENT_FILE)
    assert as_rows(back) == sorted(ROWS, key=str)


def test_line_breaks_inside_fields(spark, tmp_path):
    rows = [("1화", "한 줄\n두 줄", "a", "x", 1, 1)]
    csv_files.write_csv_folder(spark.createDataFrame(rows, schema.COMMENT_FILE), f"{tmp_path}/out")
    back = csv_files.read_csv_folder(spark, f"{tmp_path}/out", schema.COMMENT_FILE, multiline=True)
    assert as_rows(back) == rows


def test_prefix_and_suffix_filter(spark, tmp_path):
    layout = T.StructType([T.StructField("a", T.LongType())])
    os.makedirs(tmp_path / "in" / "deep")
    (tmp_path / "in" / "x.csv").write_text("a\n1\n")
    (tmp_path / "in" / "deep" / "y.csv").write_text("a\n2\n")
    (tmp_path / "in" / "z.txt").write_text("a\n3\n")
    got = csv_files.read_csv_folder(spark, str(tmp_path / "in"), layout)
    assert as_rows(got) == [(1,), (2,)]


def test_wrong_header_fails(spark, tmp_path):
    layout = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    (tmp_path / "x.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv_files.read_csv_folder(spark, str(tmp_path), layout).collect()


def test_union_of_different_headers(spark, tmp_path):
    layout = T.StructType(
        [T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.LongType())]
    )
    (tmp_path / "1.csv").write_text("a,b\n1,x\n")
    (tmp_path / "2.csv").write_text("c,a\n9,2\n")
    (tmp_path / "3.csv").write_text('﻿a,"b",extra\n3,z,drop\n')
    (tmp_path / "4.csv").write_text("a,b\n4,\n")
    got = csv_files.read_csv_union(spark, str(tmp_path), layout)
    assert got.columns == ["a", "b", "c", "extra", "_surplus"]
    assert as_rows(got.drop("extra", "_surplus")) == [(1, "x", None), (2, None, 9), (3, "z", None), (4, None, None)]
    assert [r["extra"] for r in got.filter("a = 3").collect()] == ["drop"]


def test_union_keeps_undeclared_columns_and_odd_paths(spark, tmp_path):
    layout = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    folder = tmp_path / "has space 댓글"
    folder.mkdir()
    (folder / "1.csv").write_text("b,a\nx,1\n")
    (folder / "2.csv").write_text("a,extra\n2,more\n")
    (folder / "3.csv").write_text("a")
    got = csv_files.read_csv_union(spark, str(folder), layout)
    assert got.columns == ["a", "b", "extra", "_surplus"]
    assert as_rows(got) == [(1, "x", None, None), (2, None, "more", None)]
    dropped = csv_files.read_csv_union(spark, str(folder), layout, undeclared="drop", surplus="drop")
    assert dropped.columns == ["a", "b"]
    with pytest.raises(ValueError, match="extra"):
        csv_files.read_csv_union(spark, str(folder), layout, undeclared="fail")
    (folder / "4.csv").write_text("a,b\nno number,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csv_files.read_csv_union(spark, str(folder), layout).collect()


def test_union_keeps_cells_beyond_the_header(spark, tmp_path):
    layout = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "1.csv").write_text('a,b\n3,4,5\n4,"x,y"\n5,x,,\n6,x,,"q, ""r""",7,8\n7\n')
    (tmp_path / "2.csv").write_text("b,a,c\nx,1,2,3\ny,2\n")
    got = csv_files.read_csv_union(spark, str(tmp_path), layout)
    assert as_rows(got) == [
        (1, "x", "2", ["3"]), (2, "y", None, None), (3, "4", None, ["5"]), (4, "x,y", None, None),
        (5, "x", None, None), (6, "x", None, [None, 'q, "r"', "7", "8"]), (7, None, None, None),
    ]
    # A narrower selection reads the same cells.
    assert as_rows(got.select("a")) == [(i,) for i in range(1, 8)]
    assert got.filter("_surplus IS NOT NULL").count() == 3
    with pytest.raises(Exception, match="(?s)cells beyond the header in file.*csv: "):
        csv_files.read_csv_union(spark, str(tmp_path), layout, surplus="fail").collect()
    dropped = csv_files.read_csv_union(spark, str(tmp_path), layout, surplus="drop")
    assert dropped.columns == ["a", "b", "c"] and dropped.count() == 7
    with pytest.raises(ValueError, match="surplus must be"):
        csv_files.read_csv_union(spark, str(tmp_path), layout, surplus="ignore")


def test_headers_with_line_breaks_repeats_and_blanks(spark, tmp_path):
    layout = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "1.csv").write_text('\ufeff"c\nd",a,"e ""f""\ng"\n1,2,3\n"4\n5",6,7,8\n')
    (tmp_path / "2.csv").write_text("a,x,x,\n9,10,11,12\n")
    (tmp_path / "3.csv").write_text("")
    (tmp_path / "4.csv").write_text("a")
    got = csv_files.read_csv_union(spark, str(tmp_path), layout, multiline=True)
    assert got.columns == ["a", "Unnamed: 3", "c\nd", 'e "f"\ng', "x", "x.1", "_surplus"]
    assert as_rows(got) == [
        (2, None, "1", "3", None, None, None), (6, None, "4\n5", "7", None, None, ["8"]),
        (9, "12", None, None, "10", "11", None),
    ]
    with pytest.raises(ValueError, match="read with multiline"):
        csv_files.read_csv_union(spark, str(tmp_path), layout)


def test_many_files_in_one_task_give_each_its_header(spark, tmp_path):
    layout = T.StructType([T.StructField("k", T.LongType())])
    for i in range(60):
        (tmp_path / f"{i}.csv").write_text(f'"n\n{i % 3}",k\n' + f"{i},{i}\n" * (i % 5))
    got = csv_files.read_csv_union(spark, str(tmp_path), layout, multiline=True)
    assert got.columns == ["k", "n\n0", "n\n1", "n\n2", "_surplus"]
    want = [(i, *[str(i) if i % 3 == j else None for j in range(3)], None) for i in range(60) for _ in range(i % 5)]
    assert as_rows(got) == sorted(want, key=str)


def test_block_records_keep_their_own_fields(spark):
    html = "<t>title</t><r><u>a</u><n>1</n></r><r><u>b</u></r><r><u>c</u><n>3</n></r><r><n>4</n></r><r><u>e</u><n>x</n></r>"
    pages = spark.createDataFrame([(1, html), (2, "none"), (3, None)], "page_id long, html string")
    got = stored_pages.block_records(
        pages, "<r>.*?</r>", {"user": "<u>([^<]*)</u>", "likes": "<n>([^<]*)</n>"}, ["page_id"],
        {"title": "<t>([^<]*)</t>"}, required=("user",), integer_fields=("likes",),
    )
    assert as_rows(got) == [(1, "title", 0, "a", 1), (1, "title", 2, "c", 3)]


def test_repeated_records_whole_or_nothing(spark):
    html = "<u>a</u><u>b</u><u>c</u><n>1</n><n>2x</n><n>3</n><n>4</n>"
    pages = spark.createDataFrame([(1, html), (2, "nothing")], "page_id long, html string")
    patterns = {"user": "<u>([^<]*)</u>", "likes": "<n>([^<]*)</n>"}
    text = stored_pages.repeated_records(pages, patterns, ["page_id"])
    assert as_rows(text) == [(1, 0, "a", "1"), (1, 1, "b", "2x"), (1, 2, "c", "3")]
    counted = stored_pages.repeated_records(pages, patterns, ["page_id"], integer_fields=("likes",))
    assert as_rows(counted) == [(1, 0, "a", 1), (1, 2, "c", 3)]
    assert as_rows(stored_pages.record_counts(counted, ["page_id"])) == [(1, 2)]


def test_page_fields(spark):
    pages = spark.createDataFrame(
        [(1, "<b>제목</b><s>참여 1,234명</s>"), (2, "<b></b>")], "page_id long, html string"
    )
    patterns = {"title": "<b>([^<]*)</b>", "votes": "<s>([^<]*)</s>"}
    got = stored_pages.page_fields(pages, patterns, ["page_id"], "2024-03-06", digit_fields=("votes",))
    day = dt.date(2024, 3, 6)
    assert as_rows(got) == [(1, "제목", 1234, day), (2, None, None, day)]


def test_tables_from_catalog_or_folder(spark, tmp_path):
    df = spark.range(3)
    df.createOrReplaceTempView("three")
    df.write.parquet(f"{tmp_path}/three.parquet")
    assert read_table(spark, "three").count() == read_table(spark, "three", str(tmp_path)).count() == 3


def test_months_are_pruned(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1 + i % 4, 5, i % 24)) for i in range(200)]
    log = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    write_by_month(log, f"{tmp_path}/log", "ts", rows_per_file=20)
    got = read_months(spark, f"{tmp_path}/log", dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    assert sorted(map(tuple, got.collect())) == [r for r in rows if r[1].month in (2, 3)]
    assert "PartitionFilters: [isnotnull(month" in got._jdf.queryExecution().executedPlan().toString()
    # 50 rows a month, so several files of at most 20.
    assert len(list((tmp_path / "log" / "month=2024-02-01").glob("*.parquet"))) >= 3


def test_shared_folder_follows_the_session(spark):
    assert session.shared_folder(spark) == spark.sparkContext.getCheckpointDir()
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_materialise_cuts_lineage(spark):
    df = session.materialise(spark.range(10).selectExpr("id * 2 AS v"))
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10
