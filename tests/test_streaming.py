import datetime as dt

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.operators import activity
from footfall.streaming.user_days import comment_file_stream, compact_days, keep_user_days

LAYOUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("ts", T.StringType())])


def test_user_days_follow_arriving_files(spark, tmp_path):
    source, table, mark = (str(tmp_path / n) for n in ("in", "days", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text(
        "user_id,ts\n1,2024-03-01 10:00:00\n1,2024-03-01 11:00:00\n2,2024-03-02 09:00:00\n"
    )

    def advance():
        stream = comment_file_stream(spark, source, LAYOUT).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        keep_user_days(stream, table, mark).awaitTermination()
        return spark.read.parquet(table)

    assert advance().count() == 2
    # A repeated pair, a new pair and a late day.
    (tmp_path / "in" / "2.csv").write_text(
        "user_id,ts\n1,2024-03-01 23:00:00\n3,2024-03-02 01:00:00\n9,2023-12-31 05:00:00\n"
    )
    days = advance()
    daily = {r["date"]: r["dau"] for r in activity.daily_active(days, ts="date").collect()}
    assert daily == {dt.date(2024, 3, 1): 1, dt.date(2024, 3, 2): 2, dt.date(2023, 12, 31): 1}
    assert advance().count() == days.count()
    # A replayed file only adds repeats, which compaction takes out.
    keep_user_days(
        comment_file_stream(spark, source, LAYOUT).withColumn("ts", F.col("ts").cast("timestamp_ntz")),
        table, str(tmp_path / "again"),
    ).awaitTermination()
    compact_days(spark, table, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 4


def test_a_file_in_another_layout_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("ts,user_id\n2024-03-01 10:00:00,1\n")
    stream = comment_file_stream(spark, str(tmp_path / "in"), LAYOUT).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    with pytest.raises(Exception, match="header"):
        keep_user_days(stream, str(tmp_path / "days"), str(tmp_path / "mark")).awaitTermination()
