import datetime as dt

from footfall.operators import cleaning


def test_clean_comments_edge_rows(spark):
    raw = spark.createDataFrame(
        [
            (1, "good", "5일 전"),
            (2, "good", "3시간 전"),
            (3, "good", "2024-03-03 23:10:00"),
            (4, None, "2024-03-01 10:00:00"),
            (5, "good", "2024-03-03 00:00:00"),
            (6, "good", "2024-03-02 08:00:00"),
            (7, "good", None),
            (8, "good", "4일 전"),
        ],
        "id long, content string, comment_date string",
    )
    kept = cleaning.clean_comments(raw, "2024-03-08", "2024-03-03")
    assert {r["id"]: r["comment_date"] for r in kept.collect()} == {
        1: dt.datetime(2024, 3, 3),
        5: dt.datetime(2024, 3, 3),
        6: dt.datetime(2024, 3, 2, 8),
    }
    assert cleaning.clean_comments(raw, "2024-03-08").count() == 5


def test_typed_episodes(spark):
    raw = spark.createDataFrame([("67화 : 매너리즘(1)", "24.01.07")], "episode string, upload_at string")
    row = cleaning.typed_episodes(raw).first()
    assert (row["chapter"], row["upload_at"]) == (67, dt.date(2024, 1, 7))


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame(
        [("e1", "2024-03-06", 2), ("e1", "2024-03-01", 1), ("e2", "2024-03-06", 3)],
        "episode string, down_at string, n int",
    ).repartition(5)
    got = cleaning.first_per_key(df, ["episode"], ["down_at", "n"])
    assert sorted(r["n"] for r in got.collect()) == [1, 3]


def test_snapshot(spark):
    df = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 2)], "episode string, down_at string, n int")
    assert [tuple(r) for r in cleaning.snapshot(df, "d2", ["episode", "n"]).collect()] == [("a", 2)]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    one = {r["id"] for r in cleaning.reproducible_sample(df.repartition(3), 20, ["id"], 5).collect()}
    two = {r["id"] for r in cleaning.reproducible_sample(df.repartition(7), 20, ["id"], 5).collect()}
    other = {r["id"] for r in cleaning.reproducible_sample(df, 20, ["id"], 6).collect()}
    assert one == two and len(one) == 20 and one != other


def test_preview(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS twice")
    assert [r["twice"] for r in cleaning.preview(df, ["twice"], 3, ["id"]).collect()] == [0, 2, 4]
