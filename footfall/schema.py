"""Declared layouts of the inputs."""

from pyspark.sql import types as T

COMMENT_FILE = T.StructType(
    [
        T.StructField("episode", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("comment_date", T.StringType()),
        T.StructField("comment_like", T.LongType()),
        T.StructField("comment_dislike", T.LongType()),
    ]
)

EPISODE_FILE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("episode", T.StringType()),
        T.StructField("upload_at", T.StringType()),
        T.StructField("favorite", T.StringType()),
        T.StructField("Tag", T.StringType()),
        T.StructField("like_count", T.LongType()),
        T.StructField("comment_count", T.LongType()),
        T.StructField("score_count", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("down_at", T.StringType()),
    ]
)
