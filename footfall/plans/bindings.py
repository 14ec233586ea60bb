"""The given tables seen as comments, episodes, snapshots and transactions.

Each view has a Spark form and a SQL form with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.cleaning import typed_episodes
from footfall.sources.tables import read_table

LOAD_DAY = "2024-02-04"
CUTOFF = "2024-01-25"
LATEST_SNAPSHOT = "2024-03-06"
EARLIER_SNAPSHOT = "2024-03-01"
MAX_UPLOAD_YEAR = 2025
READ_SHIFT_DAYS = 9200


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, "events", folder)


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """One comment per event, on the episode its payload names."""
    return events(spark, folder).select(
        "event_id",
        "user_id",
        F.col("ts").alias("comment_date"),
        F.col("event_type").alias("content"),
        F.floor("value").alias("comment_like"),
        F.get_json_object("props", "$.k").cast("long").alias("chapter"),
    )


def raw_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments before cleaning: text dates, relative dates, removed content."""
    kind = F.col("content")
    days_ago = F.datediff(F.lit(LOAD_DAY).cast("date"), F.to_date("comment_date"))
    text = (
        F.when(kind == "signup", F.concat(days_ago.cast("string"), F.lit("일 전")))
        .when(kind == "view", F.concat(F.hour("comment_date").cast("string"), F.lit("시간 전")))
        .otherwise(F.date_format("comment_date", "yyyy-MM-dd HH:mm:ss"))
    )
    return comments(spark, folder).select(
        "event_id",
        "user_id",
        "chapter",
        "comment_like",
        F.when(kind != "error", kind).alias("content"),
        text.alias("comment_date"),
    )


def raw_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """One episode per part, upload day as text."""
    key = F.col("p_partkey").cast("string")
    part_number = F.when(
        F.col("p_size") >= 34, F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    ).otherwise(F.lit(""))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int"))
    return read_table(spark, "part", folder).select(
        F.concat(key, F.lit("화 : "), "p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type", part_number)
        .alias("episode"),
        F.date_format(day, "yy.MM.dd").alias("upload_at"),
        F.col("p_brand").alias("tag"),
    )


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Typed episodes: chapter, episode, upload_at."""
    return typed_episodes(raw_episodes(spark, folder), max_year=MAX_UPLOAD_YEAR).select(
        "chapter", "episode", "upload_at"
    )


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Two collection days; the later one misses the episodes of one tag."""
    chapter = F.col("chapter")
    days = F.when(
        F.col("tag") == "Brand#9", F.array(F.lit(EARLIER_SNAPSHOT))
    ).otherwise(F.array(F.lit(EARLIER_SNAPSHOT), F.lit(LATEST_SNAPSHOT)))
    return typed_episodes(raw_episodes(spark, folder), max_year=MAX_UPLOAD_YEAR).select(
        "chapter",
        "episode",
        "upload_at",
        F.explode(days).alias("down_at"),
        (chapter * 7 % 91 + 100).alias("like_count"),
        (chapter * 3 % 37 + 10).alias("comment_count"),
        ((chapter % 10).cast("double") / 10.0 + 9.0).alias("score"),
    )


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """One comment per order line, spread over the whole catalogue of episodes."""
    return read_table(spark, "lineitem", folder).select(
        F.col("l_partkey").alias("chapter"),
        F.date_add(F.to_date("l_shipdate"), READ_SHIFT_DAYS).alias("comment_date"),
    )


def followers(spark: SparkSession, folder: str) -> DataFrame:
    """Readers of ten shelves each, who leave a shelf after the first event of small value.

    What counts as small differs from reader to reader, so drop-out differs too. The
    moment of leaving is a minimum folded in the map tasks.
    """
    shelf = F.floor(F.get_json_object("props", "$.k").cast("long") / 10)
    bar = 4 * ((F.col("user_id") * 7 + shelf * 3) % 10)
    steps = events(spark, folder).select(
        (F.col("user_id") * 10 + shelf).alias("user_id"), "ts", "value", (F.col("value") < bar).alias("leaves")
    )
    left = steps.filter("leaves").groupBy("user_id").agg(F.min("ts").alias("left_at"))
    return (
        steps.join(left, "user_id", "left")
        .filter("left_at IS NULL OR ts <= left_at")
        .select("user_id", "ts", F.col("value").cast("decimal(18,2)").alias("price"))
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as purchases; decimal prices keep sums exact."""
    return read_table(spark, "orders", folder).select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )


FOLLOWERS_SQL = """
steps AS (
  SELECT user_id * 10 + CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS user_id, ts, event_id, value,
         value < 4 * ((user_id * 7 + CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 * 3) % 10) AS leaves
  FROM events),
followers AS (
  SELECT s.user_id, s.ts, CAST(s.value AS DECIMAL(18,2)) AS price
  FROM steps s LEFT JOIN (SELECT user_id, min(ts) AS left_at FROM steps WHERE leaves GROUP BY user_id) l
    ON l.user_id = s.user_id
  WHERE left_at IS NULL OR s.ts <= left_at)"""

COMMENTS_SQL = """
comments AS (
  SELECT event_id, user_id, ts AS comment_date, event_type AS content,
         CAST(floor(value) AS BIGINT) AS comment_like,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS chapter
  FROM events)"""

RAW_COMMENTS_SQL = f"""{COMMENTS_SQL},
raw_comments AS (
  SELECT event_id, user_id, chapter, comment_like,
         CASE WHEN content <> 'error' THEN content END AS content,
         CASE WHEN content = 'signup'
                THEN concat(date_diff('day', CAST(comment_date AS DATE), DATE '{LOAD_DAY}'), '일 전')
              WHEN content = 'view' THEN concat(extract(hour FROM comment_date), '시간 전')
              ELSE strftime(comment_date, '%Y-%m-%d %H:%M:%S') END AS comment_date
  FROM comments)"""

EPISODES_SQL = """
episodes AS (
  SELECT p_partkey AS chapter,
         concat(p_partkey, '화 : ', p_name, ' ', p_brand, ' ', p_type,
                CASE WHEN p_size >= 34 THEN concat(' (', p_size, ')') ELSE '' END) AS episode,
         DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) AS upload_at,
         p_brand AS tag
  FROM part)"""

SNAPSHOTS_SQL = f"""{EPISODES_SQL},
snapshots AS (
  SELECT e.chapter, e.episode, e.upload_at, d.down_at,
         100 + chapter * 7 % 91 AS like_count,
         10 + chapter * 3 % 37 AS comment_count,
         CAST(chapter % 10 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(9 AS DOUBLE) AS score
  FROM episodes e, (VALUES ('{EARLIER_SNAPSHOT}'), ('{LATEST_SNAPSHOT}')) d(down_at)
  WHERE d.down_at = '{EARLIER_SNAPSHOT}' OR e.tag <> 'Brand#9')"""

READS_SQL = f"""
reads AS (
  SELECT l_partkey AS chapter, CAST(l_shipdate AS DATE) + {READ_SHIFT_DAYS} AS comment_date
  FROM lineitem)"""

TRANSACTIONS_SQL = """
txn AS (
  SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders)"""
