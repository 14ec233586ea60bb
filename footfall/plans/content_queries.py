"""Episodes and series: value, trend, ranking, group comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import cleaning, content, group_tests, histograms
from footfall.operators.ordering import with_position
from footfall.plans import bindings
from footfall.plans.customer_queries import histogram_sql
from footfall.plans.registry import query
from footfall.session import materialise

LINK = "https://example.org/detail?no=%d"
# Chapters whose title is cut, and its length.
SHORT_TITLES = {67: 4}

VALUE_SQL = f"""{bindings.READS_SQL}, {bindings.EPISODES_SQL},
ep_value AS (
  SELECT e.chapter, e.episode, e.upload_at,
         CAST(sum(CASE WHEN r.comment_date < e.upload_at THEN 1200 ELSE 0 END) AS BIGINT) AS total_cookie
  FROM reads r LEFT JOIN episodes e ON r.chapter = e.chapter
  WHERE e.chapter IS NOT NULL
  GROUP BY e.chapter, e.episode, e.upload_at)"""

TITLE_SQL = r"""
CASE WHEN chapter = 67
       THEN substring(trim(regexp_replace(str_split(episode, ':')[2], '\s*\(\d+\)$', '')), 1, 4)
     ELSE trim(regexp_replace(str_split(episode, ':')[2], '\s*\(\d+\)$', '')) END"""

SERIES_SQL = f"""{VALUE_SQL},
series AS (
  SELECT title, avg(total_cookie) AS cookie_mean, count(*) AS series_cnt
  FROM (SELECT {TITLE_SQL} AS title, total_cookie FROM ep_value WHERE total_cookie > 0)
  WHERE title IS NOT NULL GROUP BY title)"""


def _values(spark, folder):
    return content.episode_value(
        bindings.reads(spark, folder), bindings.episodes(spark, folder), key="chapter"
    )


def _series(spark, folder):
    return content.series_summary(_values(spark, folder), SHORT_TITLES)


@query(
    "episode_chapter",
    f"WITH {bindings.EPISODES_SQL} SELECT chapter, episode, upload_at FROM episodes",
)
def episode_chapter(spark, folder):
    return bindings.episodes(spark, folder)


@query(
    "series_title",
    f"WITH {bindings.EPISODES_SQL} SELECT chapter, episode, upload_at, {TITLE_SQL} AS title FROM episodes",
)
def series_title(spark, folder):
    return content.titled_values(bindings.episodes(spark, folder), SHORT_TITLES)


@query(
    "episode_dedup",
    f"""WITH {bindings.SNAPSHOTS_SQL}
SELECT chapter, episode, upload_at FROM (
  SELECT *, row_number() OVER (PARTITION BY episode ORDER BY down_at, chapter) AS place FROM snapshots)
WHERE place = 1""",
)
def episode_dedup(spark, folder):
    first = cleaning.first_per_key(
        bindings.snapshots(spark, folder), ["episode"], ["down_at", "chapter"]
    )
    return first.select("chapter", "episode", "upload_at")


@query(
    "latest_snapshot",
    f"""WITH {bindings.SNAPSHOTS_SQL}
SELECT episode, like_count, comment_count, score FROM snapshots
WHERE down_at = '{bindings.LATEST_SNAPSHOT}'""",
)
def latest_snapshot(spark, folder):
    return cleaning.snapshot(
        bindings.snapshots(spark, folder),
        bindings.LATEST_SNAPSHOT,
        ["episode", "like_count", "comment_count", "score"],
    )


@query("episode_value", f"WITH {VALUE_SQL} SELECT * FROM ep_value")
def episode_value(spark, folder):
    return _values(spark, folder)


@query(
    "episode_moving_avg",
    f"""WITH {VALUE_SQL}
SELECT *, CASE WHEN count(*) OVER w = 14 THEN avg(total_cookie) OVER w END AS moving_average
FROM ep_value
WINDOW w AS (ORDER BY upload_at, chapter ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
ORDER BY upload_at, chapter""",
)
def episode_moving_avg(spark, folder):
    return content.value_trend(_values(spark, folder)).orderBy("upload_at", "chapter")


@query(
    "episode_value_series",
    f"""WITH {VALUE_SQL}
SELECT 'cookie' AS id, CAST(row_number() OVER (ORDER BY upload_at, chapter) - 1 AS BIGINT) AS position,
       strftime(upload_at, '%Y-%m-%d') AS x, total_cookie AS y
FROM ep_value""",
)
def episode_value_series(spark, folder):
    placed = with_position(_values(spark, folder), ["upload_at", "chapter"])
    return content.chart_rows(placed, "upload_at", "total_cookie", "cookie")


@query(
    "mean_episode_value",
    f"WITH {VALUE_SQL} SELECT round_even(avg(total_cookie), 0) AS mean_cookie FROM ep_value",
)
def mean_episode_value(spark, folder):
    return content.mean_value(_values(spark, folder))


@query(
    "top3_episodes",
    f"""WITH {bindings.READS_SQL}, {bindings.SNAPSHOTS_SQL},
ep_value AS (
  SELECT e.chapter, e.episode, e.upload_at,
         CAST(sum(CASE WHEN r.comment_date < e.upload_at THEN 1200 ELSE 0 END) AS BIGINT) AS total_cookie
  FROM reads r JOIN episodes e ON r.chapter = e.chapter
  GROUP BY e.chapter, e.episode, e.upload_at)
SELECT v.*, s.like_count, s.comment_count, s.score,
       concat('https://example.org/detail?no=', v.chapter) AS link
FROM ep_value v JOIN snapshots s ON v.episode = s.episode AND s.down_at = '{bindings.LATEST_SNAPSHOT}'
ORDER BY total_cookie DESC, v.chapter LIMIT 3""",
)
def top3_episodes(spark, folder):
    return content.top_episodes(
        _values(spark, folder), latest_snapshot(spark, folder), 3, LINK
    )


@query("series_summary", f"WITH {SERIES_SQL} SELECT * FROM series")
def series_summary(spark, folder):
    return _series(spark, folder)


SAMPLES_SQL = f"""{SERIES_SQL},
samples AS (
  SELECT CASE WHEN series_cnt >= 2 THEN 'series' ELSE 'single' END AS grp, cookie_mean AS value
  FROM series)"""

# Student density on (0, |t|) by Simpson's rule gives the two-sided p-value.
STUDENT_SQL = """
curve AS (
  SELECT k, s.t, s.df, abs(s.t) / 4000 * k AS u,
         CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS w
  FROM stat s, range(0, 4001) ks(k)),
tail AS (
  SELECT 1 - 2 * sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())
                     * pow(1 + u * u / df, -(df + 1) / 2)) * any_value(abs(t)) / 4000 / 3 AS p
  FROM curve)"""


@query(
    "welch_ttest",
    f"""WITH {SAMPLES_SQL},
moments AS (
  SELECT count(*) FILTER (grp = 'series') AS n1, avg(value) FILTER (grp = 'series') AS mean1,
         var_samp(value) FILTER (grp = 'series') AS var1,
         count(*) FILTER (grp = 'single') AS n2, avg(value) FILTER (grp = 'single') AS mean2,
         var_samp(value) FILTER (grp = 'single') AS var2
  FROM samples),
stat AS (
  SELECT *, (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t,
         pow(var1 / n1 + var2 / n2, 2)
         / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)) AS df
  FROM moments), {STUDENT_SQL}
SELECT n1, round(mean1, 6) AS mean1, round(var1, 4) AS var1,
       n2, round(mean2, 6) AS mean2, round(var2, 4) AS var2,
       round(t, 8) AS t_statistic, round(df, 6) AS df, round(p, 8) AS p_value
FROM stat, tail""",
)
def welch_ttest(spark, folder):
    row = group_tests.welch_test(group_tests.split_by_parts(_series(spark, folder)))
    digits = {"mean1": 6, "mean2": 6, "var1": 4, "var2": 4, "t_statistic": 8, "df": 6, "p_value": 8}
    return row.withColumns({name: F.round(name, d) for name, d in digits.items()})


@query(
    "levene_test",
    f"""WITH {SAMPLES_SQL},
medians AS (SELECT grp, quantile_cont(value, 0.5) AS med FROM samples GROUP BY grp),
dev AS (SELECT s.grp, abs(value - med) AS z FROM samples s JOIN medians m ON s.grp = m.grp),
by_group AS (SELECT grp, count(*) AS n, avg(z) AS mean, sum(z) AS total FROM dev GROUP BY grp),
grand AS (SELECT sum(total) / sum(n) AS mean FROM by_group),
parts AS (
  SELECT (SELECT sum(n * pow(b.mean - g.mean, 2)) FROM by_group b, grand g) AS between_ss,
         (SELECT sum(pow(d.z - b.mean, 2)) FROM dev d JOIN by_group b ON d.grp = b.grp) AS within_ss,
         (SELECT count(*) FROM by_group) AS groups, (SELECT count(*) FROM dev) AS n),
stat AS (
  SELECT *, sqrt((n - groups) * between_ss / ((groups - 1) * within_ss)) AS t,
         CAST(n - groups AS DOUBLE) AS df
  FROM parts), {STUDENT_SQL}
SELECT groups, CAST(n AS BIGINT) AS n, round(t * t, 8) AS f_statistic,
       groups - 1 AS df1, CAST(n - groups AS BIGINT) AS df2, round(p, 8) AS p_value
FROM stat, tail""",
)
def levene_test(spark, folder):
    samples = materialise(group_tests.split_by_parts(_series(spark, folder)))
    row = group_tests.levene_test(samples)
    return row.withColumns({name: F.round(name, 8) for name in ("f_statistic", "p_value")})


@query(
    "value_histogram",
    f"""WITH {SERIES_SQL}, {histogram_sql("series", ["cookie_mean"], 8)}
SELECT metric, bin, round(lower, 6) AS lower, round(upper, 6) AS upper, cnt FROM binned""",
)
def value_histogram(spark, folder):
    bars = histograms.histograms(materialise(_series(spark, folder)), ["cookie_mean"], 8)
    return bars.withColumns({name: F.round(name, 6) for name in ("lower", "upper")})


@query(
    "value_kde",
    f"""WITH {SERIES_SQL},
shape AS (
  SELECT count(*) AS n, min(cookie_mean) AS low, max(cookie_mean) AS high,
         stddev_samp(cookie_mean) * pow(count(*), -0.2) AS h FROM series),
curve AS (
  SELECT k, low + k * ((high - low) / 199) AS x, n, h, (high - low) / 8 AS width,
         (SELECT sum(exp(-0.5 * pow((s.low + k * ((s.high - s.low) / 199) - v.cookie_mean) / s.h, 2)))
          FROM series v) AS kernel
  FROM shape s, range(0, 200) ks(k))
SELECT CAST(k AS INTEGER) AS point, round(x, 6) AS x,
       round(kernel / (n * h * sqrt(2 * pi())), 10) AS density,
       round(kernel / (n * h * sqrt(2 * pi())) * n * width, 6) AS scaled
FROM curve""",
)
def value_kde(spark, folder):
    curve = histograms.density_curve(materialise(_series(spark, folder)), "cookie_mean")
    return curve.select(
        "point",
        F.round("x", 6).alias("x"),
        F.round("density", 10).alias("density"),
        F.round("scaled", 6).alias("scaled"),
    )
