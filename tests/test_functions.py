import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.functions import dates, numbers, special, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("ratio,percent", [(0.29, 28), (0.57, 56), (0.575, 56), (0.5, 50), (1.0, 100)])
def test_percent_truncated(spark, ratio, percent):
    assert one(spark, numbers.percent_truncated(F.col("r")), r=ratio) == percent


def test_round_half_even_scales_first(spark):
    assert one(spark, numbers.round_half_even(F.lit(0.575), 2)) == 0.57
    assert one(spark, numbers.round_half_even(F.lit(2.5))) == 2.0
    assert one(spark, numbers.round_half_even(F.lit(3.5))) == 4.0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20), st.integers(1, 4))
def test_round_half_even_matches_numpy(spark, values, digits):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", numbers.round_half_even(F.col("v"), digits).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == list(np.round(np.array(values), digits))


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("5일 전", dt.datetime(2024, 3, 3)),
        ("0일 전", dt.datetime(2024, 3, 8)),
        ("3시간 전", None),
        ("2024-03-03 23:10:00", dt.datetime(2024, 3, 3, 23, 10)),
        ("2024-03-03 23:10", dt.datetime(2024, 3, 3, 23, 10)),
        ("2024.03.03. 23:10", dt.datetime(2024, 3, 3, 23, 10)),
        ("2024.3.3", dt.datetime(2024, 3, 3)),
        ("20240303", dt.datetime(2024, 3, 3)),
        ("2024-13-40", None),
        ("soon", None),
        ("일 전", None),
    ],
)
def test_resolve_comment_date(spark, raw, expected):
    assert one(spark, dates.resolve_comment_date(F.col("s"), "2024-03-08"), s=raw) == expected


def test_strict_short_date(spark):
    assert one(spark, dates.strict_short_date(F.col("s")), s="24.03.06") == dt.date(2024, 3, 6)
    with pytest.raises(Exception, match="24-03"):
        one(spark, dates.strict_short_date(F.col("s")), s="24-03")
    assert one(spark, dates.strict_short_date(F.col("s")), s="70.01.01") == dt.date(2070, 1, 1)
    with pytest.raises(Exception, match="out of range"):
        one(spark, dates.strict_short_date(F.col("s"), 2025), s="70.01.01")


def test_week_and_month_start(spark):
    sunday = F.lit(dt.date(2024, 3, 3))
    assert one(spark, dates.week_start(sunday)) == dt.date(2024, 2, 26)
    assert one(spark, dates.month_start(sunday)) == dt.date(2024, 3, 1)
    assert one(spark, dates.weekday_name(sunday)) == "Sunday"


@pytest.mark.parametrize(
    "raw,number", [("67화 : 매너리즘(1)", 67), ("12 next", 12), ("(3)화", 3)]
)
def test_leading_number(spark, raw, number):
    assert one(spark, text.leading_number(F.col("s")), s=raw) == number


def test_leading_number_absent(spark):
    for raw in ("제67화", "a1b", "12"):
        assert one(spark, text.leading_number(F.col("s"), strict=False), s=raw) is None
    assert one(spark, text.leading_number(F.col("s"), strict=False), s="제목") is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, text.leading_number(F.col("s")), s="제목")


@pytest.mark.parametrize(
    "raw,title",
    [
        ("67화 : 매너리즘(1)", "매너리즘"),
        ("78화 : 초대 (12)", "초대"),
        ("5화 :\t빈칸 \t", "빈칸"),
        ("5화 : 괄호(가)", "괄호(가)"),
        ("5화 : 하나 : 둘", "하나"),
        ("abc", None),
    ],
)
def test_series_title(spark, raw, title):
    assert one(spark, text.series_title(F.col("s")), s=raw) == title


def test_series_title_exception(spark):
    column = text.series_title(F.col("s"), F.col("n"), {67: 4})
    assert one(spark, column, s="67화 : 매너리즘 번외", n=67) == "매너리즘"
    assert one(spark, column, s="68화 : 매너리즘 번외", n=68) == "매너리즘 번외"


def test_link(spark):
    assert one(spark, text.link("https://example.org/?no=%d", F.col("n")), n=7) == "https://example.org/?no=7"


@settings(max_examples=200, deadline=None)
@given(st.floats(1e-6, 1e7))
def test_ln_gamma(z):
    assert math.isclose(float(special.ln_gamma(z)), math.lgamma(z), rel_tol=1e-13, abs_tol=1e-13)


def test_digamma():
    euler = 0.5772156649015329
    assert math.isclose(float(special.digamma(1.0)), -euler, rel_tol=1e-14)
    assert math.isclose(float(special.digamma(0.5)), -euler - 2 * math.log(2), rel_tol=1e-14)
    z = np.array([0.01, 0.3, 5.5, 40.0])
    assert np.allclose(special.digamma(z + 1) - special.digamma(z), 1 / z, rtol=1e-12)


def test_hyp2f1():
    z = np.array([0.0, 0.1, 0.5, 0.9, 0.999])
    expected = np.array([1.0] + [-math.log(1 - v) / v for v in z[1:]])
    assert np.allclose(special.hyp2f1(1.0, 1.0, 2.0, z), expected, rtol=1e-11)
    # (1 - z)^-a when b equals c.
    assert np.allclose(special.hyp2f1(2.5, 3.0, 3.0, z), (1 - z) ** -2.5, rtol=1e-10)


def test_tail_probabilities():
    assert math.isclose(special.student_two_sided(2.228138852, 10), 0.05, abs_tol=1e-9)
    assert math.isclose(special.student_two_sided(0.0, 10), 1.0)
    # Table value: F(0.95; 3, 20) = 3.0984.
    assert math.isclose(special.f_upper_tail(3.0984, 3, 20), 0.05, abs_tol=1e-5)
    assert math.isclose(special.f_upper_tail(2.0**2, 1, 7), special.student_two_sided(2.0, 7), rel_tol=1e-12)
