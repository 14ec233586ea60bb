"""Cleaning, RFM, lifetime value, segments and promotion cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.models import bgnbd, gammagamma
from footfall.models.bgnbd import (
    BetaGeo,
    customer_cells,
    expected_purchases,
    fit_bgnbd,
    with_log_likelihood,
)
from footfall.models.fitting import LEAST
from footfall.models.gammagamma import (
    GammaGamma,
    expected_average_value,
    fit_gammagamma,
    repeat_spend,
)
from footfall.models.value import (
    error_scores,
    fit_both,
    penalty_grid,
    score_both,
    with_lifetime_value,
)
from footfall.operators import cleaning, dayparts, histograms, pricing, quantiles, rfm, segments
from footfall.plans import bindings
from footfall.plans.activity_queries import DAYPARTS_SQL
from footfall.plans.registry import query
from footfall.session import materialise

HOLDOUT_DAYS = 365
HORIZON = 240
METRICS = ["recency", "frequency", "monetary_value", "ltv"]
WIDEST_BAND = (1, 100)

# Fixed model parameters, for results that SQL can repeat.
PURCHASE_MODEL = BetaGeo(r=4.0, alpha=900.0, a=0.8, b=20.0)
SPEND_MODEL = GammaGamma(p=6.0, q=4.0, v=120000.0)

# Penalties of the published fits.
PURCHASE_PENALTY = 0.001322590266385021
SPEND_PENALTY = 0.0018085768788633095
# As many trials as the published search, evenly by order of magnitude up to 1.
PENALTY_GRID = [10.0 ** (-6.0 + 6.0 * i / 99.0) for i in range(100)]


# ---------------------------------------------------------------- cleaning


@query(
    "clean_comments",
    f"""WITH {bindings.RAW_COMMENTS_SQL},
dated AS (
  SELECT event_id, user_id, chapter, comment_like, content,
         CASE WHEN contains(comment_date, '일 전')
                THEN CAST(DATE '{bindings.LOAD_DAY}'
                          - CAST(regexp_replace(comment_date, '[^0-9]', '', 'g') AS INTEGER) AS TIMESTAMP)
              ELSE try_cast(comment_date AS TIMESTAMP) END AS comment_date
  FROM raw_comments WHERE content IS NOT NULL)
SELECT * FROM dated WHERE comment_date <= TIMESTAMP '{bindings.CUTOFF} 00:00:00'""",
)
def clean_comments(spark, folder):
    return cleaning.clean_comments(
        bindings.raw_comments(spark, folder), bindings.LOAD_DAY, bindings.CUTOFF
    )


@query(
    "priced_comments",
    f"""WITH {bindings.COMMENTS_SQL}, {bindings.EPISODES_SQL},
priced AS (
  SELECT c.*, e.episode, e.upload_at,
         CAST(CASE WHEN c.comment_date < e.upload_at THEN 1200 ELSE 0 END AS BIGINT) AS cookie
  FROM comments c LEFT JOIN episodes e ON c.chapter = e.chapter)
SELECT *, cookie + comment_like + 500 AS price FROM priced""",
)
def priced_comments(spark, folder):
    return pricing.priced_comments(
        bindings.comments(spark, folder), bindings.episodes(spark, folder), key="chapter"
    )


@query(
    "paid_sample",
    f"""WITH {bindings.COMMENTS_SQL}, {bindings.EPISODES_SQL}
SELECT e.episode, e.upload_at, c.event_id, c.user_id, c.comment_date, c.comment_like,
       CAST(1200 AS BIGINT) AS cookie, 1200 + c.comment_like + 500 AS price
FROM comments c JOIN episodes e ON c.chapter = e.chapter
WHERE c.comment_date < e.upload_at
ORDER BY md5(concat('7|', c.event_id)), c.event_id LIMIT 5""",
)
def paid_sample(spark, folder):
    paid = priced_comments(spark, folder).filter(F.col("cookie") == pricing.PREVIEW_PRICE)
    columns = ["episode", "upload_at", "event_id", "user_id", "comment_date", "comment_like"]
    sample = cleaning.reproducible_sample(paid, 5, ["event_id"], seed=7)
    return sample.select(*columns, "cookie", "price")


@query(
    "first_comment",
    f"""WITH {bindings.COMMENTS_SQL}
SELECT chapter, user_id, CAST(comment_date AS DATE) AS comment_date, comment_like FROM (
  SELECT *, row_number() OVER (PARTITION BY chapter, user_id ORDER BY comment_date, event_id) AS place
  FROM comments) WHERE place = 1""",
)
def first_comment(spark, folder):
    first = cleaning.first_per_key(
        bindings.comments(spark, folder), ["chapter", "user_id"], ["comment_date", "event_id"]
    )
    return first.select(
        "chapter", "user_id", F.to_date("comment_date").alias("comment_date"), "comment_like"
    )


# --------------------------------------------------------------------- RFM


@query(
    "rfm_simple",
    f"""WITH {bindings.COMMENTS_SQL}, {bindings.EPISODES_SQL},
first_comment AS (
  SELECT chapter, user_id, CAST(comment_date AS DATE) AS comment_date FROM (
    SELECT *, row_number() OVER (PARTITION BY chapter, user_id ORDER BY comment_date) AS place
    FROM comments) WHERE place = 1),
priced AS (
  SELECT f.*, CASE WHEN f.comment_date < e.upload_at THEN 1200 ELSE 0 END AS price
  FROM first_comment f JOIN episodes e ON f.chapter = e.chapter)
SELECT user_id, min(comment_date) AS first_comment_date, max(comment_date) AS last_comment_date,
       CAST(date_diff('day', min(comment_date), max(comment_date)) AS INTEGER) AS recency,
       count(user_id) AS frequency, CAST(sum(price) AS BIGINT) AS monetary
FROM priced GROUP BY user_id""",
)
def rfm_simple(spark, folder):
    return rfm.rfm_simple(
        bindings.comments(spark, folder), bindings.episodes(spark, folder), key="chapter"
    )


def _repeat_sql(daily: str) -> str:
    """The repeat summary over a `daily(user_id, day, spend)` table."""
    return f"""{daily},
ends AS (SELECT max(day) AS last_day FROM daily),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS place FROM daily),
rfm AS (
  SELECT user_id, count(*) - 1 AS frequency,
         CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS recency,
         CAST(date_diff('day', min(day), (SELECT last_day FROM ends)) AS INTEGER) AS "T",
         coalesce(CAST(sum(spend) FILTER (place > 1) AS DOUBLE)
                  / count(*) FILTER (place > 1), 0) AS monetary_value
  FROM placed GROUP BY user_id)"""


COMMENT_RFM_SQL = _repeat_sql(
    f"""{bindings.COMMENTS_SQL}, {bindings.EPISODES_SQL},
daily AS (
  SELECT c.user_id, CAST(c.comment_date AS DATE) AS day,
         sum(CASE WHEN c.comment_date < e.upload_at THEN 1200 ELSE 0 END + c.comment_like + 500) AS spend
  FROM comments c LEFT JOIN episodes e ON c.chapter = e.chapter
  GROUP BY c.user_id, CAST(c.comment_date AS DATE))"""
)

ORDER_RFM_SQL = _repeat_sql(
    f"""{bindings.TRANSACTIONS_SQL},
daily AS (SELECT user_id, day, sum(price) AS spend FROM txn GROUP BY user_id, day)"""
)


@query("rfm_repeat", f"WITH {COMMENT_RFM_SQL} SELECT * FROM rfm")
def rfm_repeat(spark, folder):
    log = bindings.comments(spark, folder)
    return rfm.rfm_repeat(
        priced_comments(spark, folder), rfm.last_day(log, "comment_date"), ts="comment_date"
    )


@query("rfm_repeat_orders", f"WITH {ORDER_RFM_SQL} SELECT * FROM rfm")
def rfm_repeat_orders(spark, folder):
    log = bindings.transactions(spark, folder)
    return rfm.rfm_repeat(log, rfm.last_day(log))


@query("rfm_merged", f"WITH {ORDER_RFM_SQL} SELECT * FROM rfm")
def rfm_merged(spark, folder):
    # Even and odd months are summed up apart, as parts that arrive one by one.
    log = bindings.transactions(spark, folder)
    odd = F.month("ts") % 2 == 1
    parts = [materialise(rfm.repeat_state(log.filter(part))) for part in (odd, ~odd)]
    return rfm.rfm_of_state(rfm.merge_states(*parts), rfm.last_day(log))


CALIBRATION_SQL = f"""{bindings.TRANSACTIONS_SQL},
ends AS (SELECT max(day) AS last_day, max(day) - {HOLDOUT_DAYS} AS split FROM txn),
daily AS (
  SELECT user_id, day, sum(price) AS spend FROM txn, ends WHERE day <= split GROUP BY user_id, day),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS place FROM daily),
cal AS (
  SELECT user_id, count(*) - 1 AS frequency_cal,
         CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS recency_cal,
         CAST(date_diff('day', min(day), (SELECT split FROM ends)) AS INTEGER) AS "T_cal",
         coalesce(CAST(sum(spend) FILTER (place > 1) AS DOUBLE)
                  / count(*) FILTER (place > 1), 0) AS monetary_value_cal
  FROM placed GROUP BY user_id),
late AS (
  SELECT user_id, count(DISTINCT day) AS frequency_holdout,
         CAST(sum(price) AS DOUBLE) / count(*) AS monetary_value_holdout
  FROM txn, ends WHERE day > split AND day <= last_day GROUP BY user_id),
summary AS (
  SELECT cal.*, coalesce(frequency_holdout, 0) AS frequency_holdout,
         coalesce(monetary_value_holdout, 0) AS monetary_value_holdout,
         {HOLDOUT_DAYS} AS duration_holdout
  FROM cal LEFT JOIN late ON cal.user_id = late.user_id),
repeaters AS (SELECT * FROM summary WHERE frequency_cal > 0)"""


@query("calibration_holdout", f"WITH {CALIBRATION_SQL} SELECT * FROM summary")
def calibration_holdout(spark, folder):
    log = bindings.transactions(spark, folder)
    return rfm.calibration_holdout(log, rfm.last_day(log), HOLDOUT_DAYS)


def repeat_customers(spark, folder):
    return rfm_repeat_orders(spark, folder).filter(F.col("frequency") > 0)


def repeat_holdout(spark, folder):
    return calibration_holdout(spark, folder).filter(F.col("frequency_cal") > 0)


# ------------------------------------------------- models, fixed parameters

R, ALPHA, A, B = (getattr(PURCHASE_MODEL, n) for n in ("r", "alpha", "a", "b"))
P, Q, V = (getattr(SPEND_MODEL, n) for n in ("p", "q", "v"))
FIXED_PURCHASES, FIXED_SPEND = (R, ALPHA, A, B), (P, Q, V)
# The same places filled by the fits that SQL finds itself.
FITTED_PURCHASES = tuple(f"(SELECT {n} FROM purchase_fit)" for n in ("r", "alpha", "a", "b"))
FITTED_SPEND = tuple(f"(SELECT {n} FROM spend_fit)" for n in ("p", "q", "v"))

LOGLIK_SQL = f"""
SELECT user_id, frequency, recency, "T",
       lgamma({R} + frequency) - lgamma({R}) + {R} * ln({ALPHA})
       + lgamma({A} + {B}) + lgamma({B} + frequency) - lgamma({B}) - lgamma({A} + {B} + frequency)
       + ln(exp(-({R} + frequency) * ln(({ALPHA} + "T") / {ALPHA}))
            + CASE WHEN frequency > 0
                   THEN {A} / ({B} + greatest(frequency, 1) - 1)
                        * exp(-({R} + frequency) * ln(({ALPHA} + recency) / {ALPHA}))
                   ELSE 0 END)
       - ({R} + frequency) * ln({ALPHA}) AS loglik
FROM rfm"""


@query(
    "bgnbd_loglik",
    f"""WITH {ORDER_RFM_SQL}
SELECT user_id, frequency, recency, "T", round(loglik, 6) AS loglik FROM ({LOGLIK_SQL})""",
)
def bgnbd_loglik(spark, folder):
    scored = with_log_likelihood(rfm_repeat_orders(spark, folder), PURCHASE_MODEL)
    return scored.select("user_id", "frequency", "recency", "T", F.round("loglik", 6).alias("loglik"))


def _expected_sql(
    source: str, horizons: str, x: str, t: str, end: str, model: tuple = FIXED_PURCHASES
) -> str:
    """Expected purchases per (user, horizon) as a series summed by SQL."""
    R, ALPHA, A, B = model
    z = f"(h / ({ALPHA} + {end} + h))"
    return f"""
terms AS (
  SELECT user_id, h, any_value({x}) AS x, any_value({t}) AS t_x, any_value({end}) AS t_end,
         sum(exp(lgamma({R} + {x} + n) - lgamma({R} + {x}) + lgamma({B} + {x} + n) - lgamma({B} + {x})
                 - lgamma({A} + {B} + {x} - 1 + n) + lgamma({A} + {B} + {x} - 1) - lgamma(n + 1))
             * pow({z}, n)) AS series
  FROM {source}, ({horizons}) hs(h), range(0, 90) ns(n)
  GROUP BY user_id, h),
expected AS (
  SELECT user_id, h,
         ({A} + {B} + x - 1) / ({A} - 1)
         * (1 - series * pow(({ALPHA} + t_end) / ({ALPHA} + t_end + h), {R} + x))
         / (1 + CASE WHEN x > 0
                     THEN {A} / ({B} + greatest(x, 1) - 1)
                          * pow(({ALPHA} + t_end) / ({ALPHA} + t_x), {R} + x)
                     ELSE 0 END) AS purchases
  FROM terms)"""


def _value_sql(model: tuple) -> str:
    P, Q, V = model
    return f"""
(1 - {P} * frequency / ({P} * frequency + {Q} - 1)) * ({V} * {P} / ({Q} - 1))
+ {P} * frequency / ({P} * frequency + {Q} - 1) * monetary_value"""


VALUE_SQL = _value_sql(FIXED_SPEND)


@query(
    "expected_purchases",
    f"""WITH {ORDER_RFM_SQL},
{_expected_sql("rfm", f"VALUES (CAST({HORIZON} AS DOUBLE))", "frequency", "recency", '"T"')}
SELECT user_id, round(purchases, 6) AS predicted_purchases FROM expected""",
)
def expected_purchases_query(spark, folder):
    predicted = expected_purchases(PURCHASE_MODEL, HORIZON)
    return rfm_repeat_orders(spark, folder).select(
        "user_id", F.round(predicted, 6).alias("predicted_purchases")
    )


@query(
    "expected_avg_value",
    f"""WITH {ORDER_RFM_SQL}
SELECT user_id, round({VALUE_SQL}, 4) AS predicted_monetary_value FROM rfm WHERE frequency > 0""",
)
def expected_avg_value(spark, folder):
    return repeat_customers(spark, folder).select(
        "user_id",
        F.round(expected_average_value(SPEND_MODEL), 4).alias("predicted_monetary_value"),
    )


def _ltv_sql(purchases: tuple, spend: tuple) -> str:
    months = "SELECT CAST(m * 30 AS DOUBLE) FROM range(0, 9) ms(m)"
    return f"""
repeat_rfm AS (SELECT * FROM rfm WHERE frequency > 0),
{_expected_sql("repeat_rfm", months, "frequency", "recency", '"T"', purchases)},
months AS (
  SELECT user_id, h, purchases, purchases - lag(purchases) OVER (PARTITION BY user_id ORDER BY h) AS added
  FROM expected),
discounted AS (
  SELECT user_id, sum(added / pow(1.01, h / 30)) FILTER (h > 0) AS bought,
         max(purchases) FILTER (h = {HORIZON}) AS predicted_purchases
  FROM months GROUP BY user_id),
customers AS (
  SELECT r.user_id, r.frequency, r.recency, r."T", r.monetary_value,
         {_value_sql(spend)} AS predicted_monetary_value,
         ({_value_sql(spend)}) * d.bought AS ltv, d.predicted_purchases
  FROM repeat_rfm r JOIN discounted d ON r.user_id = d.user_id)"""


LTV_SQL = f"{ORDER_RFM_SQL}, {_ltv_sql(FIXED_PURCHASES, FIXED_SPEND)}"


def valued_customers(spark, folder):
    return with_lifetime_value(repeat_customers(spark, folder), PURCHASE_MODEL, SPEND_MODEL)


@query(
    "ltv",
    f"""WITH {LTV_SQL}
SELECT user_id, frequency, recency, "T", monetary_value, round(ltv, 2) AS ltv,
       round(predicted_purchases, 6) AS predicted_purchases,
       round(predicted_monetary_value, 4) AS predicted_monetary_value
FROM customers""",
)
def ltv(spark, folder):
    return valued_customers(spark, folder).select(
        "user_id",
        "frequency",
        "recency",
        "T",
        "monetary_value",
        F.round("ltv", 2).alias("ltv"),
        F.round("predicted_purchases", 6).alias("predicted_purchases"),
        F.round("predicted_monetary_value", 4).alias("predicted_monetary_value"),
    )


@query(
    "total_expected_ltv",
    f"WITH {LTV_SQL} SELECT round_even(sum(ltv), 0) AS ltv_sum FROM customers",
)
def total_expected_ltv(spark, folder):
    return segments.total_value(valued_customers(spark, folder))


def _holdout_sql(model: tuple) -> str:
    horizon = f"VALUES (CAST({HOLDOUT_DAYS} AS DOUBLE))"
    return f"""
{_expected_sql("repeaters", horizon, "frequency_cal", "recency_cal", '"T_cal"', model)},
purchase_errors AS (
  SELECT frequency_holdout - purchases AS error
  FROM expected e JOIN repeaters r ON e.user_id = r.user_id)"""


HOLDOUT_SQL = f"{CALIBRATION_SQL}, {_holdout_sql(FIXED_PURCHASES)}"


def _spend_error_sql(part: str, model: tuple = FIXED_SPEND) -> str:
    P, Q, V = model
    weight = f"({P} * frequency_{part} / ({P} * frequency_{part} + {Q} - 1))"
    return f"""
  SELECT monetary_value_holdout
         - ((1 - {weight}) * ({V} * {P} / ({Q} - 1)) + {weight} * monetary_value_{part}) AS error
  FROM repeaters"""


def _scores_sql(label: str, source: str) -> str:
    return f"""SELECT '{label}' AS model, count(*) AS customers, round(avg(error * error), 1) AS mse,
       round(sqrt(avg(error * error)), 4) AS rmse, round(avg(abs(error)), 4) AS mae FROM {source}"""


@query(
    "holdout_error_fixed",
    f"""WITH {HOLDOUT_SQL}
SELECT round(avg(error * error), 6) AS mse, round(sqrt(avg(error * error)), 6) AS rmse,
       round(avg(abs(error)), 6) AS mae FROM purchase_errors""",
)
def holdout_error_fixed(spark, folder):
    predicted = expected_purchases(
        PURCHASE_MODEL, "duration_holdout", "frequency_cal", "recency_cal", "T_cal"
    )
    scored = repeat_holdout(spark, folder).withColumn("predicted", predicted)
    scores = error_scores(scored, "frequency_holdout", "predicted")
    return scores.select(*[F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae")])


@query(
    "holdout_scores_fixed",
    f"""WITH {HOLDOUT_SQL},
holdout_spend AS ({_spend_error_sql("holdout")}),
forecast_spend AS ({_spend_error_sql("cal")})
{_scores_sql("bgnbd", "purchase_errors")}
UNION ALL {_scores_sql("gammagamma_holdout", "holdout_spend")}
UNION ALL {_scores_sql("gammagamma_forecast", "forecast_spend")}""",
)
def holdout_scores_fixed(spark, folder):
    holdout = materialise(repeat_holdout(spark, folder))
    scores = score_both(holdout, [PURCHASE_MODEL], [SPEND_MODEL])
    digits = {"mse": 1, "rmse": 4, "mae": 4}
    return scores.drop("l2", "usable").withColumns({name: F.round(name, d) for name, d in digits.items()})


SPEND_LOGLIK_SQL = f"""
SELECT user_id, frequency, monetary_value,
       lgamma({P} * frequency + {Q}) - lgamma({P} * frequency) - lgamma({Q}) + {Q} * ln({V})
       + ({P} * frequency - 1) * ln(monetary_value) + {P} * frequency * ln(frequency)
       - ({P} * frequency + {Q}) * ln(frequency * monetary_value + {V}) AS loglik
FROM rfm WHERE frequency > 0"""


@query(
    "gammagamma_loglik",
    f"""WITH {ORDER_RFM_SQL}
SELECT user_id, frequency, monetary_value, round(loglik, 6) AS loglik FROM ({SPEND_LOGLIK_SQL})""",
)
def gammagamma_loglik(spark, folder):
    scored = gammagamma.with_log_likelihood(repeat_customers(spark, folder), SPEND_MODEL)
    return scored.select(
        "user_id", "frequency", "monetary_value", F.round("loglik", 6).alias("loglik")
    )


@query(
    "likelihood_sums",
    f"""WITH {ORDER_RFM_SQL}
SELECT 'bgnbd' AS model, round(sum(loglik), 4) AS loglik FROM ({LOGLIK_SQL}) WHERE frequency > 0
UNION ALL SELECT 'gammagamma', round(sum(loglik), 4) FROM ({SPEND_LOGLIK_SQL})""",
)
def likelihood_sums(spark, folder):
    # The sums every pass of a fit computes, at fixed parameters.
    customers = materialise(repeat_customers(spark, folder))
    purchases = bgnbd.likelihood_sums(customer_cells(customers), [PURCHASE_MODEL])
    spend = gammagamma.likelihood_sums(repeat_spend(customers), [SPEND_MODEL])
    rows = [("bgnbd", round(purchases[0], 4)), ("gammagamma", round(spend[0], 4))]
    return spark.createDataFrame(rows, "model string, loglik double")


# ------------------------------------------------------------ fitted models


def significant(value, digits: int = 6):
    """A column to so many significant digits."""
    return F.format_string(f"%.{digits - 1}e", value.cast("double")).cast("double")


def significant_sql(value: str, digits: int = 6) -> str:
    return f"printf('%.{digits - 1}e', ({value})::DOUBLE)::DOUBLE"


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _solved_sql(size: int, curve: str, damping: str) -> list[tuple[str, str]]:
    """(alias, expression) of an LDL' factorisation, each using those before it."""
    out = []
    for j in range(size):
        less = "".join(f" - l{j}{k} * l{j}{k} * d{k}" for k in range(j))
        out.append((f"d{j}", f"{curve}{j}{j} + {damping}{less}"))
        for i in range(j + 1, size):
            less = "".join(f" - l{i}{k} * l{j}{k} * d{k}" for k in range(j))
            out.append((f"l{i}{j}", f"({curve}{j}{i}{less}) / d{j}"))
    return out


def _step_sql(size: int) -> list[tuple[str, str]]:
    """Aliases x0, x1, ... of the solution of (curvature + mu) x = slope."""
    out = _solved_sql(size, "h", "mu")
    for i in range(size):
        out.append((f"y{i}", f"g{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))))
    for i in reversed(range(size)):
        out.append((f"x{i}", f"y{i} / d{i}" + "".join(f" - l{k}{i} * x{k}" for k in range(i + 1, size))))
    return out


def _search_sql(name: str, start: list[str], problems: str, sums: str, turns: int) -> str:
    """A search of its own for the smallest penalised objective, for all problems at once.

    One damped Newton step per turn in log-parameters (Levenberg and Marquardt):
    a better point is taken and the damping cut, else the damping grows. `problems`
    gives (id, l2); `sums` is a subquery over tried(id, l2, c0, c1, ...) that gives
    per id the mean negative log-likelihood f and its slopes u and second
    derivatives w by the parameters themselves.
    """
    size = len(start)
    low = f"ln({LEAST})"
    state = [f"t{i}" for i in range(size)] + ["f"] + [f"g{i}" for i in range(size)]
    state += [f"h{i}{j}" for i, j in _pairs(size)]
    tried = {f"t{i}": f"c{i}" for i in range(size)}
    tried["f"] = "n.f + l2 * (" + " + ".join(f"exp(2 * c{i})" for i in range(size)) + ")"
    for i in range(size):
        tried[f"g{i}"] = f"n.u{i} * exp(c{i}) + 2 * l2 * exp(2 * c{i})"
    for i, j in _pairs(size):
        tried[f"h{i}{j}"] = f"n.w{i}{j} * exp(c{i}) * exp(c{j})" + (
            f" + n.u{i} * exp(c{i}) + 4 * l2 * exp(2 * c{i})" if i == j else ""
        )
    old = [f"s.{n} AS o_{n}" for n in state]
    fresh = [f"{tried[n]} AS n_{n}" for n in state]
    # A parameter that is held at its least value has no slope and a curvature of one.
    held = [f"(p_t{i} <= {low} + 1e-9 AND p_g{i} > 0) AS held{i}" for i in range(size)]
    eased = [f"CASE WHEN held{i} THEN 0.0 ELSE p_g{i} END AS g{i}" for i in range(size)]
    eased += [
        f"CASE WHEN held{i}{f' OR held{j}' if i != j else ''} THEN {float(i == j)} ELSE p_h{i}{j} END AS h{i}{j}"
        for i, j in _pairs(size)
    ]
    steps = [f"{e} AS {n}" for n, e in _step_sql(size)]
    steep = lambda p: "greatest(" + ", ".join(f"abs({p}_g{i})" for i in range(size)) + ")"
    moved = ", ".join(
        f"greatest(p_t{i} - least(greatest(coalesce(x{i}, 0.0), -2.0), 2.0), {low})" for i in range(size)
    )
    names = ", ".join(f"c{i}" for i in range(size))
    return f"""
{name}_search(turn, id, l2, mu, {", ".join(state)}, {names}) AS (
  SELECT 0, id, l2, 1.0::DOUBLE, {", ".join(["0.0::DOUBLE"] * size + ["1e300::DOUBLE"] + ["0.0::DOUBLE"] * (len(state) - size - 1))},
         {", ".join(f"{x}::DOUBLE" for x in start)}
  FROM ({problems})
  UNION ALL
  SELECT turn + 1, id, l2, mu, {", ".join(f"p_{n}" for n in state)}, {moved}
  FROM (
    SELECT *, {", ".join(held)}, {", ".join(eased)}, {", ".join(steps)}
    FROM (
      SELECT turn, id, l2, CASE WHEN better THEN greatest(mu / 16, 1e-14) ELSE mu * 8 END AS mu,
             {", ".join(f"CASE WHEN better THEN n_{n} ELSE o_{n} END AS p_{n}" for n in state)}
      FROM (
        SELECT *, n_f < o_f - 1e-11 OR (n_f <= o_f + 1e-11 AND {steep("n")} < {steep("o")}) AS better
        FROM (
          SELECT s.turn, s.id, s.l2, s.mu, {", ".join(old)}, {", ".join(fresh)}
          FROM {name}_search s JOIN ({sums.format(tried=f"(SELECT id, {names} FROM {name}_search WHERE turn < {turns})")}) n
            ON n.id = s.id)))))"""


_PURCHASE_SUMS = """
SELECT id, one.f + two.f AS f, one.u0 + two.u0 AS u0, two.u1 AS u1, one.u2 + two.u2 AS u2, one.u3 + two.u3 AS u3,
       one.w00 + two.w00 AS w00, two.w01 AS w01, two.w02 AS w02, two.w03 AS w03, two.w11 AS w11, two.w12 AS w12,
       two.w13 AS w13, one.w22 + two.w22 AS w22, one.w23 + two.w23 AS w23, one.w33 + two.w33 AS w33
FROM (
  SELECT id, -sum(m * (ln(r + j) + ln(b + j) - ln(a + b + j))) AS f,
         -sum(m / (r + j)) AS u0, sum(m / (a + b + j)) AS u2, -sum(m * (a / ((b + j) * (a + b + j)))) AS u3,
         sum(m / ((r + j) * (r + j))) AS w00, -sum(m / ((a + b + j) * (a + b + j))) AS w22,
         -sum(m / ((a + b + j) * (a + b + j))) AS w23,
         sum(m / ((b + j) * (b + j)) - m / ((a + b + j) * (a + b + j))) AS w33
  FROM (SELECT id, exp(c0) AS r, exp(c2) AS a, exp(c3) AS b FROM {tried}), tails GROUP BY id) one
JOIN (
  SELECT id, -sum(n * (r * ln(alpha) - (r + x) * ln(alpha + e) + ln(1 + odds))) AS f,
         -sum(n * (ln(alpha) - va * ln(alpha + e) - vl * ln(alpha + t))) AS u0,
         -sum(n * (r / alpha - (r + x) * (va / (alpha + e) + vl / (alpha + t)))) AS u1,
         -sum(n * vl / a) AS u2, sum(n * vl / last) AS u3,
         -sum(n * va * vl * k0 * k0) AS w00,
         -sum(n * (1 / alpha - va / (alpha + e) - vl / (alpha + t) + va * vl * k0 * k1)) AS w01,
         -sum(n * va * vl * k0 * k2) AS w02, -sum(n * va * vl * k0 * k3) AS w03,
         -sum(n * ((r + x) * (va / ((alpha + e) * (alpha + e)) + vl / ((alpha + t) * (alpha + t)))
              - r / (alpha * alpha) + va * vl * k1 * k1)) AS w11,
         -sum(n * va * vl * k1 * k2) AS w12, -sum(n * va * vl * k1 * k3) AS w13,
         -sum(n * (va * vl * k2 * k2 - vl / (a * a))) AS w22, -sum(n * va * vl * k2 * k3) AS w23,
         -sum(n * (va * vl * k3 * k3 + vl / (last * last))) AS w33
  FROM (
    SELECT *, odds / (1 + odds) AS vl, 1 / (1 + odds) AS va, ln(alpha + t) - ln(alpha + e) AS k0,
           (r + x) * (1 / (alpha + t) - 1 / (alpha + e)) AS k1, -1 / a AS k2, 1 / last AS k3
    FROM (
      SELECT *, b + greatest(x, 1) - 1 AS last,
             CASE WHEN x > 0 THEN exp(ln(a) - ln(b + greatest(x, 1) - 1) - (r + x) * (ln(alpha + t) - ln(alpha + e)))
                  ELSE 0 END AS odds
      FROM (SELECT id, exp(c0) AS r, exp(c1) AS alpha, exp(c2) AS a, exp(c3) AS b FROM {tried}),
           (SELECT x, t_x AS t, t_end AS e, n / (SELECT sum(n) FROM cells) AS n FROM cells)))
  GROUP BY id) two USING (id)"""


def _gamma_slope_sql(z: str, second: bool = False) -> str:
    """Digamma or trigamma of z: Stirling's series after a shift of ten."""
    y = f"(({z}) + 10)"
    head = f"list_sum(list_transform(range(0, 10), lambda i: 1 / (({z}) + i){' / ((' + z + ') + i)' if second else ''}))"
    if second:
        terms = ((1, "6", 3), (-1, "30", 5), (1, "42", 7), (-1, "30", 9), (5, "66", 11), (-691, "2730", 13))
        return f"(1 / {y} + 1 / (2 * {y} * {y}) + " + " + ".join(
            f"({n}.0 / {d}) / pow({y}, {k})" for n, d, k in terms
        ) + f" + {head})"
    terms = ((1, "12", 2), (-1, "120", 4), (1, "252", 6), (-1, "240", 8), (1, "132", 10), (-691, "32760", 12))
    return f"(ln({y}) - 1 / (2 * {y}) - (" + " + ".join(f"({n}.0 / {d}) / pow({y}, {k})" for n, d, k in terms) + f") - {head})"


_SPEND_SUMS = f"""
SELECT id, one.f + two.f AS f, one.u0 + two.u0 AS u0, one.u1 + two.u1 AS u1, two.u2 AS u2,
       one.w00 AS w00, one.w01 AS w01, two.w02 AS w02, one.w11 AS w11, two.w12 AS w12, two.w22 AS w22
FROM (
  SELECT id, -sum(n * (lgamma(p * x + q) - lgamma(p * x) - lgamma(q))) AS f,
         -sum(n * x * (d_all - d_own)) AS u0, -sum(n * (d_all - d_q)) AS u1,
         -sum(n * x * x * (e_all - e_own)) AS w00, -sum(n * x * e_all) AS w01, -sum(n * (e_all - e_q)) AS w11
  FROM (
    SELECT *, {_gamma_slope_sql("p * x + q")} AS d_all, {_gamma_slope_sql("p * x")} AS d_own,
           {_gamma_slope_sql("q")} AS d_q, {_gamma_slope_sql("p * x + q", True)} AS e_all,
           {_gamma_slope_sql("p * x", True)} AS e_own, {_gamma_slope_sql("q", True)} AS e_q
    FROM (SELECT id, exp(c0) AS p, exp(c1) AS q FROM {{tried}}), spent_counts)
  GROUP BY id) one
JOIN (
  SELECT id, -avg(q * ln(v) + (p * x - 1) * ln(m) + p * x * ln(x) - (p * x + q) * ln(x * m + v)) AS f,
         -avg(x * (ln(m) + ln(x) - ln(x * m + v))) AS u0, -avg(ln(v) - ln(x * m + v)) AS u1,
         -avg(q / v - (p * x + q) / (x * m + v)) AS u2, avg(x / (x * m + v)) AS w02,
         -avg(1 / v - 1 / (x * m + v)) AS w12,
         -avg((p * x + q) / ((x * m + v) * (x * m + v)) - q / (v * v)) AS w22
  FROM (SELECT id, exp(c0) AS p, exp(c1) AS q, exp(c2) AS v FROM {{tried}}), spent
  GROUP BY id) two USING (id)"""


def _errors_sql(size: int, names: list[str], total: str) -> str:
    """Standard errors from the inverse of the last curvature."""
    aliases = _solved_sql(size, "h", "0.0")
    # m holds the inverse of the unit triangle.
    for j in range(size):
        for i in range(j + 1, size):
            inner = "".join(f" + l{i}{k} * m{k}{j}" for k in range(j + 1, i))
            aliases.append((f"m{i}{j}", f"-(l{i}{j}{inner})"))
    for j, name in enumerate(names):
        inverse = " + ".join([f"1 / d{j}", *(f"m{i}{j} * m{i}{j} / d{i}" for i in range(j + 1, size))])
        aliases.append((f"{name}_error", f"{name} * sqrt(({inverse}) / {total})"))
    return ", ".join(f"{e} AS {n}" for n, e in aliases)


def _last_sql(name: str) -> str:
    return f"(SELECT * FROM {name}_search QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1)"


def purchase_fits_sql(problems: str, turns: int = 60) -> str:
    """purchase_fits(id, l2, r, alpha, a, b, objective, ...) over cells(x, t_x, t_end, n) and span(scale)."""
    return f"""
tails AS MATERIALIZED (
  SELECT j::DOUBLE AS j, sum(n) / (SELECT sum(n) FROM cells) AS m
  FROM cells, range(0, 10000) js(j) WHERE j < x GROUP BY j),
{_search_sql("purchase", ["1", "1", "0", "0"], problems, _PURCHASE_SUMS, turns)},
purchase_fits AS MATERIALIZED (
  SELECT *, exp(t0) AS r, exp(t1) / (SELECT scale FROM span) AS alpha, exp(t2) AS a, exp(t3) AS b, f AS objective
  FROM {_last_sql("purchase")})"""


def spend_fits_sql(problems: str, turns: int = 60) -> str:
    """spend_fits(id, l2, p, q, v, objective, ...) over spent(x, m, unit)."""
    return f"""
spent_counts AS MATERIALIZED (SELECT x, count(*) / (SELECT count(*) FROM spent)::DOUBLE AS n FROM spent GROUP BY x),
{_search_sql("spend", ["0.7", "1", "0"], problems, _SPEND_SUMS, turns)},
spend_fits AS MATERIALIZED (
  SELECT *, exp(t0) AS p, exp(t1) AS q, exp(t2) * (SELECT max(unit) FROM spent) AS v, f AS objective
  FROM {_last_sql("spend")})"""


_CELLS_SQL = """
span AS (SELECT 10.0::DOUBLE / max("T_cal") AS scale FROM repeaters),
cells AS MATERIALIZED (
  SELECT frequency_cal::DOUBLE AS x, recency_cal * scale AS t_x, "T_cal" * scale AS t_end, count(*)::DOUBLE AS n
  FROM repeaters, span GROUP BY ALL)"""

_SPENT_SQL = """
spent AS MATERIALIZED (
  SELECT frequency_cal::DOUBLE AS x, monetary_value_cal / avg(monetary_value_cal) OVER () AS m,
         avg(monetary_value_cal) OVER () AS unit
  FROM repeaters)"""


def _one_problem(penalty: float) -> str:
    return f"SELECT 0 AS id, {penalty}::DOUBLE AS l2"


PURCHASE_FIT_SQL = f"""{_CELLS_SQL}, {purchase_fits_sql(_one_problem(PURCHASE_PENALTY))},
purchase_fit AS MATERIALIZED (SELECT * FROM purchase_fits)"""

SPEND_FIT_SQL = f"""{_SPENT_SQL}, {spend_fits_sql(_one_problem(SPEND_PENALTY))},
spend_fit AS MATERIALIZED (SELECT * FROM spend_fits)"""


def _as_table(spark, model, names: list[str], with_errors: list[str]):
    """One row: parameters, standard errors, what the data leave flat, and how the fit ended."""
    own = model.certainty
    row = {n: getattr(model, n) for n in names} | {f"{n}_error": own.errors[n] for n in with_errors}
    row |= {"penalty": model.penalty, "objective": model.objective}
    kinds = ", ".join(f"{n} double" for n in row) + ", flat string, converged boolean"
    values = (*(float(v) for v in row.values()), ",".join(own.flat), model.converged)
    frame = spark.createDataFrame([values], kinds)
    return frame.withColumns({n: significant(F.col(n)) for n in row if n != "penalty"})


@query(
    "bgnbd_fit",
    f"""WITH RECURSIVE {CALIBRATION_SQL}, {PURCHASE_FIT_SQL}
SELECT {significant_sql("r")} AS r, {significant_sql("alpha")} AS alpha, {PURCHASE_PENALTY}::DOUBLE AS penalty,
       {significant_sql("objective")} AS objective,
       CASE WHEN h22 < 1e-7 AND h33 < 1e-7 THEN 'a,b' ELSE '' END AS flat, true AS converged
FROM purchase_fit""",
)
def bgnbd_fit(spark, folder):
    # Orders have no drop-out, so a and b run to where the likelihood is flat: they
    # are named in `flat`; `dropout_fit` has data that tell all four.
    holdout = materialise(repeat_holdout(spark, folder))
    cells = customer_cells(holdout, "frequency_cal", "recency_cal", "T_cal")
    return _as_table(spark, fit_bgnbd(cells, [PURCHASE_PENALTY])[0], ["r", "alpha"], [])


FOLLOWER_RFM_SQL = _repeat_sql(
    f"""{bindings.FOLLOWERS_SQL},
daily AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(price) AS spend FROM followers GROUP BY ALL)"""
)


@query(
    "dropout_fit",
    f"""WITH RECURSIVE {FOLLOWER_RFM_SQL},
span AS (SELECT 10.0::DOUBLE / max("T") AS scale FROM rfm),
cells AS MATERIALIZED (
  SELECT frequency::DOUBLE AS x, recency * scale AS t_x, "T" * scale AS t_end, count(*)::DOUBLE AS n
  FROM rfm, span GROUP BY ALL),
{purchase_fits_sql(_one_problem(PURCHASE_PENALTY))}
SELECT {", ".join(f"{significant_sql(n)} AS {n}" for n in ("r", "alpha", "a", "b"))},
       {", ".join(f"{significant_sql(n + '_error')} AS {n}_error" for n in ("r", "alpha", "a", "b"))},
       {PURCHASE_PENALTY}::DOUBLE AS penalty, {significant_sql("objective")} AS objective, '' AS flat, true AS converged
FROM (SELECT *, {_errors_sql(4, ["r", "alpha", "a", "b"], "(SELECT sum(n) FROM cells)")} FROM purchase_fits)""",
)
def dropout_fit(spark, folder):
    log = bindings.followers(spark, folder)
    customers = materialise(rfm.rfm_repeat(log, rfm.last_day(log)))
    names = ["r", "alpha", "a", "b"]
    return _as_table(spark, fit_bgnbd(customer_cells(customers), [PURCHASE_PENALTY])[0], names, names)


@query(
    "gammagamma_fit",
    f"""WITH RECURSIVE {CALIBRATION_SQL}, {SPEND_FIT_SQL}
SELECT {", ".join(f"{significant_sql(n)} AS {n}" for n in ("p", "q", "v"))},
       {", ".join(f"{significant_sql(n + '_error')} AS {n}_error" for n in ("p", "q", "v"))},
       {SPEND_PENALTY}::DOUBLE AS penalty, {significant_sql("objective")} AS objective, '' AS flat, true AS converged
FROM (SELECT *, {_errors_sql(3, ["p", "q", "v"], "(SELECT count(*) FROM spent)")} FROM spend_fit)""",
)
def gammagamma_fit(spark, folder):
    holdout = materialise(repeat_holdout(spark, folder))
    spend = repeat_spend(holdout, "frequency_cal", "monetary_value_cal")
    names = ["p", "q", "v"]
    return _as_table(spark, fit_gammagamma(spend, [SPEND_PENALTY])[0], names, names)


ERRORS = ("mse", "rmse", "mae")


def _fitted_scores_sql(label: str, source: str) -> str:
    errors = {"mse": "avg(error * error)", "rmse": "sqrt(avg(error * error))", "mae": "avg(abs(error))"}
    return f"""SELECT '{label}' AS model, count(*) AS customers,
       {", ".join(f"{significant_sql(e)} AS {n}" for n, e in errors.items())}, true AS usable FROM {source}"""


@query(
    "holdout_scores",
    f"""WITH RECURSIVE {CALIBRATION_SQL}, {PURCHASE_FIT_SQL}, {SPEND_FIT_SQL}, {_holdout_sql(FITTED_PURCHASES)},
holdout_spend AS ({_spend_error_sql("holdout", FITTED_SPEND)}),
forecast_spend AS ({_spend_error_sql("cal", FITTED_SPEND)})
{_fitted_scores_sql("bgnbd", "purchase_errors")}
UNION ALL {_fitted_scores_sql("gammagamma_holdout", "holdout_spend")}
UNION ALL {_fitted_scores_sql("gammagamma_forecast", "forecast_spend")}""",
)
def holdout_scores(spark, folder):
    holdout = materialise(repeat_holdout(spark, folder))
    purchases, spend = fit_both(holdout, [PURCHASE_PENALTY], [SPEND_PENALTY], "_cal")
    scores = score_both(holdout, purchases, spend).drop("l2")
    return scores.withColumns({name: significant(F.col(name)) for name in ERRORS})


def _grid_sql() -> str:
    """All penalties of the grid in one recursion, then their scores and ranks."""
    problems = "SELECT id, l2 FROM grid"
    grid = ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(PENALTY_GRID))
    z = f"({HOLDOUT_DAYS}::DOUBLE / (alpha + e + {HOLDOUT_DAYS}))"

    def spend(part: str) -> str:
        weight = f"(p * frequency_{part} / (p * frequency_{part} + q - 1))"
        return f"""SELECT id, l2, q > 1 AS usable,
         monetary_value_holdout - ((1 - {weight}) * (v * p / (q - 1)) + {weight} * monetary_value_{part}) AS error
  FROM spend_fits, repeaters"""

    return f"""WITH RECURSIVE {CALIBRATION_SQL}, {_CELLS_SQL}, {_SPENT_SQL},
grid AS (SELECT * FROM (VALUES {grid}) g(id, l2)),
{purchase_fits_sql(problems)}, {spend_fits_sql(problems)},
kinds AS MATERIALIZED (
  SELECT frequency_cal::DOUBLE AS x, recency_cal::DOUBLE AS t, "T_cal"::DOUBLE AS e,
         frequency_holdout::DOUBLE AS actual, count(*)::DOUBLE AS n FROM repeaters GROUP BY ALL),
-- Each term of the series from the one before, once for every (r, b, count) pair with its z.
series AS (
  SELECT id, l2, x, t, e, actual, n, r, alpha, a, b,
         list_reduce(list_prepend({{'s': 1.0::DOUBLE, 'u': 1.0::DOUBLE}},
           list_transform(range(0, 400), lambda k: {{'s': k::DOUBLE, 'u': 0.0::DOUBLE}})),
           lambda c, k: {{'s': c.s + c.u * (r + x + k.s) * (b + x + k.s) / ((a + b + x - 1 + k.s) * (k.s + 1)) * {z},
                         'u': c.u * (r + x + k.s) * (b + x + k.s) / ((a + b + x - 1 + k.s) * (k.s + 1)) * {z}}}).s AS series
  FROM purchase_fits, kinds),
purchase_scores AS (
  SELECT id, l2, true AS usable, n, actual
         - (a + b + x - 1) / (a - 1) * (1 - series * pow((alpha + e) / (alpha + e + {HOLDOUT_DAYS}), r + x))
           / (1 + a / (b + greatest(x, 1) - 1) * pow((alpha + e) / (alpha + t), r + x)) AS error
  FROM series),
errors AS (
  SELECT 'bgnbd' AS model, l2, usable, n, error FROM purchase_scores
  UNION ALL SELECT 'gammagamma_holdout', l2, usable, 1.0, error FROM ({spend("holdout")})
  UNION ALL SELECT 'gammagamma_forecast', l2, usable, 1.0, error FROM ({spend("cal")})),
scores AS (
  SELECT model, l2, sum(n)::BIGINT AS customers, sum(n * error * error) / sum(n) AS mse,
         sqrt(sum(n * error * error) / sum(n)) AS rmse, sum(n * abs(error)) / sum(n) AS mae, usable
  FROM errors GROUP BY ALL)
SELECT model, l2, customers, {", ".join(f"{significant_sql(n)} AS {n}" for n in ERRORS)}, usable,
       row_number() OVER (PARTITION BY model ORDER BY usable DESC, mse, l2) = 1 AND usable AS best,
       l2 IN ((SELECT min(l2) FROM grid), (SELECT max(l2) FROM grid)) AS at_edge
FROM scores"""


@query("penalty_grid", _grid_sql())
def penalty_grid_query(spark, folder):
    scores = penalty_grid(calibration_holdout(spark, folder), PENALTY_GRID)
    return scores.withColumns({name: significant(F.col(name)) for name in ERRORS})


@query(
    "ltv_fitted",
    f"""WITH RECURSIVE {CALIBRATION_SQL}, {PURCHASE_FIT_SQL}, {SPEND_FIT_SQL},
later AS (WITH {ORDER_RFM_SQL} SELECT * FROM rfm),
rfm AS (SELECT * FROM later), {_ltv_sql(FITTED_PURCHASES, FITTED_SPEND)}
SELECT user_id, frequency, recency, "T", monetary_value,
       {", ".join(f"{significant_sql(n)} AS {n}" for n in ("ltv", "predicted_purchases", "predicted_monetary_value"))}
FROM customers""",
)
def ltv_fitted(spark, folder):
    holdout = materialise(repeat_holdout(spark, folder))
    purchases, spend = fit_both(holdout, [PURCHASE_PENALTY], [SPEND_PENALTY], "_cal")
    valued = with_lifetime_value(repeat_customers(spark, folder), purchases[0], spend[0])
    names = ("ltv", "predicted_purchases", "predicted_monetary_value")
    return valued.withColumns({name: significant(F.col(name)) for name in names})


# ----------------------------------------------------------------- segments

SEGMENT_SQL = f"""{LTV_SQL},
edges AS (
  SELECT quantile_cont(ltv, 0.4) AS q40, quantile_cont(ltv, 0.6) AS q60,
         quantile_cont(ltv, 0.8) AS q80 FROM customers),
segmented AS (
  SELECT c.*, CASE WHEN ltv <= q40 THEN 'silver' WHEN ltv <= q60 THEN 'gold'
                   WHEN ltv <= q80 THEN 'platinum' ELSE 'diamond' END AS segment
  FROM customers c, edges)"""

FINAL_SQL = f"""{SEGMENT_SQL}, {DAYPARTS_SQL},
final AS (SELECT s.*, morning, day, night, morning_ratio, day_ratio, night_ratio
          FROM segmented s JOIN shares p ON s.user_id = p.user_id)"""


def segmented_customers(spark, folder):
    return segments.with_segment(materialise(valued_customers(spark, folder)))


def profiled_customers(spark, folder):
    """Segments first, over all customers; then the day parts of active ones."""
    parts = dayparts.user_dayparts(bindings.events(spark, folder))
    return segments.with_dayparts(
        segmented_customers(spark, folder), dayparts.daypart_shares(parts)
    )


@query(
    "ltv_quantiles",
    f"""WITH {LTV_SQL}
SELECT 'ltv' AS metric, p AS probability, round(CASE p WHEN 0.4 THEN a WHEN 0.6 THEN b ELSE c END, 2) AS value
FROM (SELECT quantile_cont(ltv, 0.4) AS a, quantile_cont(ltv, 0.6) AS b, quantile_cont(ltv, 0.8) AS c
      FROM customers), (VALUES (CAST(0.4 AS DOUBLE)), (CAST(0.6 AS DOUBLE)), (CAST(0.8 AS DOUBLE))) ps(p)""",
)
def ltv_quantiles(spark, folder):
    customers = materialise(valued_customers(spark, folder).select("ltv"))
    found = quantiles.exact_quantiles(customers, ["ltv"], list(segments.SEGMENT_QUANTILES))
    return found.withColumn("value", F.round("value", 2))


@query(
    "ltv_segments",
    f"WITH {SEGMENT_SQL} SELECT user_id, round(ltv, 2) AS ltv, segment FROM segmented",
)
def ltv_segments(spark, folder):
    return segmented_customers(spark, folder).select(
        "user_id", F.round("ltv", 2).alias("ltv"), "segment"
    )


@query(
    "segment_profile",
    f"""WITH {FINAL_SQL}
SELECT segment, round(avg(monetary_value), 2) AS monetary_value, round(avg(ltv), 2) AS ltv,
       CAST(sum(morning) AS BIGINT) AS morning, CAST(sum(day) AS BIGINT) AS day,
       CAST(sum(night) AS BIGINT) AS night
FROM final GROUP BY segment""",
)
def segment_profile(spark, folder):
    profile = segments.segment_profile(profiled_customers(spark, folder))
    return profile.withColumns(
        {name: F.round(name, 2) for name in ("monetary_value", "ltv")}
    )


@query(
    "rfml_top20",
    f"""WITH {LTV_SQL},
long AS (
  SELECT 'recency' AS metric, quantile_cont(CAST(recency AS DOUBLE), 0.8) AS v FROM customers
  UNION ALL SELECT 'frequency', quantile_cont(CAST(frequency AS DOUBLE), 0.8) FROM customers
  UNION ALL SELECT 'monetary_value', quantile_cont(monetary_value, 0.8) FROM customers
  UNION ALL SELECT 'ltv', quantile_cont(ltv, 0.8) FROM customers)
SELECT metric, CAST(0.8 AS DOUBLE) AS probability, round(v, 2) AS value,
       CAST(trunc(v) AS BIGINT) AS value_int FROM long""",
)
def rfml_top20(spark, folder):
    customers = materialise(valued_customers(spark, folder).select(*METRICS))
    top = segments.top_share_thresholds(customers, METRICS)
    return top.withColumn("value", F.round("value", 2))


def histogram_sql(source: str, columns: list[str], bins: int) -> str:
    pieces = " UNION ALL ".join(
        f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns
    )
    return f"""
long AS ({pieces}),
bounds AS (
  SELECT metric, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS low,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS high
  FROM long GROUP BY metric),
grid AS (
  SELECT metric, CAST(b AS INTEGER) AS bin,
         low + b * ((high - low) / {float(bins)}) AS lower,
         CASE WHEN b = {bins} - 1 THEN high ELSE low + (b + 1) * ((high - low) / {float(bins)}) END AS upper
  FROM bounds, range(0, {bins}) bs(b)),
binned AS (
  SELECT g.metric, g.bin, any_value(g.lower) AS lower, any_value(g.upper) AS upper, count(l.value) AS cnt
  FROM grid g LEFT JOIN long l ON l.metric = g.metric AND l.value >= g.lower
   AND (l.value < g.upper OR (g.bin = {bins} - 1 AND l.value = g.upper))
  GROUP BY g.metric, g.bin)"""


@query(
    "rfml_histograms",
    f"""WITH {LTV_SQL}, {histogram_sql("customers", METRICS, 20)}
SELECT metric, bin, round(lower, 2) AS lower, round(upper, 2) AS upper, cnt FROM binned""",
)
def rfml_histograms(spark, folder):
    # Two passes read the customers: bounds, then bins.
    bars = histograms.histograms(materialise(valued_customers(spark, folder)), METRICS, 20)
    return bars.withColumns({name: F.round(name, 2) for name in ("lower", "upper")})


BAND_SQL = f"""{FINAL_SQL},
bands AS (
  SELECT quantile_cont(CAST(recency AS DOUBLE), 0.99) AS r1, min(recency) AS r0,
         quantile_cont(CAST(frequency AS DOUBLE), 0.99) AS f1, min(frequency) AS f0,
         quantile_cont(monetary_value, 0.99) AS m1, min(monetary_value) AS m0,
         quantile_cont(ltv, 0.99) AS l1, min(ltv) AS l0 FROM final),
kept AS (
  SELECT f.*, CASE WHEN morning_ratio + day_ratio >= 50 THEN 'morning/day' ELSE 'other' END AS time
  FROM final f, bands
  WHERE recency BETWEEN r0 AND r1 AND frequency BETWEEN f0 AND f1
    AND monetary_value BETWEEN m0 AND m1 AND ltv BETWEEN l0 AND l1),
counts AS (SELECT segment, time, count(*) AS segment_cnt FROM kept GROUP BY segment, time)"""


def banded_customers(spark, folder):
    customers = materialise(profiled_customers(spark, folder))
    return segments.in_bands(customers, dict.fromkeys(METRICS, WIDEST_BAND))


@query(
    "percentile_band_filter",
    f"""WITH {BAND_SQL}
SELECT user_id, recency, frequency, monetary_value, round(ltv, 2) AS ltv, segment,
       morning_ratio, day_ratio, night_ratio FROM kept""",
)
def percentile_band_filter(spark, folder):
    return banded_customers(spark, folder).select(
        "user_id",
        "recency",
        "frequency",
        "monetary_value",
        F.round("ltv", 2).alias("ltv"),
        "segment",
        "morning_ratio",
        "day_ratio",
        "night_ratio",
    )


@query("segment_time_counts", f"WITH {BAND_SQL} SELECT * FROM counts")
def segment_time_counts(spark, folder):
    return segments.segment_time_counts(banded_customers(spark, folder))


@query(
    "promotion_cost",
    f"""WITH {BAND_SQL}
SELECT CAST(coalesce(sum(segment_cnt), 0) * 1000 AS BIGINT) AS total_cost,
       CAST(coalesce(sum(segment_cnt) FILTER (time = 'morning/day'), 0) * 1000 AS BIGINT) AS morning_day_cost
FROM counts""",
)
def promotion_cost(spark, folder):
    return segments.promotion_cost(segment_time_counts(spark, folder))
