import os

from conftest import plan_text
from footfall import plans
from footfall.plans import bindings
from footfall.plans.views import register_views

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
# Queries that only run jobs of their own and return their small result.
SEARCHES = {"bgnbd_fit", "gammagamma_fit", "holdout_scores", "penalty_grid", "ltv_fitted"}


def test_readme_lists_every_query():
    with open(os.path.join(ROOT, "README.md"), encoding="utf-8") as file:
        text = file.read()
    assert [name for name in plans.QUERIES if f"`{name}`" not in text] == []


def test_views_answer_sql(spark, data_root):
    folder = f"{data_root}/sf0.001"
    names = register_views(
        bindings.comments(spark, folder), bindings.episodes(spark, folder), key="chapter"
    )
    assert all(spark.table(name).columns for name in names)
    by_sql = spark.sql("SELECT date, dau, wau_trailing, stickiness FROM stickiness ORDER BY date")
    by_api = plans.QUERIES["dau_wau_stickiness"](spark, folder)
    assert by_sql.collect() == by_api.collect()
    best = spark.sql(
        "SELECT user_id, monetary FROM rfm_simple ORDER BY monetary DESC, user_id LIMIT 1"
    ).first()
    rows = plans.QUERIES["rfm_simple"](spark, folder).collect()
    assert best["monetary"] == max(r["monetary"] for r in rows)


def test_no_query_pairs_rows_without_a_key(spark, data_root):
    for name, query in plans.QUERIES.items():
        if name not in SEARCHES:
            text = plan_text(query(spark, f"{data_root}/sf0.001"))
            assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_scans_read_only_what_they_need(spark, data_root):
    folder = f"{data_root}/sf0.001"
    wanted = {
        "dau": "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>",
        "hourly_activity": "ReadSchema: struct<ts:timestamp_ntz>",
        "episode_value": "ReadSchema: struct<l_partkey:bigint,l_shipdate:timestamp_ntz>",
    }
    for name, schema in wanted.items():
        assert schema in plan_text(plans.QUERIES[name](spark, folder)), name
