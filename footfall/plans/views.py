"""The main reports as SQL views, for callers who work in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from footfall.operators import activity, content, dayparts, pricing, rfm


def register_views(comments: DataFrame, episodes: DataFrame, key: str = "episode") -> list[str]:
    """Create temporary views over cleaned comments and typed episodes.

    `comments` has user_id, comment_date, comment_like and the key;
    `episodes` has chapter, episode, upload_at and one row per key. Views are
    lazy: each query reads only what it selects.
    """
    ts = "comment_date"
    lean = episodes.select(key, "upload_at")
    views = {
        "comments": comments,
        "episodes": episodes,
        "daily_active": activity.daily_active(comments, ts=ts),
        "weekly_active": activity.weekly_active(comments, ts=ts),
        "monthly_active": activity.monthly_active(comments, ts=ts),
        "stickiness": activity.trailing_stickiness(comments, ts=ts),
        "user_dayparts": dayparts.daypart_shares(dayparts.user_dayparts(comments, ts=ts)),
        "priced_comments": pricing.priced_comments(comments, lean, key),
        "rfm_simple": rfm.rfm_simple(comments, lean, key),
        "episode_value": content.episode_value(comments, episodes, key),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return list(views)
