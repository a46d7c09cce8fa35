"""First and last, peak and lowest, best and most frequent.

All are ``min_by``/``max_by`` aggregates with an explicit tie-break, so the
answer does not depend on row order and no post is sorted globally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sql_name
from ..sources.tables import keep_clean
from .metrics import By, by_columns, category_counts, daily_engagement, platform_engagement


def direction(first: str, last: str, flat: str) -> str:
    """SQL for rising, falling or ``flat``."""
    return f"case when {last} > {first} then 'rising' when {last} < {first} then 'falling' else '{flat}' end"


def post_trend(df: DataFrame, by: By = (), order_col: str | None = None) -> DataFrame:
    """Engagements of the first and the last post by date.

    Posts on the same date are told apart by ``order_col``; without it the one with
    the fewest engagements is taken at both ends.  That needs one row per campaign and
    date only, so no post is sorted; ``order_col`` compares whole posts, but only those of
    a campaign's first and last date.  With ``by`` these dates are found at the call and
    kept below ``shared_dir``.
    """
    keys = by_columns(df, by, _POST_TREND)
    if order_col is None:
        moments = df.groupBy(*keys, F.col("date").alias("_date")).agg(
            F.count("*").alias("_n"), F.min("engagements").alias("_lowest")
        )
        return trend_of_moments(moments, by)
    return _ordered_trend(df, by, keys, sql_name(order_col))


# Campaigns whose first and last date one task may hold at once.
EDGE_CAMPAIGNS = 200_000


def _ordered_trend(df: DataFrame, by: By, keys: list[Column], tie: str) -> DataFrame:
    """The first and last date of each campaign, then the posts of those dates only.

    The dates of up to ``EDGE_CAMPAIGNS`` campaigns are counted and sent to every task, so
    that few posts are compared whole.  Beyond that all are, sorted within each task.
    """
    first, last = f"min_by(engagements, struct(date, {tie}, engagements))", f"max_by(engagements, struct(date, {tie}, -engagements))"
    edges = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("date").alias("_from"), F.max("date").alias("_to"))
    if by:
        edges = keep_clean(edges, "edges")
        if edges.count() > EDGE_CAMPAIGNS:
            posts = df.groupBy(*keys).agg(F.expr("count(*) as n_posts"), F.expr(f"{first} as first_engagements"), F.expr(f"{last} as last_engagements"))
            return _with_trend(posts)
        same = reduce(lambda a, b: a & b, [F.col(f"p.{sql_name(c)}").eqNullSafe(F.col(f"e.{sql_name(c)}")) for c in by])
        near = same & (F.col("date") == F.col("_from")) | same & (F.col("date") == F.col("_to"))
        few = df.alias("p").join(F.broadcast(edges.alias("e")), same & near).select("p.*", "_n")
        whole = few.groupBy(*keys).agg(F.max("_n").alias("n_posts"), F.expr(f"{first} as first_engagements"), F.expr(f"{last} as last_engagements"))
        return _with_trend(whole)
    few = df.where((F.col("date") == edges.select("_from").scalar()) | (F.col("date") == edges.select("_to").scalar()))
    whole = few.agg(F.expr(f"{first} as first_engagements"), F.expr(f"{last} as last_engagements"))
    return _with_trend(whole.select(edges.select("_n").scalar().alias("n_posts"), "first_engagements", "last_engagements"))


def _with_trend(table: DataFrame) -> DataFrame:
    return table.withColumn("trend", F.expr(direction("first_engagements", "last_engagements", "none")))


_POST_TREND = ("n_posts", "first_engagements", "last_engagements", "trend")


def trend_of_moments(moments: DataFrame, by: By) -> DataFrame:
    """Post trend from ``(by, _date, _n, _lowest)``, one row per campaign and date."""
    out = moments.groupBy(*[sql_name(c) for c in by]).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_posts"),
        F.expr("min_by(_lowest, _date) as first_engagements"),
        F.expr("max_by(_lowest, _date) as last_engagements"),
    )
    return _with_trend(out)


def daily_trend(df: DataFrame, by: By = ()) -> DataFrame:
    """Engagement totals of the first and the last day, and how they compare.

    ``trend`` has four values; ``is_rising`` is null with fewer than two days.
    """
    keys = by_columns(df, by, ["n_days", "first_engagements", "last_engagements", "trend", "is_rising"])
    out = daily_engagement(df, by).groupBy(*keys).agg(
        F.expr("count(*) as n_days"),
        F.expr("min_by(engagements, day) as first_engagements"),
        F.expr("max_by(engagements, day) as last_engagements"),
    )
    trend = direction("first_engagements", "last_engagements", "stable")
    return out.withColumns(
        {
            "trend": F.expr(f"if(n_days >= 2, {trend}, 'not_enough_data')"),
            "is_rising": F.expr("if(n_days >= 2, last_engagements > first_engagements, null)"),
        }
    )


def _best_row(table: DataFrame, fields: list[str], key: str, by: By) -> DataFrame:
    """The row of an aggregated table with the smallest ``key``, per campaign."""
    keys = by_columns(table, by)
    best = table.groupBy(*keys).agg(
        F.expr(f"min_by(struct({', '.join(fields)}), struct({key})) as _best")
    )
    return best.filter("_best is not null").select(*keys, "_best.*")


def peak_day(df: DataFrame, by: By = ()) -> DataFrame:
    """The day with the largest engagement total, the earliest of equals."""
    return _best_row(daily_engagement(df, by), ["day", "engagements"], "-engagements, day", by)


def lowest_day(df: DataFrame, by: By = ()) -> DataFrame:
    """The day with the smallest engagement total, the earliest of equals."""
    return _best_row(daily_engagement(df, by), ["day", "engagements"], "engagements, day", by)


def top_platform(df: DataFrame, by: By = ()) -> DataFrame:
    """The platform with the largest engagement total."""
    sums = platform_engagement(df, by)
    return _best_row(sums, ["platform", "engagements"], "-engagements, platform", by)


def dominant(df: DataFrame, category: str, by: By = ()) -> DataFrame:
    """The most frequent label of ``category``."""
    c = sql_name(category)
    return _best_row(category_counts(df, category, by), [c, "n"], f"-n, {c}", by)
