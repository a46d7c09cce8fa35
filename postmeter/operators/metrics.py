"""Counts, sums and shares.

``by`` names the columns that tell campaigns apart; ``()`` is one campaign.
Each metric is one ``groupBy`` whose partial aggregate runs before the
shuffle, so a campaign or label that holds most rows sends at most one row per
task and needs no salting.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day_text, quoted, sql_name
from ..sources.tables import keep_clean

By = Sequence[str]

# Chart name -> the value its labels are ranked by.
CHARTS = {
    "sentiment": "n",
    "platform": "engagements",
    "media_type": "n",
    "location": "n",
    "day": "engagements",
}


def by_columns(df: DataFrame, by: By, results: Collection[str] = ()) -> list[Column]:
    """The columns ``by``; they must exist and differ from the names in ``results``."""
    if isinstance(by, str):
        raise TypeError("by takes a list of column names")
    clash = sorted({c.lower() for c in by} & {r.lower() for r in results})
    if clash:
        raise ValueError(f"by columns need another name: {', '.join(clash)}")
    missing = [c for c in by if c not in df.columns]
    if missing:
        raise ValueError(f"by columns not found: {', '.join(missing)}")
    return [quoted(c) for c in by]


def total_posts(df: DataFrame, by: By = ()) -> DataFrame:
    """Number of posts."""
    return df.groupBy(*by_columns(df, by, ["n"])).agg(F.count("*").alias("n"))


def category_counts(
    df: DataFrame, category: str, by: By = (), ordered: bool = False
) -> DataFrame:
    """Posts per label of ``category``; ``ordered`` sorts by count, then label."""
    keys = by_columns(df, by, [category, "n"])
    counts = df.groupBy(*keys, F.col(category)).agg(F.count("*").alias("n"))
    return counts.orderBy(*keys, F.desc("n"), category) if ordered else counts


def platform_engagement(df: DataFrame, by: By = (), ordered: bool = False) -> DataFrame:
    """Engagement total per platform; ``ordered`` puts the largest first."""
    keys = by_columns(df, by, ["platform", "engagements"])
    sums = df.groupBy(*keys, F.col("platform")).agg(F.sum("engagements").alias("engagements"))
    return sums.orderBy(*keys, F.desc("engagements"), "platform") if ordered else sums


def daily_engagement(df: DataFrame, by: By = (), ordered: bool = False) -> DataFrame:
    """Engagement total per calendar day that has posts; ``ordered`` sorts by day."""
    keys = by_columns(df, by, ["day", "engagements"])
    sums = df.groupBy(*keys, F.to_date("date").alias("day")).agg(
        F.sum("engagements").alias("engagements")
    )
    return sums.orderBy(*keys, "day") if ordered else sums


def category_share(df: DataFrame, category: str, by: By = ()) -> DataFrame:
    """Posts per label and their share of the campaign's posts."""
    keys = by_columns(df, by, [category, "n", "share"])
    counts = category_counts(df, category, by)
    if not by:
        total = counts.agg(F.sum("n")).scalar()
        return counts.withColumn("share", F.col("n") / total)
    # Both sides are aggregated already; the adaptive skew join splits a campaign
    # that holds most labels, which a window over the campaign could not.
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    same = reduce(
        lambda a, b: a & b, [F.col(f"c.`{k}`").eqNullSafe(F.col(f"t.`{k}`")) for k in by]
    )
    return counts.alias("c").join(totals.alias("t"), same).select(
        *[F.col(f"c.`{k}`") for k in by],
        F.col(f"c.{category}"),
        F.col("c.n"),
        (F.col("c.n") / F.col("t._total")).alias("share"),
    )


# Column names of the cube and of the tables made from it.
_CUBE_COLUMNS = ("chart", "label", "n", "engagements", "value", "lowest")
# Charts of the cube that are no charts of the page: all posts, and their exact dates.
TOTAL, MOMENT = "total", "moment"


def _chart_rows(df: DataFrame, chart: str, by: By) -> DataFrame:
    key = {"day": "to_date(date)", TOTAL: "cast(null as string)", MOMENT: "date"}.get(chart, sql_name(chart))
    sums = df.groupBy(*by_columns(df, by), F.expr(f"{key} as _label")).agg(
        F.expr("count(*) as n"), F.expr("sum(engagements) as engagements"), F.expr("min(engagements) as lowest")
    )
    # The day text is made from the few days, not for every post.
    label = {"day": day_text("_label"), MOMENT: "cast(_label as string)"}.get(chart, "_label")
    own = [sql_name(c) for c in by]
    return sums.selectExpr(
        *own, f"'{chart}' as chart", f"{label} as label", "n", "engagements", "lowest"
    )


def label_table(
    df: DataFrame, by: By = (), charts: Sequence[str] = (*CHARTS, TOTAL), one_scan: bool = True
) -> DataFrame:
    """The cube with the lowest engagements per label, which trends by post need.

    Everything that reads several charts takes this table as ``labels``, so that one
    kept table serves insights, report, summary and prompts.
    """
    keys = by_columns(df, by, _CUBE_COLUMNS)
    if not one_scan:
        return reduce(DataFrame.unionByName, [_chart_rows(df, c, by) for c in charts])
    # One row per post and chart, grouped at once.  Spark can share the shuffle of two
    # readers of this table, which it cannot with grouping sets.
    rows = ", ".join(_labelled(chart) for chart in charts)
    long = df.select(*keys, "engagements", F.expr(f"stack({len(charts)}, {rows}) as (chart, _label, _at)"))
    sums = long.groupBy(*keys, "chart", "_label", "_at").agg(
        F.count("*").alias("n"), F.sum("engagements").alias("engagements"), F.min("engagements").alias("lowest")
    )
    # The texts of days are made from the few days, not for every post.
    label = f"case chart when 'day' then {day_text('_at')} when '{MOMENT}' then cast(_at as string) else _label end"
    return sums.select(*keys, "chart", F.expr(f"{label} as label"), "n", "engagements", "lowest")


def _labelled(chart: str) -> str:
    """SQL of chart, label and time of a post."""
    none, never = "cast(null as string)", "cast(null as timestamp_ntz)"
    label, at = {
        "day": (none, "cast(to_date(date) as timestamp_ntz)"),
        MOMENT: (none, "cast(date as timestamp_ntz)"),
        TOTAL: (none, never),
    }.get(chart, (sql_name(chart), never))
    return f"'{chart}', {label}, {at}"


def keep_labels(df: DataFrame, by: By = (), path: str | None = None) -> DataFrame:
    """Write the label table of all charts, with one scan of the posts, and read it back.

    Insights, report, summary, prompts and findings take it as ``labels`` and read the
    posts no more.  The default place is below ``shared_dir``.
    """
    return keep_clean(label_table(df, by, (*CHARTS, TOTAL, MOMENT)), "labels", path=path)


def merge_labels(tables: Iterable[DataFrame], by: By = ()) -> DataFrame:
    """One label table from those of separate batches of posts.

    Counts and sums add up and the lowest is the least, so nothing is lost but the
    posts themselves: insights, summaries, trends by date and reports of the merged
    table are those of all posts.  Sums of fractions may differ in the last digits.
    """
    whole = reduce(DataFrame.unionByName, tables)
    keys = by_columns(whole, by, _CUBE_COLUMNS)
    return whole.groupBy(*keys, "chart", "label").agg(
        F.sum("n").alias("n"), F.sum("engagements").alias("engagements"), F.min("lowest").alias("lowest")
    )


def add_to_labels(labels: DataFrame, posts: DataFrame, by: By = (), path: str | None = None) -> DataFrame:
    """A kept label table with a batch of new ``posts`` added; old posts are not read again.

    ``labels`` comes from ``keep_labels`` or this function and stays as it is;
    ``drop_table`` removes it.
    """
    batch = label_table(posts, by, (*CHARTS, TOTAL, MOMENT))
    return keep_clean(merge_labels([labels, batch], by), "labels", path=path)


def campaign_cube(
    df: DataFrame, by: By = (), charts: Sequence[str] = (*CHARTS, TOTAL), one_scan: bool = True
) -> DataFrame:
    """Posts and engagements per label of every chart, and in total, in one table.

    Rows are ``(by, chart, label, n, engagements)``; the label of a day is its ISO
    text, that of the total is null.  The default reads the input once (a row per
    post and chart before the partial sums); ``one_scan=False`` aggregates each chart by a scan of its own.
    """
    return label_table(df, by, charts, one_scan).drop("lowest")
