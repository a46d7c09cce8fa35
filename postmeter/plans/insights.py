"""Chart insights: up to three findings for each of the five charts.

Rows are ``(by, chart, position, code, label, value, share, text)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import percent_text, sql_name, sql_text, whole_text
from ..operators.metrics import CHARTS, By, by_columns, campaign_cube
from ..operators.trends import direction

# Code and text around the label of the first, second and third label of a chart.
RANK_TEXTS = {
    "sentiment": (
        ("dominant", "Most posts are ", ", which makes up "),
        ("second", "Next most common sentiment: ", "."),
        ("third", "In third place among sentiments: ", "."),
    ),
    "platform": (
        ("best", "Most engagement came from ", "."),
        ("second", "The runner-up platform by engagement is ", "."),
        ("third", "Further behind among platforms is ", "."),
    ),
    "media_type": (
        ("most_used", "The media type posted most often is ", "."),
        ("second", "The second largest share of media belongs to ", "."),
        ("third", "A smaller part of the media mix is ", "."),
    ),
    "location": (
        ("most_active", "The busiest location is ", "."),
        ("second", "The second busiest location is ", "."),
        ("third", "The top three locations are completed by ", "."),
    ),
}
WITH_SHARE = ("sentiment", "media_type")


# What the labels of a chart are ranked by: posts or engagements.
_BY_SUM = ", ".join(sql_text(c) for c, value in CHARTS.items() if value == "engagements")
CHART_VALUE = f"if(chart in ({_BY_SUM}), engagements, cast(n as double))"


def _insight(position: int, code: str, label: str, value: str, share: str, text: str) -> str:
    return (
        f"named_struct('position', {position}, 'code', {code}, 'label', {label},"
        f" 'value', cast({value} as double), 'share', cast({share} as double), 'text', {text})"
    )


def _rank_insights(chart: str) -> str:
    rows = []
    for i, (code, before, after) in enumerate(RANK_TEXTS[chart], start=1):
        label, value = f"_top{i}.label", f"_top{i}.value"
        parts = [sql_text(before), label, sql_text(after)]
        if code == "dominant":
            parts += [percent_text("_top1.n", "_posts"), "' of the total.'"]
        share = f"{value} / _posts" if chart in WITH_SHARE else "null"
        row = _insight(i, sql_text(code), label, value, share, f"concat({', '.join(parts)})")
        rows.append(f"if(_top{i} is not null, {row}, null)")
    return f"array({', '.join(rows)})"


def _day_insights() -> str:
    # The best of the days by value is the peak; equal days are ranked by date.
    trend = direction("_first", "_last", "stable")
    trend_text = (
        f"case {trend} when 'rising' then 'Engagement rises from the first day to the last.'"
        " when 'falling' then 'Engagement falls from the first day to the last.'"
        " else 'Engagement ends at the level of the first day.' end"
    )
    rows = [_insight(1, "'trend'", trend, "_last - _first", "null", trend_text)] + [
        _insight(
            position,
            sql_text(code),
            f"{day}.label",
            f"{day}.value",
            "null",
            f"concat({sql_text(words)}, {day}.label, ' with ', {whole_text(day + '.value')}, '.')",
        )
        for position, code, words, day in (
            (2, "peak_day", "Engagement was highest on ", "_top1"),
            (3, "lowest_day", "Engagement was lowest on ", "_lowest"),
        )
    ]
    too_few = _insight(
        1,
        "'not_enough_data'",
        "cast(null as string)",
        "null",
        "null",
        "'There are too few days to see a trend.'",
    )
    return f"if(_labels >= 2, array({', '.join(rows)}), array({too_few}))"


def campaign_insights(
    df: DataFrame | None,
    by: By = (),
    charts: Sequence[str] = tuple(CHARTS),
    labels: DataFrame | None = None,
) -> DataFrame:
    """The insights of the given charts.

    Posts are aggregated to one row per label first.  From those, the three
    best labels per chart come from a rank that Spark limits before the
    shuffle; totals and day extremes come from a ``groupBy``, over the charts
    that need them.  No task ever holds all labels of a campaign, and both read
    the same shuffle of one scan.  ``labels`` (from ``label_table`` or
    ``campaign_cube``) takes the place of the posts.
    """
    table = campaign_cube(df, by, charts) if labels is None else labels
    keys = by_columns(table, by)
    group = [*keys, F.col("chart")]
    wanted = ", ".join(sql_text(c) for c in charts)
    labels = table.where(f"chart in ({wanted})").withColumn("value", F.expr(CHART_VALUE))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), F.asc("label"))
    # The count rides along so that both readers of the labels need the same
    # columns, which is what lets Spark reuse the shuffle.
    entry = "struct(label, value, n)"
    top = (
        labels.withColumn("_rank", F.row_number().over(order))
        .filter("_rank <= 3")
        .select(*group, "_rank", F.expr(entry).alias("_entry"))
    )
    with_facts = [c for c in charts if c in WITH_SHARE or c == "day"]
    facts = []
    if with_facts:
        top = top.unionByName(
            labels.groupBy(*group).agg(
                F.expr("sum(n) as _posts"),
                F.expr("count(*) as _labels"),
                F.expr("min_by(value, label) as _first"),
                F.expr("max_by(value, label) as _last"),
                F.expr(f"min_by({entry}, struct(value, label)) as _lowest"),
            ),
            allowMissingColumns=True,
        )
        facts = ["_posts", "_labels", "_first", "_last", "_lowest"]
    # At most four rows per chart meet here.
    per_chart = top.groupBy(*group).agg(
        *[F.expr(f"max(_entry) filter (where _rank = {i}) as _top{i}") for i in (1, 2, 3)],
        *[F.expr(f"max({c}) as {c}") for c in facts],
    )
    found = " ".join(
        f"when '{c}' then {_day_insights() if c == 'day' else _rank_insights(c)}" for c in charts
    )
    names = ["position", "code", "label", "value", "share", "text"]
    return per_chart.selectExpr(
        *[sql_name(c) for c in by], "chart", f"inline(array_compact(case chart {found} end))"
    ).selectExpr(
        *[sql_name(c) for c in by], "if(chart = 'day', 'engagement', chart) as chart", *names
    )


def sentiment_insights(df: DataFrame, by: By = ()) -> DataFrame:
    """Dominant sentiment with its share, second, third."""
    return campaign_insights(df, by, ["sentiment"])


def engagement_insights(df: DataFrame, by: By = ()) -> DataFrame:
    """Day trend, peak day and lowest day, or one row when there are too few days."""
    return campaign_insights(df, by, ["day"])


def platform_insights(df: DataFrame, by: By = ()) -> DataFrame:
    """Best, second and third platform by engagement."""
    return campaign_insights(df, by, ["platform"])


def media_type_insights(df: DataFrame, by: By = ()) -> DataFrame:
    """Most used, second and third media type."""
    return campaign_insights(df, by, ["media_type"])


def location_insights(df: DataFrame, by: By = ()) -> DataFrame:
    """Most active, second and third location."""
    return campaign_insights(df, by, ["location"])
