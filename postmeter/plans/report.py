"""The campaign report: ordered text lines, and the table they are written to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sql_name, sql_text
from ..operators.metrics import By, by_columns, campaign_cube
from .insights import CHART_VALUE

TITLE = "Campaign report"
ANALYSIS_HEADING = "Analysis and recommendations"
FINDINGS_HEADING = "Main findings"
FOOTER = "End of report"


def campaign_bests(df: DataFrame | None, by: By, labels: DataFrame | None = None) -> DataFrame:
    """Per campaign: the leading label of each chart, and the first and last day's totals."""
    table = campaign_cube(df, by) if labels is None else labels
    keys = by_columns(table, by, ["position", "code", "section", "text"])
    labels = table.withColumn("value", F.expr(CHART_VALUE))
    per_chart = labels.groupBy(*keys, "chart").agg(
        F.expr("count(*) as labels"),
        F.expr("min_by(label, struct(-value, label)) as best"),
        F.expr("min_by(value, label) as first"),
        F.expr("max_by(value, label) as last"),
    )

    def of(chart: str, field: str, name: str) -> Column:
        return F.expr(f"max({field}) filter (where chart = '{chart}') as {name}")

    bests = per_chart.groupBy(*keys).agg(
        *[of(c, "best", f"_{c}") for c in ("sentiment", "platform", "media_type", "location")],
        of("day", "labels", "_days"),
        of("day", "first", "_first"),
        of("day", "last", "_last"),
    )
    return bests.filter("_sentiment is not null")


# Finding -> SQL of its line; null leaves the line out.
FINDINGS = {
    "dominant_sentiment": "concat('Dominant sentiment: ', _sentiment, '.')",
    "engagement_trend": (
        "if(_days >= 2, if(_last > _first, 'Engagement is rising overall.',"
        " 'The last day brought no more engagement than the first.'), null)"
    ),
    "best_platform": "concat('Best performing platform: ', _platform, '.')",
    "main_media_type": "concat('Main media type: ', _media_type, '.')",
    "top_location": "concat('Most active location: ', _location, '.')",
}


def _lines(df: DataFrame, by: By, field: str, lines: list[tuple[int, str, str]]) -> DataFrame:
    """One row per line that has a text, from one row per campaign."""
    rows = ", ".join(
        f"named_struct('position', {i}, '{field}', '{name}', 'text', {text})"
        for i, name, text in lines
    )
    return df.selectExpr(
        *[sql_name(c) for c in by], f"inline(filter(array({rows}), x -> x.text is not null))"
    )


def report_lines(df: DataFrame | None, by: By = (), labels: DataFrame | None = None) -> DataFrame:
    """Up to five one-line findings per campaign, in order.

    The trend line is left out with fewer than two days; its position stays free.
    """
    lines = [(i, c, t) for i, (c, t) in enumerate(FINDINGS.items(), start=1)]
    return _lines(campaign_bests(df, by, labels), by, "code", lines)


def report_document(
    df: DataFrame | None,
    by: By = (),
    analysis: str | DataFrame | None = None,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Every line of the report: title, analysis, findings, footer.

    The title names the campaign.  ``analysis`` is the text an analyst or a language
    model wrote: one text, or a table ``(by, analysis)``.  A campaign without a row in it
    has neither the text nor its heading; a row without a campaign is left out; two for
    one campaign make the read fail.
    """
    bests = campaign_bests(df, by, labels)
    own = [sql_name(c) for c in by]
    if isinstance(analysis, DataFrame):
        checked = analysis.groupBy(*by_columns(analysis, by)).agg(
            F.expr(
                "if(count(*) > 1, cast(raise_error('two analyses for one campaign') as string),"
                " max(analysis)) as _analysis"
            )
        )
        if by:
            same = reduce(
                lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in own]
            )
            bests = bests.alias("b").join(checked.alias("a"), same, "left").select("b.*", "a._analysis")
        else:
            bests = bests.join(checked, how="left")
    else:
        bests = bests.withColumn("_analysis", F.lit(analysis).cast("string"))
    names = ", ', ', ".join(f"coalesce(cast({c} as string), '')" for c in own)
    title = f"concat({sql_text(TITLE + ': ')}, {names})" if by else sql_text(TITLE)
    lines = [
        (1, "title", title),
        (2, "analysis_heading", f"if(_analysis is null, null, {sql_text(ANALYSIS_HEADING)})"),
        (3, "analysis", "_analysis"),
        (4, "findings_heading", sql_text(FINDINGS_HEADING)),
        *[(i, "finding", t) for i, t in enumerate(FINDINGS.values(), start=5)],
        (10, "footer", sql_text(FOOTER)),
    ]
    return _lines(bests, by, "section", lines)


def write_report(
    document: DataFrame,
    path: str,
    by: By = (),
    fmt: str = "json",
    mode: str = "errorifexists",
    folders: bool = False,
) -> None:
    """Write report lines in order as ``json``, ``parquet`` or plain ``text``.

    In the text form the title line of each report says whose it is.  ``folders`` makes
    a folder per campaign with one file that holds its lines in order.
    """
    keys = by_columns(document, by)
    if fmt not in ("json", "parquet", "text"):
        raise ValueError(f"unknown report format: {fmt}")
    if folders and not by:
        raise ValueError("folders need the columns that tell campaigns apart")
    if folders:
        # A campaign has a few lines, all in one range; no range holds another's.
        ordered = document.repartitionByRange(*keys).sortWithinPartitions(*keys, "position")
    else:
        ordered = document.orderBy(*keys, "position")
    if fmt == "text":
        ordered = ordered.select(*(keys if folders else []), "text")
    writer = ordered.write.mode(mode).format(fmt)
    (writer.partitionBy(*by) if folders else writer).save(path)
