"""Campaign summaries and the prompts made from them: one row per campaign."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import number_text, sql_name, sql_text
from ..operators.metrics import MOMENT, By, by_columns, label_table
from ..operators.trends import direction, post_trend
from ..sources.tables import keep_clean
from .insights import CHART_VALUE
from .report import campaign_bests

TREND_TEXTS = {
    "rising": "engagement rises over the campaign",
    "falling": "engagement falls over the campaign",
    "none": "first and last post are level",
}
NO_DATA = "There are no posts to describe."
# What the prompt asks for, unless the caller says otherwise.
REQUEST = (
    "Write a short briefing on this campaign for its owner. State what the numbers above show, "
    "and close with three next steps, each tied to one of them."
)


def summary_facts(
    df: DataFrame | None, by: By = (), order_col: str | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Per campaign: number of posts, post trend, and the label totals, best first.

    ``_sentiment``, ``_platform`` and ``_media_type`` hold every label, because
    the summary lists every label; ``_location`` holds three.  Posts are
    aggregated to labels before anything is collected.  ``labels`` is a
    ``label_table`` with the chart of moments; then the posts are read only if
    ``order_col`` is given.
    """
    charts = ["sentiment", "platform", "media_type", "location", *([] if order_col else [MOMENT])]
    table = label_table(df, by, charts) if labels is None else labels
    keys = by_columns(table, by)
    wanted = ", ".join(sql_text(c) for c in charts)
    valued = table.where(f"chart in ({wanted})").withColumn("value", F.expr(CHART_VALUE))
    group = [*keys, F.col("chart")]
    order = Window.partitionBy(*group).orderBy(F.desc("value"), F.asc("label"))
    # Both readers of the labels take all charts and the same columns, so that they
    # share one shuffle; charts are told apart only after it.
    top = (
        valued.withColumn("_rank", F.row_number().over(order))
        .filter("_rank <= 3")
        .select(*group, "_rank", F.expr("struct(label, value, n, lowest) as _entry"))
    )
    moment = f"filter (where chart = '{MOMENT}')"
    at = "cast(label as timestamp_ntz)"
    whole = valued.groupBy(*group).agg(
        F.expr(f"array_sort(collect_list(struct(-value as minus, label, value)) filter (where chart in ({_LISTED}))) as _list"),
        F.expr(f"sum(n) {moment} as n_posts"),
        F.expr(f"min_by(lowest, if(chart = '{MOMENT}', {at}, null)) as first_engagements"),
        F.expr(f"max_by(lowest, if(chart = '{MOMENT}', {at}, null)) as last_engagements"),
    )
    parts = whole.unionByName(top, allowMissingColumns=True)
    if order_col:
        trend = post_trend(df, by, order_col).drop("trend")
        parts = parts.drop("n_posts", "first_engagements", "last_engagements").unionByName(trend, allowMissingColumns=True)
    places = ", ".join(f"max(_entry) filter (where chart = 'location' and _rank = {i})" for i in (1, 2, 3))
    # At most a few rows per chart and campaign meet here.
    facts = parts.groupBy(*keys).agg(
        F.expr("coalesce(max(n_posts), 0) as n_posts"),
        F.expr("max(first_engagements) as _first"),
        F.expr("max(last_engagements) as _last"),
        *[
            F.expr(f"coalesce(max(_list) filter (where chart = '{c}'), cast(array() as {_LIST})) as _{c}")
            for c in ("sentiment", "platform", "media_type")
        ],
        F.expr(
            f"transform(array_compact(array({places})), e -> struct(-e.value as minus, e.label, e.value)) as _location"
        ),
    )
    return facts.withColumn("trend", F.expr(direction("_first", "_last", "none"))).drop("_first", "_last")


_LISTED = "'sentiment', 'platform', 'media_type'"
_LIST = "array<struct<minus:double,label:string,value:double>>"


def _list_text(best_first: str) -> str:
    return (
        f"array_join(transform({best_first},"
        f" e -> concat(e.label, ' ', {number_text('e.value')})), ', ')"
    )


def _summary_text() -> str:
    trends = " ".join(f"when '{k}' then {sql_text(v)}" for k, v in TREND_TEXTS.items())
    lines = [
        ("Posts: ", "n_posts"),
        ("\nPosts per sentiment: ", _list_text("_sentiment")),
        ("\nEngagement per platform: ", _list_text("_platform")),
        ("\nPosts per media type: ", _list_text("_media_type")),
        ("\nTop locations: ", _list_text("_location")),
        ("\nTrend: ", f"case trend {trends} end"),
    ]
    text = ", ".join(f"{sql_text(words)}, {value}" for words, value in lines)
    return f"if(n_posts > 0, concat({text}), {sql_text(NO_DATA)})"


def _findings_text() -> str:
    best = ", '; ', ".join(
        f"{sql_text(words)}, _{c}"
        for c, words in (
            ("sentiment", "leading sentiment: "),
            ("platform", "platform with most engagement: "),
            ("media_type", "most frequent media type: "),
            ("location", "busiest location: "),
        )
    )
    return f"concat({best})"


def campaign_summary(
    df: DataFrame | None, by: By = (), order_col: str | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """Totals, label maps, top three locations and post trend of each campaign.

    The maps hold every label of a campaign, by contract; ``campaign_cube`` has the
    same numbers as rows, without that limit.
    """

    def as_map(c: str, kind: str, name: str) -> str:
        pairs = f"transform(_{c}, e -> struct(e.label, cast(e.value as {kind})))"
        return f"map_from_entries({pairs}) as {name}"

    return summary_facts(df, by, order_col, labels).selectExpr(
        *[sql_name(c) for c in by],
        "n_posts as total_posts",
        as_map("sentiment", "bigint", "sentiment_counts"),
        as_map("platform", "double", "platform_engagements"),
        as_map("media_type", "bigint", "media_type_counts"),
        as_map("location", "bigint", "top_locations"),
        "trend",
        f"{_summary_text()} as summary",
    )


def summary_chunks(
    df: DataFrame | None, by: By = (), labels: DataFrame | None = None, size: int = 1000
) -> DataFrame:
    """The label lists of the summary as rows of up to ``size`` labels.

    ``by, chart, chunk, n_labels, text``: chunk k has the labels of ranks k * size to
    (k + 1) * size - 1, best first; the texts of a chart in the order of ``chunk``, with
    ``', '`` between, are its list in the summary (of locations all, not three).  Labels are
    ranked by ranges of the sorted table, so no task holds all labels of a campaign.
    """
    charts = ["sentiment", "platform", "media_type", "location"]
    table = label_table(df, by, charts) if labels is None else labels
    keys = by_columns(table, by, ["chart", "chunk", "n_labels", "text"])
    group = [sql_name(c) for c in by] + ["chart"]
    wanted = ", ".join(sql_text(c) for c in charts)
    entries = table.where(f"chart in ({wanted})").select(
        *keys, "chart", F.expr(f"-{CHART_VALUE} as _minus"), F.col("label").alias("_label")
    )
    # Written once, so that ranges and places in them hold for both readers below.
    ranged = entries.repartitionByRange(*group, "_minus", "_label").withColumn("_part", F.spark_partition_id())
    kept = keep_clean(ranged, "ranged_labels")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        kept.groupBy(*group, "_part")
        .agg(F.count("*").alias("_n"))
        .select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    in_part = Window.partitionBy(*group, "_part").orderBy("_minus", "_label")
    placed = kept.withColumn("_row", F.row_number().over(in_part)).alias("p")
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_part"]])
    ranked_labels = placed.join(before.alias("b"), same).select(
        "p.*", F.floor((F.col("_before") + F.col("_row") - 1) / size).alias("chunk")
    )
    listed = "array_sort(collect_list(struct(_minus as minus, _label as label, -_minus as value)))"
    return (
        ranked_labels.groupBy(*group, "chunk")
        .agg(F.count("*").alias("n_labels"), F.expr(f"{listed} as _list"))
        .selectExpr(*group, "chunk", "n_labels", f"{_list_text('_list')} as text")
    )


def prompt_findings(
    df: DataFrame | None, by: By = (), labels: DataFrame | None = None
) -> DataFrame:
    """The leading label of four charts in one line per campaign."""
    bests = campaign_bests(df, by, labels)
    return bests.selectExpr(*[sql_name(c) for c in by], f"{_findings_text()} as findings")


def campaign_prompts(
    df: DataFrame | None,
    by: By = (),
    order_col: str | None = None,
    labels: DataFrame | None = None,
    request: str = REQUEST,
) -> DataFrame:
    """Summary, findings and request as one prompt per campaign with posts."""
    own = [sql_name(c) for c in by]
    leading = ", ".join(
        f"get(_{c}, 0).label as _{c}" for c in ("sentiment", "platform", "media_type", "location")
    )
    texts = (
        summary_facts(df, by, order_col, labels)
        .filter("n_posts > 0")
        .selectExpr(*own, f"{_summary_text()} as summary", f"inline(array(struct({leading})))")
        .selectExpr(*own, "summary", f"{_findings_text()} as findings")
    )
    heading, middle = sql_text("Summary of the campaign data:\n"), sql_text("\n\nMain findings: ")
    return texts.selectExpr(
        *own,
        "summary",
        "findings",
        f"concat({heading}, summary, {middle}, findings, {sql_text(chr(10) * 2 + request)}) as prompt",
    )
