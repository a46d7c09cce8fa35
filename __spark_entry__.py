"""

The input of every query is the ``events`` table, read whole as raw campaign
posts.  ``_by_brand`` queries compute the same per influencer brand.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import postmeter as pm  # noqa: E402
import sql_oracle  # noqa: E402
from postmeter.schema import CATEGORIES  # noqa: E402
from postmeter.sources.events import EVENT_COLUMNS  # noqa: E402

try:
    from postmeter.llm.queries import ORACLE_SQL as LLM_SQL
    from postmeter.llm.queries import QUERIES as LLM_QUERIES
except ImportError:
    LLM_QUERIES, LLM_SQL = {}, {}
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

BRAND = ("influencer_brand",)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pm.event_posts(spark, sf_dir)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pm.null_tokens(_raw(spark, sf_dir))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pm.clean_posts(_marked(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """The insights of all five charts, at sf0.001."""
    return pm.campaign_insights(_posts(spark, "/root/testdata/sf0.001"))


# --- cleaning, step by step -------------------------------------------------


def _null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).toDF(*EVENT_COLUMNS)


def _normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pm.normalize_columns(_raw(spark, sf_dir))


def _parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pm.normalize_columns(_marked(spark, sf_dir))
    return pm.parse_dates(named).select("event_id", "date")


def _drop_invalid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pm.drop_invalid_dates(_parse_dates(spark, sf_dir))


def _parse_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pm.normalize_columns(_marked(spark, sf_dir))
    return pm.fill_engagements(named).select("event_id", "engagements")


def _missing_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _marked(spark, sf_dir).drop("Engagements")
    return pm.clean_posts(raw).select("event_id", "date", "engagements")


def _missing_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _marked(spark, sf_dir).select("Date", "Engagements", "event_id")
    return pm.clean_posts(raw)


def _fill_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pm.normalize_columns(_marked(spark, sf_dir))
    return pm.fill_categories(named).select("event_id", *CATEGORIES)


# --- sources and sinks ------------------------------------------------------


def _fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place."""
    return f"{pm.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "csv_source")
    _raw(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    posts, _ = pm.read_posts_csv(spark, path, multi_line=False)
    return pm.clean_posts(posts)


def _csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts of columns in one folder."""
    path = _fresh(spark, "csv_mixed")
    raw = _raw(spark, sf_dir)
    for part, columns in ((0, raw.columns), (1, raw.columns[::-1])):
        own = raw.where(F.col("event_id") % 2 == part).select(*[f"`{c}`" for c in columns])
        own.write.mode("append").option("header", True).option("escape", '"').csv(path)
    posts, _ = pm.read_posts_csv(spark, path, multi_line=False)
    return pm.clean_posts(posts)


def _csv_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per brand, which the files do not name."""
    path = _fresh(spark, "csv_folders")
    raw = _raw(spark, sf_dir).withColumnRenamed("Influencer Brand", "influencer_brand")
    raw.write.partitionBy("influencer_brand").option("header", True).option("escape", '"').csv(path)
    posts, _ = pm.read_posts_csv(spark, path, multi_line=False)
    return pm.clean_posts(posts)


def _write_ragged(spark: SparkSession, sf_dir: str) -> str:
    """CSV files in which every 101st record is too long and every 103rd too short."""
    path = _fresh(spark, "csv_ragged")
    raw = _raw(spark, sf_dir)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in raw.columns]
    cells = [F.when(c.contains(","), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c) for c in cells]
    event = F.col("event_id")
    line = (
        F.when(event % 101 == 0, F.concat_ws(",", *cells, F.lit("one too many")))
        .when(event % 103 == 0, F.concat_ws(",", *cells[:2]))
        .otherwise(F.concat_ws(",", *cells))
    )
    # One column that holds whole records: no separator or quote of its own.
    records = raw.select(line.alias(",".join(raw.columns)))
    records.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
    return path


def _csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, _ = pm.read_posts_csv(spark, _write_ragged(spark, sf_dir), multi_line=False)
    return pm.clean_posts(posts)


# Bytes of the ranges that the queries below read by, so that small tables have many too.
RANGE = 100_000


def _csv_multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with line breaks and quotes, read by byte ranges."""
    path = _fresh(spark, "csv_lines")
    note = F.concat(F.lit('said "'), F.col("event_id").cast("string"), F.lit('",\n\nthen\nleft'))
    raw = _raw(spark, sf_dir).withColumn("The Note", F.when(F.col("event_id") % 3 > 0, note))
    raw.write.option("header", True).option("escape", '"').csv(path)
    posts, _ = pm.read_posts_csv(spark, path, range_bytes=RANGE)
    return pm.clean_posts(posts)


def _csv_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of an upload that gives no post: rejected ones and undated posts."""
    posts, rejects = pm.read_posts_csv(spark, _write_ragged(spark, sf_dir), origin=True, range_bytes=RANGE)
    return rejects.unionByName(pm.quarantine(posts)).select("record", "reason")


def _preview_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first posts of an upload of several files, in their order."""
    path = _fresh(spark, "csv_order")
    ordered = _raw(spark, sf_dir).repartitionByRange(4, F.desc("event_id")).sortWithinPartitions(F.desc("event_id"))
    ordered.write.option("header", True).option("escape", '"').csv(path)
    posts, _ = pm.read_posts_csv(spark, path, origin=True, range_bytes=RANGE)
    return pm.preview(pm.clean_posts(posts), 5, file_order=True)


def _observed_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome seen while the cleaned table is written."""
    return pm.keep_posts(_marked(spark, sf_dir))[1]


def _undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated posts of a table."""
    raw = _marked(spark, sf_dir).select("Date", "Platform", "event_id")
    return pm.quarantine(raw).select("record", "reason")


def _merged(spark: SparkSession, sf_dir: str, by) -> DataFrame:
    """The label table of three batches, each added without reading the ones before."""
    posts = _posts(spark, sf_dir)
    batches = [posts.where(F.col("event_id") % 3 == k) for k in range(3)]
    labels = pm.keep_labels(batches[0], by)
    for batch in batches[1:]:
        labels = pm.add_to_labels(labels, batch, by)
    return labels


def _merged_cube(spark: SparkSession, sf_dir: str, by=()) -> DataFrame:
    return _merged(spark, sf_dir, by).where("chart <> 'moment'").drop("lowest")


def _merged_prompts(spark: SparkSession, sf_dir: str, by=()) -> DataFrame:
    return pm.campaign_prompts(None, by, labels=_merged(spark, sf_dir, by))


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = pm.read_posts_csv(spark, _write_ragged(spark, sf_dir), multi_line=False)
    return rejects.select("record", "reason")


def _clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pm.keep_clean(_posts(spark, sf_dir), by_day=True)


def _report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "report")
    document = pm.report_document(_posts(spark, sf_dir), BRAND)
    pm.write_report(document, path, BRAND)
    return spark.read.schema(document.schema).json(path)


def _report_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per brand, each with its lines in order."""
    path = _fresh(spark, "report_folders")
    document = pm.report_document(_posts(spark, sf_dir), BRAND)
    pm.write_report(document, path, BRAND, folders=True)
    return spark.read.schema(document.schema).json(path)


def _report_with_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses for some brands, and for one that has no posts."""
    posts = _posts(spark, sf_dir)
    brands = posts.select(*BRAND).distinct().where("influencer_brand < 'Brand15'")
    texts = brands.union(spark.sql("select 'nobody'")).withColumn("analysis", F.concat(F.lit("On "), *BRAND))
    return pm.report_document(posts, BRAND, texts)


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as day.month.year with an offset, which is ignored."""
    raw = _raw(spark, sf_dir)
    day = F.regexp_replace("Date", "^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"$3.$2.$1 02:30 +07:00")
    named = pm.normalize_columns(raw.withColumn("Date", day))
    return pm.parse_dates(named, ["dd.MM.yyyy HH:mm XXX"]).select("event_id", "date")


def _fractions(spark: SparkSession, sf_dir: str, by=()) -> DataFrame:
    """Summary of engagements with fractions, beyond ten million in total."""
    posts = _posts(spark, sf_dir).withColumn("engagements", F.col("engagements") * 64 + 0.5)
    return pm.campaign_summary(posts, by).select(*by, "total_posts", "trend", "summary")


def _upload_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "uploads")
    raw = _raw(spark, sf_dir)
    raw.write.option("header", True).option("escape", '"').csv(f"{path}/in")
    for query in pm.append_uploads(
        spark, f"{path}/in", f"{path}/clean", f"{path}/rejects", f"{path}/state", raw.columns
    ):
        query.awaitTermination()
    return pm.read_clean(spark, f"{path}/clean")


# --- metrics and what is made from them ------------------------------------


def _dominant_labels(posts: DataFrame, by) -> DataFrame:
    """From one label table, so that the posts are read once."""
    charts = ["sentiment", "media_type", "location"]
    labels = pm.campaign_cube(posts, by, charts)
    best = labels.groupBy(*by, F.col("chart").alias("category")).agg(
        F.expr("min_by(struct(label, n), struct(-n, label)) as best")
    )
    return best.select(*by, "category", "best.label", "best.n")


def _summary(posts: DataFrame, by) -> DataFrame:
    """The maps as JSON text, which keeps their order."""

    def text(name: str):
        whole = F.transform_values(F.col(name), lambda _, v: v.cast("bigint"))
        return F.to_json(whole).alias(name)

    summary = pm.campaign_summary(posts, by, order_col="event_id")
    return summary.select(
        *by,
        "total_posts",
        text("sentiment_counts"),
        text("platform_engagements"),
        text("media_type_counts"),
        text("top_locations"),
        "trend",
        "summary",
    )


def _top3(counts: Callable, label: str, value: str) -> Callable:
    return lambda posts, by: pm.ranked(counts(posts, by), label, value, 3, by)


def _counts(category: str, ordered: bool = False) -> Callable:
    return lambda posts, by: pm.category_counts(posts, category, by, ordered)


# Name -> what it computes from clean posts; each is registered for the whole
# table and per brand.
METRICS: dict[str, Callable] = {
    "total_posts": pm.total_posts,
    "sentiment_counts": _counts("sentiment", ordered=True),
    "media_type_counts": _counts("media_type", ordered=True),
    "location_counts": _counts("location", ordered=True),
    "platform_engagement": pm.platform_engagement,
    "platform_ranking": lambda p, by: pm.platform_engagement(p, by, ordered=True),
    "daily_engagement": lambda p, by: pm.daily_engagement(p, by, ordered=True),
    "sentiment_share": lambda p, by: pm.category_share(p, "sentiment", by),
    "media_type_share": lambda p, by: pm.category_share(p, "media_type", by),
    "campaign_cube": pm.campaign_cube,
    "campaign_cube_one_scan": lambda p, by: pm.campaign_cube(p, by, one_scan=True),
    "campaign_cube_scan_per_chart": lambda p, by: pm.campaign_cube(p, by, one_scan=False),
    "top5_locations": lambda p, by: pm.top_locations(p, 5, by),
    "top3_locations": lambda p, by: pm.top_locations(p, 3, by),
    "sentiment_top3": _top3(_counts("sentiment"), "sentiment", "n"),
    "platform_top3": _top3(pm.platform_engagement, "platform", "engagements"),
    "media_type_top3": _top3(_counts("media_type"), "media_type", "n"),
    "post_trend": pm.post_trend,
    "post_trend_ordered": lambda p, by: pm.post_trend(p, by, order_col="event_id"),
    "daily_trend": pm.daily_trend,
    "peak_day": pm.peak_day,
    "lowest_day": pm.lowest_day,
    "top_platform": pm.top_platform,
    "dominant_labels": _dominant_labels,
    "sentiment_insights": pm.sentiment_insights,
    "engagement_insights": pm.engagement_insights,
    "platform_insights": pm.platform_insights,
    "media_type_insights": pm.media_type_insights,
    "location_insights": pm.location_insights,
    "campaign_insights": pm.campaign_insights,
    "report_lines": pm.report_lines,
    "report_document": lambda p, by: pm.report_document(p, by, "Post more in the evening."),
    "campaign_summary": _summary,
    "summary_chunks": lambda p, by: pm.summary_chunks(p, by, size=5),
    "prompt_findings": pm.prompt_findings,
    "campaign_prompts": pm.campaign_prompts,
}


def _on_posts(metric: Callable, by) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: metric(_posts(spark, sf_dir), by)


def _with_folder(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """Name a shared folder first where a local session has none; one is never replaced."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        local = spark.sparkContext.master.split("[")[0] == "local"
        if local and not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postmeter-"))
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes (spark, sf_dir)."""
    found = {
        "null_tokens": _null_tokens,
        "normalize_columns": _normalize_columns,
        "parse_dates": _parse_dates,
        "drop_invalid_dates": _drop_invalid_dates,
        "parse_engagements": _parse_engagements,
        "missing_engagements": _missing_engagements,
        "missing_categories": _missing_categories,
        "fill_unknown": _fill_unknown,
        "clean_posts": _posts,
        "preview": lambda spark, sf_dir: pm.preview(_posts(spark, sf_dir), 5, "event_id"),
        "csv_source": _csv_source,
        "csv_mixed_headers": _csv_mixed_headers,
        "csv_by_folder": _csv_by_folder,
        "csv_ragged": _csv_ragged,
        "csv_rejects": _csv_rejects,
        "csv_multi_line": _csv_multi_line,
        "csv_left_out": _csv_left_out,
        "preview_files": _preview_files,
        "cleaning_outcome_observed": _observed_outcome,
        "undated_posts": _undated,
        "merged_cube": _merged_cube,
        "merged_cube_by_brand": lambda spark, sf_dir: _merged_cube(spark, sf_dir, BRAND),
        "merged_prompts": _merged_prompts,
        "merged_prompts_by_brand": lambda spark, sf_dir: _merged_prompts(spark, sf_dir, BRAND),
        "clean_table": _clean_table,
        "report_table": _report_table,
        "report_folders": _report_folders,
        "report_with_analyses_by_brand": _report_with_analyses,
        "parse_dates_formats": _formats,
        "campaign_summary_fractions": _fractions,
        "campaign_summary_fractions_by_brand": lambda spark, sf_dir: _fractions(spark, sf_dir, BRAND),
        "upload_stream": _upload_stream,
    }
    for name, metric in METRICS.items():
        found[name] = _on_posts(metric, ())
        found[f"{name}_by_brand"] = _on_posts(metric, BRAND)
    found["cleaning_outcome"] = lambda spark, sf_dir: pm.cleaning_outcome(_marked(spark, sf_dir))
    found["cleaning_outcome_by_brand"] = lambda spark, sf_dir: pm.cleaning_outcome(_marked(spark, sf_dir), BRAND)
    found |= LLM_QUERIES
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return {name: _with_folder(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    """The same results in SQL, written apart from the Spark code."""
    found = sql_oracle.statements() | LLM_SQL
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
