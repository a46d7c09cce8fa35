"""Campaign posts derived from the ``events`` table.

Each event becomes one raw post, with the dirt an upload may hold: bad and
missing dates, null markers, numbers in the wrong form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Raw column -> (upload header, expression over ``events``).
# The expressions read the same in Spark SQL and in DuckDB.
EVENT_COLUMNS = {
    "raw_date": (
        "Date",
        "case when event_id % 97 = 0 then 'not a date' when event_id % 89 = 0 then null"
        " else cast(cast(ts as date) as string) end",
    ),
    "raw_platform": (
        "Platform",
        "case when event_id % 41 = 0 then null when event_type='view' then 'Instagram'"
        " when event_type='click' then 'Twitter' when event_type='purchase' then 'TikTok'"
        " when event_type='signup' then 'Blog' else 'YouTube' end",
    ),
    "raw_sentiment": (
        "Sentiment",
        "case when event_id % 37 = 0 then 'NA' when user_id % 10 < 5 then 'Positive'"
        " when user_id % 10 < 8 then 'Neutral' else 'Negative' end",
    ),
    "raw_location": (
        "Location",
        "case when event_id % 43 = 0 then '' else concat('City', cast(user_id % 12 as string)) end",
    ),
    "raw_engagements": (
        "Engagements",
        "case when event_id % 53 = 0 then 'n/a' when event_id % 59 = 0 then null"
        " when event_id % 61 = 0 then '1,500' when event_id % 67 = 0 then '1.5f'"
        " else cast(cast(floor(value*10) as bigint) as string) end",
    ),
    "raw_media_type": (
        "Media Type",
        "case when user_id % 4 = 0 then 'Image' when user_id % 4 = 1 then 'Video'"
        " when user_id % 4 = 2 then 'Text' else 'Carousel' end",
    ),
    "raw_influencer_brand": (
        "Influencer Brand",
        "concat('Brand', cast(event_id % 20 as string))",
    ),
    "raw_post_type": (
        "Post Type",
        "case when event_id % 3 = 0 then 'Feed Post' when event_id % 3 = 1 then 'Story'"
        " else 'Reel' end",
    ),
    "event_id": ("event_id", "event_id"),
}


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts with the upload headers, and ``event_id`` as an extra column."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(
        *[f"{expr} as `{header}`" for header, expr in EVENT_COLUMNS.values()]
    )
