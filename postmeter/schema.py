"""The shape of a campaign post before and after cleaning."""

from __future__ import annotations

from pyspark.sql import types as T

# The headers of an uploaded table and the label for a missing category.
RAW_HEADERS = (
    "Date",
    "Platform",
    "Sentiment",
    "Location",
    "Engagements",
    "Media Type",
    "Influencer Brand",
    "Post Type",
)
CATEGORIES = (
    "platform",
    "sentiment",
    "location",
    "media_type",
    "influencer_brand",
    "post_type",
)
UNKNOWN = "Unknown"
# Where a post comes from, as far as its reader knows; see ``read_posts_csv``.
SOURCE_COLUMNS = ("source_file", "source_place", "source_record")

RAW_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in RAW_HEADERS])

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("date", T.TimestampNTZType()),
        T.StructField("platform", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("engagements", T.DoubleType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("influencer_brand", T.StringType()),
        T.StructField("post_type", T.StringType()),
    ]
)
