"""Cleaning, metrics, rankings and trends over posts."""

from .clean import (
    clean_posts,
    cleaning_outcome,
    drop_invalid_dates,
    fill_categories,
    fill_engagements,
    normalize_columns,
    null_tokens,
    observed_posts,
    parse_dates,
    quarantine,
)
from .keep import keep_posts
from .metrics import (
    CHARTS,
    add_to_labels,
    campaign_cube,
    category_counts,
    category_share,
    daily_engagement,
    keep_labels,
    label_table,
    merge_labels,
    platform_engagement,
    total_posts,
)
from .ranking import preview, ranked, top_locations
from .trends import daily_trend, dominant, lowest_day, peak_day, post_trend, top_platform

__all__ = [
    "CHARTS",
    "add_to_labels",
    "campaign_cube",
    "category_counts",
    "category_share",
    "clean_posts",
    "cleaning_outcome",
    "daily_engagement",
    "daily_trend",
    "dominant",
    "drop_invalid_dates",
    "fill_categories",
    "fill_engagements",
    "keep_labels",
    "keep_posts",
    "label_table",
    "merge_labels",
    "lowest_day",
    "normalize_columns",
    "null_tokens",
    "observed_posts",
    "parse_dates",
    "peak_day",
    "platform_engagement",
    "post_trend",
    "preview",
    "quarantine",
    "ranked",
    "top_locations",
    "top_platform",
    "total_posts",
]
