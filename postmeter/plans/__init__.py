"""Insights, summaries, prompts and reports built from the operators."""

from .insights import (
    campaign_insights,
    engagement_insights,
    location_insights,
    media_type_insights,
    platform_insights,
    sentiment_insights,
)
from .report import report_document, report_lines, write_report
from .summary import campaign_prompts, campaign_summary, prompt_findings, summary_chunks

__all__ = [
    "campaign_insights",
    "campaign_prompts",
    "campaign_summary",
    "engagement_insights",
    "location_insights",
    "media_type_insights",
    "platform_insights",
    "prompt_findings",
    "report_document",
    "report_lines",
    "sentiment_insights",
    "summary_chunks",
    "write_report",
]
