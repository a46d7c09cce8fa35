"""Continuous cleaning of uploads."""

from .uploads import append_uploads

__all__ = ["append_uploads"]
