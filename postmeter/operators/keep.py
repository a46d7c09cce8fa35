"""Clean once and keep the result, with what cleaning did to it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation

from ..sources.tables import keep_clean
from .clean import cleaning_outcome, observed_posts


def keep_posts(
    raw: DataFrame, formats: Iterable[str] = (), by_day: bool = False, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(posts, outcome)``: the kept table of cleaned posts and the row of ``cleaning_outcome``.

    Both come from one pass over ``raw``: the outcome is observed while the table is
    written.  A task that ran twice, after a lost executor, may be observed twice; the
    count of the table shows that, and then the outcome is taken from ``raw`` again.
    """
    formats = list(formats)
    if not raw.columns:
        raise ValueError("column 'date' not found")
    observation = Observation(f"cleaning-{uuid.uuid4().hex}")
    posts = keep_clean(observed_posts(raw, observation, formats), by_day=by_day, path=path)
    outcome = cleaning_outcome(raw, formats=formats)
    found = observation.get
    if found.get("rows_kept") != posts.count():
        return posts, outcome
    return posts, raw.sparkSession.createDataFrame([tuple(found[c] for c in outcome.columns)], outcome.schema)
