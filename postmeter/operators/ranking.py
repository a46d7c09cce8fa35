"""Top-k tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import order_columns, quoted
from ..schema import SOURCE_COLUMNS
from .metrics import By, by_columns, category_counts


def ranked(
    table: DataFrame, label: str, value: str, k: int = 3, by: By = ()
) -> DataFrame:
    """The ``k`` labels with the largest value, with their ``rank``.

    ``table`` is aggregated already.  Equal values are ranked by label.  With
    ``by``, Spark cuts each task's rows to ``k`` per campaign before the
    shuffle (window group limit); without, it keeps ``k`` rows per task.
    """
    order = [F.desc(value), F.asc(label)]
    if not by:
        top = table.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*by_columns(table, by)).orderBy(*order)
    return table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_locations(df: DataFrame, k: int = 5, by: By = ()) -> DataFrame:
    """The ``k`` locations with most posts."""
    return ranked(category_counts(df, "location", by), "location", "n", k, by)


def preview(df: DataFrame, n: int = 5, order_col: str | None = None, file_order: bool = False) -> DataFrame:
    """The first ``n`` posts by date, then ``order_col``, then the other columns.

    ``file_order`` gives the first as the files hold them, file by file; it needs the
    columns of ``read_posts_csv`` with ``origin``, which the result leaves out.
    """
    if file_order:
        rest = [c for c in df.columns if c not in SOURCE_COLUMNS]
        own = df.select(*SOURCE_COLUMNS[:2], *[quoted(c) for c in rest])
        return own.orderBy(*SOURCE_COLUMNS[:2]).limit(n).drop(*SOURCE_COLUMNS)
    first = ["date"] + ([order_col] if order_col else [])
    return df.orderBy(*order_columns(df, first)).limit(n)
