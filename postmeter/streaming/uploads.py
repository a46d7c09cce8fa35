"""Clean uploads as they arrive.

The cleaner looks at one row at a time, so a stream needs no state and no
watermark; each new file is read, cleaned and appended once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean_posts
from ..schema import RAW_HEADERS
from ..sources.csv_posts import stream_posts_csv


def append_uploads(
    spark: SparkSession,
    path: str,
    clean_path: str,
    rejects_path: str,
    checkpoint: str,
    headers: Sequence[str] = RAW_HEADERS,
    formats: Iterable[str] = (),
    follow: bool = False,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Append new ``.csv`` files in ``path`` to the clean table, once each.

    Records with too many cells are appended to ``rejects_path`` by a query of
    its own, so both tables are written exactly once whatever fails.
    ``follow`` keeps waiting for files; otherwise both queries end when all
    present files are done.
    """
    posts, rejects = stream_posts_csv(spark, path, headers)

    def append(table: DataFrame, out: str, state: str) -> StreamingQuery:
        writer = (
            table.writeStream.format("parquet")
            .outputMode("append")
            .option("path", out)
            .option("checkpointLocation", f"{checkpoint}/{state}")
        )
        return writer.start() if follow else writer.trigger(availableNow=True).start()

    return (
        append(clean_posts(posts, formats), clean_path, "posts"),
        append(rejects, rejects_path, "rejects"),
    )
