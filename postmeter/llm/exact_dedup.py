"""Exact deduplication by radix partitioning from the first byte on.

Texts are split by their length and then by successive runs of bytes, each run
sixteen times as long as the one before.  A group that is down to one text, or
whose texts have ended, is done; only the others go on.  Equality is decided by
the bytes themselves, never by a digest.

A group of copies may hold any share of the rows: it is counted with a partial
aggregate before the shuffle.  The counts are stored, so that the join in which its
rows meet them reads a plain table, which lets Spark split it where a group is large.
The counts grow with the corpus, so they are merged at every size and never broadcast.
No group is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, keep, numbered_rows, passing_tables, text_or_empty, unused_name

FIRST_BYTES = 32
GROWTH = 16


def _bytes_from(column: str, start: int, width: int | None = None):
    tail = f"{start}" if width is None else f"{start}, {width}"
    return F.expr(f"substring({column}, {tail})")


def _go_on(active: DataFrame, keys: list[str], width: int, offset: int) -> DataFrame:
    """One step: rows of groups with several texts, with their group and what is left."""
    dealt = active.select(*keys, "row", "doc_id", *({"size"} - {*keys}), "rest").withColumn(
        "digit", _bytes_from("rest", 1, width)
    )
    groups = (
        dealt.groupBy(*keys, "digit")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("last"))
        .where("n > 1")
    )
    groups = keep(groups, "radix-groups")
    ended = F.col("size") <= offset + width
    return dealt.join(groups.hint("merge"), [*keys, "digit"]).select(
        "row",
        "doc_id",
        "size",
        F.col("last.row").alias("group"),
        F.col("last.doc_id").alias("keep_id"),
        "n",
        ended.alias("ended"),
        F.when(~ended, _bytes_from("rest", width + 1)).alias("rest"),
    )


def equal_texts(docs: DataFrame, first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """Class of every row: ``(row, doc_id, keep_id, keep_row, group_size, text_sha256)``.

    * Texts are equal when identical after lower-casing A-Z; null is empty.
    * The row with the largest ``doc_id`` represents its class; a null id is the
      smallest, and of rows with one id the one read last is taken.
    * ``row`` numbers the rows of ``docs``; repeated ids are separate rows.
    * An empty table gives an empty one.  Other columns are not looked at.
    """
    own = docs.select(docs["doc_id"], ascii_lower(text_or_empty(docs)).alias("norm"))
    sized = own.select(
        "doc_id",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("norm").alias("size"),
        F.expr(f"substring(cast(norm as binary), 1, {first_bytes})").alias("head"),
        F.expr("cast(norm as binary)").alias("bytes"),
    )
    several = keep(
        sized.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1"), "radix-sizes"
    )
    numbered = sized.withColumn("row", F.monotonically_increasing_id())
    marked = numbered.join(several.hint("merge"), ["size", "head"], "left").select(
        "row",
        "doc_id",
        "text_sha256",
        "size",
        F.when(F.col("n").isNotNull(), F.col("head")).alias("head"),
        F.when(F.col("n").isNotNull(), _bytes_from("bytes", first_bytes + 1)).alias("rest"),
    )
    # The row numbers are drawn once, in this write.
    everything = keep(marked, "radix-rows")

    keys, offset, width = ["size", "head"], first_bytes, first_bytes * growth
    active, done = everything.where("rest is not null"), []
    while True:
        step = keep(_go_on(active, keys, width, offset), "radix-step")
        done.append(step.where("ended").select("row", "keep_id", "group", "n"))
        active = step.where("not ended")
        if active.isEmpty():
            break
        keys, offset, width = ["group"], offset + width, width * growth
    classes = reduce(DataFrame.unionByName, done)
    return (
        everything.select("row", "doc_id", "text_sha256")
        .join(classes, "row", "left")
        .select(
            "row",
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group", "row").alias("keep_row"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, stored: bool = False) -> DataFrame:
    """The rows of ``docs`` without earlier copies, with their own columns.

    Rows are told apart as in :func:`equal_texts`: of the rows with one text, the
    one with the largest ``doc_id`` stays.  A ``stored`` table of Parquet files is read
    again and not copied (see :func:`numbered_rows`).
    """
    key = unused_name(docs, "row")
    numbered = numbered_rows(docs, key, "radix-docs", stored)
    as_docs = numbered.select(F.struct("doc_id", key).alias("doc_id"), "text")
    with passing_tables(docs.sparkSession):
        found = equal_texts(as_docs).where("row = keep_row").select(F.col("doc_id")[key].alias(key))
        kept = keep(found, "radix-kept", lasting=True)
    # The kept rows grow with the corpus: merged at every size, as the counts are.
    return numbered.join(kept.hint("merge"), key, "left_semi").drop(key)


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    return equal_texts(docs).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
