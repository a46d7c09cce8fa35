"""Cleaning: raw posts in, posts with the fixed schema out, and what was left out.

Every step looks at one row only, so the same code serves a batch table and a
stream, and no step shuffles.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import (
    NUMBER,
    normalized_names,
    null_if_token,
    parse_date,
    parse_engagements,
    quoted,
    sql_text,
)
from ..schema import CATEGORIES, CLEAN_SCHEMA, UNKNOWN


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Rename every column to lower case with ``_`` for spaces."""
    return raw.toDF(*normalized_names(raw.columns))


def null_tokens(raw: DataFrame, besides: Collection[str] = ()) -> DataFrame:
    """Turn the standard null markers into null in every text column but those in ``besides``."""
    return raw.select(
        *[
            null_if_token(name) if kind == "string" and name not in besides else quoted(name)
            for name, kind in raw.dtypes
        ]
    )


def _date(df: DataFrame, formats: Iterable[str]) -> dict[str, Column]:
    if "date" not in df.columns:
        raise ValueError("column 'date' not found")
    return {"date": parse_date("date", df.schema["date"].dataType, formats)}


def _engagements(df: DataFrame) -> dict[str, Column]:
    if "engagements" not in df.columns:
        return {"engagements": F.lit(0.0)}
    return {"engagements": parse_engagements("engagements", df.schema["engagements"].dataType)}


def _categories(df: DataFrame) -> dict[str, Column]:
    present = set(df.columns)
    return {
        c: F.expr(f"coalesce(cast({c} as string), {sql_text(UNKNOWN)})")
        if c in present
        else F.lit(UNKNOWN)
        for c in CATEGORIES
    }


def parse_dates(df: DataFrame, formats: Iterable[str] = ()) -> DataFrame:
    """Make ``date`` a wall-clock timestamp, null where the value is no date."""
    return df.withColumns(_date(df, formats))


def drop_invalid_dates(df: DataFrame) -> DataFrame:
    """Keep the posts that have a date."""
    return df.filter("date is not null")


def fill_engagements(df: DataFrame) -> DataFrame:
    """Make ``engagements`` a finite number, zero where it is bad, null or absent."""
    return df.withColumns(_engagements(df))


def fill_categories(df: DataFrame) -> DataFrame:
    """Put ``Unknown`` for a null or absent category."""
    return df.withColumns(_categories(df))


def clean_posts(raw: DataFrame, formats: Iterable[str] = ()) -> DataFrame:
    """The whole cleaner: one projection and one filter, extra columns kept."""
    if not raw.columns:
        return raw.sparkSession.createDataFrame([], CLEAN_SCHEMA)
    posts = normalize_columns(raw)
    steps = {**_date(posts, formats), **_engagements(posts), **_categories(posts)}
    return drop_invalid_dates(posts.withColumns(steps))


def cleaning_outcome(
    raw: DataFrame, by: Iterable[str] = (), formats: Iterable[str] = ()
) -> DataFrame:
    """What cleaning does to ``raw``, in one aggregate, per campaign if ``by`` is given.

    ``rows_in``, ``rows_without_date`` (dropped), ``rows_kept``, ``bad_engagements`` (kept
    rows whose value is no finite number and became 0), ``null_engagements`` (likewise
    null), and ``engagements_absent``.  ``rows_kept`` 0 means that nothing valid is left.
    """
    marked, counts = _marked(raw, formats)
    return marked.groupBy(*[quoted(c) for c in by]).agg(*counts)


def observed_posts(raw: DataFrame, observation: Observation, formats: Iterable[str] = ()) -> DataFrame:
    """``clean_posts`` that tells ``observation`` the outcome as its rows pass by."""
    marked, counts = _marked(raw, formats)
    return drop_invalid_dates(marked.observe(observation, *counts).drop(_GIVEN))


_GIVEN = "_given_engagements"


def _marked(raw: DataFrame, formats: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """Posts before undated ones go, with the engagements as given, and what to count of them."""
    posts = normalize_columns(raw)
    absent = "engagements" not in posts.columns
    text = "engagements" if not absent else "cast(null as string)"
    steps = {**_date(posts, formats), **_engagements(posts), **_categories(posts)}
    marked = posts.withColumn(_GIVEN, F.expr(f"cast({text} as string)")).withColumns(steps)
    bad = f"{_GIVEN} is not null and not coalesce(rlike({_GIVEN}, {sql_text(NUMBER)}) and abs(try_cast({_GIVEN} as double)) < double('infinity'), false)"
    kept = "date is not null"
    return marked, [
        F.count("*").alias("rows_in"),
        F.count_if(F.expr("date is null")).alias("rows_without_date"),
        F.count_if(F.expr(kept)).alias("rows_kept"),
        F.count_if(F.expr(f"{kept} and {bad}")).alias("bad_engagements"),
        F.count_if(F.expr(f"{kept} and {_GIVEN} is null")).alias("null_engagements"),
        F.lit(absent).alias("engagements_absent"),
    ]


def quarantine(raw: DataFrame, formats: Iterable[str] = ()) -> DataFrame:
    """The posts that cleaning drops, one row each: ``file, record, reason``.

    Cleaned posts and these are all rows of ``raw``; for a CSV upload these and its
    rejects are all that is left out.  ``file`` and ``record`` are those of
    ``read_posts_csv`` with ``origin``; without them ``file`` is null and ``record`` the row as
    JSON, null values included.
    """
    posts = normalize_columns(raw)
    given = posts.withColumn("_given", F.col("date").cast("string") if "date" in posts.columns else F.lit(None))
    undated = given.withColumns(_date(posts, formats)).where("date is null")
    row = F.struct(*[F.col("_given").alias("date") if c == "date" else quoted(c) for c in posts.columns])
    whole = F.to_json(row, {"ignoreNullFields": "false"})
    has = set(posts.columns)
    return undated.select(
        F.col("source_file") if "source_file" in has else F.lit(None).cast("string").alias("source_file"),
        F.coalesce("source_record", whole) if "source_record" in has else whole,
        F.when(F.col("_given").isNull(), F.lit("no date")).otherwise(F.concat(F.lit("not a date: "), F.col("_given"))),
    ).toDF("file", "record", "reason")
