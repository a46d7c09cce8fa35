"""Column expressions shared by the cleaner, the metrics and the texts.

Everything here is a built-in Spark expression: no Python UDF, no row order,
no dependence on other rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The markers a CSV reader with the usual data-frame defaults
# takes as "no value".
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Spark's casts are more lenient than the documented input form ('12:30' is
# today, '2023' is 1 January, '1.5f' is 1.5), so the text is checked first.
ISO_DATE = (
    "^ *[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    "([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)? *$"
)
NUMBER = "^ *[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)? *$"


def normalize_name(name: str) -> str:
    """Lower-case a header and put ``_`` for each space; nothing is trimmed."""
    return name.lower().replace(" ", "_")


def normalized_names(names: Sequence[str]) -> list[str]:
    """Normalise headers and refuse two that become the same name."""
    out = [normalize_name(n) for n in names]
    clashes = sorted({n for n in out if out.count(n) > 1})
    if clashes:
        raise ValueError(f"headers collide after normalisation: {', '.join(clashes)}")
    return out


def sql_name(name: str) -> str:
    """A column name as it stands in a SQL expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(text: str) -> str:
    """A text literal for a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> Column:
    """Column by its exact name, also when the name holds dots."""
    return F.col(sql_name(name))


# The expressions below are built as SQL text: one call to the JVM each, where
# a tree of Column calls takes dozens.


def null_if_token(name: str) -> Column:
    """Null where column ``name`` holds a standard null marker, else its text."""
    c = sql_name(name)
    markers = ", ".join(sql_text(t) for t in NULL_TOKENS)
    return F.expr(f"if({c} in ({markers}), null, {c})").alias(name)


def parse_date(name: str, dtype: T.DataType, formats: Iterable[str] = ()) -> Column:
    """Wall-clock timestamp in column ``name``, null where it is no date.

    ISO dates and date-times are read as they stand; a zone suffix is accepted
    and ignored.  ``formats`` (Spark datetime patterns) are tried after that, in
    order; an offset in them is ignored too, whatever the session time zone.
    """
    c = sql_name(name)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.expr(f"cast({c} as timestamp_ntz)")
    if not isinstance(dtype, T.StringType):
        c = f"cast({c} as string)"
    # The match is empty when the form is wrong, and that casts to null.
    tries = [f"try_cast(regexp_extract({c}, {sql_text(ISO_DATE)}, 0) as timestamp_ntz)"] + [
        # The first call only tells whether the text fits; the second keeps its wall clock.
        f"if(try_to_timestamp(trim({c}), {sql_text(f)}) is not null,"
        f" to_timestamp_ntz(trim({c}), {sql_text(f)}), null)"
        for f in formats
    ]
    return F.expr(tries[0] if len(tries) == 1 else f"coalesce({', '.join(tries)})")


def parse_engagements(name: str, dtype: T.DataType) -> Column:
    """Finite double in column ``name``; zero where it is null, no number or not finite."""
    c = sql_name(name)
    if isinstance(dtype, T.NumericType):
        number = f"cast({c} as double)"
    elif isinstance(dtype, T.BooleanType):
        number = f"cast(cast({c} as int) as double)"
    else:
        if not isinstance(dtype, T.StringType):
            c = f"cast({c} as string)"
        number = f"try_cast(regexp_extract({c}, {sql_text(NUMBER)}, 0) as double)"
    # NaN sorts above infinity in Spark, so one comparison drops both.
    return F.expr(f"coalesce(if(abs({number}) < double('infinity'), {number}, null), 0.0D)")


def day_text(day: str) -> str:
    """SQL for a date as ``YYYY-MM-DD``."""
    return f"date_format({day}, 'yyyy-MM-dd')"


def whole_text(number: str) -> str:
    """SQL for the whole part of a double as text, cut towards zero."""
    # Beyond 2^53 every double is whole, so the decimal cast only changes the type.
    return (
        f"coalesce(if(abs({number}) < 9007199254740992D, cast(try_cast({number} as bigint) as string), null),"
        f" cast(try_cast({number} as decimal(38,0)) as string), cast({number} as string))"
    )


def number_text(number: str) -> str:
    """SQL for a total as plain text: without decimals when it is whole, never with an exponent."""
    # A double with a fraction has at most sixteen digits before the point.
    plain = f"cast(try_cast(cast({number} as string) as decimal(38,18)) as string)"
    fraction = f"coalesce(rtrim('0', {plain}), cast({number} as string))"
    return f"if({number} % 1 = 0, {whole_text(number)}, {fraction})"


def percent_text(n: str, total: str) -> str:
    """SQL for ``n / total`` as a percentage with one decimal, halves rounded up.

    Whole-number arithmetic only, so the text does not depend on how a ratio is
    rounded in binary.
    """
    tenths = f"((2000 * {n} + {total}) div (2 * {total}))"
    return f"concat({tenths} div 10, '.', {tenths} % 10, '%')"


def order_columns(df: DataFrame, first: Sequence[str]) -> list[Column]:
    """``first`` and then every other sortable column: a total order of distinct rows."""
    rest = [
        f.name
        for f in df.schema.fields
        if f.name not in first and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return [quoted(c) for c in [*first, *rest]]
