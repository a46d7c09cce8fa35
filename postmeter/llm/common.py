"""What several corpus operators share: text folding and kept tables."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop_table, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TOKENIZER_DIR = "/opt/tokenizers"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is the faster of the two and does the same where every character
    is one byte; elsewhere it would fold accented letters too.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_or_empty(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def unused_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that the driver and all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_passing: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are deleted at the end, but for those kept as ``lasting``."""
    own: list[str] = []
    _passing.append(own)
    try:
        yield
    finally:
        _passing.remove(own)
        for path in own:
            drop_table(spark, path)


def keep(df: DataFrame, name: str, path: str | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared place and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the
    steps before, and what was numbered or drawn keeps its value.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    if _passing and not lasting:
        _passing[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Numbers of the rows of one file.
_FILE_ROWS = 1 << 40


def numbered_rows(docs: DataFrame, key: str, name: str, stored: bool = False) -> DataFrame:
    """``docs`` with the number of each row in a column ``key``, the same at every read.

    The numbers are drawn once, in a copy of the table.  A ``stored`` table is one that
    gives the same rows whenever it is read; where it comes from Parquet files, it needs
    no copy, and a row is numbered by its file and its place in it.
    """
    if stored and "_metadata" not in docs.columns:
        file, place = unused_name(docs, "file"), unused_name(docs, "place")
        try:
            placed = docs.select(
                "*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)
            )
        except AnalysisException:
            # Not from such files alone.
            pass
        else:
            paths = sorted(r[0] for r in placed.select(file).distinct().collect())
            numbers = docs.sparkSession.createDataFrame(list(enumerate(paths)), f"{key} long, {file} string")
            own = [f"`{c}`" for c in docs.columns]
            return placed.join(F.broadcast(numbers), file).select(
                *own, (F.col(key) * F.lit(_FILE_ROWS) + F.col(place)).alias(key)
            )
    return keep(docs.withColumn(key, F.monotonically_increasing_id()), name)


# Bits of a filter of hashes (2 MB), and of one row of it.
FILTER_BITS = 1 << 24
_ROW_BITS = 1 << 15


def _filter_place(column: str) -> tuple[Column, Column]:
    """The row of a hash in a filter, and its bit there."""
    slot = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    return F.shiftright(slot, 15), slot.bitwiseAND(F.lit(_ROW_BITS - 1))


def hash_filter(hashes: DataFrame, column: str) -> DataFrame:
    """A table of bits, set where a hash of ``column`` falls; its size is fixed."""
    row, bit = _filter_place(column)
    return hashes.groupBy(row.alias("filter_row")).agg(F.bitmap_construct_agg(bit).alias("filter_bits"))


def maybe_in(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose hash may be among those of the filter ``wanted``; none that is gets lost."""
    row, bit = _filter_place(column)
    place = df.withColumn("filter_row", row).withColumn("filter_bit", bit)
    byte = "conv(hex(substring(filter_bits, cast(shiftright(filter_bit, 3) as int) + 1, 1)), 16, 10)"
    found = place.join(F.broadcast(wanted), "filter_row").where(
        f"cast({byte} as int) & shiftleft(1, cast(filter_bit & 7 as int)) <> 0"
    )
    return found.select(*df.columns)


def drop_kept(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark._jvm
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_unused_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more.

    Spark does so when the driver's garbage is collected, which a driver with little to
    do may put off for half an hour while the files fill the executors' disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def give_back_memory() -> None:
    """Return freed memory of this Python worker to the system.

    Workers live on from stage to stage; what one stage freed but still holds counts
    against the next one beside the JVM.
    """
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Another C library has its own way.
        pass


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)
