"""Campaign posts from CSV files.

Columns are found by header, never by position, and nothing is inferred: every
value stays text until the cleaner looks at it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import normalized_names, quoted
from ..operators.clean import null_tokens
from ..schema import RAW_HEADERS, SOURCE_COLUMNS
from .csv_records import RANGE_BYTES, can_open, cells, file_records, header_records

ONLY_CSV = "*.[cC][sS][vV]"
_RECORD = "_malformed_record"
_END = "\u0001"


def _read_options(multi_line: bool, check_header: bool) -> dict[str, str]:
    return {
        "header": "true",
        "multiLine": str(multi_line).lower(),
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _RECORD,
        # Cells that are not parsed cannot be counted.
        "columnPruning": "false",
        "pathGlobFilter": ONLY_CSV,
        "enforceSchema": str(not check_header).lower(),
    }


def _text_schema(headers: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(h, T.StringType()) for h in [*headers, _RECORD]])


def _is_long(headers: Sequence[str]) -> Column:
    """True for a malformed record with more cells than headers.

    Spark marks short and long records alike.  A mark added as one more cell
    shows where the record ends: past the expected cells for a long one.
    """
    width = len(headers)
    # Spark refuses to read the record column alone, as a count would do; an
    # empty piece of the first cell keeps that column in the read.
    nothing = F.coalesce(F.substring(quoted(headers[0]), 1, 0), F.lit(""))
    cells = F.from_csv(
        F.concat(F.col(_RECORD), F.lit("," + _END), nothing),
        ", ".join(f"c{i} string" for i in range(width + 1)),
        {"escape": '"'},
    )
    extra = cells[f"c{width}"]
    ends_inside = reduce(
        lambda a, b: a | b,
        [F.coalesce(cells[f"c{i}"].contains(_END), F.lit(False)) for i in range(width + 1)],
    )
    return F.col(_RECORD).isNotNull() & (
        F.coalesce(extra != _END, F.lit(False)) | ~ends_inside
    )


def _split(
    read: DataFrame,
    headers: Sequence[str],
    strict: bool,
    file: Column,
    folders: Sequence[Column] = (),
    places: Sequence[Column] = (),
) -> tuple[DataFrame, DataFrame]:
    """Posts under their normalised names, and the records that do not fit."""
    too_long = _is_long(headers)
    if strict:
        message = F.concat(
            F.lit(f"record has more than {len(headers)} cells: "), F.col(_RECORD)
        )
        keep = F.when(too_long, F.raise_error(message).cast("boolean")).otherwise(True)
    else:
        keep = ~too_long
    posts = read.filter(keep).select(
        *[quoted(h).alias(n) for h, n in zip(headers, normalized_names(headers))], *folders, *places
    )
    rejects = read.filter(too_long).select(
        file.alias("file"),
        F.col(_RECORD).alias("record"),
        F.lit(f"more than {len(headers)} cells").alias("reason"),
    )
    return null_tokens(posts, SOURCE_COLUMNS), rejects


def _files(spark: SparkSession, path: str, recursive: bool) -> tuple[dict[str, int], list[str]]:
    """The ``.csv`` files with content and their sizes, and the names of ``name=value`` folders above them."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", ONLY_CSV)
        .option("recursiveFileLookup", True)
        .load(path)
        .filter("length > 0")
    )
    files = dict(sorted((r["path"], r["length"]) for r in listing.select("path", "length").collect()))
    if not files:
        raise ValueError(f"no .csv file with content in {path}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(jvm_path)
    depth = len([p for p in base.toUri().getPath().split("/") if p])
    names: dict[str, None] = {}
    for file in files:
        inner = [p for p in file.split(":", 1)[-1].split("/") if p][depth:-1]
        for folder in inner:
            if "=" in folder:
                names[folder.split("=", 1)[0]] = None
            elif not recursive:
                raise ValueError(f"{folder} holds .csv files; read it too with recursive=True")
    return files, list(names)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _folder_value(file: Column, name: str) -> Column:
    """Value of a ``name=value`` folder above the file, null if there is none."""
    # Writers escape the values in a path.
    value = _decoded(F.regexp_extract(file, f"/{re.escape(name)}=([^/]*)/", 1))
    return F.when(~value.isin("", "__HIVE_DEFAULT_PARTITION__"), value).alias(normalized_names([name])[0])


Layouts = dict[tuple[str, ...], list[str]]


def _layouts(spark: SparkSession, files: Iterable[str]) -> tuple[Layouts, set[str]]:
    """Header -> files, from the first record of each file, and the files with bare CR line ends."""
    layouts: Layouts = {}
    old: set[str] = set()
    for row in header_records(spark, list(files)).orderBy("file").collect():
        if row["header"].strip():
            layouts.setdefault(tuple(cells(row["header"])), []).append(row["file"])
        if row["old_line_ends"]:
            old.add(row["file"])
    return layouts, old


def _layouts_by_lines(spark: SparkSession, files: Iterable[str]) -> Layouts:
    """The same through Spark's reader, for stores that only it can open.

    It reads all lines; only the part of a file that starts it gives its first line, so
    ``first`` sees the lines in order.
    """
    lines = spark.read.text(list(files)).where("trim(value) <> '' and _metadata.file_block_start = 0")
    firsts = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.first("value").alias("line"))
    layouts: Layouts = {}
    for row in firsts.orderBy("file").collect():
        line = row["line"].removeprefix("\ufeff")
        if line.count('"') % 2:
            raise ValueError(f"a header with a line break; give headers for {row['file']}")
        # This column is encoded, what a reader is given is not.
        layouts.setdefault(tuple(cells(line)), []).append(unquote(row["file"]))
    return layouts


def _by_ranges(
    spark: SparkSession, header: Sequence[str], sizes: dict[str, int], named: bool, range_bytes: int
) -> DataFrame:
    """The cells of all records, whose files are read in byte ranges, and where each is from."""
    options = {k: v for k, v in _read_options(True, False).items() if k in ("escape", "mode", "columnNameOfCorruptRecord")}
    schema = ", ".join(f"`c{i}` string" for i in range(len(header))) + f", {_RECORD} string"
    found = file_records(spark, sizes, header if named else None, range_bytes)
    parsed = found.withColumn("_cells", F.from_csv("record", schema, options))
    return parsed.select(
        *[F.col(f"_cells.c{i}").alias(h) for i, h in enumerate(header)],
        F.col(f"_cells.{_RECORD}").alias(_RECORD),
        F.col("file").alias("source_file"),
        F.col("place").alias("source_place"),
        F.col("record").alias("source_record"),
    )


def _by_files(spark: SparkSession, header: Sequence[str], files: list[str], multi_line: bool, named: bool) -> DataFrame:
    """The same through Spark's reader, which gives neither place nor record."""
    read = (
        spark.read.options(**_read_options(multi_line, check_header=named))
        .schema(_text_schema(header))
        .csv(files)
    )
    return read.select(
        "*",
        _decoded(F.col("_metadata.file_path")).alias("source_file"),
        F.lit(None).cast("long").alias("source_place"),
        F.lit(None).cast("string").alias("source_record"),
    )


def read_posts_csv(
    spark: SparkSession,
    path: str,
    strict: bool = False,
    multi_line: bool = True,
    headers: Sequence[str] | None = None,
    recursive: bool = False,
    origin: bool = False,
    range_bytes: int = RANGE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Read the ``.csv`` files of ``path``: ``(posts, rejects)``.

    Standard null markers become null.  Short records are padded with null;
    records with too many cells go to ``rejects``, or make the read of the posts
    fail with ``strict``.

    The first record of every file is read first, and nothing else of it, so the files
    may hold different columns in different orders.  With ``headers`` all files have that
    header, and nothing is read first.  Exactly the files listed at the call are
    read, and each header is checked again when its file is read: a file that arrives
    or changes later is left out or makes the read fail.

    A ``name=value`` folder gives every post in it a column ``name``.  Other subfolders
    with ``.csv`` files are read with ``recursive`` and refused without.

    ``multi_line`` allows line breaks inside quotes.  Files longer than ``range_bytes`` are
    read by several tasks, after a job over them that finds where records start; of large
    uploads the ranges are longer (see ``file_records``).
    Without it Spark's line reader is used, which takes one pass.

    ``origin`` adds ``source_file`` to the posts, and ``source_place`` (byte at which the record
    starts) and ``source_record`` (its text) where files are read by ranges.

    Where only Spark can open a store, and for files whose lines end in a bare CR, its
    reader takes over: then ``multi_line`` means one task per file, and without
    ``headers`` all lines are read once to find the first ones.
    """
    sizes, folders = _files(spark, path, recursive)
    seekable = can_open(next(iter(sizes)))
    old: set[str] = set()
    if headers:
        layouts = {tuple(headers): list(sizes)}
    elif seekable:
        layouts, old = _layouts(spark, sizes)
    else:
        layouts = _layouts_by_lines(spark, sizes)
    if not layouts:
        raise ValueError("no header in any file")
    parts = []
    for header, own in layouts.items():
        normalized_names([*header, *folders])
        # A header cell without a name has none that could be checked.
        named = not any(h == f"_c{i}" for i, h in enumerate(header))
        by_range = [f for f in own if multi_line and seekable and f not in old]
        by_file = [f for f in own if f not in set(by_range)]
        reads = []
        if by_range:
            reads.append(_by_ranges(spark, header, {f: sizes[f] for f in by_range}, named, range_bytes))
        if by_file:
            reads.append(_by_files(spark, header, by_file, multi_line, named))
        file = F.col("source_file")
        from_ = [F.col(c) for c in SOURCE_COLUMNS] if origin else []
        parts += [_split(r, header, strict, file, [_folder_value(file, f) for f in folders], from_) for r in reads]
    posts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for p, _ in parts])
    rejects = reduce(DataFrame.unionByName, [r for _, r in parts])
    return posts, rejects


def stream_posts_csv(
    spark: SparkSession,
    path: str,
    headers: Sequence[str] = RAW_HEADERS,
    strict: bool = False,
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The same for a folder that keeps receiving files, all with ``headers``."""
    read = (
        spark.readStream.options(**_read_options(multi_line, check_header=True))
        .schema(_text_schema(headers))
        .csv(path)
    )
    return _split(read, headers, strict, F.col("_metadata.file_path"))
