"""Records of CSV files by byte ranges, with line breaks inside quotes.

A range owns the records that start in it.  Whether its first line starts a record or
lies inside a quoted cell follows from all bytes before it, so a first job takes from
every range of a long file two bits: whether it ends inside a quote if it starts
outside, and if it starts inside.  Chaining these gives each range its start, and a
second job reads all ranges apart.  A third reads headers: one record per file.

All three are one Python data source, because Spark's readers give no byte positions.
It opens files through pyarrow; see ``can_open``.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
# Beyond so many ranges they are made longer, up to RANGE_BYTES.
MOST_RANGES = 128
# Headers read by one task.
BUNDLE_FILES = 256
_CHUNK = 4 << 20
_HEADER_CHUNK = 64 << 10
_BOM = b"\xef\xbb\xbf"

# A quoted cell up to its closing quote, and what a line does with cells of its own.
_INNER = rb'[^"]*+(?:""[^"]*+)*+'
_REST = rb'(?:"' + _INNER + rb'"[^,]*+,|[^",][^,]*+,|,)*+"' + _INNER + rb"\Z"
_OPENS = re.compile(_REST)
_STAYS = re.compile(_INNER + rb'(?:\Z|"[^,]*+,' + _REST + rb")")
_QUOTED = re.compile(rb'"' + _INNER + rb'"')


def _inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``."""
    if b'"' not in line:
        return inside
    return (_STAYS if inside else _OPENS).match(line) is not None


def _open(path: str) -> pa.NativeFile:
    scheme, _, rest = path.partition(":")
    if "/" in scheme or not rest:
        return pafs.LocalFileSystem().open_input_file(path)
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    place, _, inner = rest.removeprefix("//").partition("/")
    store, base = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{place}/")
    return store.open_input_file(f"{base.rstrip('/')}/{inner}")


def can_open(path: str) -> bool:
    """Whether Python opens the file: local and shared folders, and stores that pyarrow knows."""
    try:
        _open(path).close()
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False
    return True


def _lines(file: pa.NativeFile, start: int, chunk: int) -> Iterator[tuple[int, bytes]]:
    """``(place, lines)``: whole lines from the first that starts at ``start`` or later."""
    at = max(start - 1, 0)
    file.seek(at)
    rest, skip = b"", start > 0
    while True:
        data = file.read(chunk)
        whole = rest + data
        if skip:
            cut = whole.find(b"\n") + 1
            if not cut and data:
                at, rest = at + len(whole), b""
                continue
            if not cut:
                return
            at, whole, skip = at + cut, whole[cut:], False
        end = whole.rfind(b"\n") + 1 if data else len(whole)
        if end:
            yield at, whole[:end]
        at, rest = at + end, whole[end:]
        if not data:
            return
        # A line longer than the chunk is put together in growing steps.
        chunk = max(chunk, len(rest))


def _enough(start: int, end: int, chunk: int) -> int:
    """Bytes to read at a time: of a short range no more than itself and the end of its last record."""
    return min(chunk, max(end - start, 0) + _HEADER_CHUNK)


def _each(lines: bytes) -> list[bytes]:
    own = lines.split(b"\n")
    return own if own[-1] else own[:-1]


def _upto(place: int, lines: bytes, end: int) -> tuple[bytes, bytes]:
    """``lines`` cut after the last that starts before ``end``."""
    if place >= end:
        return b"", lines
    cut = lines.find(b"\n", end - 1 - place) + 1
    return (lines[:cut], lines[cut:]) if cut else (lines, b"")


def range_outcomes(path: str, start: int, end: int, chunk: int = _CHUNK) -> tuple[bool, bool]:
    """Whether the lines that start in the range end inside a quote, from outside and from inside."""
    outside, inside = False, True
    with _open(path) as file:
        for place, lines in _lines(file, start, _enough(start, end, chunk)):
            own, more = _upto(place, lines, end)
            if b'"' in own:
                for line in _each(own):
                    if b'"' in line:
                        same = outside == inside
                        outside = _inside_after(line, outside)
                        inside = outside if same else _inside_after(line, inside)
            if more or place >= end:
                break
    return outside, inside


def records(path: str, start: int, end: int, inside: bool, chunk: int = _CHUNK) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of ``(place, record)`` that start in the range, the last read to its end.

    ``inside`` says that the first line of the range is inside a quoted cell.  Blank
    lines between records are no records.
    """
    begun: list[bytes] | None = None
    since = 0
    with _open(path) as file:
        for place, lines in _lines(file, start, _enough(start, end, chunk)):
            out: list[tuple[int, bytes]] = []
            own, more = _upto(place, lines, end)
            if own and not inside and b'"' not in own:
                each = _each(own)
                sizes = np.fromiter(map(len, each), np.int64, len(each)) + 1
                out += [(p, x) for p, x in zip((place + np.cumsum(sizes) - sizes).tolist(), each) if x.strip()]
            else:
                at = place
                for line in _each(own):
                    now = _inside_after(line, inside)
                    if inside:
                        if begun is not None:
                            begun.append(line)
                            if not now:
                                out.append((since, b"\n".join(begun)))
                                begun = None
                    elif now:
                        begun, since = [line], at
                    elif line.strip():
                        out.append((at, line))
                    inside, at = now, at + len(line) + 1
            if begun is not None:
                for line in _each(more):
                    begun.append(line)
                    inside = _inside_after(line, inside)
                    if not inside:
                        out.append((since, b"\n".join(begun)))
                        begun = None
                        break
            yield out
            if begun is None and (more or place + len(lines) >= end):
                return
    if begun is not None:
        yield [(since, b"\n".join(begun))]


def first_record(path: str, chunk: int = _HEADER_CHUNK) -> tuple[str, bool, int]:
    """The first record that is not blank, whether lines end in a bare CR, and the bytes read."""
    with _open(path) as file:
        data, size = b"", file.size()
        while True:
            more = file.read(chunk)
            data += more
            text = data.removeprefix(_BOM)
            begun: list[bytes] = []
            inside = False
            lines = text.split(b"\n")
            # What follows the last line end may go on in the next chunk.
            for line in lines if not more or len(data) >= size else lines[:-1]:
                if not inside and not line.strip():
                    continue
                begun.append(line)
                inside = _inside_after(line, inside)
                if not inside:
                    break
            if begun and not inside or not more:
                record = b"\n".join(begun).removesuffix(b"\r")
                old = _bare_cr(record)
                return (record if old < 0 else record[:old]).decode("utf-8", "replace"), old >= 0, len(data)
            if b"\n" not in text and (old := _bare_cr(text[:-1])) > 0:
                return text[:old].decode("utf-8", "replace"), True, len(data)
            chunk *= 2


def _bare_cr(record: bytes) -> int:
    """Place of a CR outside quotes that ends a line on its own, or -1."""
    plain = _QUOTED.sub(lambda m: b"x" * len(m.group()), record)
    found = re.search(rb"\r(?!\n)", plain)
    return found.start() if found else -1


@dataclass
class _Bundle(InputPartition):
    """What one task reads: ``(path, start, end, inside)`` each."""

    ranges: list[tuple[str, int, int, bool]]


_SCHEMAS = {
    "header": "file string, header string, old_line_ends boolean, bytes_read long",
    "outcomes": "file string, start long, outside boolean, inside boolean",
    "records": "file string, place long, record string",
}


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.mode = options["mode"]
        self.bundles = [_Bundle([tuple(r) for r in b]) for b in json.loads(options["bundles"])]
        self.expected = json.loads(options.get("header", "null"))
        self.sizes = json.loads(options.get("sizes", "{}"))

    def partitions(self) -> Sequence[InputPartition]:
        return self.bundles

    def __getstate__(self) -> dict:
        # Every task is sent the reader, and its own bundle beside it.
        return self.__dict__ | {"bundles": []}

    def read(self, partition: _Bundle) -> Iterator[tuple | pa.RecordBatch]:
        for path, start, end, inside in partition.ranges:
            if self.mode == "header":
                yield (path, *first_record(path))
            elif self.mode == "outcomes":
                yield (path, start, *range_outcomes(path, start, end))
            else:
                yield from self._records(path, start, end, inside)

    def _records(self, path: str, start: int, end: int, inside: bool) -> Iterator[pa.RecordBatch]:
        head = start == 0
        for found in records(path, start, end, inside):
            texts = [r.removesuffix(b"\r").decode("utf-8", "replace") for _, r in found]
            places = [p for p, _ in found]
            if head and texts:
                self._check(path, texts[0].removeprefix("﻿"))
                texts, places, head = texts[1:], places[1:], False
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(texts)), pa.array(places, pa.int64()), pa.array(texts, pa.string())],
                    ["file", "place", "record"],
                )

    def _check(self, path: str, header: str) -> None:
        if self.expected is not None:
            found = cells(header)
            if [c.lower() for c in found] != [c.lower() for c in self.expected]:
                raise ValueError(f"{path} has the header {found}, not {self.expected}")


class CsvRecords(DataSource):
    """Options: ``mode`` (a key of the schemas) and ``bundles``, JSON lists of ranges."""

    @classmethod
    def name(cls) -> str:
        return "postmeter_csv_records"

    def schema(self) -> str:
        return _SCHEMAS[self.options["mode"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def cells(header: str) -> list[str]:
    """The cells of a header record; one without a name is named by its place."""
    own = next(csv.reader([header] if "\n" not in header else header.splitlines(keepends=True)), [])
    return [c if c else f"_c{i}" for i, c in enumerate(own)]


def _load(spark: SparkSession, mode: str, bundles: Sequence[Sequence], **options: str) -> DataFrame:
    spark.dataSource.register(CsvRecords)
    reader = spark.read.format(CsvRecords.name()).option("mode", mode).option("bundles", json.dumps(bundles))
    return reader.options(**options).load()


def header_records(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``file, header, old_line_ends, bytes_read``: the first record of each file, and no more."""
    whole = [(f, 0, 0, False) for f in files]
    return _load(spark, "header", [whole[i : i + BUNDLE_FILES] for i in range(0, len(whole), BUNDLE_FILES)])


def _bundled(ranges: Sequence[tuple[str, int, int, bool]], most: int) -> list[list[tuple]]:
    """Ranges in lists of about ``most`` bytes, so that small files share a task."""
    out: list[list[tuple]] = []
    held = most
    for r in ranges:
        size = r[2] - r[1]
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += size
    return out


def file_records(
    spark: SparkSession, sizes: Mapping[str, int], header: Sequence[str] | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``file, place, record`` of all records but the headers, ``place`` in bytes from the start.

    ``sizes`` are the files and their lengths.  Files longer than ``range_bytes`` are read
    by several tasks.  With ``header`` each file's own is compared with it.

    Each range costs a task its start, so more than ``MOST_RANGES`` are not made of a length
    below ``RANGE_BYTES``.
    """
    range_bytes = max(range_bytes, min(RANGE_BYTES, -(-sum(sizes.values()) // MOST_RANGES)))
    ranges = {
        f: [(at, min(at + range_bytes, size)) for at in range(0, size, range_bytes)] for f, size in sizes.items()
    }
    long = [(f, a, b, False) for f, own in ranges.items() if len(own) > 1 for a, b in own]
    outcomes = {}
    if long:
        found = _load(spark, "outcomes", _bundled(long, range_bytes))
        outcomes = {(r["file"], r["start"]): (r["outside"], r["inside"]) for r in found.collect()}
    started = []
    for f, own in ranges.items():
        inside = False
        for a, b in own:
            started.append((f, a, b, inside))
            if len(own) > 1:
                inside = outcomes[f, a][inside]
    return _load(spark, "records", _bundled(started, range_bytes), header=json.dumps(None if header is None else list(header)))
