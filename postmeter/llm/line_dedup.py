"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are one edit apart exactly if leaving one character out of one or both
gives the same text.  Each line therefore sends the hashes of all its texts with one
character left out; lines that meet at the same hash are compared, and of lines
within one edit the earliest stays.

Only lines that can have a neighbour send anything: one edit leaves the first or the
second half of a line as it was, so a line must share a half, at a matching length,
with another.  Equal lines are one line from the start, under their first place.

Two edits, where the length of the lines allows them, leave two quarters of a line as
they were, moved by two places at most; lines that share two quarters are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import text_steps
from .common import keep, text_or_empty, unused_name

_B = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_B, -1, 1 << 64))


def _spread(points: np.ndarray) -> np.ndarray:
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def deletion_hashes(line: str) -> np.ndarray:
    """Hash of ``line``, then of the line without its first, second, ... character.

    A polynomial in the place of each character, so that all of them take one pass.
    """
    values = _spread(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(values), _B, np.uint64)]))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:-1])])
    without = upto[:-1] + (upto[-1] - upto[1:]) * _INVERSE
    # The length is part of the hash.
    sizes = np.array([len(values), len(values) - 1]).astype(np.uint64) * np.uint64(_B)
    return np.concatenate([upto[-1:] + sizes[:1], without + sizes[1:]])


class Edits(NamedTuple):
    """How many edits make two lines one, by the length of the shorter of them.

    No edit below ``one_from`` characters, one from there, two from ``two_from`` (never
    if None).
    """

    one_from: int = 1
    two_from: int | None = None


# One edit at any length, as the report counts; by length, for texts that are cut.
ONE_EDIT = Edits()
BY_LENGTH = Edits(10, 60)


def _quarter_keys(size: str = "n") -> str:
    """SQL: hashes of what two edits may leave of ``line``, for each size of the longer line.

    For each pair of quarters of the longer line that may hold the edits: the text before,
    between and after them, where edits before a text have moved it.
    """
    keys = []
    for more in (0, 1, 2):
        whole = f"({size} + {more})"
        at = [f"({whole} * {i} div 4)" for i in range(5)]
        for p in range(3):
            for q in range(p + 1, 4):
                # What the first edit may do to the place of the text between.
                for moved in {0: (-1, 0, 1), 1: (-1, 0), 2: (-1,)}[more] if q > p + 1 else (0,):
                    keys.append(
                        f"xxhash64({p}, {q}, {whole}, left(line, {at[p]}),"
                        f" substring(line, {at[p + 1]} + {moved} + 1, {at[q]} - {at[p + 1]}), right(line, {whole} - {at[q + 1]}))"
                    )
    return f"array_distinct(array({', '.join(keys)}))"


def _two_edits(docs: DataFrame, distinct: DataFrame, two_from: int) -> DataFrame:
    """``h1, h2, near`` of the lines that a line within two edits precedes, both long enough."""
    lines = docs.select(F.explode(F.split(text_or_empty(docs), "\n")).alias("line")).where("trim(line) <> ''")
    long = lines.withColumn("n", F.char_length("line")).where(F.col("n") >= two_from)
    once = long.select(*[e.alias(a) for e, a in zip(_line_hash(), ("h1", "h2"))], "line", "n").groupBy("h1", "h2").agg(
        F.first("line").alias("line"), F.first("n").alias("n")
    )
    texts = keep(once.join(distinct.select("h1", "h2", "first"), ["h1", "h2"]), "long-lines")
    keyed = keep(texts.select("h1", "h2", "first", F.explode(F.expr(_quarter_keys())).alias("key")), "line-quarters")
    earlier = keyed.select("key", F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("before"))
    pairs = keyed.join(earlier, "key").where("before < first").select("h1", "h2", "o1", "o2").distinct()
    return (
        pairs.join(texts.select("h1", "h2", "line"), ["h1", "h2"])
        .join(texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("earlier")), ["o1", "o2"])
        .where("levenshtein(line, earlier, 2) between 0 and 2")
        .select("h1", "h2", F.lit(True).alias("near"))
        .distinct()
    )


def _occurrences(docs: DataFrame, one_from: int = 1) -> DataFrame:
    """Places of all lines with the hashes of the line and of its halves, no text."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"),
        F.split(text_or_empty(docs), "\n").alias("lines"),
    )
    lines = numbered.select("row", "doc_id", F.posexplode("lines").alias("pos", "line"))
    sized = lines.withColumn("n", F.char_length("line"))

    def halves(size: str) -> list[str]:
        # The longer of two neighbours has this size; its middle splits both.
        middle = f"(({size}) div 2)"
        return [
            f"xxhash64('first', {size}, left(line, {middle}))",
            f"xxhash64('last', {size}, right(line, {size} - {middle}))",
        ]

    return sized.select(
        "row", "doc_id", "pos", *[e.alias(a) for e, a in zip(_line_hash(), ("h1", "h2"))],
        (F.trim("line") == "").alias("blank"),
        # A line too short for an edit asks for no neighbour.
        F.expr(f"case when n >= {one_from} then array({', '.join(halves('n') + halves('n + 1'))}) end").alias("halves"),
    )


def _line_hash():
    return F.xxhash64(F.lit(1), "line"), F.xxhash64(F.lit(2), "line")


# Fixed size of the filter that picks the lines to fetch; 1 MB whatever the input.
FILTER_BITS = 1 << 23


def _maybe(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``lines (h1, h2, line)`` that may be in ``wanted (h1, ...)``: all that are, and few more.

    A filter of fixed size goes to every task, so that the lines that nobody asks for
    are not shuffled; the join that follows is exact.
    """
    bit = f"pmod(h1, {FILTER_BITS})"
    words = wanted.groupBy(F.expr(f"cast({bit} div 64 as int)").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 as int)))").alias("bits")
    ).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = lines.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % FILTER_BITS
            hit = shared.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    return lines.mapInArrow(run, lines.schema)


_VARIANTS = "late boolean, doc_id long, row long, pos int, h1 long, h2 long, variant long, gone int"


def _variants(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_steps(batch.column(6), 1 << 20):
                hashes = [deletion_hashes(t) for t in texts.to_pylist()]
                sizes = np.array([len(h) for h in hashes])
                own = np.repeat(np.arange(start, start + len(texts)), sizes)
                gone = np.concatenate([np.arange(-1, s - 1, dtype=np.int32) for s in sizes])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).take(pa.array(own)) for i in range(6)],
                        pa.array(np.concatenate(hashes).view(np.int64)),
                        pa.array(gone),
                    ],
                    [c.split()[0] for c in _VARIANTS.split(", ")],
                )

    found = lines.select("first.*", "h1", "h2", "line").mapInArrow(run, _VARIANTS)
    return found.select("h1", "h2", F.struct("late", "doc_id", "row", "pos").alias("first"), "variant", "gone")


def line_places(docs: DataFrame, edits: Edits = ONE_EDIT) -> DataFrame:
    """``row, doc_id, pos, stays`` of every line of every row of ``docs``.

    * Lines end at a line feed.  A blank line always stays and drops nothing.
    * A line is dropped if an equal line, or a line within the edits (a character
      added, left out or replaced) that ``edits`` allows for the shorter of both, starts earlier: by ``doc_id`` (null last), then by
      row, then by position.  Whether that line stays itself does not matter.
    * Null texts are empty: one blank line.  Rows are documents of their own, also
      with a repeated ``doc_id``.  An empty table gives an empty one.
    """
    # Below 12 characters a quarter is too small to be moved by two.
    if edits.one_from < 1 or edits.two_from is not None and edits.two_from < max(12, edits.one_from):
        raise ValueError(f"one edit counts from 1 character or more, two from 12 or more and not before one: {edits}")
    places = keep(_occurrences(docs, edits.one_from), "line-places")
    at = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "pos")
    distinct = keep(
        places.where("not blank").groupBy("h1", "h2").agg(
            F.min(at).alias("first"), F.first("halves").alias("halves")
        ),
        "lines",
    )
    halves = distinct.select("h1", "h2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").select("half")
    some = halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()
    asking = keep(distinct.select("h1", "h2", "first").join(some, ["h1", "h2"], "left_semi"), "asking-lines")
    all_lines = docs.select(F.explode(F.split(text_or_empty(docs), "\n")).alias("line")).where("trim(line) <> ''")
    hashed = all_lines.select(*[e.alias(a) for e, a in zip(_line_hash(), ("h1", "h2"))], "line")
    once = _maybe(hashed, asking).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts = keep(once.join(asking, ["h1", "h2"]), "asking-texts")
    sent = _variants(texts)
    # Lines that meet at a variant differ from it by one character each, so the group
    # is as small as the alphabet; no pairs are made.
    mine = F.struct("first", "h1", "h2")
    same_place = F.min(mine).over(Window.partitionBy("variant", "gone"))
    whole = F.min(F.when(F.col("gone") == -1, mine)).over(Window.partitionBy("variant"))
    shorter = F.min(F.when(F.col("gone") >= 0, mine)).over(Window.partitionBy("variant"))
    met = sent.select(
        "h1", "h2", "first",
        F.when(F.col("gone") == -1, shorter).otherwise(F.least(same_place, whole)).alias("other"),
    ).where("other.first < first")
    witness = met.groupBy("h1", "h2").agg(F.min("other").alias("other"))
    # The hash is only a meeting place: the edit distance decides.
    pairs = witness.select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    near = (
        pairs.join(texts.drop("first"), ["h1", "h2"])
        .join(texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("earlier")), ["o1", "o2"])
        .where("levenshtein(line, earlier, 1) between 0 and 1")
        .select("h1", "h2", F.lit(True).alias("near"))
    )
    if edits.two_from is not None:
        near = near.union(_two_edits(docs, distinct, edits.two_from)).distinct()
    verdict = keep(distinct.join(near, ["h1", "h2"], "left").select("h1", "h2", "first", "near"), "line-verdicts")
    stays = verdict.where("near is null").select(F.col("first.row").alias("row"), F.col("first.pos").alias("pos"), F.lit(True).alias("kept"))
    return places.join(stays, ["row", "pos"], "left").select(
        "row", "doc_id", "pos", F.expr("blank or kept is not null").alias("stays")
    )


def line_report(docs: DataFrame, edits: Edits = ONE_EDIT) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_kept, dropped`` (line numbers from 0, comma-joined)."""
    gone = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.col("pos"))))
    return (
        line_places(docs, edits)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.count("*").alias("n_lines"),
            F.count_if("stays").alias("n_kept"),
            F.array_join(gone.cast("array<string>"), ",").alias("dropped"),
        )
        .drop("row")
    )


def drop_lines(docs: DataFrame, edits: Edits = BY_LENGTH) -> DataFrame:
    """``docs`` with the text of each row cut down to the lines that stay.

    Short lines (list numbers, table cells, braces) go only if an equal line is earlier.
    """
    key = unused_name(docs, "row")
    numbered = keep(docs.withColumn(key, F.monotonically_increasing_id()), "line-docs")
    # The own row number ranks as the ids do where those are unique and ascending.
    gone = (
        line_places(numbered.select(F.col(key).alias("doc_id"), "text"), edits)
        .where("not stays").groupBy(F.col("doc_id").alias(key))
        .agg(F.collect_set("pos").alias("__gone"))
    )
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(__gone, i)), '\\n')")
    joined = numbered.join(gone, key, "left")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("text", text).drop(key, "__gone")
