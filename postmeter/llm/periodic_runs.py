"""Runs of words that repeat with a period, found through string synchronising sets.

A run is a stretch of words that are equal to those ``period`` places on, with the
smallest such period, of at least ``LEAST_POWER`` periods and ``LEAST_LENGTH`` words,
that no neighbouring word prolongs.

At each scale t = 1, 2, 4, ... every position has the hash of its t words.  A
position is in the synchronising set if the least hash of the t + 1 positions from
it on is that of the first or of the last: a choice that depends on the 2t words
there alone, so a run repeats its chosen positions with its period.  Two chosen
positions in a row with the same 2t words, at a distance from t to 2t, propose that
distance as a period; the proposal is compared word by word and prolonged both ways.
Stretches of t words with a period of t/4 or less have no hash at that scale.  They
lie in runs that smaller scales have found, which supply those periods.

A batch of texts is one array of word numbers in which a number of its own ends each
text, so nothing runs over from text to text, and all steps are numpy calls on the
whole batch.  Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import text_steps
from .common import text_or_empty

LEAST_LENGTH = 6
LEAST_POWER = 4
# Bytes of text looked at a time; the arrays of one step take about thirty times as much.
_STEP = 4 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers; the largest is kept free."""
    for shift, factor in zip((30, 27), _MULTIPLIERS):
        x = (x ^ (x >> np.uint64(shift))) * factor
    x ^= x >> np.uint64(31)
    x[x == _NONE] = 0
    return x


def _later(x: np.ndarray, places: int) -> np.ndarray:
    """What stands ``places`` further on; the largest number past the end."""
    out = np.full(len(x), _NONE)
    if places < len(x):
        out[:-places] = x[places:]
    return out


def _least_of_next(x: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` numbers from each position on, by blocks of that width."""
    blocks = -(-(len(x) + width) // width)
    padded = np.full(blocks * width, _NONE)
    padded[: len(x)] = x
    rows = padded.reshape(blocks, width)
    from_left = np.minimum.accumulate(rows, axis=1).ravel()
    to_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_right[: len(x)], from_left[width - 1 : width - 1 + len(x)])


def _reach(words: np.ndarray, i: int, period: int, step: int) -> int:
    """First place from ``i`` on, in direction ``step``, that differs from that a period on."""
    size = 64
    while True:
        if step > 0:
            stop = min(i + size, len(words) - period)
            unlike = words[i:stop] != words[i + period : stop + period]
            end = len(words) - period
        else:
            stop = max(i + 1 - size, 0)
            unlike = (words[stop : i + 1] != words[stop + period : i + 1 + period])[::-1]
            end = -1
        if unlike.any():
            return i + step * int(unlike.argmax())
        i += step * len(unlike)
        if i == end:
            return end
        size *= 4


def _prolonged(words: np.ndarray, at: np.ndarray, periods: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of the stretches around the proposals, sorted by period and place."""
    found: list[tuple[int, int, int]] = []
    last, upto = 0, -1
    for i, period in zip(at.tolist(), periods.tolist()):
        if period == last and i < upto:
            continue
        right = _reach(words, i, period, 1)
        last, upto = period, max(right, i + 1)
        if right == i:
            continue
        start = _reach(words, i, period, -1) + 1
        if right + period - start >= LEAST_POWER * period:
            found.append((start, right + period, period))
    return found


def find_runs(words: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Rows ``start, end, period`` of all runs of at least ``LEAST_POWER`` periods.

    ``words`` holds the texts one after the other, each followed by a number that
    occurs nowhere else; ``text_ends`` are the places after those.
    """
    lengths = np.diff(text_ends, prepend=0) - 1
    where = np.arange(len(words))
    hashes = _mix(words.astype(np.uint64) + np.uint64(1))
    runs: list[tuple[int, int, int]] = []
    scale = 1
    while True:
        # Texts too short for a run at this scale take no further part.
        long_enough = lengths >= LEAST_POWER * scale
        if not long_enough.any():
            break
        if not long_enough.all():
            kept = np.repeat(long_enough, lengths + 1)
            words, hashes, where = words[kept], hashes[kept], where[kept]
            lengths = lengths[long_enough]
        context = _mix(hashes * _MULTIPLIERS[0] + _later(hashes, scale))
        own = hashes
        small = [(s, e) for s, e, p in runs if p * LEAST_POWER <= scale <= e - s]
        if small:
            starts, ends = np.array(small).T
            edges = np.zeros(len(where) + 1, np.int64)
            first = np.searchsorted(where, starts)
            inside = (first < len(where)) & (where[np.minimum(first, len(where) - 1)] == starts)
            np.add.at(edges, first[inside], 1)
            np.add.at(edges, first[inside] + (ends - starts)[inside] - scale + 1, -1)
            own = np.where(np.cumsum(edges[:-1]) > 0, _NONE, hashes)
        least = _least_of_next(own, scale + 1)
        chosen = np.flatnonzero((least < _NONE) & ((own == least) | (_later(own, scale) == least)))
        order = np.argsort(context[chosen], kind="stable")
        at = chosen[order]
        gap = np.diff(at)
        pairs = (np.diff(context[at]) == 0) & (gap >= scale) & (gap < 2 * scale)
        at, gap = at[:-1][pairs], gap[pairs]
        order = np.lexsort((at, gap))
        runs += [
            (int(where[s]), int(where[s]) + e - s, p) for s, e, p in _prolonged(words, at[order], gap[order])
        ]
        hashes = context
        scale *= 2
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


@dataclass
class _Found:
    """Runs of a batch of texts: the text of each, and places counted from its start."""

    words: pa.Array
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray

    def collapsed(self) -> pa.Array:
        """Each text with the words that no run repeats, joined by one space."""
        edges = np.zeros(len(self.words) + 1, np.int64)
        base = self.offsets[self.doc] + self.start
        np.add.at(edges, base + self.period, 1)
        np.add.at(edges, base + self.length, -1)
        kept = np.cumsum(edges[:-1]) == 0
        places = np.concatenate([[0], np.cumsum(kept)])[self.offsets]
        words = self.words.filter(pa.array(kept))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), words), " ")


def _runs_of(texts: pa.Array) -> _Found:
    split = pc.ascii_split_whitespace(texts)
    raw = split.offsets.to_numpy().astype(np.int64)
    words = split.values.slice(raw[0], raw[-1] - raw[0]).cast(pa.string())
    # White space at the ends of a text gives empty words.
    real = pc.greater(pc.binary_length(words), 0)
    offsets = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[raw - raw[0]]
    words = words.filter(real)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = len(texts)
    ended = np.empty(len(codes) + count, np.int64)
    text_ends = offsets[1:] + np.arange(1, count + 1)
    inner = np.ones(len(ended), bool)
    inner[text_ends - 1] = False
    ended[inner] = codes
    ended[text_ends - 1] = len(coded.dictionary) + np.arange(count)
    runs = find_runs(ended, text_ends)
    runs = runs[runs[:, 1] - runs[:, 0] >= LEAST_LENGTH]
    doc = np.searchsorted(text_ends, runs[:, 0], "right")
    begin = np.concatenate([[0], text_ends])[doc]
    return _Found(words, offsets, doc, runs[:, 0] - begin, runs[:, 1] - runs[:, 0], runs[:, 2])


def _own_columns(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long"), text_or_empty(docs).alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, period`` of every run, in words counted from 0.

    A null text has no words.  Rows are independent, so repeated rows give their runs
    each and a null ``doc_id`` stays null; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_steps(batch.column(1), _STEP):
                f = _runs_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(f.doc + first)), pa.array(f.start), pa.array(f.length), pa.array(f.period)],
                    ["doc_id", "start", "length", "period"],
                )

    return _own_columns(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeats cut: of every run only the first period stays in ``text``.

    All columns and rows stay.  A text with a run becomes its kept words joined by one
    space; others, null ones too, stay as they are.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    text = plain[docs.columns.index("text")]
    renamed = docs.toDF(*plain).withColumn("text", F.col(text).cast("string"))
    schema = renamed.drop("text").withColumn(text, F.col(text).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_steps(batch.column(len(plain)), _STEP):
                f = _runs_of(texts)
                changed = np.zeros(len(texts), bool)
                changed[f.doc] = True
                given = batch.slice(first, len(texts))
                cut = pc.if_else(pa.array(changed), f.collapsed(), given.column(len(plain)))
                yield pa.RecordBatch.from_arrays(
                    [cut if name == text else given.column(i) for i, name in enumerate(plain)], plain
                )

    return renamed.mapInArrow(run, schema).toDF(*docs.columns)


_REPORT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long,"
    " runs_sha256 string, collapsed_sha256 string"
)


def _digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def runs_report(docs: DataFrame) -> DataFrame:
    """One row per document: its runs, the one of most periods, and checksums.

    ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the run with the
    largest length by period, of equals the one that starts first and then the shortest
    period; null without a run.  ``runs_sha256`` covers all runs, ``collapsed_sha256`` the
    text without the repeats.  Null is an empty text; repeated rows, null ids and empty
    tables as in ``periodic_runs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_steps(batch.column(1), _STEP):
                f, count = _runs_of(texts), len(texts)
                bounds = np.searchsorted(f.doc, np.arange(count + 1))
                best: list[tuple] = [(None,) * 4] * count
                listed = [_digest("")] * count
                for doc in np.unique(f.doc).tolist():
                    own = slice(bounds[doc], bounds[doc + 1])
                    rows = list(zip(f.start[own].tolist(), f.length[own].tolist(), f.period[own].tolist()))
                    start, length, period = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
                    best[doc] = (start, length, period, 1000 * length // period)
                    listed[doc] = _digest("".join(f"{s},{n},{p}\n" for s, n, p in sorted(rows, key=lambda r: (r[0], r[2]))))
                whole = [_digest(t) for t in f.collapsed().to_pylist()]
                columns = [
                    ids.slice(first, count),
                    pa.array(np.diff(bounds)),
                    *[pa.array([b[k] for b in best], pa.int64()) for k in range(4)],
                    pa.array(listed),
                    pa.array(whole),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _REPORT.split(",")])

    return _own_columns(docs).mapInArrow(run, _REPORT)


def plant_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a run planted in about a tenth of the texts.

    With h the crc32 of the decimal id, g = h div 10, and n > 0 words: where h divides by
    ten, each word from a = g mod n on becomes the one at the same place of the first
    p = 1 + (n - a) div (3 + g mod 8) words from there.  The words are then joined by
    spaces.  A null id has no hash, so its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " ")

    own = _own_columns(docs)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # As the variable of a lambda the words are split once, not once per word.
    once = F.get(F.transform(F.array(words), planted), 0)
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return own.withColumn("text", F.when(chosen, once).otherwise(F.col("text")))
