"""Packing examples into training sequences under several limits at once.

A sequence has limits on tokens, on segments and on loss-bearing tokens.  It is
filled by a dot-product rule: of the waiting examples that fit, the one whose
sizes, as shares of the limits, have the largest dot product with what the
sequence has left.  Where no example fits and cutting is allowed, the first part
of one fills the gap.

Each task packs the examples it reads, so nothing is shuffled; only its last
sequences stay part empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, text_steps
from .common import give_back_memory, text_or_empty

# Examples looked at when one is chosen; the others wait their turn.
POOL = 512
STEP_BYTES = 16 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024

    def shares(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.float64)


@dataclass
class Example:
    """Token ids of one example, and which of them bear loss."""

    key: int | None
    ids: np.ndarray
    loss: np.ndarray
    start: int = 0
    total: int = 0
    loss_sums: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.total = self.total or len(self.ids)
        self.loss_sums = np.concatenate([[0], np.cumsum(self.loss)])

    def split(self, size: int) -> tuple[Example, Example]:
        return (
            Example(self.key, self.ids[:size], self.loss[:size], self.start, self.total),
            Example(self.key, self.ids[size:], self.loss[size:], self.start + size, self.total),
        )


def _sizes(examples: list[Example]) -> np.ndarray:
    """Tokens, segments and loss tokens of each example."""
    return np.array([(len(x.ids), 1, x.loss_sums[-1]) for x in examples], np.float64).reshape(-1, 3)


class Packer:
    """Takes examples one by one and gives sequences, lists of examples."""

    def __init__(self, limits: Limits = Limits(), cut: bool = True, pool: int = POOL):
        self.limits, self.cut, self.pool = limits, cut, pool
        self._waiting: list[Example] = []
        # The sizes of the waiting examples, row by row.
        self._sizes = _sizes([])

    def _largest_part(self, example: Example, room: np.ndarray) -> int:
        """Tokens from the start of ``example`` that fit into ``room``."""
        by_loss = int(np.searchsorted(example.loss_sums, room[2], "right")) - 1
        return max(0, min(int(room[0]), by_loss, len(example.ids)))

    def _sequence(self) -> list[Example]:
        room, placed, free = self.limits.shares(), [], np.ones(len(self._waiting), bool)
        scaled = self._sizes / self.limits.shares() ** 2
        while free.any():
            fits = free & (self._sizes <= room).all(axis=1)
            if not fits.any():
                break
            scores = np.where(fits, scaled @ room, -1.0)
            best = int(scores.argmax())
            placed.append(self._waiting[best])
            room -= self._sizes[best]
            free[best] = False
        left = np.flatnonzero(free)
        rest, sizes = [self._waiting[i] for i in left], self._sizes[left]
        if self.cut and rest and room[0] > 0 and room[1] > 0:
            longest = int(sizes[:, 0].argmax())
            size = self._largest_part(rest[longest], room)
            if size:
                first, other = rest[longest].split(size)
                placed.append(first)
                rest[longest] = other
                sizes[longest] = _sizes([other])
        elif not placed and rest:
            raise ValueError("an example exceeds the limits and may not be cut")
        self._waiting, self._sizes = rest, sizes
        return placed

    def add(self, examples: list[Example]) -> Iterator[list[Example]]:
        """Sequences that are ready once ``examples`` wait too."""
        at = 0
        while at < len(examples):
            more = examples[at : at + self.pool - len(self._waiting)]
            at += len(more)
            self._waiting = self._waiting + more
            self._sizes = np.concatenate([self._sizes, _sizes(more)])
            while len(self._waiting) >= self.pool:
                yield self._sequence()

    def finish(self) -> Iterator[list[Example]]:
        while self._waiting:
            yield self._sequence()


_PIECES = (
    "doc_id long, start long, length long, doc_tokens long, loss_tokens long,"
    " sequence_id long, offset long, ids binary"
)


class _Output:
    """Numbers the sequences of one task and makes rows of their pieces."""

    def __init__(self) -> None:
        self.next = TaskContext.get().partitionId() << 36
        self.rows: list[tuple] = []

    def add(self, sequence: list[Example]) -> None:
        offset = 0
        for x in sequence:
            own = len(x.ids)
            self.rows.append(
                (x.key, x.start, own, x.total, int(x.loss_sums[-1]), self.next, offset, x.ids.astype("<u4").tobytes())
            )
            offset += own
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = [c.split()[0] for c in _PIECES.split(",")]
        columns = zip(*self.rows) if self.rows else [[]] * 8
        made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
        self.rows = []
        return made


def pack_documents(
    docs: DataFrame,
    limits: Limits = Limits(),
    end_id: int = 0,
    tokenizer_dir: str | None = None,
    step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """Pieces of all texts, packed: one row per piece with its ids.

    A null text is empty and gives a piece of its end id alone.  Every token bears
    loss.  Rows that repeat are packed each by itself; a null ``doc_id`` stays
    null; an empty table gives no piece.  Whole sequences are cut off a long text
    first; what is left of it is packed with others.  ``step_bytes`` of text are encoded
    at a time: more is faster, because equal words of a step are encoded once, and takes
    about thirty times as much memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, out = ByteBpe(tokenizer_dir), Packer(limits), _Output()
        end = np.array([end_id], np.uint32)
        most = min(limits.tokens, limits.loss_tokens)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, texts in text_steps(batch.column(1), step_bytes):
                ids, ends = bpe.encode(texts)
                examples = []
                for i, own in enumerate(np.split(ids, ends[:-1])):
                    own = np.concatenate([own, end])
                    whole = len(own) // most * most
                    for at in range(0, whole, most):
                        piece = own[at : at + most]
                        out.add([Example(doc_ids[start + i], piece, np.ones(most, bool), at, len(own))])
                    if whole < len(own):
                        rest = own[whole:]
                        examples.append(Example(doc_ids[start + i], rest, np.ones(len(rest), bool), whole, len(own)))
                for sequence in packer.add(examples):
                    out.add(sequence)
                yield out.batch()
        for sequence in packer.finish():
            out.add(sequence)
        yield out.batch()
        give_back_memory()

    read = docs.select(docs["doc_id"].cast("long"), text_or_empty(docs).alias("text"))
    return read.mapInArrow(run, _PIECES)


def pack_conversations(
    turns: DataFrame,
    limits: Limits = Limits(),
    end_id: int = 0,
    loss_role: str = "assistant",
    tokenizer_dir: str | None = None,
) -> DataFrame:
    """Instruction data: one example per turn, only ``loss_role`` bears loss.

    ``key`` is the ``conv_id``; turns with the same id are examples of their own, so
    a conversation of any length needs no gathering.  Turns longer than a sequence
    are cut.  Null text is empty, a null role bears no loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, out = ByteBpe(tokenizer_dir), Packer(limits), _Output()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys, bears = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for start, texts in text_steps(batch.column(1)):
                ids, ends = bpe.encode(texts)
                examples = []
                for i, own in enumerate(np.split(ids, ends[:-1])):
                    own = np.concatenate([own, end])
                    loss = np.full(len(own), bool(bears[start + i]))
                    examples.append(Example(keys[start + i], own, loss))
                for sequence in packer.add(examples):
                    out.add(sequence)
                yield out.batch()
        for sequence in packer.finish():
            out.add(sequence)
        yield out.batch()

    read = turns.select(
        turns["conv_id"].cast("long").alias("key"),
        text_or_empty(turns).alias("text"),
        F.coalesce(turns["role"] == loss_role, F.lit(False)).alias("bears"),
    )
    return read.mapInArrow(run, _PIECES)


def packing_report(docs: DataFrame, step_bytes: int = STEP_BYTES) -> DataFrame:
    """The pieces with a checksum in place of their ids; rows as in ``pack_documents``."""
    return pack_documents(docs, step_bytes=step_bytes).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
