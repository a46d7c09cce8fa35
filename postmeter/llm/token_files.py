"""Token ids in blocks of fixed-width bits.

Each id takes the fewest bits that hold the vocabulary.  A block starts with
its bit width and the end of each of its documents, so that one document is read
without its neighbours and a whole block is unpacked by one numpy expression.
Blocks are rows of a Parquet table: Spark's writer commits a task's blocks at
once, on any store, also when an executor is lost midway.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, text_steps
from .common import keep, text_or_empty

BLOCK_IDS = 1 << 17
BLOCK_DOCS = 1 << 12
_MAGIC = b"TKB1"
_HEAD = struct.Struct("<4sBIQ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` as one run of bits, ``width`` each, highest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids[:, None] >> shifts & 1).astype(np.uint8)).tobytes()


def unpack_bits(data: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on, as uint32."""
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(data, f">u{size}", count, start * size).astype(np.uint32)
    first, last = start * width, (start + count) * width
    raw = np.frombuffer(data, np.uint8)[first // 8 : -(-last // 8)]
    bits = np.unpackbits(raw)[first % 8 : first % 8 + count * width].reshape(count, width)
    return bits.astype(np.uint32) @ (1 << np.arange(width - 1, -1, -1, dtype=np.uint32))


def make_block(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    """A block of the documents that end at ``ends`` within ``ids``."""
    head = _HEAD.pack(_MAGIC, width, len(ends), len(ids))
    return head + ends.astype("<u8").tobytes() + pack_bits(ids, width)


def block_ends(block: bytes) -> np.ndarray:
    magic, _, docs, _ = _HEAD.unpack_from(block)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    return np.frombuffer(block, "<u8", docs, _HEAD.size).astype(np.int64)


def read_document(block: bytes, index: int) -> np.ndarray:
    """Ids of one document of a block; the others are not unpacked."""
    _, width, docs, _ = _HEAD.unpack_from(block)
    ends = block_ends(block)
    start = int(ends[index - 1]) if index else 0
    data = memoryview(block)[_HEAD.size + 8 * docs :]
    return unpack_bits(data, width, start, int(ends[index]) - start)


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, ends)`` of a whole block."""
    _, width, docs, count = _HEAD.unpack_from(block)
    return unpack_bits(memoryview(block)[_HEAD.size + 8 * docs :], width, 0, count), block_ends(block)


_BLOCKS = "part long, block long, before long, doc_ids array<long>, n_ids long, data binary"


def write_token_files(
    docs: DataFrame, path: str | None = None, end_id: int = 2, tokenizer_dir: str | None = None
) -> DataFrame:
    """Write the ids of all texts, each with ``end_id``, in ascending ``doc_id``.

    Null texts are empty, so only the end id is written.  Null ids come first;
    rows with one id stand by the hash of their text.  An empty table writes no
    block.  Returns the written table: ``part`` and ``block`` give the order, and
    ``before`` the ids of the part before the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer_dir)
        width = bits_for(max(bpe.vocabulary, end_id + 1))
        part = TaskContext.get().partitionId()
        number, before = 0, 0
        waiting: list[tuple[object, np.ndarray]] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal number, before, held, waiting
            ends = np.cumsum([len(x) for _, x in waiting])
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array([before], pa.int64()),
                    pa.array([[d for d, _ in waiting]], pa.list_(pa.int64())),
                    pa.array([held], pa.int64()),
                    pa.array([make_block(np.concatenate([x for _, x in waiting]), ends, width)], pa.binary()),
                ],
                ["part", "block", "before", "doc_ids", "n_ids", "data"],
            )
            number, before, held, waiting = number + 1, before + held, 0, []
            return made

        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, texts in text_steps(batch.column(1)):
                ids, ends = bpe.encode(texts)
                for i, own in enumerate(np.split(ids, ends[:-1])):
                    waiting.append((doc_ids[start + i], np.concatenate([own, end])))
                    held += len(own) + 1
                    if held >= BLOCK_IDS or len(waiting) >= BLOCK_DOCS:
                        yield block()
        if waiting:
            yield block()

    read = docs.select(docs["doc_id"].cast("long"), text_or_empty(docs).alias("text"))
    # The hash keeps one id with many rows from filling one part.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_docs = read.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(sorted_docs.mapInArrow(run, _BLOCKS), "token-blocks", path)


def read_token_files(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every written document.

    ``start`` is the number of ids of all documents before it; ``ids`` are
    little-endian unsigned 32-bit integers.
    """
    # One row per written part, whatever the number of documents.
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for row in sums:
        base[row["part"]] = total
        total += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, doc_ids, data = (batch.column(c)[row].as_py() for c in range(4))
                ids, ends = read_block(data)
                starts = np.concatenate([[0], ends[:-1]])
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(),
                    len(ends),
                    [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64)), pa.py_buffer(ids)],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts + base[part] + before, pa.int64()),
                        raw.cast(pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    read = blocks.select("part", "before", "doc_ids", "data")
    return read.mapInArrow(run, "doc_id long, start long, ids binary")


def token_file_report(docs: DataFrame) -> DataFrame:
    """Write, read back, and give ``doc_id, start, n_tokens, ids_crc32``."""
    return read_token_files(write_token_files(docs)).select(
        "doc_id",
        "start",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


__all__ = [
    "bits_for",
    "make_block",
    "pack_bits",
    "read_block",
    "read_document",
    "read_token_files",
    "token_file_report",
    "unpack_bits",
    "write_token_files",
]
