"""Token counts by merging whole arrays, rank by rank.

Texts are cut into pre-tokens (a run of spaces and what follows).  The distinct
pre-tokens of a batch stand as rows of integer arrays, one array per length.  In
each step every row merges its pair of lowest rank, the leftmost of equals, until
no row has a pair left; what survives is counted.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import strings, text_steps
from .common import text_or_empty, tokenizer_path

_NONE = np.iinfo(np.int32).max
_SPACE = "▁"
# Longer pre-tokens are merged one by one from a heap: the same merges in the same
# order, where rows that long would be moved once per merge.
ROW_SYMBOLS = 64


class PieceCounter:
    """Counts the pieces of the public 32k piece vocabulary with byte fallback."""

    def __init__(self, folder: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(
            model_file=tokenizer_path("piece_bpe_32k.model", folder)
        )
        score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        order = sorted(set(score.values()), reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self._id = {piece: i for i, piece in enumerate(score)}
        self._known = len(self._id)
        self._rank = {piece: rank_of[s] for piece, s in score.items()}
        pairs = {
            (self._id[p[:k]] << 32 | self._id[p[k:]]): (self._rank[p], i)
            for p, i in self._id.items()
            for k in range(1, len(p))
            if p[:k] in self._id and p[k:] in self._id
        }
        self._keys = np.array(sorted(pairs), np.int64)
        found = [pairs[int(k)] for k in self._keys]
        self._ranks = np.array([r for r, _ in found], np.int32)
        self._merged = np.array([i for _, i in found], np.int32)
        points = {ord(p): i for p, i in self._id.items() if len(p) == 1}
        self._id_of_point = np.full(0x110000, -1, np.int32)
        self._id_of_point[list(points)] = list(points.values())

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        hit = (self._keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self._ranks[at], _NONE), self._merged[at]

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols left in each row of equally long sequences."""
        left = np.full(len(symbols), symbols.shape[1])
        rows = np.arange(len(symbols))
        ranks, merged = self._pair(symbols[:, :-1], symbols[:, 1:])
        while symbols.shape[1] > 1 and len(rows):
            at = ranks.argmin(axis=1)
            go = ranks[np.arange(len(rows)), at] < _NONE
            if not go.all():
                rows, at, symbols, ranks, merged = rows[go], at[go], symbols[go], ranks[go], merged[go]
                if not len(rows):
                    break
            n, width = symbols.shape
            own = np.arange(n)
            new = merged[own, at]
            keep = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            symbols = np.take_along_axis(symbols, keep, 1)
            symbols[own, at] = new
            keep = np.minimum(keep[:, : width - 2], width - 2)
            ranks, merged = np.take_along_axis(ranks, keep, 1), np.take_along_axis(merged, keep, 1)
            left[rows] -= 1
            if width == 2:
                break
            for place in (at - 1, at):
                ok = np.flatnonzero((place >= 0) & (place < width - 2))
                p = place[ok]
                ranks[ok, p], merged[ok, p] = self._pair(symbols[ok, p], symbols[ok, p + 1])
        return left

    def _merge_long(self, symbols: list[int]) -> int:
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
                key = symbols[i] << 32 | symbols[j]
                at = int(np.searchsorted(self._keys, key))
                if at < len(self._keys) and self._keys[at] == key:
                    heapq.heappush(heap, (int(self._ranks[at]), i, symbols[i], symbols[j], int(self._merged[at])))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        left, gone = len(symbols), -2
        while heap:
            _, i, first, second, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != first or j < 0 or symbols[j] != second:
                continue
            symbols[i], symbols[j] = new, gone
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            left -= 1
            offer(before[i], i)
            offer(i, after[i])
        return left

    def count_units(self, units: list[str]) -> np.ndarray:
        """Tokens of each unit; its spaces are already written as the space piece."""
        sizes = np.array([len(u) for u in units], np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self._id_of_point[points]
        # A character without a piece stands as its UTF-8 bytes.
        extra = np.where(ids < 0, (points > 0x7F) * 1 + (points > 0x7FF) + (points > 0xFFFF), 0)
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(extra)])
        counts = sums[ends] - sums[ends - sizes]
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            if size > ROW_SYMBOLS:
                for i in own:
                    counts[i] += self._merge_long(ids[ends[i] - size : ends[i]].tolist())
            elif size:
                at = (ends[own] - size)[:, None] + np.arange(size)
                counts[own] += self._merge_rows(ids[at]) if size > 1 else 1
        return counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        texts = pc.replace_substring(texts, _SPACE, " ")
        runs = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        split = pc.split_pattern(pc.if_else(runs, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        segments = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = segments.dictionary_encode()
        codes = coded.indices.to_numpy()
        of_unit = self.count_units([_SPACE + s for s in strings(coded.dictionary)])
        sums = np.concatenate([[0], np.cumsum(of_unit[codes])])
        counts = sums[offsets[1:]] - sums[offsets[:-1]]
        counts[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = 0
        places = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
        for i in places:
            cut = re.findall(r" *[^ ]+| +", " " + texts[int(i)].as_py())
            distinct, back = np.unique(np.array(cut, object), return_inverse=True)
            counts[i] = self.count_units([u.replace(" ", _SPACE) for u in distinct])[back].sum()
        return counts


def token_counts(docs: DataFrame, limit: int = 4096, tokenizer_dir: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    Null texts are empty: no bytes, no tokens.  Repeated rows and ids are counted
    row by row, other columns are not read, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer_dir)
        for batch in batches:
            for start, texts in text_steps(batch.column(1)):
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pc.binary_length(texts).cast(pa.int64()),
                        pa.array(n, pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    read = docs.select(docs["doc_id"].cast("long"), text_or_empty(docs).alias("text"))
    counted = read.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
