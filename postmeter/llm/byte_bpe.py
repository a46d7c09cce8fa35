"""Ids of the public byte-level vocabulary for batches of texts.

A text is cut before each space.  The tokenizer splits there too, so the ids of
a text are those of its units in a row, and each unit that occurs in a batch is
encoded once.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tokenizer_path

# A space between white space belongs to a longer run, which is not cut.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_SPECIAL = "<|endoftext|>"
# Fixed value: the pattern that the vocabulary was made with.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STEP_BYTES = 16 << 20


def text_steps(texts: pa.Array, most: int = _STEP_BYTES):
    """Slices of ``texts`` (null as empty) of about ``most`` bytes, one text at least."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start:start + length]`` one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class ByteBpe:
    def __init__(self, folder: str | None = None):
        import tiktoken

        with open(tokenizer_path("byte_bpe_50k.tiktoken", folder), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.special_id = len(ranks)
        self.vocabulary = len(ranks) + 1
        self._encoder = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes_of = np.zeros(len(ranks), np.int64)
        for piece, rank in ranks.items():
            self._bytes_of[rank] = len(piece)

    def encode_one(self, text: str) -> np.ndarray:
        """Ids of one text; the special string inside it is its own id."""
        ids = array("I")
        for i, part in enumerate(text.split(_SPECIAL)):
            if i:
                ids.append(self.special_id)
            ids.extend(self._encoder.encode_ordinary(part))
        return np.frombuffer(ids, np.uint32)

    def _encode_units(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each segment: all ids, and how many each has."""
        odd = pc.or_(
            pc.equal(pc.binary_length(segments), 0),
            pc.match_substring_regex(segments, f"^{_BLANK}|{_BLANK}$"),
        ).to_numpy(zero_copy_only=False)
        plain = segments.filter(pa.array(~odd))
        counts = np.zeros(len(segments), np.int64)
        ids = np.empty(0, np.uint32)
        if len(plain):
            joined = " " + " ".join(strings(plain))
            ids = np.array(self._encoder.encode_ordinary(joined), np.uint32)
            ends = np.cumsum(pc.binary_length(plain).to_numpy(zero_copy_only=False) + 1)
            upto = np.searchsorted(np.cumsum(self._bytes_of[ids]), ends, "right")
            counts[~odd] = np.diff(upto, prepend=0)
        starts = np.cumsum(counts) - counts
        extra = [self.encode_one(" " + s) for s in strings(segments.filter(pa.array(odd)))]
        if extra:
            at = len(ids)
            for place, own in zip(np.flatnonzero(odd), extra):
                starts[place], counts[place] = at, len(own)
                at += len(own)
            ids = np.concatenate([ids, *extra])
        self._starts = starts
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the uint32 ids of all texts, and where each text ends."""
        alone = pc.or_(
            pc.match_substring_regex(texts, f"{_BLANK} {_BLANK}"), pc.match_substring(texts, _SPECIAL)
        )
        split = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        segments = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = segments.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        ids, counts = self._encode_units(coded.dictionary)
        starts = self._starts
        # The first segment of a text has no space before it; a text that was
        # set aside is one such segment.
        first = [
            self.encode_one(t if whole else t.split(" ", 1)[0])
            for t, whole in zip(strings(texts), alone.to_pylist())
        ]
        codes[offsets[:-1]] = len(counts) + np.arange(len(texts))
        first_counts = np.array([len(f) for f in first], np.int64)
        starts = np.concatenate([starts, len(ids) + np.cumsum(first_counts) - first_counts])
        counts = np.concatenate([counts, first_counts])
        ids = np.concatenate([ids, *first])
        lengths = counts[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets[1:]]
        return gather(ids, starts[codes], lengths), ends
