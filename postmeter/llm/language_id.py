"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  The vector of three letters in a
row is the product of the letters' vectors, each rotated by its place; the sum of
these over a text is the text's vector, and the sum over the labelled texts of a
language is the language's prototype.  The prototype with the largest cosine wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import text_steps
from .common import give_back_memory

DIMENSIONS = 512
NGRAM = 3
UNKNOWN = "und"
_SEED = 7
# N-grams and counts looked at in one matrix product.
_BLOCK = 1 << 15
# Bytes of text looked at a time; the arrays of one step take about sixty times as much.
_STEP = 2 << 20
_CELLS = 1 << 22


def _letter_table() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


class Profiles:
    """Vectors of texts.  Letter vectors are drawn from the code point alone."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self._letters = _letter_table()
        self._drawn: dict[int, np.ndarray] = {0: self._draw(0)}

    def _draw(self, point: int) -> np.ndarray:
        seed = zlib.crc32(f"{_SEED}:{point}".encode())
        return np.random.Generator(np.random.Philox(seed)).integers(0, 2, self.dimensions, np.int8) * 2 - 1

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams, given as rows of letters; 0 is the edge of a word."""
        bound = np.ones((len(grams), self.dimensions), np.int8)
        for place in range(NGRAM):
            distinct, back = np.unique(grams[:, place], return_inverse=True)
            for point in distinct.tolist():
                if point not in self._drawn:
                    self._drawn[point] = self._draw(point)
            letters = np.stack([np.roll(self._drawn[p], NGRAM - 1 - place) for p in distinct.tolist()])
            bound *= letters[back]
        return bound.astype(np.float32)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vector of each text, and how many n-grams it sums."""
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        data = "".join(f" {t} " for t in texts.to_numpy(zero_copy_only=False).tolist())
        points = self._letters[np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)]
        doc = np.repeat(np.arange(len(sizes)), sizes + 2)
        # A run of other characters is one edge; each text begins and ends with one.
        kept = np.concatenate([[False], (points[1:] > 0) | (points[:-1] > 0)])[: len(points)]
        kept[np.cumsum(sizes + 2) - sizes - 2] = True
        points, doc = points[kept], doc[kept]
        present = np.flatnonzero(np.bincount(points, minlength=1)) if len(points) else np.empty(0, np.int64)
        base = len(present)
        dense = np.zeros(int(present[-1]) + 1 if base else 1, np.int64)
        dense[present] = np.arange(base)
        codes = dense[points] if base else np.empty(0, np.int64)
        grams, whole = codes, np.ones(len(codes), bool)
        for k in range(1, NGRAM):
            whole[-k:] = False
            whole[:-k] &= doc[:-k] == doc[k:]
            grams = grams * base + np.concatenate([codes[k:], np.zeros(min(k, len(codes)), np.int64)])
        # A word of one letter stands between two edges, so every letter is in one.
        grams, doc = grams[whole], doc[whole]
        distinct, back = self._distinct(grams, base**NGRAM)
        sums = np.zeros((len(sizes), self.dimensions), np.float32)
        parts = np.zeros((len(distinct), NGRAM), np.int64)
        rest = distinct
        for place in range(NGRAM - 1, -1, -1):
            rest, last = np.divmod(rest, max(base, 1))
            parts[:, place] = present[last] if base else last
        for first in range(0, len(distinct), _BLOCK):
            vectors = self._vectors(parts[first : first + _BLOCK])
            width = len(vectors)
            at, owner = back, doc
            if len(distinct) > _BLOCK:
                here = (back >= first) & (back < first + _BLOCK)
                at, owner = back[here] - first, doc[here]
            step = max(1, _CELLS // width)
            for low in range(0, len(sizes), step):
                rows = min(step, len(sizes) - low)
                a, b = np.searchsorted(owner, [low, low + rows])
                counts = np.bincount((owner[a:b] - low) * width + at[a:b], minlength=rows * width)
                sums[low : low + rows] += counts.reshape(rows, width).astype(np.float32) @ vectors
        return sums, np.bincount(doc, minlength=len(sizes))

    @staticmethod
    def _distinct(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and the place of each; by a table where the alphabet is small."""
        if span > 1 << 23:
            return np.unique(grams, return_inverse=True)
        table = np.zeros(span, bool)
        table[grams] = True
        places = np.cumsum(table) - 1
        return np.flatnonzero(table), places[grams]


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by their id, from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit vector of each language of ``labelled (text, lang)``.

    Each text counts as a unit vector, so that long ones do not outweigh the rest.
    Every task sends one number per language and dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for start, texts in text_steps(batch.column(0), _STEP):
                vectors, _ = profiles.texts(texts)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.maximum(norms, 1e-9)
                own = langs[start : start + len(texts)]
                for lang in set(own.tolist()):
                    part = vectors[own == lang].sum(axis=0, dtype=np.float64)
                    sums[lang] = sums.get(lang, 0) + part
        give_back_memory()
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * dimensions),
                    pa.array(np.arange(dimensions, dtype=np.int32)),
                    # Whole numbers add up alike in every order.
                    pa.array(np.rint(total * 1e6).astype(np.int64)),
                ],
                ["lang", "dim", "value"],
            )

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, dim int, value long")
    sums = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    found: dict[str, np.ndarray] = {}
    for row in sums:
        found.setdefault(row["lang"], np.zeros(dimensions))[row["dim"]] = row["value"]
    return {
        lang: (v / np.linalg.norm(v)).astype(np.float32)
        for lang, v in sorted(found.items())
        if np.linalg.norm(v) > 0
    }


def predict(docs: DataFrame, known: dict[str, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but null-safe text by default), ``lang_pred`` and ``score``.

    ``score`` is the cosine with the winning prototype, 0 at least.  Null texts and
    texts without a letter are ``und`` with score 0; so is every text if nothing was
    learned.  Of equal cosines the language that sorts first wins.
    """
    names = sorted(known)
    carried = docs.columns if keep is None else keep
    matrix = np.stack([known[n] for n in names]) if names else np.zeros((0, DIMENSIONS), np.float32)
    text_at = len(carried)
    schema = docs.select(*[f"`{c}`" for c in carried]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(matrix.shape[1])
        for batch in batches:
            for start, texts in text_steps(batch.column(text_at), _STEP):
                vectors, grams = profiles.texts(texts)
                if len(names):
                    norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                    cosines = (vectors / norms) @ matrix.T
                    best = cosines.argmax(axis=1)
                    score = np.clip(np.rint(cosines.max(axis=1).astype(np.float64) * 1e5) / 1e5, 0, 1)
                    lang = np.array(names, object)[best]
                else:
                    score, lang = np.zeros(len(texts)), np.full(len(texts), UNKNOWN, object)
                score[grams == 0], lang[grams == 0] = 0, UNKNOWN
                own = [batch.column(i).slice(start, len(texts)) for i in range(text_at)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(lang.tolist(), pa.string()), pa.array(score)],
                    [*carried, "lang_pred", "score"],
                )

    text = docs["text"].cast("string").alias("__text")
    return docs.select(*[docs[f"`{c}`"] for c in carried], text).mapInArrow(run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict all of them.

    ``doc_id, held_out, lang_pred, score``.  A null ``doc_id`` is not held out;
    repeated rows are predicted row by row; an empty table gives an empty one.
    """
    own = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"), docs["lang"].cast("string"))
    learned = prototypes(own.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()))
    found = predict(own, learned, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# Texts that resemble no learned language this much are in none of them.
LEAST_SCORE = 0.05


def drop_unknown_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` in a language that their labels teach.

    Dropped are null texts, texts without a letter, and texts whose cosine with the best
    prototype is below ``least_score``.  That bound is low, because a clean text of a few
    words has few n-grams: of 51,282 labelled texts the lowest score is 0.063.  Without any
    label nothing is learned, and every text with a letter stays.  Rows are judged one
    by one, so repeated rows and null ids stay as they are, and an empty table is empty.

    Only the text goes to Python, once, and only language and score come back.
    """
    learned = prototypes(docs.select(docs["text"].cast("string"), docs["lang"].cast("string")).where("lang is not null"))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    # Positions stand in for names, so that no name can clash.
    renamed = docs.toDF(*plain)
    text = F.col(plain[docs.columns.index("text")]).cast("string")
    if learned:
        kept = renamed.where(_scores(learned)(text) >= least_score)
    else:
        kept = renamed.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return kept.toDF(*docs.columns)


def _scores(known: dict[str, np.ndarray]) -> Callable[[Column], Column]:
    """The cosine of texts with the nearest of ``known``, -1 for those without a letter."""
    matrix = np.stack([known[n] for n in sorted(known)])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiles = Profiles(matrix.shape[1])
        for batch in batches:
            found = [np.empty(0)]
            for _, texts in text_steps(batch, _STEP):
                vectors, grams = profiles.texts(texts)
                norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = ((vectors / norms) @ matrix.T).max(axis=1).astype(np.float64)
                found.append(np.where(grams == 0, -1.0, best))
            yield pa.array(np.concatenate(found))
        give_back_memory()

    return F.arrow_udf(run, "double")
