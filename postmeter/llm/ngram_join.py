"""Jaccard similarity join of documents on word n-grams, with grouped prefixes.

The n-grams of a document are put in one order for all documents, rare ones first.
Documents at or above the threshold share one of the first few n-grams of each: the
prefix.  Documents with the same prefix and size form a group, and only groups are
looked up; candidate group pairs are filtered by size, place, the number of prefix
n-grams they share and a parity bitmap of their sets, then expanded to their members,
which are verified on their whole sets.  Documents with one set are one member from
the start.

The parity bitmap holds, for each of 512 cells, whether an odd number of the set's
n-grams falls there.  Bitmaps of two sets differ in at most as many cells as the sets
differ in n-grams, so the filter loses no link.

The result is the components of the links.  Members that earlier links have
brought together need no further verification, so candidates are drawn in rounds:
in the first ones each group takes, in every list, the one of another component whose
bitmap is nearest; then come all pairs of groups that are not yet within one component.
No link between components is lost.  Long lists are cut into blocks, which tasks take
one by one or, in the last round, two by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import gather, text_steps
from .common import (
    drop_kept, drop_unused_shuffles, give_back_memory, hash_filter, keep, maybe_in, numbered_rows, passing_tables,
    text_or_empty, unused_name,
)
from .components import components

WORDS = 4
PERCENT = 85
# Fixed number of counters that order n-grams by how common they are.
COUNTERS = 1 << 20
_WIDE = 16
# Partners of one document that are verified in one group.
_PARTNERS = 256
# Cells of the parity bitmap, a multiple of 64.
CELLS = 512
# Rounds in which each group takes one neighbour of a list before all pairs are drawn.
ROUNDS = 2
# Rows of a list that meet in one task at a time (twice as many in the last round).
BLOCK = 4096

# Bytes of text hashed at a time: the arrays of one step take about forty times as much.
_STEP = 2 << 20

_RANDOM = np.random.Generator(np.random.Philox(11))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each text has.

    Words are runs of other bytes than space and 9 to 13, after lower-casing A-Z.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    firsts = offsets[:-1][(offsets[:-1] < offsets[1:])]
    starts[firsts] = ~space[firsts]
    at = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(at, offsets))
    if not len(at):
        return np.empty(0, np.uint64), counts
    letters = _FOLD[data[~space]]
    first = (np.cumsum(~space) - 1)[at]
    lengths = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _POWER, np.uint64))
    sums = np.add.reduceat(_BYTE[letters] * powers[place], first)
    return _mix(sums + lengths.astype(np.uint64)), counts


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of each text, one after the other, and each set's size.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    rolled = np.full(len(hashes), words, np.uint64)
    for k in range(words):
        shifted = np.zeros_like(hashes)
        shifted[: len(hashes) - k] = hashes[k:]
        rolled = _mix(rolled * _POWER + shifted)
    n = np.where(counts >= words, counts - words + 1, 0)
    tokens = gather(rolled, ends - counts, n)
    short = np.flatnonzero((counts > 0) & (counts < words))
    parts = np.split(tokens, np.cumsum(n)[:-1]) if len(n) else []
    for i in short:
        value = np.full(1, counts[i], np.uint64)
        for h in hashes[ends[i] - counts[i] : ends[i]]:
            value = _mix(value * _POWER + h)
        parts[i] = value
    sets = [np.unique(p) for p in parts]
    return (np.concatenate(sets) if sets else tokens), np.array([len(s) for s in sets], np.int64)


def _commonness(docs: DataFrame, words: int) -> np.ndarray:
    """A class per counter, higher for the more common.

    The counters count the n-grams of all documents by a part of their hash.  Any
    order is right as long as all documents share it; this one keeps what is in many
    documents out of the prefixes.
    """
    rows = COUNTERS // _WIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, texts in text_steps(batch.column(0), _STEP):
                tokens, _ = shingle_sets(texts, words)
                counts += np.bincount(tokens & np.uint64(COUNTERS - 1), minlength=COUNTERS)
        table = counts.reshape(rows, _WIDE)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(table[used, i]) for i in range(_WIDE)]],
            ["slot", *[f"c{i}" for i in range(_WIDE)]],
        )

    schema = "slot long, " + ", ".join(f"c{i} long" for i in range(_WIDE))
    sums = docs.select("text").mapInArrow(run, schema).groupBy("slot").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(_WIDE)]
    )
    found = sums.toArrow()
    table = np.zeros((rows, _WIDE), np.int64)
    table[found.column("slot").to_numpy()] = np.stack(
        [found.column(f"c{i}").to_numpy() for i in range(_WIDE)], axis=1
    ).reshape(-1, _WIDE)
    del found
    counts = table.reshape(-1)
    # Counters below the mean come first, so that what many documents share comes
    # late even where rare n-grams load its counter by chance as much.
    mean = max(1.0, counts.sum() / COUNTERS)
    kinds = np.empty(COUNTERS, np.uint8)
    for start in range(0, COUNTERS, rows):
        off = (counts[start : start + rows] - mean) / mean**0.5
        near = np.floor(4 * off) + 16
        kind = np.where(off < 6, near, 40 + np.log2(np.maximum(off, 6) / 6))
        kinds[start : start + rows] = np.clip(kind, 0, 60)
    del table, counts
    give_back_memory()
    return kinds


def _parities(tokens: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parity bitmap of each set; the sets follow one another in ``tokens``."""
    cells = tokens >> np.uint64(24) & np.uint64(CELLS - 1)
    words, bit = cells >> np.uint64(6), np.uint64(1) << (cells & np.uint64(63))
    full = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[full]
    maps = np.zeros((len(n), CELLS // 64), np.uint64)
    if len(full):
        for k in range(CELLS // 64):
            maps[full, k] = np.bitwise_xor.reduceat(np.where(words == np.uint64(k), bit, np.uint64(0)), starts)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CELLS // 8), len(n), [None, pa.py_buffer(maps.tobytes())])
    return fixed.cast(pa.binary())


def _bitmaps(column: pa.Array) -> np.ndarray:
    """Rows of bitmap words of a binary column that holds one bitmap in each row."""
    wide = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    if not len(wide):
        return np.empty((0, CELLS // 64), np.uint64)
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = np.frombuffer(wide.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), np.uint64).reshape(len(wide), CELLS // 64)


_SETS = (
    "row long, doc_id long, n long, c1 long, c2 long, grp long, prefix array<long>, t1 long, t2 long, bits binary"
)


def _sets(numbered: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """Every document with its size, the hash of its set, its group and its prefix."""
    shared = numbered.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_steps(batch.column(2), _STEP):
                tokens, n = shingle_sets(texts, words)
                kind = shared.value[tokens & np.uint64(COUNTERS - 1)].astype(np.uint64)
                ordered = kind << np.uint64(56) | tokens >> np.uint64(8)
                ends = np.cumsum(n)
                whole = np.concatenate([[np.uint64(0)], np.cumsum(_mix(tokens + np.uint64(1)))])
                other = np.concatenate([[np.uint64(0)], np.cumsum(_mix(tokens ^ _POWER))])
                keeps = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                prefixes = [np.sort(o)[:k] for o, k in zip(np.split(ordered, ends[:-1]), keeps)]
                flat = np.concatenate(prefixes) if prefixes else ordered
                group = np.array([_mix(np.array([_mix(p).sum()])) [0] for p in prefixes], np.uint64)
                group = _mix(group + n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        batch.column(1).slice(start, len(texts)),
                        pa.array(n),
                        pa.array((whole[ends] - whole[ends - n]).view(np.int64)),
                        pa.array((other[ends] - other[ends - n]).view(np.int64)),
                        pa.array(group.view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(keeps)]), pa.int32()),
                            pa.array(flat.view(np.int64)),
                        ),
                        batch.column(3).slice(start, len(texts)),
                        batch.column(4).slice(start, len(texts)),
                        _parities(tokens, n),
                    ],
                    [c.split()[0] for c in _SETS.split(", ")],
                )

    return numbered.mapInArrow(run, _SETS)


def _runs(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows in chunks that hold all rows of each list."""
    held: list[dict[str, np.ndarray]] = []
    size = 0

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if batch.num_rows:
            columns = dict(zip(batch.schema.names, batch.columns))
            bits = _bitmaps(columns.pop("bits"))
            held.append({"bits": bits} | {c: v.to_numpy(zero_copy_only=False) for c, v in columns.items()})
            size += batch.num_rows
        if size >= most:
            rows = joined()
            last = int(np.searchsorted(rows["list"], rows["list"][-1]))
            if last:
                yield {c: v[:last] for c, v in rows.items()}
            held, size = [{c: v[last:] for c, v in rows.items()}], size - last
    if size:
        yield joined()


def _may_link(a: dict, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Filters by size, place and bitmap, and how far the bitmaps differ.

    ``i`` has the smaller size.  A bitmap speaks for a group of one member only; others
    count as differing as far as a link allows.
    """
    small, large = a["n"][i], a["n"][j]
    need = -(-percent * (small + large) // (100 + percent))
    # What may still follow after the shared n-gram, itself included.
    bound = np.minimum(small - a["pos"][i], large - a["pos"][j]) + np.minimum(a["pos"][i], a["pos"][j])
    ok = (100 * small >= percent * large) & (bound >= need)
    most = small + large - 2 * need
    differ = most.copy()
    told = np.flatnonzero(ok & a["alone"][i] & a["alone"][j])
    differ[told] = np.bitwise_count(a["bits"][i[told]] ^ a["bits"][j[told]]).sum(axis=1, dtype=np.int64)
    return ok & (differ <= most), differ


def _slack(a: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams past a shared one the pair may share, less what it needs.

    Up to the end of the prefix that ends first all shared n-grams are known; past it
    is what that document has left, and at most what the other has left from here.
    """
    n, m = a["n"][i], a["n"][j]
    need = -(-percent * (n + m) // (100 + percent))
    past_n, past_m = -(-percent * n // 100) - 1, -(-percent * m // 100) - 1
    left = np.maximum(np.minimum(past_n, m - a["pos"][j] - 1), np.minimum(n - a["pos"][i] - 1, past_m))
    return left - need


_PAIRS = "a long, b long"
# Pairs of one task that are held before equal ones are added up.
_HELD = 1 << 20


def _pairs(rows: dict, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one list, by distance, as far as their sizes may link."""
    lists, n = rows["list"], rows["n"]
    stops = np.searchsorted(lists, lists, "right")
    i = np.arange(len(lists))
    for k in range(1, len(lists)):
        i = i[i + k < stops[i]]
        # Lists are in order of size: what is too large stays so.
        i = i[100 * n[i] >= percent * n[i + k]]
        if not len(i):
            return
        yield i, i + k


def _added_up(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, slack = (np.concatenate([h[k] for h in held]) for k in range(3))
    order = np.lexsort((b, a))
    a, b, slack = a[order], b[order], slack[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.flatnonzero(new)
    columns = [a[first], b[first], np.diff(first, append=len(a)), np.minimum.reduceat(slack, first)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "shared", "slack"])


def _listed(postings: DataFrame, seed: int | None) -> DataFrame:
    """``postings`` with the lists that tasks take: blocks, or with no seed pairs of blocks.

    ``k`` is the length of the list.  A block is drawn by hash, anew for each seed; a
    pair of blocks holds the rows of both, told apart by ``block``.
    """
    blocks = f"cast(ceil(k / {BLOCK}) as bigint)"
    rows = postings.withColumn("block", F.expr(f"pmod(xxhash64(grp, {seed or 0}), {blocks})"))
    if seed is not None:
        rows = rows.withColumns({"list": F.expr("xxhash64(token, block)"), "cross": F.lit(False)})
    else:
        pair = "xxhash64(token, least(block, other), greatest(block, other))"
        rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0, {blocks} - 1)"))).withColumns(
            {"list": F.expr(pair), "cross": F.expr("block <> other")}
        )
    return rows.select("list", "grp", "n", "pos", "low", "high", "alone", "bits", "block", "cross")


def _candidates(postings: DataFrame, percent: int, seed: int | None, counted: bool = False) -> DataFrame:
    """Distinct group pairs ``a, b`` that share a prefix n-gram and pass the filters.

    With a ``seed`` each row of a list takes the row of another component that may link and
    differs least; else all such pairs of the list are taken.  ``counted`` (not with a
    seed, which misses some lists of a pair) keeps the pairs whose shared prefix n-grams,
    added up over all lists, leave the threshold within reach.
    """

    def may_link(rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        mixed = rows["low"] != rows["high"]
        for i, j in _pairs(rows, percent):
            apart = mixed[i] | mixed[j] | (rows["low"][i] != rows["low"][j])
            # In a pair of two blocks only rows of different blocks meet.
            apart &= ~rows["cross"][i] | (rows["block"][i] != rows["block"][j])
            i, j = i[apart], j[apart]
            ok, differ = _may_link(rows, i, j, percent)
            if ok.any():
                yield i[ok], j[ok], differ[ok]

    def nearest(rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        least = np.full(len(rows["n"]), np.iinfo(np.int64).max)
        partner = np.full(len(least), -1)
        for i, j, differ in may_link(rows):
            for own, other in ((i, j), (j, i)):
                better = differ < least[own]
                least[own[better]], partner[own[better]] = differ[better], other[better]
        own = np.flatnonzero(partner >= 0)
        yield np.minimum(own, partner[own]), np.maximum(own, partner[own]), least[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in _runs(batches):
            for i, j, _ in may_link(rows) if seed is None else nearest(rows):
                a, b = rows["grp"][i], rows["grp"][j]
                held.append((np.minimum(a, b), np.maximum(a, b), _slack(rows, i, j, percent)))
                size += len(i)
                if size >= _HELD:
                    yield _added_up(held)
                    held, size = [], 0
        if size:
            yield _added_up(held)

    lists = _listed(postings, seed).repartition("list").sortWithinPartitions("list", "n", "grp")
    found = lists.mapInArrow(run, f"{_PAIRS}, shared long, slack long")
    if not counted:
        return found.select("a", "b").distinct()
    sums = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("slack").alias("slack"))
    return sums.where("shared + slack >= 0").select("a", "b")


def _meet(pairs: DataFrame, payload: DataFrame) -> DataFrame:
    """Sorted groups ``a, part, member, ...`` in which ``a`` itself comes first.

    What ``a`` carries meets what its partners carry; a member with many partners is
    split over several groups.  What is sent is stored first, so that the plan stays short.
    """
    degree = pairs.groupBy("a").agg(F.count("*").alias("d"))
    split = pairs.join(degree, "a").select(
        "a", "b", F.expr(f"pmod(xxhash64(b), cast(ceil(d / {_PARTNERS}) as bigint))").alias("part")
    )
    sent = keep(
        split.select("a", "part", F.col("b").alias("member")).union(
            split.select("a", "part", F.col("a").alias("member")).distinct()
        ),
        "sent-members",
    )
    rows = sent.join(payload, "member").select("a", "part", "member", *payload.drop("member").columns)
    return rows.repartition("a", "part").sortWithinPartitions(
        "a", "part", F.col("member") != F.col("a"), "member"
    )


def _pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two sorted arrays without repeats share."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return 0
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _overlap_filter(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole prefixes leave the threshold within reach.

    Up to where the shorter prefix ends the shared n-grams are known; past it the pair
    shares at most what is left of the smaller one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, None
        for batch in batches:
            heads, parts, members, sizes = (batch.column(i).to_pylist() for i in range(4))
            offsets = batch.column(4).offsets.to_numpy()
            values = batch.column(4).values.to_numpy()
            out = []
            for i, (head, part, n) in enumerate(zip(heads, parts, sizes)):
                own = (n, values[offsets[i] : offsets[i + 1]])
                if (head, part) != key:
                    key, hub = (head, part), own
                    continue
                last = min(hub[1][-1], own[1][-1])
                known = [p[: np.searchsorted(p, last, "right")] for _, p in (hub, own)]
                left = min(hub[0] - len(known[0]), n - len(known[1]))
                if _in_common(*known) + left >= -(-percent * (hub[0] + n) // (100 + percent)):
                    out.append((head, members[i]))
            yield _pairs_batch(out)

    # The prefixes of groups in no pair are kept out of the shuffle.
    asked = pairs.select(F.col("a").alias("member")).union(pairs.select("b"))
    wanted = keep(hash_filter(asked, "member"), "asked-groups")
    known = maybe_in(prefixes.select("member", "n", "prefix"), "member", wanted)
    return _meet(pairs, known).mapInArrow(run, _PAIRS)


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of members ``a, b`` that reach the threshold, on their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, None
        for batch in batches:
            heads, parts, members = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for start, own in text_steps(batch.column(3), _STEP):
                tokens, n = shingle_sets(own, words)
                for i, own_set in enumerate(np.split(tokens, np.cumsum(n)[:-1]), start):
                    if (heads[i], parts[i]) != key:
                        key, hub = (heads[i], parts[i]), own_set
                        continue
                    both = _in_common(hub, own_set)
                    if 100 * both >= percent * (len(hub) + len(own_set) - both):
                        out.append((heads[i], members[i]))
            yield _pairs_batch(out)

    return _meet(pairs, texts).mapInArrow(run, _PAIRS)


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``row, doc_id, n_shingles, component_row`` of every row of ``docs``.

    Two documents link when ``100 * intersection >= percent * union``.  Texts without
    words (null too) have an empty set and link with nothing.  Rows are documents of
    their own, also with a null or repeated ``doc_id``; ``component_row`` is the row
    with the smallest ``doc_id`` of the component, null ids last.  Other columns are
    not read; an empty table gives an empty one.
    """
    own = docs.select(docs["doc_id"].cast("long"), text_or_empty(docs).alias("text"))
    hashes = [F.xxhash64(F.lit(k), "text").alias(f"t{k}") for k in (1, 2)]
    numbered = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *hashes)
    common = _commonness(own, words)
    sets = keep(_sets(numbered, common, words, percent), "shingle-sets")

    facts = sets.where("n > 0").select("row", "doc_id", "n", "c1", "c2", "grp", "t1", "t2", "bits")
    members = keep(
        facts.groupBy("c1", "c2").agg(
            F.min("row").alias("member"), F.first("n").alias("n"), F.first("grp").alias("grp"),
            F.first("bits").alias("bits"),
            F.min(F.struct("row", "t1", "t2")).alias("text"),
        ),
        "shingle-members",
    )
    leaders = keep(
        members.groupBy("grp").agg(F.min("member").alias("row"), F.count("*").alias("members")), "group-leaders"
    )
    prefixes = keep(
        sets.select("row", "n", "prefix", "bits").join(leaders, "row").select(
            F.col("grp").alias("member"), "n", "prefix", "bits", (F.col("members") == 1).alias("alone")
        ),
        "group-prefixes",
    )
    drop_unused_shuffles(docs.sparkSession)
    exploded = prefixes.select(F.col("member").alias("grp"), "n", F.posexplode("prefix").alias("pos", "token"))
    # A row whose neighbours by size are too far off links with none of its list.
    by_size = Window.partitionBy("token").orderBy("n")
    postings = keep(
        exploded.withColumns({
            "k": F.count("*").over(by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            "before": F.lag("n").over(by_size),
            "after": F.lead("n").over(by_size),
        }).where(f"100 * before >= {percent} * n or 100 * n >= {percent} * after").drop("before", "after"),
        "prefix-postings",
    )
    drop_unused_shuffles(docs.sparkSession)

    def linked(pairs: DataFrame) -> DataFrame:
        """Verified pairs; only the texts of members that stand in a pair are fetched.

        A filter of fixed size keeps the other texts out of the shuffle.
        """
        asked = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).distinct()
        known = keep(asked.join(members.select("member", "text.t1", "text.t2"), "member"), "asked-members")
        wanted = keep(hash_filter(known, "t1"), "asked-texts")
        texts = keep(
            maybe_in(own.select(*hashes, "text"), "t1", wanted)
            .join(known.hint("merge"), ["t1", "t2"]).select("member", "text"),
            "member-texts",
        )
        drop_unused_shuffles(docs.sparkSession)
        found = keep(_verify(pairs, texts.dropDuplicates(["member"]), words, percent), "near-links")
        drop_kept(texts)
        return found

    def expanded(near: DataFrame, place: DataFrame, inside: DataFrame) -> DataFrame:
        """Pairs of members of different components: of the group pairs ``near``, and those ``inside`` groups."""
        between = near.join(place.toDF("a", "ma", "ca"), "a").join(place.toDF("b", "mb", "cb"), "b").where("ca <> cb")
        return between.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).union(inside).distinct()

    # Members of one group stand in one list of their own, in the same rounds.
    in_group = keep(
        members.join(leaders.where("members > 1").select("grp", F.col("members").alias("k")), "grp").select(
            F.col("grp").alias("token"), F.col("member").alias("grp"), "n", "k", F.lit(0).alias("pos"),
            F.lit(True).alias("alone"), "bits",
        ),
        "group-lists",
    )
    told = postings.join(prefixes.select(F.col("member").alias("grp"), "alone", "bits"), "grp")

    def placed(place: DataFrame, links: DataFrame) -> DataFrame:
        """``place`` with the components that ``links`` join as one; only links between components are followed."""
        of = place.select("member", "component")
        between = links.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(
            F.col("ca").alias("a"), F.col("cb").alias("b")
        )
        label = components(between).toDF("component", "joined")
        joined = keep(
            place.join(label, "component", "left").select(
                "grp", "member", F.coalesce("joined", "component").alias("component")
            ),
            "member-components",
        )
        drop_unused_shuffles(docs.sparkSession)
        return joined

    def drawn(place: DataFrame, seed: int | None) -> tuple[DataFrame, DataFrame]:
        """Candidate pairs of groups, and of members within groups, of different components.

        Each is stored: one plan of all that follows would make the driver hold, at each
        of its many stages, the metrics of the whole plan anew.
        """
        spans = place.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        ones = place.select(
            F.col("member").alias("grp"), F.col("component").alias("low"), F.col("component").alias("high")
        )
        groups = keep(_candidates(told.join(spans, "grp"), percent, seed, counted=seed is None), "group-pairs")
        inside = keep(_candidates(in_group.join(ones, "grp"), percent, seed), "inside-pairs")
        drop_unused_shuffles(docs.sparkSession)
        return groups, inside

    place = members.select("grp", "member", F.col("member").alias("component"))
    for seed in [*range(ROUNDS), None]:
        groups, inside = drawn(place, seed)
        near = groups if seed is None else keep(_overlap_filter(groups, prefixes, percent), "near-groups")
        found = linked(keep(expanded(near, place, inside), "near-pairs"))
        place = placed(place, found)
    drop_kept(postings)

    label = (
        members.join(place.select("member", "component"), "member").select("c1", "c2", "component")
    )
    rows = keep(facts.join(label, ["c1", "c2"]).select("row", "doc_id", "component"), "component-rows")
    # Stored, so that the join below may be split where one component holds many rows.
    first_of = keep(
        rows.groupBy("component").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("first")
        ),
        "component-first",
    )
    found = rows.join(first_of, "component").select(
        "row", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("component_row")
    )
    return (
        sets.select("row", "doc_id", F.col("n").alias("n_shingles"))
        .join(found, "row", "left")
        .select(
            "row",
            "doc_id",
            "n_shingles",
            F.expr("case when component_row is null then doc_id else component_id end").alias("component_id"),
            F.coalesce("component_row", "row").alias("component_row"),
        )
    )


def near_report(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Nulls, repeated ids, ties and empty tables are treated as in :func:`near_components`;
    a document that links with nothing is its own component.
    """
    return near_components(docs).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, stored: bool = False
) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest ``doc_id``.

    A null id comes after all others; of rows with one id the one read first stays.
    Texts without words are linked with nothing and stay.  The columns are those of
    ``docs``, whatever their names; an empty table gives an empty one.  A ``stored`` table
    of Parquet files is read again and not copied (see :func:`numbered_rows`).
    """
    key = unused_name(docs, "row")
    numbered = numbered_rows(docs, key, "near-docs", stored)
    # The own row number stands in for the id, ranked as the ids are.
    ranked = numbered.select(F.col(key).alias("doc_id"), "text")
    with passing_tables(docs.sparkSession):
        found = keep(
            near_components(ranked, words, percent).select(
                F.col("doc_id").alias(key), F.col("component_id").alias("component")
            ),
            "near-found",
            lasting=True,
        )
    ids = numbered.select(key, "doc_id").join(found, key)
    stay = ids.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", key)).alias("first")
    ).select(F.col("first")[key].alias(key))
    # The rows that stay grow with the corpus: merged at every size.
    return numbered.join(keep(stay, "near-stay").hint("merge"), key, "left_semi").drop(key)
