"""Mixing overlapping sources to target weights, by a min-cost flow.

Texts are grouped by their membership pattern: the sources that hold them.  Words flow
from the patterns to the quotas of their sources.  A pattern may send each of its
sources what that source's rows of it hold, times the most repeats; what it sends in
all costs more with every time that its distinct texts have been used up (the cost is
convex).  So a source prefers texts that the mix does not have yet, and leaves a shared
text to a source with nothing else.  The flow is found cost level by cost level, each a
maximum flow on top of the last, which is the cheapest for costs that depend on the level
alone.

The flow decides how many words of each pattern each source takes.  Its rows are taken
whole as often as that allows; the rest comes from the rows that a seeded hash puts
first, the last of them in part.  The place where these end is found digit by digit of
the hash, with sums per digit, so no group is sorted or gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, text_or_empty

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 17
# Patterns that the flow routes one by one, those of most words; the texts of any other
# count for the source of their row, as if no other source had them.
ROUTED_PATTERNS = 4096
_DIGIT = 10
_HASH_BITS = 60


def targets(sizes: Sequence[int], weights: Sequence[int], most: int = MOST_REPEATS) -> list[Fraction]:
    """Words wanted of each source: all words shared by weight, ``most`` times its size at most.

    What a source cannot take is shared among the others by weight, until none is
    above its bound.
    """
    bound: dict[int, Fraction] = {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in bound]
        rest = sum(sizes) - sum(bound.values())
        whole = sum(weights[i] for i in open_)
        shares = {i: Fraction(rest * weights[i]) / whole for i in open_}
        over = [i for i in open_ if shares[i] > most * sizes[i]]
        if not over:
            return [bound[i] if i in bound else shares[i] for i in range(len(sizes))]
        bound |= {i: Fraction(most * sizes[i]) for i in over}


class _Network:
    """Maximum flow from quotas to patterns; capacities may grow between runs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def link(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _distances(self, start: int, end: int) -> list[int]:
        far = [-1] * len(self.out)
        far[start] = 0
        queue = deque([start])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 0 and far[self.to[e]] < 0:
                    far[self.to[e]] = far[a] + 1
                    queue.append(self.to[e])
        return far

    def push(self, start: int, end: int) -> int:
        """Send as much more as fits; shortest ways first."""
        sent = 0
        while (far := self._distances(start, end))[end] >= 0:
            tried = [0] * len(self.out)
            way: list[int] = []
            a = start
            while True:
                if a == end:
                    fits = min(self.room[e] for e in way)
                    sent += fits
                    cut = 0
                    for i in range(len(way) - 1, -1, -1):
                        self.room[way[i]] -= fits
                        self.room[way[i] ^ 1] += fits
                        if not self.room[way[i]]:
                            cut = i
                    a = self.to[way[cut] ^ 1]
                    del way[cut:]
                    continue
                edges = self.out[a]
                while tried[a] < len(edges):
                    e = edges[tried[a]]
                    if self.room[e] > 0 and far[self.to[e]] == far[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(edges):
                    way.append(edges[tried[a]])
                    a = self.to[way[-1]]
                elif way:
                    a = self.to[way.pop() ^ 1]
                    tried[a] += 1
                else:
                    break
        return sent


def levels(most: int) -> list[int]:
    """Times that a text is used up to each cost level: 1, 2, 3, 4, then doubling."""
    out = list(range(1, min(most, 4) + 1))
    while out[-1] < most:
        out.append(min(most, out[-1] * 2))
    return out


def route(
    quotas: Sequence[int], distinct: Sequence[int], capacity: Mapping[tuple[int, int], int]
) -> dict[tuple[int, int], int]:
    """Words that each ``(pattern, source)`` sends, by the cheapest flow that meets the quotas.

    ``distinct`` has the words of each pattern's different texts, ``capacity`` the most
    that a pattern may send to a source.  Sending more than k times ``distinct`` costs
    more than sending it k times.  Quotas beyond all capacity are met as far as it goes.
    """
    sources, patterns = len(quotas), len(distinct)
    start, end = sources + patterns, sources + patterns + 1
    net = _Network(end + 1)
    for s, quota in enumerate(quotas):
        net.link(start, s, quota)
    held = [0] * patterns
    # The texts of fewest sources come first.
    width = [0] * patterns
    for p, _ in capacity:
        width[p] += 1
    edge = {k: net.link(k[1], sources + k[0], capacity[k]) for k in sorted(capacity, key=lambda k: (width[k[0]], k))}
    for (p, _), room in capacity.items():
        held[p] += room
    sink = [net.link(sources + p, end, 0) for p in range(patterns)]
    most = max((-(-held[p] // distinct[p]) for p in range(patterns) if distinct[p]), default=0)
    left, before = sum(quotas), [0] * patterns
    for times in levels(most) if most else []:
        for p in range(patterns):
            upto = min(times * distinct[p], held[p])
            net.room[sink[p]] += upto - before[p]
            before[p] = upto
        left -= net.push(start, end)
        if not left:
            break
    return {k: net.room[e ^ 1] for k, e in edge.items()}


def _narrow(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, k1, k2, h`` of each row; ``k1, k2`` hash its text, ``h`` draws it."""
    text = text_or_empty(docs)
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(5), text)
    drawn = F.xxhash64(F.lit(SEED), docs["doc_id"].cast("long"), k1, k2)
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        k1.alias("k1"),
        k2.alias("k2"),
        F.shiftrightunsigned(drawn, 64 - _HASH_BITS).alias("h"),
    )


def _with_patterns(rows: DataFrame, routed: int) -> DataFrame:
    """``rows`` with the number of their source and their pattern, a text of such numbers."""
    several = (
        rows.select("k1", "k2", "src")
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set("src")).alias("all"))
        .where(F.size("all") > 1)
        .select("k1", "k2", F.array_join("all", ",").alias("shared"))
    )
    shared = keep(several, "shared-texts")
    marked = keep(rows.join(shared, ["k1", "k2"], "left"), "marked-rows")
    words = marked.where("shared is not null").groupBy("shared").agg(F.sum("size").alias("words"))
    top = keep(words.orderBy(F.desc("words"), "shared").limit(routed).select("shared", F.col("shared").alias("pattern")), "patterns")
    return marked.join(top, "shared", "left").select(
        "doc_id", "src", "size", "k1", "k2", "h", F.coalesce("pattern", F.col("src").cast("string")).alias("pattern")
    )


def _ends(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where the part of each group ``(pattern, src)`` of ``rows`` ends.

    ``wanted (pattern, src, need)`` has a need below the size of the group and above 0.
    Result: ``last``, the hash that the part ends with, ``part``, the words that rows of
    that hash still give, and ``tied``, their words in all.
    """
    keys = ["pattern", "src"]
    open_ = wanted.select(*keys, F.lit(0).cast("long").alias("prefix"), "need")
    shift, done = _HASH_BITS, []
    while True:
        shift -= _DIGIT
        inside = rows.join(open_.drop("need"), keys).where(
            F.shiftright("h", shift + _DIGIT) == F.col("prefix")
        )
        sums = inside.groupBy(*keys, F.shiftright("h", shift).alias("digit")).agg(
            F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        # A group has at most 2^10 digits here.
        upto = F.sum("words").over(Window.partitionBy(*keys).orderBy("digit"))
        crossed = (
            sums.withColumn("upto", upto)
            .join(open_, keys)
            .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
            .select(*keys, "digit", "low", "high", "words", (F.col("need") - F.col("upto") + F.col("words")).alias("need"))
        )
        crossed = keep(crossed, "ends")
        single = F.col("low") == F.col("high")
        done.append(crossed.where(single).select(*keys, F.col("low").alias("last"), F.col("need").alias("part"), F.col("words").alias("tied")))
        if shift == 0 or crossed.where(~single).isEmpty():
            break
        open_ = crossed.where(~single).select(*keys, F.col("digit").alias("prefix"), "need")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, routed: int = ROUTED_PATTERNS) -> DataFrame:
    """How many words of each row of ``docs (doc_id, text, source)`` the mix takes.

    Sources in code point order, null last, have the ``weights``, over and over.
    ``doc_id, size, source_size, target, taken``: the words of the text (null: 0), of its
    source, the source's target, and the words taken, repeats counted; a part of a row
    is its first words.  The words taken of a source are its target rounded down to a
    whole number, but for rows that agree in id and text, which are taken alike and may
    lose a word each.  The same rows give the same mix in any order.  An empty table
    gives an empty one, and a source without words takes none.

    The driver holds one row per source and per source of a routed pattern.
    """
    rows = keep(_narrow(docs), "sizes")
    spark = docs.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    facts = spark.createDataFrame(
        [(i, r["source"], r["size"], float(t)) for i, (r, t) in enumerate(zip(found, wanted))],
        "src int, source string, source_size long, target double",
    )
    numbered = rows.join(facts.select("src", "source"), rows["source"].eqNullSafe(facts["source"])).drop("source")
    placed = keep(_with_patterns(numbered, routed), "placed-rows")
    held = placed.where("size > 0").groupBy("pattern", "src").agg(F.sum("size").alias("words")).collect()
    texts = placed.where("size > 0").groupBy("pattern", "k1", "k2").agg(F.max("size").alias("size"))
    distinct = {r["pattern"]: r["words"] for r in texts.groupBy("pattern").agg(F.sum("size").alias("words")).collect()}
    names = sorted(distinct)
    at = {name: i for i, name in enumerate(names)}
    words = {(at[r["pattern"]], r["src"]): r["words"] for r in held}
    flow = route(
        [int(t) for t in wanted], [distinct[n] for n in names], {k: most * v for k, v in words.items()}
    )
    plan = keep(
        spark.createDataFrame(
            [(names[p], s, flow[p, s] // words[p, s], flow[p, s] % words[p, s]) for p, s in sorted(flow)],
            "pattern string, src int, times long, need long",
        ),
        "plan",
    )
    ends = _ends(placed.where("size > 0"), plan.where("need > 0").select("pattern", "src", "need"))
    steps = keep(plan.join(ends, ["pattern", "src"], "left"), "steps")
    h, last = F.col("h"), F.col("last")
    share = F.floor(F.col("part") * F.col("size") / F.col("tied"))
    extra = F.when(h < last, F.col("size")).when(h == last, share).otherwise(0)
    taken = F.coalesce("times", F.lit(0)) * F.col("size") + F.coalesce(extra, F.lit(0))
    return (
        placed.join(steps, ["pattern", "src"], "left")
        .join(facts.drop("source"), "src")
        .select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
    )
