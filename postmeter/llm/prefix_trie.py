"""The trie of shared beginnings of conversations, through vertical bitmaps.

Conversations are sharded by ranges of their ids, and long ones by blocks of turns
too, so that a shard has a bounded size whatever the data.  A shard indexes each
(position, turn) as the bitset of its conversations that have that turn there.
Starting from all its conversations, it takes the lowest one left, intersects what is
left with the posting of that conversation's next turn, and so gets a child, its
popcount and, against the bitset of conversations of that length, its end list; then
it goes down into the child.  A child of one conversation needs no more
intersections: the rest of that conversation is its own.

A node has a key that does not depend on the shard: the XOR of 128 hashed bits per
(position, turn) on its path.  Shards meet by key.  The smallest member owns a node, so
each conversation owns a (possibly empty) lower part of its path, and a node is a pair
of owner and depth.  What a conversation does not own it saves, which turns sums over
subtrees into sums over the members of each node; no step goes level by level, and
every count is added up before it is shuffled.

Turns are numbered by ranges of the sorted table, so a conversation of any length is
spread over tasks.  Rows without ``conv_id`` are no conversation and are left out.
Turns of one conversation with equal ``turn`` come in the order of their role, then of
a hash of their text.  An empty table gives an empty trie, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

# Ids of a shard and turns of a block: a shard holds at most their product of turns.
SHARD = 1280
BLOCK = 1024

NO_ENDS = hashlib.sha256(b"").hexdigest()


def _shard(conv: Column) -> Column:
    return F.floor(conv / SHARD).cast("long")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv, pos, c1, c2, bytes`` of each turn, numbered from 0 in each conversation.

    ``c1, c2`` are hashes of role and text, where null counts as empty.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("long").alias("conv"),
        turns["turn"].alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("c1"),
        F.xxhash64(F.lit(11), role, text).alias("c2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    keys = ["conv", "turn", "role", "c1"]
    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys, "c2")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            at = np.arange(len(conv)) - np.repeat(first, np.diff(first, append=len(conv)))
            if conv[0] == last:
                at[: first[1] if len(first) > 1 else len(conv)] += upto
            last, upto = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(conv), part, np.int64)), pa.array(at), *batch.columns[1:]],
                ["conv", "part", "at", "c1", "c2", "bytes"],
            )

    schema = "conv long, part long, at long, c1 long, c2 long, bytes long"
    placed = keep(ranged.select("conv", "c1", "c2", "bytes").mapInArrow(number, schema), "turns")
    # Only a conversation that goes on in another range has turns before that range.
    counts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = keep(
        counts.select("conv", "part", F.sum("n").over(earlier).alias("before")).where("before > 0"), "before"
    )
    return placed.join(before, ["conv", "part"], "left").select(
        "conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "c1", "c2", "bytes"
    )


def lengths(turns: DataFrame) -> DataFrame:
    """``conv, len``."""
    return turns.groupBy("conv").agg(F.count("*").alias("len"))


def _key(pos: Column, content: Column) -> Column:
    return F.xxhash64(pos, content)


_PLACES = (
    "conv long, depth long, k1 long, k2 long, before long, bytes long, len long,"
    " members long, ends array<long>"
)


def _bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _first_of_each(*columns: np.ndarray) -> np.ndarray:
    """True where any of the sorted columns changes."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return change


def _shard_trie(table: pa.Table) -> pa.Table:
    """The nodes of one shard: a row per conversation and depth, the lowest has the node's members."""
    columns = {name: table.column(name).to_numpy() for name in table.column_names}
    order = np.lexsort((columns["pos"], columns["conv"]))
    conv, pos, k1, k2, size, length = (columns[c][order] for c in ("conv", "pos", "k1", "k2", "bytes", "len"))
    given = columns["given"][order].astype(bool)
    first = np.flatnonzero(_first_of_each(conv))
    counts = np.diff(first, append=len(conv))
    local = np.repeat(np.arange(len(first)), counts)
    # Along a conversation the key of a node is that of its parent and one turn more.
    keys = []
    for k in (k1, k2):
        along = np.bitwise_xor.accumulate(k)
        keys.append(along ^ np.repeat(along[first] ^ k[first], counts))
    upto = np.cumsum(size)
    upto -= np.repeat(upto[first] - size[first], counts)
    # Postings: the bitset of each (position, turn) that several conversations have.
    by_turn = np.lexsort((k2, k1, pos))
    starts = _first_of_each(pos[by_turn], k1[by_turn], k2[by_turn])
    posting = np.empty(len(pos), np.int64)
    posting[by_turn] = np.cumsum(starts) - 1
    shared = np.bincount(posting) > 1
    bitset: dict[int, int] = {}
    ending: dict[int, int] = {}
    ended = pos + 1 == length
    for p, c in zip(posting[shared[posting]].tolist(), local[shared[posting]].tolist()):
        bitset[p] = bitset.get(p, 0) | (1 << c)
    for d, c in zip(length[ended].tolist(), local[ended].tolist()):
        ending[d] = ending.get(d, 0) | (1 << c)
    members = np.ones(len(pos), np.int64)
    ends: dict[int, list[int]] = {}
    ids, post, begin = conv[first].tolist(), posting.tolist(), first.tolist()
    low, rows_of = int(pos.min()), counts.tolist()
    # The nodes that the block starts from: the root, or those reached before it.
    stack: list[tuple[int, int]] = []
    if given[first].all():
        stack.append(((1 << len(first)) - 1, low))
    else:
        reached: dict[tuple[int, int], int] = {}
        for c, at in enumerate(begin):
            node = (int(keys[0][at]), int(keys[1][at]))
            reached[node] = reached.get(node, 0) | (1 << c)
        stack += [(bits, low + 1) for bits in reached.values()]
    alone = [False] * len(first)
    while stack:
        left, at = stack.pop()
        while left:
            bit = left & -left
            c = bit.bit_length() - 1
            place = at - low
            if place >= rows_of[c]:
                left ^= bit
                continue
            row = begin[c] + place
            child = left & bitset.get(post[row], bit)
            left ^= child
            count = child.bit_count()
            if count == 1:
                alone[c] = True
                continue
            for other in _bits(child ^ bit):
                members[begin[other] + place] = 0
            members[row] = count
            done = child & ending.get(at + 1, 0)
            if done:
                ends[row] = [ids[x] for x in _bits(done)]
                child ^= done
            if child:
                stack.append((child, at + 1))
    # Conversations that end alone; those that end in a shared node are in its list.
    last = np.flatnonzero(ended & np.array(alone)[local] & given)
    ends.update((r, [i]) for r, i in zip(last.tolist(), conv[last].tolist()))
    lists = pa.array([ends.get(r) for r in np.flatnonzero(given).tolist()], pa.list_(pa.int64()))
    out = [conv, pos + 1, *keys, upto - size, size, length, members]
    return pa.Table.from_arrays(
        [*[pa.array(x[given]) for x in out], lists], [c.split()[0] for c in _PLACES.split(",")]
    )


def _places(turns: DataFrame) -> DataFrame:
    """Shard tries of ``conv, pos, c1, c2, bytes, len``."""
    keyed = turns.select(
        "conv",
        "pos",
        _key(F.col("pos"), F.col("c1")).alias("k1"),
        _key(F.col("pos"), F.col("c2")).alias("k2"),
        "bytes",
        "len",
    )
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    # What a long conversation holds before each block after the first.
    sums = keyed.where(F.col("len") > BLOCK).groupBy("conv", "len", block.alias("block")).agg(
        F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("bytes").alias("bytes")
    )
    upto = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.select(
        "conv",
        ((F.col("block") + 1) * BLOCK - 1).alias("pos"),
        F.bit_xor("k1").over(upto).alias("k1"),
        F.bit_xor("k2").over(upto).alias("k2"),
        F.sum("bytes").over(upto).alias("bytes"),
        "len",
        (F.col("block") + 1).alias("block"),
        F.lit(False).alias("given"),
    ).where(F.col("pos") + 1 < F.col("len"))
    parts = keyed.withColumn("block", block).withColumn("given", F.lit(True)).unionByName(starts)
    grouped = parts.withColumn("shard", _shard(F.col("conv"))).groupBy("shard", "block")
    return grouped.applyInArrow(_shard_trie, _PLACES)


def _end_digests(chunks: DataFrame) -> DataFrame:
    """``owner, depth, ends_sha256`` of ``owner, depth, ends``, sorted id lists by ascending shard.

    The lists of a node pass through one task in pieces and are never held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for owner, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                data = ",".join(map(str, ids)).encode()
                if (owner, depth) == node:
                    digest.update(b"," + data)
                    continue
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (owner, depth), hashlib.sha256(data)
            yield _digests(done)
        if node:
            yield _digests([(*node, digest.hexdigest())])

    def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        kinds = {"owner": pa.int64(), "depth": pa.int64(), "ends_sha256": pa.string()}
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds)
        )

    sorted_chunks = (
        chunks.withColumn("first", F.get("ends", F.lit(0)))
        .repartition("owner", "depth")
        .sortWithinPartitions("owner", "depth", "first")
    )
    return sorted_chunks.select("owner", "depth", "ends").mapInArrow(
        run, "owner long, depth long, ends_sha256 string"
    )


def trie_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns (conv, pos, c1, c2, bytes)``.

    ``convs (conv, len)`` has every conversation, those without a turn too.  Result:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``; a node is named by its smallest member and its depth.
    """
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("owner")).first()
    places = keep(_places(turns.join(convs, "conv")), "places")
    nodes = keep(places.groupBy("k1", "k2").agg(F.sum("members").alias("n"), F.min("conv").alias("owner")), "nodes")
    columns = ["conv", "depth", "owner", "n", "before", "bytes", "len", "ends"]
    below = places.join(nodes, ["k1", "k2"]).select(*columns)
    turnless = F.when(F.col("len") == 0, F.array("conv"))
    at_root = convs.select(
        "conv",
        F.lit(0).cast("long").alias("depth"),
        F.lit(root["owner"]).cast("long").alias("owner"),
        F.lit(root["n"]).cast("long").alias("n"),
        F.lit(0).cast("long").alias("before"),
        F.lit(0).cast("long").alias("bytes"),
        "len",
        F.lit(None).cast("array<long>").alias("ends"),
    )
    paths = keep(below.unionByName(at_root), "paths")
    own = F.col("owner") == F.col("conv")
    # Where a conversation leaves the paths of smaller ones, and the bytes it shares with them.
    chains = keep(
        paths.groupBy("conv").agg(
            F.max("len").alias("len"),
            F.min(F.when(own, F.col("depth"))).alias("top"),
            F.max_by(F.when(~own, F.col("owner")), F.when(~own, F.col("depth"))).alias("above"),
            F.coalesce(F.max(F.when(~own, F.col("before") + F.col("bytes"))), F.lit(0)).alias("shared"),
        ),
        "chains",
    )
    heads = chains.where("top > 0").select(F.col("above").alias("conv"), (F.col("top") - 1).alias("len"))
    ends_owned = chains.where("top is not null").join(heads.distinct(), ["conv", "len"], "left_anti")
    leaf = ends_owned.select("conv", F.lit(1).alias("leaf"))
    facts = keep(
        chains.join(leaf, "conv", "left").select(
            "conv", "top", "above", "shared", F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")
        ),
        "facts",
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = F.col("owner") == F.col("conv")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("above"))
    counted = paths.join(facts, "conv").select(
        "owner",
        "depth",
        F.when(own, parent).alias("parent"),
        F.when(own, F.col("n")).alias("n"),
        F.when(own & (F.col("len") > F.col("depth")), 1).otherwise(0).cast("long").alias("children"),
        F.col("leaf").alias("leaves"),
        F.when(own, 0).otherwise(F.col("shared") - F.col("before")).alias("saved"),
        F.lit(None).cast("string").alias("ends_sha256"),
    )
    attached = heads.select(
        F.col("conv").alias("owner"), F.col("len").alias("depth"), none, none, F.lit(1).cast("long"), zero, zero,
        F.lit(None).cast("string"),
    )
    # Conversations without a turn end at the root, listed by shard like all others.
    empty = convs.where("len = 0").groupBy(_shard(F.col("conv"))).agg(F.sort_array(F.collect_list("conv")).alias("ends"))
    chunks = paths.where("ends is not null").select("owner", "depth", "ends").unionByName(
        empty.select(F.lit(root["owner"]).cast("long").alias("owner"), zero.alias("depth"), "ends")
    )
    digests = _end_digests(chunks).select("owner", "depth", none, none, zero, zero, zero, "ends_sha256")
    return (
        counted.union(attached)
        .union(digests)
        .groupBy("owner", "depth")
        .agg(
            F.max("parent").alias("parent_conv_id"),
            F.max("n").alias("n_convs"),
            F.sum("children").alias("n_children"),
            F.sum("leaves").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
            F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        .withColumnRenamed("owner", "conv_id")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations (conv_id, turn, role, text)`` as they are."""
    turns = ordered_turns(conversations)
    return trie_nodes(turns, keep(lengths(turns), "lengths"))


# Conversations that share their beginnings, and the most turns they share.
FAMILY = 5
LONGEST_LOAN = 8


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns, convs)`` in which families of conversations begin alike.

    Conversation c takes its first h = crc32(decimal c) mod 9 turns from conversation
    c - c mod 5 (all it has if fewer, none if there is none), then goes on with its own
    after the first h.
    """
    own = keep(lengths(turns), "lengths")
    lender = own.select(F.col("conv").alias("lender"), F.col("len").alias("lent"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (LONGEST_LOAN + 1)
    wanted = own.withColumn("h", h).withColumn("lender", F.col("conv") - F.pmod("conv", F.lit(FAMILY)))
    plan = keep(
        wanted.join(lender, "lender", "left").select(
            "conv", "h", "len", F.least("h", F.coalesce("lent", F.lit(0))).alias("taken")
        ),
        "loans",
    )
    later = (
        turns.join(plan, "conv")
        .where("pos >= h")
        .select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "c1", "c2", "bytes")
    )
    lent = turns.where((F.col("pos") < LONGEST_LOAN) & (F.pmod("conv", F.lit(FAMILY)) == 0))
    family = F.explode(F.array(*[F.col("conv") + k for k in range(FAMILY)]))
    begun = (
        lent.select(family.alias("conv"), "pos", "c1", "c2", "bytes")
        .join(plan.select("conv", "h"), "conv")
        .where("pos < h")
        .drop("h")
    )
    convs = plan.select("conv", (F.col("taken") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"))
    return later.unionByName(begun), keep(convs, "convs")


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    return trie_nodes(*rebuilt(ordered_turns(conversations)))


def _crc32(text: str) -> str:
    """DuckDB expression for the crc32 of a decimal number."""
    step = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    byte = f"list_reduce([xor(x, y)::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda x, y: {byte}), 4294967295)"


def oracle_sql() -> str:
    """The same trie by prefix strings and a join of every node with its subtree."""
    return f"""
        with t as (
            select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
                   row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as p
            from conversations where conv_id is not null
        ),
        own as (select c, count(*) as n from t group by c),
        plan as (
            select o.c, {_crc32("o.c::varchar")} % {LONGEST_LOAN + 1} as h, o.c - o.c % {FAMILY} as d, o.n, coalesce(l.n, 0) as lent
            from own o left join own l on l.c = o.c - o.c % {FAMILY}
        ),
        turns as (
            select plan.c, r, x, p from plan join t on t.c = d and p < h
            union all
            select plan.c, r, x, least(h, lent) + p - h from plan join t on t.c = plan.c and p >= h
        ),
        paths as (
            select c, 0 as d, '' as k, 0 as b from own
            union all
            select c, p + 1, string_agg(md5(r || chr(31) || x), '/') over (partition by c order by p), strlen(x) from turns
        ),
        steps as (select *, lag(k) over (partition by c order by d) as up, d = max(d) over (partition by c) as last from paths),
        nodes as (
            select k, d, any_value(up) as up, any_value(b) as b, min(c) as owner, count(*) as n,
                   sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) as ends
            from steps group by k, d
        ),
        kids as (select up as k, count(*) as n from nodes where d > 0 group by up),
        below as (select distinct a.k as top, b.k from paths a join paths b on a.c = b.c and b.d >= a.d),
        sums as (
            select top as k, count(*) filter (kids.n is null) as leaves, sum((v.n - 1) * v.b) as saved
            from below join nodes v using (k) left join kids using (k) group by top
        )
        select u.owner as conv_id, u.d::bigint as depth, p.owner as parent_conv_id, u.n as n_convs,
               coalesce(kids.n, 0) as n_children, leaves as n_leaves, saved::bigint as saved_tokens, u.ends as ends_sha256
        from nodes u left join nodes p on p.k = u.up and u.d > 0 left join kids on kids.k = u.k join sums on sums.k = u.k
    """
