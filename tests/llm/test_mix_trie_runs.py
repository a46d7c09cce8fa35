"""Mixing, conversation trie and periodic runs against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from postmeter.llm import mixing, periodic_runs, prefix_trie

from .test_operators import ODD, table

# --- runs of words ----------------------------------------------------------


def brute_runs(words):
    """All maximal runs, by comparing the words with those of every distance."""
    found, numbers = [], {}
    a = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    for q in range(1, len(words) // 4 + 1):
        edges = np.diff(np.concatenate([[0], (a[:-q] == a[q:]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) + q).tolist()):
            if e - s >= 4 * q and not any(s >= x and e <= y and q % p == 0 for x, y, p in found):
                found.append((s, e, q))
    return sorted((s, e - s, q) for s, e, q in found if e - s >= 6)


def brute_report(words):
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repeated_words(rng):
    letters, words = rng.choice([1, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        block = [str(rng.randrange(letters)) for _ in range(rng.randint(1, 20))]
        words += (block * 7)[: rng.randint(1, len(block) * rng.randint(1, 7))]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    texts = [repeated_words(rng) for _ in range(400)]
    batch = pa.array([rng.choice(["", " ", "\n\t"]) + "  ".join(t) + rng.choice(["", "\r"]) for t in texts])
    found = periodic_runs._runs_of(batch.cast(pa.large_string()))
    got = defaultdict(list)
    for doc, *run in zip(found.doc.tolist(), found.start.tolist(), found.length.tolist(), found.period.tolist()):
        got[doc].append(tuple(run))
    assert [sorted(got[i]) for i in range(len(texts))] == [brute_runs(t) for t in texts]


def test_runs_of_fibonacci_words():
    """Words full of squares and cubes, but without a fourth power: no run."""
    a, b = ["a"], ["b"]
    while len(b) < 3000:
        a, b = b, b + a
    assert brute_runs(b) == []
    assert len(periodic_runs._runs_of(pa.array([" ".join(b)]).cast(pa.large_string())).doc) == 0


def test_runs_report(spark):
    rng = random.Random(9)
    texts = ODD + [" ".join(repeated_words(rng)) for _ in range(60)] + ["z y " * 100_000, "a " * 5, "a " * 6, "é é " * 4]
    ids = [None, *range(1, len(texts))]
    found = {r["doc_id"]: tuple(r)[1:] for r in periodic_runs.runs_report(table(spark, texts, ids)).collect()}
    for i, text in zip(ids, texts):
        words = [w.decode() for w in (text or "").encode().split()]
        if len(words) < 50_000:
            assert found[i] == brute_report(words), i
    assert found[len(texts) - 4][:5] == (1, 0, 200_000, 2, 100_000_000)
    rows = periodic_runs.periodic_runs(table(spark, ["a b " * 4, None, "a b " * 4], [5, 6, 5])).collect()
    assert [tuple(r) for r in rows] == [(5, 0, 8, 2)] * 2


def test_collapse_runs_keeps_columns_and_rows(spark):
    docs = table(spark, ["x " + "a b " * 5 + " end", " plain  text ", None, ""])
    kept = periodic_runs.collapse_runs(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, "x a b end"), (1, " plain  text "), (2, None), (3, "")]


def test_runs_of_empty_tables(spark):
    for operator in (periodic_runs.runs_report, periodic_runs.periodic_runs, periodic_runs.collapse_runs):
        assert operator(table(spark, [])).collect() == []
    planted = periodic_runs.plant_runs(table(spark, [None, "a b"], [None, 3]))
    assert sorted(r["text"] for r in planted.collect()) == ["", "a b"]


def test_runs_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: tuple(r)[1:] for r in periodic_runs.runs_report(periodic_runs.plant_runs(docs)).collect()}
    planted = 0
    for row in docs.collect():
        words = [w.decode() for w in (row["text"] or "").encode().split()]
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        assert found[row["doc_id"]] == brute_report(words)
    assert planted


# --- trie of conversations --------------------------------------------------


def brute_trie(conversations):
    """Nodes of ``{conv: [(role, text), ...]}`` by their prefixes."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    if not conversations:
        return []
    below = defaultdict(set)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].add(path)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(path))
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below[path] if v)
        out.append(
            (
                min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children[path],
                sum(not children[v] for v in below[path]), saved, hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out)


def brute_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return turns, out


TURNS = "conv_id long, turn long, role string, text string, conv string, n long, len string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], TURNS).repartition(3)


def random_turns(rng, count, longest):
    rows, begun = [], [[("user", "hé"), ("assistant", "")] * 9, [("system", None), ("user", "b")] * 9]
    for c in rng.sample(range(-20, 4 * count), count):
        own = rng.choice(begun)[: rng.randint(0, 18)]
        own = own + [(rng.choice(["user", None, ""]), rng.choice(["a", "bb", None, "ü" * 9])) for _ in range(rng.randint(0, longest))]
        rows += [(c, None if not t and rng.random() < 0.3 else t, *turn) for t, turn in enumerate(own)]
    return rows


@pytest.mark.parametrize("shard, block", [(prefix_trie.SHARD, prefix_trie.BLOCK), (10, 4)])
def test_trie_of_random_conversations(spark, monkeypatch, shard, block):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = random_turns(random.Random(shard), 60, 25)
    plain, wanted = brute_rebuilt(rows)
    table_ = conversations(spark, rows)
    assert sorted(map(tuple, prefix_trie.trie_report(table_).collect())) == brute_trie(wanted)
    assert sorted(map(tuple, prefix_trie.prefix_trie(table_).collect())) == brute_trie(plain)


def test_trie_of_copies_nulls_and_nothing(spark):
    copy = [(0, "user", "same"), (1, None, None)]
    rows = [(c, *t) for c in [3, 11, 4000, 9, 10_000] for t in copy]
    want = brute_trie(brute_rebuilt(rows)[0])
    nobody = [(None, 0, "user", "no conversation"), (None, None, None, None)]
    got = prefix_trie.prefix_trie(conversations(spark, rows + nobody)).collect()
    assert sorted(map(tuple, got)) == want
    assert prefix_trie.trie_report(conversations(spark, [])).collect() == []
    assert prefix_trie.trie_report(conversations(spark, nobody)).collect() == []


def test_tied_turns_come_in_one_order(spark):
    rows = [(5, 1, "user", t) for t in "abcdef"] + [(6, 1, "user", t) for t in "fedcba"]
    got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
    assert sorted(r["n_convs"] for r in got) == [2] * 7


def test_long_conversation_over_ranges(spark):
    """One conversation holds most rows and is numbered over several tasks."""
    rows = [(10, t, "user", str(t % 7)) for t in range(3000)] + [(c, t, "user", str(t % 7)) for c in (11, 12) for t in range(40)]
    got = prefix_trie.prefix_trie(conversations(spark, rows)).collect()
    assert len(got) == 3001 and {r["conv_id"] for r in got} == {10}
    nodes = {r["depth"]: r for r in got}
    for d in range(3001):
        shared = 2 * sum(len(str(t % 7)) for t in range(max(d, 1) - 1, 40))
        assert (nodes[d]["n_convs"], nodes[d]["saved_tokens"]) == (3 if d <= 40 else 1, shared)
        assert (nodes[d]["n_children"], nodes[d]["n_leaves"]) == (int(d < 3000), 1)
    assert nodes[40]["ends_sha256"] == hashlib.sha256(b"11,12").hexdigest()


# --- mixing -----------------------------------------------------------------


def flow_cost(sent, distinct, held):
    """Cost of what each pattern sends: the k-th level costs k for every word."""
    cost = 0
    for p, words in enumerate(sent):
        before = 0
        for k, times in enumerate(mixing.levels(max(1, -(-held[p] // distinct[p])))):
            upto = min(times * distinct[p], held[p])
            cost += k * max(0, min(words, upto) - before)
            before = upto
    return cost


@pytest.mark.parametrize("seed", range(12))
def test_route_is_the_cheapest_flow(seed):
    rng = random.Random(seed)
    distinct = [rng.randint(1, 3) for _ in range(3)]
    capacity = {(p, s): rng.randint(1, 4) for p in range(3) for s in range(2) if p == 2 or p == s}
    held = [sum(v for (q, _), v in capacity.items() if q == p) for p in range(3)]
    most = [sum(v for (_, t), v in capacity.items() if t == s) for s in range(2)]
    quotas = [rng.randint(0, m) for m in most]
    flow = mixing.route(quotas, distinct, capacity)
    keys = list(capacity)
    assert all(0 <= flow[k] <= capacity[k] for k in keys)
    assert [sum(flow[k] for k in keys if k[1] == s) for s in range(2)] == quotas
    costs = []
    for values in itertools.product(*[range(capacity[k] + 1) for k in keys]):
        given = dict(zip(keys, values))
        if [sum(v for k, v in given.items() if k[1] == s) for s in range(2)] == quotas:
            costs.append(flow_cost([sum(v for k, v in given.items() if k[0] == p) for p in range(3)], distinct, held))
    assert flow_cost([sum(flow[k] for k in keys if k[0] == p) for p in range(3)], distinct, held) == min(costs)


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.targets([100, 1, 1], [1, 2, 3]) == [96, 3, 3]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], [1]) == []
    assert mixing.targets([50, 0, 2, 8], [1, 2, 3, 1]) == [30, 0, 6, 24]


def sourced(spark, rows):
    schema = "doc_id long, text string, source string, src int, size string, h long, pattern string"
    return spark.createDataFrame([(*r, 1, "x", 2, None) for r in rows], schema).repartition(3)


def mixed(rows, found):
    """Words taken by source, and the targets."""
    source = {r[0]: r[2] for r in rows}
    taken, target = defaultdict(int), {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    return taken, target


def test_mix_meets_its_targets_and_reruns_agree(spark):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(99)) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "a b\x1cc"]
    names = ["s1", "s0", None, "", "é", "z"]
    rows = [(i, rng.choice(texts), names[min(int(rng.expovariate(0.7)), 5)]) for i in range(600)]
    rows += [(600 + i, "the same words for a third of all", rng.choice(names)) for i in range(300)]
    found = mixing.mix(sourced(spark, rows)).collect()
    assert len(found) == len(rows)
    taken, target = mixed(rows, found)
    sizes = [sum(len((t or "").encode().split()) for _, t, s in rows if s == n) for n in sorted(target, key=lambda n: (n is None, n or ""))]
    order = sorted(target, key=lambda n: (n is None, n or ""))
    want = mixing.targets(sizes, [(1, 2, 3)[i % 3] for i in range(len(order))])
    assert [target[n] for n in order] == [float(w) for w in want]
    assert [taken[n] for n in order] == [int(w) for w in want]
    again = mixing.mix(sourced(spark, rows[::-1])).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    # Fewer routed patterns change the texts, not the words of a source.
    assert mixed(rows, mixing.mix(sourced(spark, rows), routed=1).collect())[0] == taken


def test_mix_takes_new_texts_before_copies(spark):
    """A text of two sources is left to the one that has nothing else."""
    shared, other = "a b c d", "e f g h"
    rows = [(0, shared, "x"), (1, other, "x"), (2, shared, "y")]
    found = {r["doc_id"]: r["taken"] for r in mixing.mix(sourced(spark, rows), weights=(1, 1)).collect()}
    assert found[2] == 6 and found[0] + found[1] == 6 and found[1] >= 4


def test_mix_of_repeated_rows_and_nothing(spark):
    assert mixing.mix(sourced(spark, [])).collect() == []
    empty = mixing.mix(sourced(spark, [(1, None, None), (2, "", "a"), (2, "", "a")])).collect()
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in empty) == [(1, 0, 0.0), (2, 0, 0.0), (2, 0, 0.0)]
    rows = [(None, "one two three", "a")] * 4 + [(7, "four five six", "a")] * 3 + [(8, "w " * 20_000, "b")]
    found = mixing.mix(sourced(spark, rows)).collect()
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add(r["taken"])
    assert len(found) == 8 and all(len(v) == 1 for v in by_id.values())
