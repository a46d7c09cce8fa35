"""Every operator against brute force on small tables."""

import random
import re
import textwrap
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from postmeter.llm import (
    components,
    decontamination,
    exact_dedup,
    language_id,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    pii,
    token_counts,
    token_files,
)
from postmeter.llm.byte_bpe import ByteBpe
from postmeter.llm.common import tokenizer_path

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Names that an operator might use itself.
        T.StructField("row", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("pos", T.StringType()),
    ]
)


def table(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, g, "x", 1, None) for i, t, g in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", " ", "\n\n", "a", "A", "é", "É", "word", "1 2 3", "漢字 仮名", "x" * 5000, "b c " * 2000, "\U0001f600 ok"]


REPORTS = {
    "exact": exact_dedup.dedup_report,
    "near": ngram_join.near_report,
    "lines": line_dedup.line_report,
    "pii": pii.pii_report,
    "licenses": licenses.license_report,
    "language": language_id.language_report,
    "counts": token_counts.token_counts,
    "files": token_files.token_file_report,
    "packing": packing.packing_report,
}


@pytest.mark.parametrize("name", list(REPORTS))
def test_odd_rows_each_give_a_result(spark, name):
    texts = ODD + ODD
    ids = [None, None, *range(len(texts) - 2)]
    found = REPORTS[name](table(spark, texts, ids)).collect()
    assert {r["doc_id"] for r in found} == set(ids)
    if name != "packing":
        assert len(found) == len(texts)


@pytest.mark.parametrize("name", list(REPORTS))
def test_empty_table_gives_an_empty_one(spark, name):
    assert REPORTS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("name", list(REPORTS))
def test_repeated_rows_stay_rows(spark, name):
    found = REPORTS[name](table(spark, ["one two three four five"] * 4, [7, 7, 7, 8])).collect()
    assert sorted(r["doc_id"] for r in found) == [7, 7, 7, 8]


def test_exact_classes(spark):
    texts = ["Aa", "aA", "aa ", "é", "É", None, "", "x" * 40 + "y", "x" * 40 + "z", "X" * 40 + "Y", "q" * 9000, "Q" * 9000]
    found = {r["doc_id"]: r for r in exact_dedup.dedup_report(table(spark, texts)).collect()}
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want["".join(c.lower() if c.isascii() else c for c in t or "")].append(i)
    for members in want.values():
        for i in members:
            assert (found[i]["keep_id"], found[i]["group_size"]) == (max(members), len(members))
            assert found[i]["kept"] == (i == max(members))
    kept = exact_dedup.drop_copies(table(spark, texts))
    assert kept.columns == [f.name for f in DOCS.fields]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(m) for m in want.values())


def test_one_of_repeated_ids_stays(spark):
    kept = exact_dedup.drop_copies(table(spark, ["same"] * 5, [1, 1, None, 1, None])).collect()
    assert [r["doc_id"] for r in kept] == [1]


def shingles(text, words):
    own = (text or "").encode().lower().split()
    if len(own) < words:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)}


def brute_components(texts, words=4, percent=85):
    sets = [shingles(t, words) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("words,percent,seed", [(4, 85, 1), (5, 80, 2), (4, 85, 3)])
def test_near_components(spark, words, percent, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 7)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own) if rng.random() < 0.7 else "\t".join(own).upper())
        texts.append(" ".join(base + passage))
    # A large group of near copies: each differs from the base in one word.
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts += [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(80)]
    found = ngram_join.near_components(table(spark, texts), words, percent).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert got == brute_components(texts, words, percent)
    kept = ngram_join.drop_near_copies(table(spark, texts), words, percent)
    want = {c for _, c in brute_components(texts, words, percent).values()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_near_components_of_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 9)
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    texts = []
    for k in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            own[rng.randrange(len(own))] = f"new{rng.randrange(40)}"
        texts.append(" ".join(own))
    for rounds in (0, 1):
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        found = ngram_join.near_components(table(spark, texts)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts)


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, k, np.uint64)) for k in (0, 1, 40, 300, 2000)]
    sets += [np.union1d(sets[3][20:], sets[2])]
    n = np.array([len(s) for s in sets])
    maps = ngram_join._bitmaps(ngram_join._parities(np.concatenate(sets), n))
    assert maps.shape == (len(sets), ngram_join.CELLS // 64) and not maps[0].any()
    for x, a in zip(maps, sets):
        for y, b in zip(maps, sets):
            differ, real = int(np.bitwise_count(x ^ y).sum()), len(np.setxor1d(a, b))
            assert differ <= real and differ % 2 == real % 2


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(1, 1)]
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    got = {r["node"]: r["component"] for r in found}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}}


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    lines = ["", "a", "b", "aa", "ab", "é", "hello world", "hello worl", "hello worlds", "hxllo world"]
    lines += ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8))) for _ in range(25)] + [None, ""]
    seen, want = [], {}
    for d, text in enumerate(texts):
        own, gone = (text or "").split("\n"), []
        for p, line in enumerate(own):
            if line.strip(" "):
                if any(within_one(line, s) for s in seen):
                    gone.append(str(p))
                seen.append(line)
        want[d] = (len(own), len(own) - len(gone), ",".join(gone))
    found = line_dedup.line_report(table(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_kept"], r["dropped"]) for r in found} == want
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(table(spark, ["x1 long line\nk", "x2 long line\nm"]).coalesce(1)).collect()}
    assert sorted(left.values(), key=len) == ["m", "x1 long line\nk"] or len(left) == 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", [5, 6])
def test_lines_by_length_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    edits = line_dedup.Edits(4, 12)
    lines = ["1", "2", "}", "{", "ab", "ac", "abc", "abd", "abcd", "abce"]
    for n in [3, 4, 5, 11, 12, 13, 14, 15, 16, 17, 23, 40] * 2:
        base = "".join(rng.choice("abcdef é") for _ in range(n)) + "."
        lines.append(base)
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(1, 3)):
                at, kind = rng.randrange(len(own)), rng.randrange(3)
                own[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice("abcdefé")]
            lines.append("".join(own))
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    seen, want = [], {}
    for d, text in enumerate(texts):
        gone = []
        for p, line in enumerate(text.split("\n")):
            if line.strip(" "):
                for s in seen:
                    short = min(len(line), len(s))
                    if distance(line, s) <= (0 if short < 4 else 1 if short < 12 else 2):
                        gone.append(str(p))
                        break
                seen.append(line)
        want[d] = ",".join(gone)
    found = line_dedup.line_report(table(spark, texts), edits).collect()
    assert {r["doc_id"]: r["dropped"] for r in found} == want


def test_drop_lines_leaves_exactly(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(198)) + "zz"
    two, three = "Q" + long[1:120] + "Q" + long[121:], "R" + long[1:60] + "R" + long[61:150] + "R" + long[151:]
    texts = [f"x1 long line\nk\n1\n{{\n{long}", f"x2 long line\nm\n2\n}}\n{two}", f"k\n12.5\n{three}\n12.6"]
    left = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(table(spark, texts).coalesce(1).sortWithinPartitions("doc_id")).collect()}
    assert left == {0: texts[0], 1: "m\n2\n}", 2: f"12.5\n{three}\n12.6"}
    with pytest.raises(ValueError):
        line_dedup.line_places(table(spark, ["a"]), line_dedup.Edits(1, 5))


def test_contamination(spark):
    ten = [f"t{i}" for i in range(14)]
    bench = spark.createDataFrame(
        [(1, " ".join(ten)), (2, "short Item"), (3, None), (4, "!!"), (10, "short item"), (None, "other thing")],
        "item_id long, text string",
    )
    texts = [
        "pre " + " ".join(ten[2:13]) + " post", " ".join(ten[:9]), "a Short, item b short item", None, "",
        "other thing", "other\nTHING é", " ".join(ten) + " " + " ".join(ten),
    ]
    found = {r["doc_id"]: r for r in decontamination.contamination(table(spark, texts), bench).collect()}
    assert [found[i]["n_hit"] for i in range(8)] == [11, 0, 4, 0, 0, 2, 2, 28]
    assert [found[i]["n_words"] for i in range(8)] == [13, 9, 6, 0, 0, 2, 3, 28]
    assert found[2]["items"] == ["10", "2"] and found[0]["items"] == ["1"] and found[5]["items"] == []
    kept = decontamination.drop_contaminated(table(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4}
    empty = decontamination.contamination_report(table(spark, ["a b"]), bench.limit(0)).collect()
    assert [r["contaminated"] for r in empty] == [False]


def test_proximity(spark):
    index = decontamination.build_index(table(spark, ["alpha x x beta", "alpha x x x x x beta", "beta alpha"]))
    runs = spark.createDataFrame([("p", ["alpha", "beta"])], "phrase string, words array<string>")
    found = decontamination.proximity_matches(index, runs, 3)
    keys = {r["row"]: r["term"] for r in index.where("pos = 0").collect()}
    assert {keys[r["row"]] for r in found.collect()} == {0, 2}


def test_language_accuracy(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.language_report(pages).join(pages.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = [(r["lang"] == r["lang_pred"], r["score"]) for r in found.collect()]
    assert len(rows) > 100 and sum(ok for ok, _ in rows) / len(rows) > 0.97
    assert all(0 <= s <= 1 for _, s in rows)


def test_language_without_letters_or_labels(spark):
    found = language_id.language_report(table(spark, ["1 2", None, "abc"], langs=[None] * 3)).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    kept = language_id.drop_unknown_language(table(spark, ["1 2", None, "abc de"]))
    assert [r["doc_id"] for r in kept.collect()] == [2]
    assert kept.columns == [f.name for f in DOCS.fields]


def test_language_stage_drops_what_resembles_no_language(spark):
    words = "the cat and the dog were in the house and saw the garden".split()
    texts = [" ".join(words[i % 5 :]) for i in range(40)] + ["漢字仮名交じり文 " * 9, "### @@ 12", None, "", "the dog"]
    langs = ["en"] * 40 + [None] * 5
    docs = table(spark, texts, langs=langs)
    kept = language_id.drop_unknown_language(docs, 0.2)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(40), 44]


def test_language_stage_keeps_texts_when_no_label_is_there(spark):
    docs = table(spark, ["plain words", "plain words", None, "12", "more"], [1, 1, 2, 3, None], [None] * 5)
    assert sorted(map(repr, (r["doc_id"] for r in language_id.drop_unknown_language(docs).collect()))) == ["1", "1", "None"]
    assert language_id.drop_unknown_language(table(spark, [])).collect() == []


def odd_texts(seed, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]


PARTS = [" ", "  ", "\n", "\t", "　", "a", "B", "'s", "the", "1", "é", "漢", "!", "<|endoftext|>", "\r\n", " y", "▁", "\U0001f600", "<s>", "\x00"]


def test_byte_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    texts = odd_texts(1, PARTS)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids, ends = ByteBpe().encode(pa.array(texts, pa.large_string()))
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_piece_counts_are_those_of_the_library():
    import sentencepiece

    texts = odd_texts(2, PARTS) + ["abc" * 200, "x" * 3000, " " * 100, "aé漢" * 70 + " b"]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    counted = token_counts.PieceCounter().count(pa.array(texts, pa.large_string()))
    assert counted.tolist() == [len(library.encode(t)) for t in texts]


@pytest.mark.parametrize("width", [1, 3, 8, 15, 16, 17, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 257, np.uint64).astype(np.uint32)
    ends = np.array([0, 10, 10, 250, 257])
    block = token_files.make_block(ids, ends, width)
    got, back = token_files.read_block(block)
    assert (got == ids).all() and (back == ends).all()
    for i, (a, b) in enumerate(zip([0, *ends], ends)):
        assert (token_files.read_document(block, i) == ids[a:b]).all()


def test_token_files_in_order(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [f"document {i} " * (i % 7) for i in range(60)]
    found = token_files.read_token_files(token_files.write_token_files(table(spark, texts))).collect()
    at = 0
    for r in sorted(found, key=lambda r: r["doc_id"]):
        want = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert r["start"] == at and np.frombuffer(r["ids"], "<u4").tolist() == want
        at += len(want)


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ODD + ["some words here " * k for k in range(0, 900, 23)]
    limits = packing.Limits(1024, 5, 900)
    pieces = packing.pack_documents(table(spark, texts), limits).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for d, text in enumerate(texts):
        parts = sorted(own[d], key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist()
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert {p["doc_tokens"] for p in parts} == {len(ids)}
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in parts])
        assert [p["offset"] for p in parts] == [0, *ends[:-1]]
        assert ends[-1] <= 1024 and len(parts) <= 5 and sum(p["loss_tokens"] for p in parts) <= 900


def test_packing_conversations_bears_loss_on_answers(spark):
    turns = spark.createDataFrame(
        [(1, "user", "a question"), (1, "assistant", "an answer"), (2, None, None)], "conv_id long, role string, text string"
    )
    pieces = packing.pack_conversations(turns).collect()
    assert sorted((p["loss_tokens"] > 0) for p in pieces) == [False, False, True]


def test_examples_that_may_not_be_cut():
    packer = packing.Packer(packing.Limits(10, 3, 10), cut=False)
    examples = [packing.Example(i, np.zeros(k, np.uint32), np.ones(k, bool)) for i, k in enumerate([7, 3, 6, 4, 5, 5])]
    done = [*packer.add(examples), *packer.finish()]
    assert sorted(sum(len(x.ids) for x in s) for s in done) == [10, 10, 10]


def test_packer_counts_each_example_once(monkeypatch):
    """What waits is not measured anew for each sequence."""
    counted = []
    sizes = packing._sizes
    monkeypatch.setattr(packing, "_sizes", lambda examples: counted.append(len(examples)) or sizes(examples))
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1400, 1500)
    packer = packing.Packer(pool=200)
    examples = [packing.Example(i, np.zeros(k, np.uint32), np.ones(k, bool)) for i, k in enumerate(lengths)]
    done = [*packer.add(examples), *packer.finish()]
    assert sum(counted) <= len(lengths) + len(done)
    assert all(sum(len(x.ids) for x in s) == 1024 for s in done[:-1])
    placed = defaultdict(list)
    for x in (x for s in done for x in s):
        placed[x.key].append((x.start, len(x.ids)))
    for i, k in enumerate(lengths):
        at = 0
        for start, own in sorted(placed[i]):
            assert start == at
            at += own
        assert at == k


def test_pii_base_spans(spark):
    text = "é😀 mail a.b@c.example.com, 10.0.0.256, 8.8.8.8, 4111 1111 1111 1111 +49 (30) 123456-7 x@y.z_d@e.f"
    row = pii.pii_report(table(spark, [text])).collect()[0]
    at = [(k, v) for k, v in (s.split(":", 1) for s in row["spans"].split(","))]
    base = {(k, text[int(v.split(":")[0]) : int(v.split(":")[1])]) for k, v in at if k in pii.BASE}
    assert ("email", "a.b@c.example.com") in base and ("ip", "8.8.8.8") in base
    assert ("card", "4111 1111 1111 1111") in base and ("phone", "+49 (30) 123456-7") in base
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (3, 1, 1, 1)


# The patterns as the contract words them.
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
}


def proposed(spark, texts):
    got = defaultdict(list)
    for r in pii.candidates(table(spark, texts)).where("kind is not null").orderBy("doc_id", "kind", "i").collect():
        got[r["doc_id"], r["kind"]].append(r["value"])
    return got


def test_pii_patterns_match_as_the_contract_words_them(spark):
    rng = random.Random(4)
    parts = ["1", "22", "0", " ", "-", ".", "..", "@", "a", "b-c", "_", "%", "+", "é", "x@y.z", "1.2.3.4", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 24))) for _ in range(2000)]
    got = proposed(spark, texts)
    for d, text in enumerate(texts):
        for kind, pattern in CONTRACT.items():
            assert got[d, kind] == re.findall(pattern, text), (kind, text)


def test_pii_long_runs(spark):
    runs = ["7" * 100_000, "1 " * 50_000 + "1", "4-" * 50_000 + "4", "3.14" + "15" * 200_000, "a@b" + ".c" * 50_000, "q" * 200_000 + " @ 1.2.3"]
    got = proposed(spark, runs)
    assert [got[d, "card"] for d in range(3)] == [[r] for r in runs[:3]]
    assert got[3, "card"] == [runs[3][2:]] and got[4, "email"] == [runs[4]] and not got[5, "email"]
    assert len(pii.pii_report(table(spark, runs)).collect()) == len(runs)


def test_pii_gates_let_every_match_through(spark):
    names = [f"{t}{dot} {n}" for t in pii.TITLES for dot in ("", ".") for n in ("Müller", "Émile", "Özil", "Żak", "Ωmega", "Ann")]
    samples = {
        "email": ["é@é a@b.c", "%@-.-"], "ip": ["1.2.3.4", "é0.0.0.00"], "card": ["12", "1 2", "é1-2"],
        "phone": ["+1 2", "+1((2"], "secret": ["TOKEN=abcdefgh", "Api-Key : \"abcd_efgh", "password:12345678"], "name": names,
    }
    texts = [f"é {x}, y" for values in samples.values() for x in values]
    kinds = [k for k, values in samples.items() for _ in values]
    got = proposed(spark, texts)
    assert [k for d, k in enumerate(kinds) if not got[d, k]] == []
    assert [got[d, "name"] for d, k in enumerate(kinds) if k == "name"] == [[n] for n in names]


def test_reliabilities_tell_a_good_labeler_from_a_bad_one():
    patterns = [((1, 1, 1, 1, 1), 80), ((-1, -1, -1, -1, 1), 80), ((1, 1, 1, -1, 1), 5), ((-1, -1, -1, 1, 1), 5)]
    prior, tables = pii.reliabilities(patterns)
    assert 0.3 < prior < 0.7
    assert tables[0][1][0] > 0.9 > tables[0][1][1]
    assert abs(tables[4][1][0] - tables[4][1][1]) < 0.05


def test_license_rules(spark):
    mit = licenses.SENTENCES["mit-grant"] + ":\n\n" + licenses.SENTENCES["mit-notice"].replace(" and ", "\nand ") + "."
    texts = [
        "Released under the MIT License.\nText.", mit, licenses.SENTENCES["mit-notice"], "x\nlicensed under  cc by-nc 4.0!",
        "the licence of poets", None,
    ]
    found = {r["doc_id"]: r for r in licenses.license_report(table(spark, texts)).collect()}
    assert [found[i]["licenses"] for i in range(6)] == ["MIT", "MIT", "", "CC-BY-NC-4.0", "", ""]
    assert [found[i]["restricted"] for i in range(6)] == [False, False, False, True, False, False]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 A. Writer

""" + textwrap.fill(licenses.SENTENCES["mit-grant"], 70) + ":\n\n" + textwrap.fill(licenses.SENTENCES["mit-notice"], 70) + "."


def gnu(name, version, mark=";", what="program"):
    return f"""frob - does things
Copyright (C) 2020 A. Writer

This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the {name} as published by
the Free Software Foundation{"," if mark == ":" else mark} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def comment(text, sign):
    return "\n".join(f"{sign} {line}".rstrip() for line in text.split("\n"))


def test_real_wrapped_headers(spark):
    lesser = "GNU Lesser General Public License"
    cases = [
        (APACHE, "Apache-2.0", False), ("Copyright 2020 X\n\n" + APACHE, "Apache-2.0", False),
        (comment("Copyright 2020 X\n\n" + APACHE, "#"), "Apache-2.0", False),
        (comment(textwrap.fill(APACHE.replace("\n\n", " "), 40), " *"), "Apache-2.0", False),
        (MIT, "MIT", False), (comment(MIT, "//"), "MIT", False), ("The MIT License\n\nwords", "MIT", False),
        (gnu("GNU General Public License", 2), "GPL-2.0", True), (gnu("GNU General Public License", 3, ":"), "GPL-3.0", True),
        (comment(gnu("GNU General Public License", 3), " *"), "GPL-3.0", True), (gnu(lesser, "2.1", what="library"), "LGPL-2.1", True),
        (gnu(lesser, 3, ":"), "LGPL-3.0", True), (gnu("GNU Library General Public License", 2), "LGPL-2.0", True),
        (gnu("GNU Affero General Public License", 3, ":").replace("\n", "\r\n"), "AGPL-3.0", True),
        (gnu("GNU General Public License", 2).replace("either version 2 of the License, or\n(at your option) any later version", "version 2 of the License"), "GPL-2.0", True),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL", "MPL-2.0", True),
        ("\n".join(["The MIT License. x"] + ["Licensed under CC BY 4.0"] * 20000), "CC-BY-4.0,MIT", False),
        ("you may not use this file except in compliance with the License.", "", False),
    ]
    found = {r["doc_id"]: r for r in licenses.license_report(table(spark, [c[0] for c in cases])).collect()}
    assert [(found[i]["licenses"], found[i]["restricted"]) for i in range(len(cases))] == [c[1:] for c in cases]
    assert found[0]["sentence_ids"].split(",")[:2] == ["apache-header-license", "apache-may-not"]
    assert "apache-as-is" in found[0]["sentence_ids"] and set(found[4]["sentence_ids"].split(",")) == {"mit-grant", "mit-notice"}
    assert all(found[i]["n_sentences"] > 0 for i in found)


BSD2 = "\n\n".join(licenses.SENTENCES[k] + "." for k in ("bsd-redistribution", "bsd-source", "bsd-binary"))
BSD3 = BSD2 + "\n\n" + licenses.SENTENCES["bsd-names"] + "."


def test_longer_rules_and_identifier_lines(spark):
    texts = [BSD2, BSD3, BSD2 + "\n\n" + BSD3, "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", "# SPDX-License-Identifier: MIT\n", "MIT"]
    found = {r["doc_id"]: (r["licenses"], r["restricted"]) for r in licenses.license_report(table(spark, texts)).collect()}
    assert [found[i] for i in range(6)] == [
        ("BSD-2-Clause", False), ("BSD-3-Clause", False), ("BSD-2-Clause,BSD-3-Clause", False), ("GPL-3.0", True), ("MIT", False), ("", False),
    ]


def test_many_notices_in_one_document(spark):
    begun = time.time()
    rows = licenses.license_report(table(spark, [(BSD2 + "\n\n") * 10_000, (licenses.SENTENCES["bsd-redistribution"] + ".\n") * 20_000])).collect()
    assert sorted((r["licenses"], r["n_sentences"]) for r in rows) == [("", 20_000), ("BSD-2-Clause", 30_000)]
    assert time.time() - begun < 60


def test_license_sql_reads_wrapped_headers_alike(spark):
    import duckdb

    texts = [APACHE, MIT, comment(MIT, "//"), BSD3, textwrap.fill(BSD3, 60), gnu("GNU General Public License", 3, ":"), "x", None, comment(APACHE, "#")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    wanted = con.execute(licenses.oracle_sql())
    names = [d[0] for d in wanted.description]
    got = [tuple(r[n] for n in names) for r in licenses.license_report(table(spark, texts)).collect()]
    assert sorted(got) == sorted(wanted.fetchall())


def test_every_sentence_is_in_a_rule_and_every_rule_has_sentences():
    ruled = {i for _, ids, _ in licenses.RULES for x in ids for i in x.split(",")}
    assert ruled == set(licenses.SENTENCES)
