"""Hot groups of the exact classes, and phrases whose rarest words are common."""

import random
import re

import pytest

from postmeter.llm import decontamination, exact_dedup

from .test_operators import table

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def skew_settings(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_joins_of_a_hot_radix_group_are_split(spark, skew_settings, monkeypatch):
    plans = {}
    write = exact_dedup.keep

    def watched(df, name, **more):
        df.collect()
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **more)

    monkeypatch.setattr(exact_dedup, "keep", watched)
    # Equal in length and head, apart or equal only after 40 or 700 bytes.
    hot = ["h" * 40 + "m" * 660 + f"{i % 300:04d}" for i in range(2700)]
    texts = hot + [f"{i} alone" for i in range(300)]
    docs = table(spark, texts)
    found = {r["doc_id"]: r for r in exact_dedup.dedup_report(docs).collect()}
    assert "skew=true" in plans["radix-rows"][0]
    assert any("skew=true" in plan for plan in plans["radix-step"])
    for i in range(2700):
        assert (found[i]["keep_id"], found[i]["group_size"]) == (2400 + i % 300, 9)
    assert all(found[i]["kept"] for i in range(2700, 3000))


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items, window):
    out = []
    for text in texts:
        own, hit, named = words(text), set(), set()
        for item, said in items:
            w = words(said)
            size = min(window, len(w))
            runs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in runs:
                    hit.update(range(i, i + size))
                    named.add(item)
        out.append((len(own), len(hit), sorted(named)))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefghijkl"])
@pytest.mark.parametrize("window", [3, 10])
@pytest.mark.parametrize("few", [0, decontamination.ASKING_ROWS])
def test_phrases_of_common_and_repeated_words(spark, monkeypatch, letters, window, few):
    monkeypatch.setattr(decontamination, "ASKING_ROWS", few)
    draw = random.Random(len(letters) * 100 + window)
    said = [" ".join(draw.choices(letters, k=k)) for k in (1, 2, 3, 9, 10, 11, 14, 20, 20)]
    items = [(f"i{k}", t) for k, t in enumerate(said)] + [("none", ""), ("null", None), ("twice", said[-1]), ("twice", said[-1])]
    texts = [None, "", "zz", said[0], said[-1] + " " + said[-1], " ".join(said)]
    for _ in range(40):
        filler = " ".join(draw.choices(letters + "xyz", k=draw.randrange(30)))
        texts.append(filler + " " + draw.choice(said) + " , " + filler)
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.contamination(table(spark, texts), bench, window).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found}
    assert [got[i] for i in range(len(texts))] == brute(texts, items, window)


def test_contamination_of_odd_empty_and_repeated_rows(spark):
    bench = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    assert decontamination.contamination_report(table(spark, []), bench).collect() == []
    assert decontamination.drop_contaminated(table(spark, []), bench).collect() == []
    texts, ids = ["one two three", "one two three", None, "clean"], [None, None, 7, 7]
    found = decontamination.contamination_report(table(spark, texts, ids), bench).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"]) for r in found) == [("7", 0), ("7", 0), ("None", 3), ("None", 3)]
    kept = decontamination.drop_contaminated(table(spark, texts, ids), bench).collect()
    assert [r["doc_id"] for r in kept] == [7, 7]
