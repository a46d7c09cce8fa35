"""Corpus queries against their SQL, and the pipeline against brute force."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from postmeter.llm import common, exact_dedup, ngram_join
from postmeter.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import brute_components

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_and_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    found = QUERIES[name](spark, SF_DIR)
    wanted = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert got and got == sorted(wanted.fetchall(), key=repr)


def test_near_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    found = QUERIES["op7_ngram_join"](spark, SF_DIR).collect()
    want = brute_components([r["text"] for r in docs])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(any(c.isalpha() for c in t) for t in kept["language_id"].values())
    texts = kept["exact_dedup"]
    ids = sorted(texts)
    want = brute_components([texts[i] for i in ids], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert set(kept["ngram_join"]) == {ids[c] for _, c in want.values()}
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {p["doc_id"] for p in pieces} == set(kept["decontamination"])


def test_stages_copy_no_stored_table(spark, tmp_path, monkeypatch):
    """Rows of Parquet files are numbered by file and place; the same rows stay as from a copy."""
    names = []
    keep = common.keep
    monkeypatch.setattr(common, "keep", lambda df, name, *args, **more: names.append(name) or keep(df, name, *args, **more))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    twice = docs.union(docs).union(docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    twice.repartition(3).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    found = corpus_pipeline.exact_copies(spark, stored, SF_DIR).collect()
    assert found and not names
    assert Counter(found) == Counter(exact_dedup.drop_copies(stored).collect())
    assert names == ["radix-docs"]
    # A table that is not read from files is copied.
    made = spark.createDataFrame(found, stored.schema)
    assert Counter(corpus_pipeline.exact_copies(spark, made, SF_DIR).collect()) == Counter(found)
    assert names == ["radix-docs"] * 2


def test_kept_documents_are_merged_at_every_size(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    for stage in (corpus_pipeline.exact_copies, corpus_pipeline.near_copies):
        plan = stage(spark, stored, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftSemi" in plan


def test_hash_filter_loses_nothing(spark):
    ids = spark.range(5000).selectExpr("xxhash64(id) as h")
    some = ids.where("h % 7 = 0").union(spark.sql("select 0L union all select -1L union all select 9223372036854775807L"))
    found = {r["h"] for r in common.maybe_in(ids.union(some), "h", common.hash_filter(some, "h")).collect()}
    want = {r["h"] for r in some.collect()}
    assert want <= found and len(found) < len(want) + 100


def test_rows_without_near_sizes_are_no_postings(spark, monkeypatch):
    """Texts that share a rare passage and differ much in length send no postings."""
    stored = []
    keep = ngram_join.keep

    def kept(df, name, *args, **more):
        made = keep(df, name, *args, **more)
        if name == "prefix-postings":
            stored.append(made.count())
        return made

    monkeypatch.setattr(ngram_join, "keep", kept)
    texts = [" ".join(["one rare passage here", *(f"w{k}x{i}" for i in range(4**k))]) for k in range(1, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ngram_join.near_report(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts)
    assert stored == [0]


def test_no_plan_of_the_near_query_holds_many_stages(spark):
    # The driver keeps, for each stage of a plan, the metrics of the whole plan.
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(120)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(own))
    store = spark._jsparkSession.sharedState().statusStore()

    def ran():
        listed = store.executionsList()
        return {e.executionId(): (e.jobs().size(), e.metrics().size()) for e in map(listed.apply, range(listed.size()))}

    before = set(ran())
    found = ngram_join.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts)
    own = [held for i, held in ran().items() if i not in before]
    assert own and max(jobs for jobs, _ in own) <= 8 and max(metrics for _, metrics in own) <= 1500
