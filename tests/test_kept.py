"""Observed outcomes, merged label tables, quarantine, chunks and report folders."""

import os

import pytest
from pyspark.sql import functions as F

import postmeter as pm
from postmeter.operators import trends

BRAND = ["influencer_brand"]


def raw_posts(spark, rows, names=("Date", "Engagements", "Platform", "Influencer Brand")):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


ROWS = [
    ("2023-01-01", "1", "A", "x"), ("2023-01-01", "4", "B", "x"), (None, "5", "A", "x"), ("soon", "5", "A", "y"),
    ("2023-01-03", "bad", "A", "y"), ("2023-01-02", None, None, "y"), ("2023-01-02", "inf", "B", None),
]


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("by_day", [False, True])
def test_outcome_is_observed_while_the_table_is_written(spark, by_day):
    raw = raw_posts(spark, ROWS).repartition(3)
    posts, outcome = pm.keep_posts(raw, by_day=by_day)
    assert tuples(outcome) == tuples(pm.cleaning_outcome(raw))
    assert outcome.schema == pm.cleaning_outcome(raw).schema
    assert tuples(posts.drop("day")) == tuples(pm.clean_posts(raw))
    assert "_given_engagements" not in posts.columns


def test_outcome_of_nothing_and_without_engagements(spark):
    for raw in (raw_posts(spark, []), raw_posts(spark, ROWS).drop("Engagements"), raw_posts(spark, [(None,) * 4])):
        posts, outcome = pm.keep_posts(raw)
        assert tuples(outcome) == tuples(pm.cleaning_outcome(raw))
        assert posts.count() == outcome.first()["rows_kept"]


def test_outcome_is_counted_again_if_a_task_was_observed_twice(spark, monkeypatch):
    from postmeter.operators import keep

    class Twice:
        def __init__(self, name):
            self.get = {"rows_kept": 99}

    raw = raw_posts(spark, ROWS)
    monkeypatch.setattr(keep, "Observation", Twice)
    monkeypatch.setattr(keep, "observed_posts", lambda raw, observation, formats: pm.clean_posts(raw, formats))
    assert tuples(pm.keep_posts(raw)[1]) == tuples(pm.cleaning_outcome(raw))


@pytest.mark.parametrize("origin", [True, False])
def test_posts_and_quarantine_are_all_rows(spark, tmp_path, origin):
    text = "Date,Platform,Note\n2023-01-01,A,x\n,B,y\nnever,C,\"z\nz\"\n2023-01-02\n2023-01-03,D,e,EXTRA\nNA,E,w\n"
    (tmp_path / "u.csv").write_text(text)
    posts, rejects = pm.read_posts_csv(spark, str(tmp_path), origin=origin)
    left_out = pm.quarantine(posts)
    assert pm.clean_posts(posts).count() + left_out.count() + rejects.count() == 6
    found = {r["record"]: r["reason"] for r in left_out.collect()}
    if origin:
        assert found == {",B,y": "no date", 'never,C,"z\nz"': "not a date: never", "NA,E,w": "no date"}
        assert all(r["file"].endswith("u.csv") for r in left_out.collect())
        assert left_out.unionByName(rejects).count() == 4
    else:
        assert found['{"date":"never","platform":"C","note":"z\\nz"}'] == "not a date: never" and len(found) == 3


def test_quarantine_tries_the_formats(spark):
    raw = raw_posts(spark, [("31.12.2023", "1", "A", "x"), ("32.12.2023", "1", "A", "x")])
    assert [r["reason"] for r in pm.quarantine(raw, ["dd.MM.yyyy"]).collect()] == ["not a date: 32.12.2023"]
    assert pm.quarantine(raw_posts(spark, [])).collect() == []
    with pytest.raises(ValueError, match="date"):
        pm.quarantine(raw.drop("Date"))


@pytest.mark.parametrize("by", [(), BRAND], ids=["whole", "brand"])
def test_merged_labels_give_what_all_posts_give(spark, by):
    dates = [f"2023-01-{d:02}" for d in (1, 2, 3)]
    rows = [(dates[i % 3], str(i * 7 % 5), f"P{i % 4}", None if i % 9 == 0 else f"b{i % 2}") for i in range(90)]
    posts = pm.clean_posts(raw_posts(spark, rows))
    batches = [pm.clean_posts(raw_posts(spark, rows[k::4])) for k in range(4)] + [pm.clean_posts(raw_posts(spark, []))]
    labels = pm.keep_labels(batches[0], by)
    for batch in batches[1:]:
        labels = pm.add_to_labels(labels, batch, by)
    assert tuples(labels) == tuples(pm.keep_labels(posts, by))
    for made in (pm.campaign_insights, pm.campaign_summary, pm.campaign_prompts, pm.report_lines):
        assert tuples(made(None, by, labels=labels)) == tuples(made(posts, by))


def test_adding_a_batch_reads_no_old_post(spark, tmp_path):
    for k in range(2):
        pm.write_clean(pm.clean_posts(raw_posts(spark, ROWS[k::2])), str(tmp_path / f"{k}"))
    old, new = (pm.read_clean(spark, str(tmp_path / f"{k}")) for k in range(2))
    merged = pm.merge_labels([pm.keep_labels(old), pm.label_table(new)])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "0") not in plan and str(tmp_path / "1") in plan


def test_chunks_joined_are_the_list_of_the_summary(spark):
    rows = [("2023-01-01", str(i % 13), f"P{i % 37}", f"b{i % 2}") for i in range(500)]
    posts = pm.clean_posts(raw_posts(spark, rows))
    texts = {r["influencer_brand"]: r["summary"] for r in pm.campaign_summary(posts, BRAND).collect()}
    lists = {b: t.split("Engagement per platform: ")[1].split("\n")[0] for b, t in texts.items()}
    chunks = pm.summary_chunks(posts, BRAND, size=4).where("chart = 'platform'").orderBy("influencer_brand", "chunk").collect()
    for brand, listed in lists.items():
        own = [r for r in chunks if r["influencer_brand"] == brand]
        assert [r["chunk"] for r in own] == list(range(-(-len(listed.split(', ')) // 4))) and all(r["n_labels"] <= 4 for r in own)
        assert ", ".join(r["text"] for r in own) == listed


def test_one_ordered_file_per_campaign(spark, tmp_path):
    posts = pm.clean_posts(raw_posts(spark, [("2023-01-01", "1", "A", f"b{i % 7}") for i in range(70)] + [("2023-01-02", "1", "A", None)]))
    document = pm.report_document(posts, BRAND)
    for fmt in ("json", "text"):
        pm.write_report(document, str(tmp_path / fmt), BRAND, fmt, folders=True)
        folders = sorted(f for f in os.listdir(tmp_path / fmt) if "=" in f)
        assert len(folders) == 8
        for folder in folders:
            files = [f for f in os.listdir(tmp_path / fmt / folder) if f.startswith("part-")]
            assert len(files) == 1
            lines = (tmp_path / fmt / folder / files[0]).read_text().splitlines()
            assert lines[0].count("Campaign report") and lines[-1].count("End of report")
    with pytest.raises(ValueError, match="folders"):
        pm.write_report(document, str(tmp_path / "x"), folders=True)


@pytest.mark.parametrize("most", [trends.EDGE_CAMPAIGNS, 1])
def test_ordered_trend_compares_posts_of_two_dates_only(spark, monkeypatch, most):
    monkeypatch.setattr(trends, "EDGE_CAMPAIGNS", most)
    rows = [("2023-01-01", "3", "b", "x"), ("2023-01-01", "5", "a", "x"), ("2023-01-09", "7", "a", "x"), ("2023-01-09", "2", "a", "x"),
            ("2023-01-05", "9", "z", "x"), ("2023-01-02", "4", None, None), ("2023-01-02", "6", "k", None)]
    posts = pm.clean_posts(raw_posts(spark, rows, ("Date", "Engagements", "Tie", "Influencer Brand")).withColumn(
        "Influencer Brand", F.nullif("Influencer Brand", F.lit("none"))))
    want = [("Unknown", 2, 4.0, 6.0, "rising"), ("x", 5, 5.0, 2.0, "falling")]
    found = pm.post_trend(posts, BRAND, order_col="tie")
    assert tuples(found) == want
    assert tuples(pm.post_trend(posts, order_col="tie")) == [(7, 5.0, 2.0, "falling")]
    if most > 1:
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Sort" not in plan[plan.index("BroadcastHashJoin") :]
    none = posts.where("false")
    assert tuples(pm.post_trend(none, order_col="tie")) == [(0, None, None, "none")]
    assert tuples(pm.post_trend(none, BRAND, order_col="tie")) == []
