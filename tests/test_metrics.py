import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

import postmeter as pm

BRAND = ["influencer_brand"]


def posts(spark, rows, columns):
    """Clean posts from a few columns; the date defaults to one day."""
    df = spark.createDataFrame(rows, columns)
    return pm.clean_posts(df if "date" in df.columns else df.withColumn("date", F.lit("2023-01-01")))


def tuples(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def event_posts(spark):
    df = pm.clean_posts(pm.null_tokens(pm.event_posts(spark, "/root/testdata/sf0.001"))).cache()
    yield df
    df.unpersist()


def test_ties_go_to_the_smaller_label(spark):
    df = posts(spark, [("b", 5.0), ("a", 5.0)], ["platform", "engagements"])
    assert tuples(pm.platform_engagement(df, ordered=True)) == [("a", 5.0), ("b", 5.0)]
    assert tuples(pm.top_platform(df)) == [("a", 5.0)]
    assert tuples(pm.dominant(df, "platform")) == [("a", 1)]
    assert tuples(pm.ranked(pm.platform_engagement(df), "platform", "engagements", 1)) == [("a", 5.0, 1)]


def test_equal_days(spark):
    df = posts(spark, [("2023-01-02", 5.0), ("2023-01-01", 5.0)], ["date", "engagements"])
    day = datetime.date(2023, 1, 1)
    assert tuples(pm.peak_day(df)) == [(day, 5.0)] and tuples(pm.lowest_day(df)) == [(day, 5.0)]
    assert tuples(pm.daily_trend(df)) == [(2, 5.0, 5.0, "stable", False)]
    texts = {r["code"]: r["label"] for r in pm.engagement_insights(df).collect()}
    assert texts == {"trend": "stable", "peak_day": "2023-01-01", "lowest_day": "2023-01-01"}


def test_one_day(spark):
    df = posts(spark, [("2023-01-01 09:00", 5.0), ("2023-01-01 10:00", 7.0)], ["date", "engagements"])
    assert tuples(pm.daily_trend(df)) == [(1, 12.0, 12.0, "not_enough_data", None)]
    assert tuples(pm.post_trend(df)) == [(2, 5.0, 7.0, "rising")]
    assert [r["code"] for r in pm.engagement_insights(df).collect()] == ["not_enough_data"]
    assert [r["position"] for r in pm.report_lines(df).orderBy("position").collect()] == [1, 3, 4, 5]


def test_same_date_takes_the_smallest_at_both_ends(spark):
    df = posts(spark, [("2023-01-01", 5.0), ("2023-01-01", 3.0)], ["date", "engagements"])
    assert tuples(pm.post_trend(df)) == [(2, 3.0, 3.0, "none")]


def test_day_and_post_trend_may_differ(spark):
    df = posts(
        spark,
        [("2023-01-01", 10.0, 2), ("2023-01-01", 1.0, 1), ("2023-01-02", 2.0, 3)],
        ["date", "engagements", "id"],
    )
    assert tuples(pm.daily_trend(df)) == [(2, 11.0, 2.0, "falling", False)]
    assert tuples(pm.post_trend(df, order_col="id")) == [(3, 1.0, 2.0, "rising")]


def test_two_labels_give_two_insights(spark):
    df = posts(spark, [("x",), ("x",), ("y",)], ["sentiment"])
    found = pm.sentiment_insights(df).orderBy("position").collect()
    assert [(r["label"], round(r["share"], 6)) for r in found] == [("x", 0.666667), ("y", 0.333333)]
    assert "66.7%" in found[0]["text"]


def test_half_tenths_round_up(spark):
    df = posts(spark, [("x",)] * 2 + [(f"y{i:02}",) for i in range(30)], ["sentiment"])
    assert "6.3%" in pm.sentiment_insights(df).orderBy("position").first()["text"]


def test_big_and_broken_totals_in_texts(spark):
    df = posts(spark, [("2023-01-01", 1e20), ("2023-01-02", -2.5)], ["date", "engagements"])
    found = {r["code"]: r["text"] for r in pm.engagement_insights(df).collect()}
    assert "100000000000000000000." in found["peak_day"] and " -2." in found["lowest_day"]


def test_share_adds_up_per_campaign(spark, event_posts):
    shares = pm.category_share(event_posts, "location", BRAND)
    for r in shares.groupBy(*BRAND).agg(F.sum("share").alias("s")).collect():
        assert abs(r["s"] - 1) < 1e-9


def test_by_columns_may_be_null_or_oddly_named(spark):
    df = posts(
        spark, [("a", None), ("a", None), ("b", "k"), ("a", "k")], "sentiment string, `team.x` string"
    )
    got = sorted(map(str, tuples(pm.category_share(df, "sentiment", ["team.x"]))))
    assert got == ["('k', 'a', 1, 0.5)", "('k', 'b', 1, 0.5)", "(None, 'a', 2, 1.0)"]
    assert pm.campaign_insights(df, ["team.x"]).filter("`team.x` is null").count() == 5
    summary = {r["team.x"]: r["total_posts"] for r in pm.campaign_summary(df, ["team.x"]).collect()}
    assert summary == {None: 2, "k": 2}
    assert pm.campaign_prompts(df, ["team.x"]).count() == 2


def test_unknown_by_column(spark, event_posts):
    with pytest.raises(ValueError, match="nope"):
        pm.total_posts(event_posts, ["nope"])
    with pytest.raises(ValueError, match="another name"):
        pm.campaign_insights(event_posts.withColumn("label", F.lit("x")), ["label"])
    with pytest.raises(TypeError):
        pm.total_posts(event_posts, "influencer_brand")


def test_totals_agree(event_posts):
    n = pm.total_posts(event_posts).first()["n"]
    e = event_posts.agg(F.sum("engagements")).first()[0]
    cube = pm.campaign_cube(event_posts).groupBy("chart").agg(F.sum("n"), F.sum("engagements"))
    assert {tuple(r)[1:] for r in cube.collect()} == {(n, e)}


@pytest.mark.parametrize("by", [(), BRAND], ids=["all", "brand"])
def test_both_cube_plans_agree(event_posts, by):
    parts, copied = pm.campaign_cube(event_posts, by), pm.campaign_cube(event_posts, by, one_scan=True)
    assert sorted(tuples(parts), key=str) == sorted(tuples(copied), key=str)


METRICS = {
    "counts": lambda d, by: pm.category_counts(d, "location", by),
    "days": pm.daily_engagement,
    "share": lambda d, by: pm.category_share(d, "media_type", by),
    "top": lambda d, by: pm.top_locations(d, 3, by),
    "post_trend": pm.post_trend,
    "daily_trend": pm.daily_trend,
    "peak": pm.peak_day,
    "platform": pm.top_platform,
    "insights": pm.campaign_insights,
    "lines": pm.report_lines,
    "prompts": pm.campaign_prompts,
}


@pytest.mark.parametrize("name", list(METRICS))
def test_by_equals_one_campaign_alone(event_posts, name):
    metric = METRICS[name]
    whole = metric(event_posts, BRAND)
    for brand in ("Brand0", "Brand7"):
        mine = whole.filter(F.col("influencer_brand") == brand).drop("influencer_brand")
        alone = metric(event_posts.filter(F.col("influencer_brand") == brand), ())
        assert sorted(map(str, tuples(mine))) == sorted(map(str, tuples(alone.select(*mine.columns))))


@pytest.mark.parametrize("name", ["insights", "prompts", "post_trend"])
def test_row_order_and_partitions_do_not_matter(event_posts, name):
    first = sorted(map(str, tuples(METRICS[name](event_posts, BRAND))))
    moved = event_posts.orderBy(F.rand(3)).repartition(5)
    assert sorted(map(str, tuples(METRICS[name](moved, BRAND)))) == first


def test_empty_posts(event_posts):
    none = event_posts.limit(0)
    assert pm.campaign_insights(none).isEmpty() and pm.report_lines(none).isEmpty()
    assert pm.report_document(none).isEmpty() and pm.campaign_prompts(none).isEmpty()
    assert pm.peak_day(none).isEmpty() and pm.top_platform(none).isEmpty()
    row = pm.campaign_summary(none).first()
    assert row["total_posts"] == 0 and row["summary"] == "There are no posts to describe."
    assert tuples(pm.post_trend(none)) == [(0, None, None, "none")]
    assert pm.campaign_summary(none, BRAND).isEmpty()


def test_one_brand_holds_most_posts(spark, event_posts):
    """A hot campaign and a hot label change no result."""
    hot = event_posts.withColumn(
        "influencer_brand", F.when(F.col("event_id") % 3 > 0, "Hot").otherwise(F.col("influencer_brand"))
    )
    counts = {r["influencer_brand"]: r["n"] for r in pm.total_posts(hot, BRAND).collect()}
    assert counts["Hot"] == hot.filter("influencer_brand = 'Hot'").count()
    wide = hot.withColumn("location", F.concat(F.lit("L"), F.col("event_id")))
    top = pm.top_locations(wide, 2, BRAND).filter("influencer_brand = 'Hot'").collect()
    ids = [f"L{r[0]}" for r in wide.filter("influencer_brand = 'Hot'").select("event_id").collect()]
    assert [r["location"] for r in sorted(top, key=lambda r: r["rank"])] == sorted(ids)[:2]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_ranks_are_cut_before_the_shuffle(event_posts):
    plan = plan_of(pm.top_locations(event_posts, 3, BRAND))
    assert plan.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(pm.top_locations(event_posts, 3))


@pytest.mark.parametrize(
    "made,scans",
    [
        (pm.campaign_cube, 1), (pm.report_lines, 1), (pm.report_document, 1), (pm.prompt_findings, 1),
        (pm.campaign_insights, 1), (pm.campaign_summary, 1), (pm.campaign_prompts, 1),
    ],
)
@pytest.mark.parametrize("by", [(), BRAND], ids=["whole", "brand"])
def test_how_often_posts_are_read(spark, tmp_path, event_posts, made, scans, by):
    pm.write_clean(event_posts, str(tmp_path / "t"))
    clean = pm.read_clean(spark, str(tmp_path / "t"))
    plan = plan_of(made(clean, by))
    assert plan.count("FileScan parquet") == scans
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    if made is pm.prompt_findings:
        assert "collect_list" not in plan
    if made is not pm.campaign_cube:
        # A kept label table serves all of them without the posts.
        labels = pm.keep_labels(clean, by)
        plan = plan_of(made(None, by, labels=labels))
        assert str(tmp_path / "t") not in plan
        assert sorted(map(str, made(None, by, labels=labels).collect())) == sorted(map(str, made(clean, by).collect()))


def test_post_trend_sorts_no_post(event_posts):
    plan = plan_of(pm.post_trend(event_posts, BRAND))
    assert "Sort " not in plan and "SortAggregate" not in plan


def test_total_row_of_the_cube(event_posts):
    total = pm.campaign_cube(event_posts, BRAND).where("chart = 'total'").selectExpr("influencer_brand", "n")
    assert sorted(tuples(total)) == sorted(tuples(pm.total_posts(event_posts, BRAND)))


def test_result_names_are_guarded(spark, event_posts):
    by_day = event_posts.withColumns({"day": F.to_date("date"), "n": F.lit("x")})
    for refused, by in (
        (pm.daily_trend, "day"), (pm.peak_day, "day"), (pm.total_posts, "n"), (pm.platform_engagement, "platform"),
        (pm.post_trend, "trend"), (pm.daily_trend, "trend"),
    ):
        with pytest.raises(ValueError, match="another name"):
            refused(by_day.withColumn("trend", F.lit(1)), [by])
    assert pm.total_posts(by_day, ["day"]).count() == 30


def test_fractions_print_plainly(spark):
    df = posts(spark, [("a", 12345678.5), ("b", 0.0001), ("c", 3.0)], ["platform", "engagements"])
    text = pm.campaign_summary(df).first()["summary"]
    assert "a 12345678.5, c 3, b 0.0001" in text


def test_report_of_many_campaigns(spark, tmp_path, event_posts):
    texts = spark.createDataFrame([("Brand1", "one"), ("nobody", "none")], "influencer_brand string, analysis string")
    document = pm.report_document(event_posts, BRAND, texts)
    found = document.groupBy("influencer_brand").agg(F.collect_set("section").alias("s")).collect()
    assert {r[0] for r in found if "analysis_heading" in r[1]} == {"Brand1"} and "nobody" not in {r[0] for r in found}
    pm.write_report(document, str(tmp_path / "r"), BRAND, fmt="text")
    written = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert "Campaign report: Brand1" in written and "Campaign report: Brand2" in written
    with pytest.raises(Exception, match="two analyses"):
        pm.report_document(event_posts, BRAND, texts.union(texts)).collect()


def test_report_document_and_files(spark, tmp_path, event_posts):
    analyses = spark.createDataFrame([("Brand1", "It's fine.\nGo on.")], "influencer_brand string, analysis string")
    document = pm.report_document(event_posts, BRAND, analyses)
    one = document.filter("influencer_brand = 'Brand1'").orderBy("position").collect()
    assert [r["section"] for r in one] == [
        "title",
        "analysis_heading",
        "analysis",
        "findings_heading",
        *["finding"] * 5,
        "footer",
    ]
    assert one[2]["text"] == "It's fine.\nGo on."
    single = pm.report_document(event_posts, (), "It's \\fine.").orderBy("position")
    assert [r["text"] for r in single.collect()][2] == "It's \\fine."
    for fmt in ("json", "parquet", "text"):
        pm.write_report(single, str(tmp_path / fmt), fmt=fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == 10
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 10
    lines = []
    for file in sorted(os.listdir(tmp_path / "text")):
        if file.startswith("part"):
            lines += open(tmp_path / "text" / file).read().splitlines()
    assert lines[0] == "Campaign report" and lines[-1] == "End of report"
    with pytest.raises(ValueError):
        pm.write_report(single, str(tmp_path / "x"), fmt="pdf")


def test_summary_maps(event_posts):
    summary = pm.campaign_summary(event_posts)
    row = summary.select("*", F.to_json("sentiment_counts").alias("text")).first()
    counts = {r["sentiment"]: r["n"] for r in pm.category_counts(event_posts, "sentiment").collect()}
    assert row["sentiment_counts"] == counts
    assert list(json.loads(row["text"])) == sorted(counts, key=lambda k: (-counts[k], k))
    assert len(row["top_locations"]) == 3


def test_clean_table_by_day(spark, tmp_path, event_posts):
    path = str(tmp_path / "days")
    pm.write_clean(event_posts, path, by_day=True)
    back = pm.read_clean(spark, path)
    assert back.count() == event_posts.count()
    assert len([d for d in os.listdir(path) if d.startswith("day=")]) == 30
    kept = pm.keep_clean(event_posts, "kept_in_test")
    assert sorted(map(str, tuples(pm.daily_engagement(kept)))) == sorted(
        map(str, tuples(pm.daily_engagement(event_posts)))
    )


def test_preview(spark):
    df = posts(
        spark, [(f"2023-01-0{d}", p) for d in (3, 1, 2) for p in "ba"], ["date", "platform"]
    )
    got = [(str(r["date"])[:10], r["platform"]) for r in pm.preview(df, 3).collect()]
    assert got == [("2023-01-01", "a"), ("2023-01-01", "b"), ("2023-01-02", "a")]
