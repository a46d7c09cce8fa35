import datetime

import pytest

import postmeter as pm
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmeter import clean_posts, normalize_columns, null_tokens
from postmeter.schema import CATEGORIES, CLEAN_SCHEMA, RAW_HEADERS, RAW_SCHEMA

DATES = [
    ("2023-01-01", "2023-01-01 00:00:00"),
    ("2023-1-5", "2023-01-05 00:00:00"),
    ("2023-01-02 10:00:00", "2023-01-02 10:00:00"),
    ("2023-01-01T10:00:00Z", "2023-01-01 10:00:00"),
    ("2023-01-01T10:00:00+07:00", "2023-01-01 10:00:00"),
    ("2023-01-01 10:00", "2023-01-01 10:00:00"),
    ("  2023-01-01 ", "2023-01-01 00:00:00"),
    ("2023-02-30", None),
    ("12:30", None),
    ("2023", None),
    ("2023-01-01 extra", None),
    ("20230101", None),
    ("01/15/2023", None),
    ("bad", None),
    ("", None),
    (None, None),
]


def dated(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "Date string, id int")


def test_headers(spark):
    for header, wanted in (
        ("Media Type", "media_type"),
        (" Date ", "_date_"),
        ("Post  Type", "post__type"),
        ("DATE", "date"),
    ):
        assert normalize_columns(spark.range(1).toDF(header)).columns == [wanted]


def test_header_clash_raises(spark):
    raw = spark.createDataFrame([("a", "b", "2023-01-01")], ["Media Type", "media_type", "Date"])
    with pytest.raises(ValueError, match="media_type"):
        clean_posts(raw)


def test_dates(spark):
    got = {r["id"]: str(r["date"]) for r in clean_posts(dated(spark, [d for d, _ in DATES])).collect()}
    assert got == {i: w for i, (_, w) in enumerate(DATES) if w}


def test_dates_do_not_depend_on_order_or_partitions(spark):
    raw = dated(spark, [d for d, _ in DATES])
    first = sorted(map(tuple, clean_posts(raw).select("id", "date").collect()))
    for n in (1, 7):
        shuffled = raw.orderBy(F.desc("id")).repartition(n)
        assert sorted(map(tuple, clean_posts(shuffled).select("id", "date").collect())) == first


def test_date_formats_are_tried_in_order(spark):
    raw = dated(spark, ["01/15/2023", "15.01.2023 08:30", "2023-01-02", "x", None])
    posts = clean_posts(raw, formats=["MM/dd/yyyy", "dd.MM.yyyy HH:mm"])
    assert {r["id"]: str(r["date"]) for r in posts.collect()} == {
        0: "2023-01-15 00:00:00",
        1: "2023-01-15 08:30:00",
        2: "2023-01-02 00:00:00",
    }


def test_typed_dates_and_numbers(spark):
    raw = spark.createDataFrame(
        [(datetime.date(2023, 1, 2), 5, float("nan"), True)], "Date date, a int, b double, c boolean"
    )
    assert str(clean_posts(raw).first()["date"]) == "2023-01-02 00:00:00"
    for column, wanted in (("a", 5.0), ("b", 0.0), ("c", 1.0)):
        one = raw.select("Date", F.col(column).alias("Engagements"))
        assert clean_posts(one).first()["engagements"] == wanted
    stamp = spark.sql("select timestamp '2023-01-02 03:04:05' as Date, double('-infinity') as Engagements")
    row = clean_posts(stamp).first()
    assert str(row["date"]) == "2023-01-02 03:04:05" and row["engagements"] == 0.0
    assert clean_posts(spark.sql("select 20230101 as Date")).count() == 0


def test_numbers(spark):
    cases = [
        ("12", 12.0),
        (" 12 ", 12.0),
        ("1e3", 1000.0),
        ("+5", 5.0),
        (".5", 0.5),
        ("5.", 5.0),
        *[(t, 0.0) for t in ("1,500", "1.5f", "1.5d", "0x10", "1_000", "NaN", "inf", "1e999", "", None)],
    ]
    raw = spark.createDataFrame(
        [("2023-01-01", v, i) for i, (v, _) in enumerate(cases)], "Date string, Engagements string, id int"
    )
    got = {r["id"]: r["engagements"] for r in clean_posts(raw).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_table_labels_are_kept(spark):
    raw = spark.createDataFrame(
        [("2023-01-01", v) for v in ("", "None", None)], "Date string, Sentiment string"
    )
    assert sorted(r["sentiment"] for r in clean_posts(raw).collect()) == ["", "None", "Unknown"]


def test_null_tokens_leave_other_columns(spark):
    raw = spark.createDataFrame([("NA", 1), (" ", 2), ("x", 3)], "a string, `b.c` int")
    assert [tuple(r) for r in null_tokens(raw).collect()] == [(None, 1), (" ", 2), ("x", 3)]


def test_missing_columns_and_extras(spark):
    row = clean_posts(spark.createDataFrame([("2023-01-01", 7)], "Date string, `Extra Col` int")).first()
    assert row["engagements"] == 0.0 and row["extra_col"] == 7
    assert all(row[c] == "Unknown" for c in CATEGORIES)


def test_category_of_another_type_becomes_text(spark):
    row = clean_posts(spark.createDataFrame([("2023-01-01", 42)], "Date string, Location int")).first()
    assert row["location"] == "42"


def test_no_date_raises(spark):
    with pytest.raises(ValueError, match="date"):
        clean_posts(spark.createDataFrame([("x",)], "Platform string"))


def test_empty_input_has_the_clean_schema(spark):
    wanted = {f.name: f.dataType for f in CLEAN_SCHEMA}
    for raw in (spark.createDataFrame([], RAW_SCHEMA), spark.createDataFrame([], T.StructType([]))):
        posts = clean_posts(raw)
        assert {f.name: f.dataType for f in posts.schema} == wanted
        assert posts.isEmpty()


def test_all_dates_bad_is_empty(spark):
    raw = spark.createDataFrame([tuple(["x"] * 8)], ", ".join(f"`{h}` string" for h in RAW_HEADERS))
    assert clean_posts(raw).isEmpty()


def test_cleaning_does_not_shuffle(spark):
    plan = clean_posts(null_tokens(dated(spark, ["2023-01-01"])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_formats_keep_the_wall_clock(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([("01.02.2023 10:00 +07:00",), ("26.03.2023 02:30 +00:00",), ("x",)], ["date"])
        found = pm.parse_dates(rows, ["dd.MM.yyyy HH:mm XXX"]).selectExpr("cast(date as string)").collect()
        plain = spark.createDataFrame([("26.03.2023 02:30",)], ["date"])
        gap = pm.parse_dates(plain, ["dd.MM.yyyy HH:mm"]).selectExpr("cast(date as string)").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r[0] for r in found] == ["2023-02-01 10:00:00", "2023-03-26 02:30:00", None]
    assert gap[0][0] == "2023-03-26 02:30:00"


def test_cleaning_outcome(spark):
    raw = spark.createDataFrame(
        [("2023-01-01", "5"), ("bad", "6"), (None, None), ("2023-01-02", "1,5"), ("2023-01-03", None)],
        "Date string, Engagements string",
    )
    assert tuple(pm.cleaning_outcome(raw).first()) == (5, 2, 3, 1, 1, False)
    assert tuple(pm.cleaning_outcome(raw.drop("Engagements")).first()) == (5, 2, 3, 0, 3, True)
    nothing = pm.cleaning_outcome(raw.where("Date = 'bad'")).first()
    assert nothing["rows_in"] == 1 and nothing["rows_kept"] == 0


def test_kept_tables_can_be_named_and_dropped(spark, tmp_path):
    raw = spark.createDataFrame([("2023-01-01",)], "Date string")
    path = str(tmp_path / "kept")
    assert pm.keep_clean(pm.clean_posts(raw), path=path).count() == 1
    assert pm.drop_table(spark, path) and not pm.drop_table(spark, path)
