import os

import pytest

from postmeter import append_uploads, clean_posts, read_clean, read_posts_csv

HEADER = "Date,Platform,Sentiment,Location,Engagements,Media Type,Influencer Brand,Post Type"
SEED = "2023-01-01,Instagram,Positive,Jakarta,1500,Image,BrandX,Feed Post"


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def test_plain(spark, tmp_path):
    path = put(tmp_path, "plain.csv", f"{HEADER}\n{SEED}\n")
    posts, rejects = read_posts_csv(spark, path)
    rows = clean_posts(posts).collect()
    assert len(rows) == 1 and rejects.count() == 0
    assert str(rows[0]["date"]) == "2023-01-01 00:00:00"
    assert rows[0]["engagements"] == 1500.0 and rows[0]["media_type"] == "Image"


def test_quoted_newline_blank_line_and_bom(spark, tmp_path):
    text = (
        b"\xef\xbb\xbfDate,Platform,Note\n"
        b'2023-01-01,"a ""b"", c","two\nlines"\n\n2023-01-02,p,n\n'
    )
    posts, rejects = read_posts_csv(spark, put(tmp_path, "q.csv", text))
    rows = sorted(posts.collect())
    assert rows[0]["platform"] == 'a "b", c' and rows[0]["note"] == "two\nlines"
    assert len(rows) == 2 and rejects.count() == 0
    assert clean_posts(posts).filter("note is not null").count() == 2


RAGGED = "\n".join(
    [
        "Date,Platform,Location",
        "2023-01-01,fits,x",
        "2023-01-02,short",
        "2023-01-03,long,x,EXTRA",
        "2023-01-04,trailing comma,x,",
        "2023-01-05,two commas,x,,",
        '2023-01-06,"quoted, comma",x,"y,z"',
        "",
    ]
)


@pytest.mark.parametrize("multi_line", [True, False])
def test_ragged(spark, tmp_path, multi_line):
    path = put(tmp_path, "ragged.csv", RAGGED)
    posts, rejects = read_posts_csv(spark, path, multi_line=multi_line)
    assert [tuple(r) for r in sorted(posts.collect())] == [
        ("2023-01-01", "fits", "x"),
        ("2023-01-02", "short", None),
    ]
    assert sorted(r["record"][:10] for r in rejects.collect()) == [
        "2023-01-03",
        "2023-01-04",
        "2023-01-05",
        "2023-01-06",
    ]
    assert all(r["file"].endswith("ragged.csv") and r["reason"] for r in rejects.collect())
    # Only counting must not skip the check.
    assert posts.count() == 2


def test_strict_raises_on_long_but_not_on_short(spark, tmp_path):
    long = put(tmp_path, "long.csv", RAGGED)
    with pytest.raises(Exception, match="more than 3 cells"):
        read_posts_csv(spark, long, strict=True)[0].collect()
    short = put(tmp_path, "short.csv", "Date,Platform\n2023-01-01\n2023-01-02,p\n")
    posts, _ = read_posts_csv(spark, short, strict=True)
    assert sorted(map(tuple, posts.collect())) == [("2023-01-01", None), ("2023-01-02", "p")]


def test_unclosed_quote_in_the_last_cell(spark, tmp_path):
    path = put(tmp_path, "open.csv", 'Date,Platform,Location\n2023-01-01,p,x\n2023-01-02,"open\n')
    posts, rejects = read_posts_csv(spark, path, multi_line=False)
    assert posts.count() == 2 and rejects.count() == 0


def test_columns_are_found_by_header(spark, tmp_path):
    put(tmp_path, "a.csv", "Date,Platform,Engagements\n2023-01-01,A,1\n")
    put(tmp_path, "b.csv", "platform,Extra,Engagements,DATE\nB,e,2,2023-01-02\n")
    put(tmp_path, "c.txt", "Date,Platform\n2023-01-03,C\n")
    put(tmp_path, "d.csv", "")
    posts, _ = read_posts_csv(spark, str(tmp_path))
    got = {(r["date"], r["platform"], r["engagements"], r["extra"]) for r in posts.collect()}
    assert got == {("2023-01-01", "A", "1", None), ("2023-01-02", "B", "2", "e")}


def test_upper_case_suffix(spark, tmp_path):
    put(tmp_path, "A.CSV", "Date\n2023-01-01\n")
    assert read_posts_csv(spark, str(tmp_path))[0].count() == 1


def test_many_files_in_two_layouts(spark, tmp_path):
    for i in range(300):
        text = f"Date,Platform\n2023-01-01,P{i}\n" if i % 2 else f"Platform,Date\nP{i},2023-01-01\n"
        put(tmp_path, f"{i}.csv", text)
    posts, _ = read_posts_csv(spark, str(tmp_path))
    assert {(r["date"], r["platform"]) for r in posts.collect()} == {("2023-01-01", f"P{i}") for i in range(300)}


def test_a_later_file_is_left_out_and_a_changed_one_refused(spark, tmp_path):
    put(tmp_path, "a.csv", "Date,Platform\n2023-01-01,A\n")
    posts, _ = read_posts_csv(spark, str(tmp_path))
    put(tmp_path, "b.csv", "Platform,Date\nTikTok,2023-01-02\n")
    assert [tuple(r) for r in posts.collect()] == [("2023-01-01", "A")]
    put(tmp_path, "a.csv", "Platform,Date\nTikTok,2023-01-02\n")
    posts, _ = read_posts_csv(spark, str(tmp_path), headers=["Date", "Platform"])
    with pytest.raises(Exception, match="header"):
        posts.collect()


def test_folder_columns_and_subfolders(spark, tmp_path):
    for brand in ("Brand X", "007", "__HIVE_DEFAULT_PARTITION__"):
        folder = tmp_path / "up" / f"influencer_brand={brand.replace(' ', '%20')}"
        folder.mkdir(parents=True)
        put(folder, "a.csv", "Date\n2023-01-01\n")
    posts, _ = read_posts_csv(spark, str(tmp_path / "up"))
    assert {r["influencer_brand"] for r in clean_posts(posts).collect()} == {"Brand X", "007", "Unknown"}
    (tmp_path / "up" / "more").mkdir()
    put(tmp_path / "up" / "more", "b.csv", "Date\n2023-01-02\n")
    with pytest.raises(ValueError, match="recursive"):
        read_posts_csv(spark, str(tmp_path / "up"))
    posts, _ = read_posts_csv(spark, str(tmp_path / "up"), recursive=True)
    assert posts.count() == 4
    put(tmp_path / "up" / "more", "c.csv", "Influencer_Brand,Date\nx,2023-01-02\n")
    with pytest.raises(ValueError, match="collide"):
        read_posts_csv(spark, str(tmp_path / "up"), recursive=True)


def test_header_cell_without_a_name(spark, tmp_path):
    posts, _ = read_posts_csv(spark, put(tmp_path, "e.csv", "Date,,Platform\n2023-01-01,x,A\n"))
    assert [r.asDict() for r in posts.collect()] == [{"date": "2023-01-01", "_c1": "x", "platform": "A"}]


def test_no_csv_and_colliding_headers(spark, tmp_path):
    put(tmp_path, "x.txt", "Date\n")
    with pytest.raises(ValueError, match="no .csv"):
        read_posts_csv(spark, str(tmp_path))
    path = put(tmp_path, "clash.csv", "Media Type,media_type,Date\na,b,2023-01-01\n")
    with pytest.raises(ValueError, match="collide"):
        read_posts_csv(spark, path)


def test_null_markers_become_unknown(spark, tmp_path):
    lines = ["Date,Sentiment"] + [f"2023-01-01,{s}" for s in ("", '""', "NA", "None", "null", " ", "x")]
    posts, _ = read_posts_csv(spark, put(tmp_path, "n.csv", "\n".join(lines) + "\n"))
    got = sorted(r["sentiment"] for r in clean_posts(posts).collect())
    assert got == [" ", "Unknown", "Unknown", "Unknown", "Unknown", "Unknown", "x"]


def test_stream_appends_each_upload_once(spark, tmp_path):
    incoming, out, bad, state = (str(tmp_path / d) for d in ("in", "out", "bad", "state"))
    os.mkdir(incoming)

    def run():
        for query in append_uploads(spark, incoming, out, bad, state):
            query.awaitTermination()

    put(incoming, "1.csv", f"{HEADER}\n{SEED}\nnot a date,a,b,c,1,d,e,f\n")
    run()
    put(incoming, "2.csv", f"{HEADER}\n{SEED},too long\n2023-01-02,TikTok,,Bali,x,Video,B,Reel\n")
    run()
    run()
    posts = read_clean(spark, out).collect()
    got = sorted((r["platform"], r["sentiment"], r["engagements"]) for r in posts)
    assert got == [("Instagram", "Positive", 1500.0), ("TikTok", "Unknown", 0.0)]
    rejects = spark.read.parquet(bad).collect()
    assert [r["record"] for r in rejects] == [f"{SEED},too long"]
