"""Records by byte ranges against Python's CSV reader and Spark's one-task read."""

import csv
import json
import io
import os
import pickle
import random

import pytest
from pyspark.sql import functions as F

from postmeter import clean_posts, read_posts_csv
from postmeter.sources import csv_records
from postmeter.sources.csv_posts import _by_files, _layouts, _layouts_by_lines

PIECES = ["a", "bé", " ", "", '"', '""', ",", "\n", "\r\n", "\n\n", "12", "x" * 40, 'say "hi", ok', "\nline\n"]


def random_file(rng, records, end="\n"):
    out = io.StringIO()
    rows = [[("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 4)))) for _ in range(3)] for _ in range(records)]
    csv.writer(out, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]), lineterminator=end).writerows(rows)
    return out.getvalue()


def by_ranges(path, size, step, chunk):
    inside, out = False, []
    for at in range(0, size, step):
        stop = min(at + step, size)
        out += [r for part in csv_records.records(path, at, stop, inside, chunk) for r in part]
        inside = csv_records.range_outcomes(path, at, stop, chunk)[inside]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_ranges_of_any_size_give_the_same_records(tmp_path, seed):
    rng = random.Random(seed)
    text = random_file(rng, rng.randint(1, 30), rng.choice(["\n", "\r\n"]))
    if rng.random() < 0.3:
        text = text.rstrip("\r\n")
    path = tmp_path / "r.csv"
    path.write_bytes(text.encode())
    size = path.stat().st_size
    whole = by_ranges(str(path), size, max(size, 1), 1 << 20)
    got = [row for _, r in whole for row in csv.reader(io.StringIO(r.decode().removesuffix("\r"), newline=""))]
    assert got == [row for row in csv.reader(io.StringIO(text, newline="")) if "".join(row).strip() or len(row) > 1]
    for step in (1, 7, 37, 200):
        assert by_ranges(str(path), size, step, rng.choice([1, 5, 64, 1 << 20])) == whole


def test_odd_quotes_do_not_run_over(tmp_path):
    lines = ['5" screen,a', 'b,6" c', '"q" tail,d', 'e,"f"', 'g,""', '"two', 'lines",h', '"x""', 'y",i']
    path = tmp_path / "o.csv"
    path.write_text("\n".join(lines) + "\n")
    found = by_ranges(str(path), path.stat().st_size, 5, 3)
    assert [r.decode() for _, r in found] == lines[:5] + ['"two\nlines",h', '"x""\ny",i']
    assert [p for p, _ in found] == [path.read_text().index(r.decode()) for _, r in found]


def test_unclosed_quote_takes_the_rest(tmp_path):
    path = tmp_path / "u.csv"
    path.write_text('a,b\nc,"open\nd,e\nf,g')
    found = by_ranges(str(path), path.stat().st_size, 4, 2)
    assert [r.decode() for _, r in found] == ["a,b", 'c,"open\nd,e\nf,g']


def test_first_record(tmp_path):
    cases = {
        b"\xef\xbb\xbfA,B\r\n1,2\r\n": ("A,B", False),
        b'\n  \n"A\nx",B\n1,2': ('"A\nx",B', False),
        b"A,B\r1,2\r3,4": ("A,B", True),
        b'"A\r\nx",B\r\n': ('"A\r\nx",B', False),
        b"A": ("A", False),
        b"\n\n": ("", False),
    }
    for i, (data, want) in enumerate(cases.items()):
        path = tmp_path / f"{i}.csv"
        path.write_bytes(data)
        for chunk in (2, 1 << 16):
            assert csv_records.first_record(str(path), chunk)[:2] == want, (data, chunk)


def big_file(folder, name, rows):
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["Date", "Platform", "The\nNote", "Engagements"])
        for i in range(rows):
            note = f"post {i}\nsays \"{i}\",\n\nbye" if i % 3 else f"plain {i}"
            writer.writerow([f"2023-01-{i % 28 + 1:02}", f"P{i % 5}", note, i])
    return path


def test_long_file_is_read_by_many_tasks(spark, tmp_path):
    path = big_file(tmp_path, "big.csv", 60_000)
    posts, rejects = read_posts_csv(spark, path, range_bytes=100_000, origin=True)
    tasks = -(-os.path.getsize(path) // 100_000)
    assert tasks > 20 and posts.select(F.spark_partition_id().alias("t")).distinct().count() == tasks
    header = ("Date", "Platform", "The\nNote", "Engagements")
    one = _by_files(spark, header, [path], True, True).select(*[f"`{h}`" for h in header])
    assert one.rdd.getNumPartitions() == 1
    names = ["date", "platform", "the\nnote", "engagements"]
    got = posts.select(*[f"`{n}`" for n in names])
    assert got.count() == 60_000 and got.exceptAll(one).isEmpty() and one.exceptAll(got).isEmpty()
    assert rejects.isEmpty()
    data = open(path, "rb").read()
    for r in posts.where("engagements % 9973 = 0").collect():
        assert data[r["source_place"] :].startswith(r["source_record"].encode())


def test_header_job_reads_one_record_per_file(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        big_file(tmp_path, name, 20_000)
    files = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    found = csv_records.header_records(spark, files).collect()
    assert [r["header"] for r in found] == ['Date,Platform,"The\nNote",Engagements'] * 2
    assert all(r["bytes_read"] <= 64 << 10 < os.path.getsize(r["file"]) / 8 for r in found)
    assert _layouts(spark, files)[0] == {("Date", "Platform", "The\nNote", "Engagements"): files}


def test_bare_cr_and_spark_only_stores(spark, tmp_path, monkeypatch):
    (tmp_path / "old.csv").write_bytes(b"Date,Platform\r2023-01-01,A\r2023-01-02,B\r")
    (tmp_path / "new.csv").write_bytes(b'Platform,Date\r\n"C\r\nD",2023-01-03\r\n')
    want = {("2023-01-01", "A"), ("2023-01-02", "B"), ("2023-01-03", "C\r\nD")}
    posts, _ = read_posts_csv(spark, str(tmp_path))
    assert {(r["date"], r["platform"]) for r in posts.collect()} == want
    monkeypatch.setattr("postmeter.sources.csv_posts.can_open", lambda path: False)
    assert len(_layouts_by_lines(spark, [str(tmp_path / "new.csv")])) == 1
    posts, _ = read_posts_csv(spark, str(tmp_path / "new.csv"))
    assert clean_posts(posts).count() == 1


def test_origin_of_posts(spark, tmp_path):
    (tmp_path / "NA.csv").write_text("Date,Platform\nNA,x\n2023-01-02,NA\n")
    posts, _ = read_posts_csv(spark, str(tmp_path), origin=True)
    rows = sorted(posts.collect(), key=lambda r: r["source_place"])
    assert [(r["date"], r["platform"], r["source_place"], r["source_record"]) for r in rows] == [
        (None, "x", 14, "NA,x"),
        ("2023-01-02", None, 19, "2023-01-02,NA"),
    ]
    assert all(r["source_file"].endswith("NA.csv") for r in rows)


def test_ranges_of_large_uploads_are_longer(spark, tmp_path, monkeypatch):
    path = big_file(tmp_path, "big.csv", 20_000)
    few, _ = read_posts_csv(spark, path, range_bytes=10_000, origin=True)
    many = few.rdd.getNumPartitions()
    monkeypatch.setattr(csv_records, "MOST_RANGES", 7)
    posts, _ = read_posts_csv(spark, path, range_bytes=10_000, origin=True)
    assert posts.rdd.getNumPartitions() <= 7 < many
    assert posts.count() == 20_000 and posts.exceptAll(few).isEmpty() and few.exceptAll(posts).isEmpty()


def test_short_ranges_read_and_send_little(tmp_path, monkeypatch):
    path = big_file(tmp_path, "big.csv", 60_000)
    size, got = os.path.getsize(path), []
    opened = csv_records._open

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            got.append(len(data := self.file.read(n)))
            return data

    monkeypatch.setattr(csv_records, "_open", lambda p: Counted(opened(p)))
    for at in range(0, size, 100_000):
        csv_records.range_outcomes(path, at, min(at + 100_000, size))
    assert sum(got) < 3 * size
    bundles = [[(path, i, i + 1, False)] for i in range(1000)]
    reader = csv_records._Reader({"mode": "records", "bundles": json.dumps(bundles)})
    assert len(reader.partitions()) == 1000 and len(pickle.dumps(reader)) < 1000
