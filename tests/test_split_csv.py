"""CSV with quoted line ends, cut into many tasks, against Spark's reader of whole files and the csv module."""

import csv
import random

import pytest

from plaintide.sources import quoted_csv, readers

CELLS = ["plain", "", "two\nlines", 'a "quote"', '"', '""', "\n", "\n\n", "x,y", '",\n"', "é\n日本", "long\n" + "w" * 700, " blank ", 'end"\n']


@pytest.fixture
def small_blocks(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, ends="\n", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as out:
        writer = csv.writer(out, lineterminator=ends)
        writer.writerow(["id", "first", "second"])
        writer.writerows(rows)


def rows_of(n, seed):
    draw = random.Random(seed)
    return [(str(i), draw.choice(CELLS), draw.choice(CELLS)) for i in range(n)]


def expected(rows):
    return [tuple(c or None for c in r) for r in rows]


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_one_large_file(spark, tmp_path, small_blocks, ends):
    rows = rows_of(400, 3)
    write(tmp_path / "a.csv", rows, ends)
    assert quoted_csv.blocks(spark, str(tmp_path)).count() > 50
    split = readers.read_reviews(spark, str(tmp_path), ordinal="ordinal", split=True).orderBy("ordinal")
    assert [tuple(r)[:3] for r in split.collect()] == expected(rows)
    whole = readers.read_reviews(spark, str(tmp_path))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, split.drop("ordinal").collect()))


def test_files_headers_and_empty_lines(spark, tmp_path, small_blocks):
    one, two = rows_of(30, 5), rows_of(50, 6)
    write(tmp_path / "b.csv", one, encoding="utf-8-sig")
    write(tmp_path / "a.csv", two)
    (tmp_path / "c.csv").write_text('id,first,second\n\n\n7,"x\n\ny",z\n\n8,,"last, without an end"')
    (tmp_path / "d.csv").write_text("id,first,second\n")
    df = readers.read_reviews(spark, str(tmp_path), "id BIGINT", ordinal="ordinal", split=True)
    rows = df.orderBy("ordinal").collect()
    assert len({r.ordinal for r in rows}) == len(rows) == 82
    want = [(int(i), *rest) for i, *rest in expected(two) + expected(one)] + [(7, "x\n\ny", "z"), (8, None, "last, without an end")]
    assert [tuple(r)[:3] for r in rows] == want


def test_records_stay_where_they_are(spark, tmp_path, small_blocks):
    """Every record is counted once, whatever the parity at the start of its block."""
    write(tmp_path / "a.csv", [(str(i), "x\n" * (i % 7), "y") for i in range(300)])
    numbers = [r.record_no for r in quoted_csv.records(spark, str(tmp_path)).select("record_no").collect()]
    assert sorted(numbers) == list(range(1, 302))


def test_large_tables_in_more_parts(spark):
    """Rows are dealt into parts by their size, not only one for each core."""
    from verification import views

    keys = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.shuffle.partitions"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for key, value in zip(keys, ["100000", "10000", "40"]):
            spark.conf.set(key, value)
        rows = views.spread(spark.range(20_000).selectExpr("id", "repeat(md5(string(id)), 4) AS text"), "id")
        assert rows.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
        assert rows.count() == 20_000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
