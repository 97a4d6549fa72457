"""csv_roundtrip gives back every text as it was, whatever it holds."""

import pytest

from loomframe import queries, read_csv

ODD = ["", None, " ", "\t", "\r", "\n", "\r\n", "a\rb", "a\r\nb", "x\r", '"', '""', 'a"\r\n"b', ",", '","', "\\", '\\"', "\x00", "a\x00b", '\x00"', 'a\x00"b,', "\x00" * 2000, "﻿x", "null", "plain"]


def trip(spark, folder, rows, files=1):
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    made.repartitionByRange(files, "doc_id").write.parquet(f"{folder}/documents.parquet")
    return queries.csv_roundtrip(spark, str(folder))


@pytest.mark.parametrize("first", range(len(ODD)))
def test_each_text_at_the_beginning_of_a_file(spark, tmp_path, first):
    """The first line end of a file, in quotes or not, must not decide what ends its records."""
    rows = [(k, t, "en") for k, t in enumerate(ODD[first:] + ODD[:first])]
    assert sorted(map(tuple, trip(spark, tmp_path, rows).collect())) == rows


def test_several_files_and_other_columns(spark, tmp_path):
    rows = [(k, ODD[k * 7 % len(ODD)], ODD[k % len(ODD)]) for k in range(600)]
    assert sorted(map(tuple, trip(spark, tmp_path, rows, 5).collect())) == rows


def test_null_ids_and_no_rows(spark, tmp_path):
    assert [tuple(r) for r in trip(spark, tmp_path / "a", [(None, None, None)]).collect()] == [(None, None, None)]
    got = trip(spark, tmp_path / "b", [])
    assert got.count() == 0 and got.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string")]


def test_small_buffers(spark, tmp_path):
    """Quotes, NUL and line ends across the borders of the source's buffer."""
    rows = [(k, "".join(t or "" for t in ODD[k % 9 : k % 23])[: k % 70], "en") for k in range(3000)]
    want = sorted((k, t, lang) for k, t, lang in rows)
    spark.conf.set("spark.sql.csv.parser.inputBufferSize", "64")
    try:
        assert sorted(map(tuple, trip(spark, tmp_path, rows).collect())) == want
    finally:
        spark.conf.unset("spark.sql.csv.parser.inputBufferSize")


def test_reader_takes_the_line_end_of_the_record(spark):
    t = read_csv(spark, b'a,b\n"x\r\ny\rz",1\n"",\n')
    assert [tuple(r) for r in t.collect()] == [("x\r\ny\rz", "1"), ("", None)]
    t = read_csv(spark, b'"a\rb",c\n1,2\n3,4\n')
    assert t.meta["linebreak"] == "\n" and t.columns == ["a\rb", "c"] and [tuple(r) for r in t.collect()] == [("1", "2"), ("3", "4")]
    t = read_csv(spark, b'a,"b\nc"\r\n1,2\r\n')
    assert t.meta["linebreak"] == "\r\n" and t.columns == ["a", "b\nc"]
    with pytest.raises(ValueError, match="line end"):
        read_csv(spark, b"a\n1\n", line_end="\r\n")
