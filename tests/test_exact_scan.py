"""The exact scan gives one result however a file is cut into parts."""

import random

import pytest

from loomframe import read_csv
from loomframe.sources import strict
from loomframe.sources.reader import HEAD, changed_since_read

FORMS = ['{},"a\nb","c"', "{},plain,x", '{},mid"quo\nted"dle,"', '{},"say ""so""\r\n",\r\n', "{},,", "# no, record {}", "", '{},é,"ü\n\n\n"']


def content(seed, rows=400):
    pick = random.Random(seed)
    lines = [pick.choice(FORMS).format(k) for k in range(rows)]
    return "\n".join(["k,note,more", *(x + '"' if x.count('"') % 2 else x for x in lines)]) + pick.choice(["", "\n"])


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def wanted(text, comment=None, blank=False):
    kept = [r for r in strict.records(text) if (blank or r != [""]) and not (comment and r[0].startswith(comment))]
    return [tuple(([strict.field(f) for f in r] + [None] * 3)[:3]) for r in kept[1:]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("given,comment,blank", [({}, None, False), ({"comments": True}, "#", False), ({"skip_empty_rows": False}, None, True)])
def test_parts_of_any_size_read_alike(spark, tmp_path, small_parts, seed, given, comment, blank):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(content(seed + ord(name)), newline="")
    t = read_csv(spark, str(tmp_path), strict=True, **given)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    want = [r for name in "ab" for r in wanted(content(seed + ord(name)), comment, blank)]
    assert [tuple(r) for r in t.collect()] == want


def test_one_record_over_many_parts_and_an_open_quote(spark, tmp_path, small_parts):
    (tmp_path / "x.csv").write_text('k,v\n1,"' + "line\n" * 500 + '"\n2,x\n3,"never closed\n' + "more\n" * 200)
    got = [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), strict=True).collect()]
    assert got == [("1", "line\n" * 500), ("2", "x"), ("3", '"never closed\n' + "more\n" * 200)]


def test_record_sizes_count_quotes(spark):
    text = b'a,b\n1,"2345678"\n1,2345678\n"1","234"\n'
    t = read_csv(spark, text, max_record_size=9)
    assert [(e.row, e.message.partition("got ")[2]) for e in t.errors().orderBy("row").collect()] == [(0, "10)")]
    assert [tuple(r) for r in read_csv(spark, text, max_record_size=9, skip_records_with_error=True).collect()] == [("1", "2345678"), ("1", "234")]


def test_long_comment_signs_in_fast_mode(spark):
    text = b"a,b\n//x,1\n/d,2\n"
    assert [tuple(r) for r in read_csv(spark, text, fast_mode=True, comments="//").collect()] == [("/d", "2")]
    assert [tuple(r) for r in read_csv(spark, text, comments="//").collect()] == []


def test_hooks_may_empty_a_text(spark):
    assert read_csv(spark, b"a,b\n1,2\n", before_first_chunk=lambda t: "").columns == []
    assert read_csv(spark, b"a,b\n1,2\n", before_first_chunk=lambda t: None).count() == 1


def test_previews_of_long_files_read_their_beginning(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("k,v\n" + "".join(f'{k},"x\n{k}"\n' for k in range(9 * HEAD // 10)))
    t = read_csv(spark, str(path), preview=3)
    assert [tuple(r) for r in t.collect()] == [(str(k), f"x\n{k}") for k in range(3)] and t.meta["truncated"]
    assert [tuple(r) for r in read_csv(spark, str(path), preview=20, from_line=15, to_line=16).collect()] == [(str(k), f"x\n{k}") for k in (13, 14)]


def test_changed_files_are_told(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("k\n1\n")
    t = read_csv(spark, str(tmp_path))
    assert changed_since_read(spark, t) == []
    (tmp_path / "a.csv").write_text("k\n1\n2\n")
    (tmp_path / "b.csv").unlink()
    (tmp_path / "c.csv").write_text("k\n")
    assert [p.rpartition("/")[2] for p in changed_since_read(spark, t)] == ["a.csv", "b.csv", "c.csv"]


def test_old_charsets_leave_the_session_alone(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_bytes(f"k,näme\n{name},é\n".encode("cp1252"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets", "false")
    t = read_csv(spark, str(tmp_path), encoding="windows-1252")
    assert t.columns == ["k", "näme"] and [tuple(r) for r in t.collect()] == [("a", "é"), ("b", "é")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == before
