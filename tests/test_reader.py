"""Reader options, one by one, on small literal files."""

import http.server
import threading

import pytest
from pyspark.sql import functions as F

from loomframe import read_csv, typed_table, typing_errors
from loomframe.sources import detect, reader, strict
from loomframe.sources.reader import ReadOptions, header_names

PEOPLE = "name,age,city\nAlice,30,NYC\nBob,25,LA\nCharlie,35,Chicago\n"
MIXED = "name,age\nAlice,30\nBob,25,extra1,extra2\nCharlie\nDiana,28\n"


@pytest.fixture
def read(spark):
    return lambda text, **o: read_csv(spark, text.encode() if isinstance(text, str) else text, **o)


def rows(table):
    return [tuple(r) for r in table.collect()]


def errors(table):
    return [(r.code, r.row) for r in table.errors().orderBy("row").collect()]


def test_quotes_and_line_ends(read):
    t = read('name,address,note\r\nAlice,"123 Main St, Apt 4",normal\r\nBob,"456 Oak Ave","says ""hello"""\r\nEve,"two\nlines",\r\n')
    assert rows(t) == [("Alice", "123 Main St, Apt 4", "normal"), ("Bob", "456 Oak Ave", 'says "hello"'), ("Eve", "two\nlines", None)]
    assert t.meta["linebreak"] == "\r\n" and t.meta["fields"] == ["name", "address", "note"]


def test_null_and_empty_text_differ(read):
    assert rows(read('a,b\n,""\n')) == [(None, "")]
    assert rows(read('a,b\n"",x\n', dynamic_typing=True)) == [(None, "x")]


@pytest.mark.parametrize("sign", [",", "\t", "|", ";"])
def test_delimiter_is_detected(read, sign):
    assert rows(read(PEOPLE.replace(",", sign), delimiter="auto"))[0] == ("Alice", "30", "NYC")


def test_single_column_falls_back_to_comma(read):
    t = read("name\nAlice\nBob\n", delimiter="auto")
    assert t.meta["delimiter"] == "," and rows(t) == [("Alice",), ("Bob",)]
    assert detect.detect_delimiter('a;b\n"x,y,z";2\n') == ";"
    assert detect.detect_delimiter("a:b:c\n1:2:3\n", [":", ","]) == ":"


def test_headers():
    o = ReadOptions()
    assert header_names(["name", "age", "name", "score", "age"], o) == ["name", "age", "name_1", "score", "age_1"]
    assert header_names(["x", "x", "x"], o) == ["x", "x_1", "x_2"]
    assert header_names(["name", "name", "name_1"], o) == ["name", "name_2", "name_1"]
    assert header_names(["a", None], o) == ["a", "col1"]
    with pytest.raises(ValueError, match="twice"):
        header_names(["x", "x"], ReadOptions(duplicate_headers="error"))


def test_no_header_and_transformed_header(read):
    assert read("1,2\n3,4\n", has_header=False).columns == ["col0", "col1"]
    assert errors(read("1,2\n3\n", has_header=False)) == []
    assert read(PEOPLE, transform_header=lambda h, i: f"{i}{h.upper()}").columns == ["0NAME", "1AGE", "2CITY"]


def test_ragged_records(read):
    t = read(MIXED)
    assert errors(t) == [("TooManyFields", 1), ("TooFewFields", 2)]
    got = t.errors().orderBy("row").collect()
    assert got[0].message == "Expected 2 fields but found 4" and got[0].type == "FieldMismatch"
    assert rows(t.with_parsed_extra()) == [("Alice", "30", None), ("Bob", "25", ["extra1", "extra2"]), ("Charlie", None, None), ("Diana", "28", None)]
    t = read(MIXED, skip_records_with_error=True)
    assert [r[0] for r in rows(t)] == ["Alice", "Diana"] and len(errors(t)) == 2
    assert errors(read(MIXED, relax_column_count=True)) == []
    assert errors(read(MIXED, relax_column_count_less=True)) == [("TooManyFields", 1)]
    assert errors(read(MIXED, relax_column_count_more=True)) == [("TooFewFields", 2)]
    seen = []
    read(MIXED, on_error=lambda e: seen.append(e["code"]))
    assert sorted(seen) == ["TooFewFields", "TooManyFields"]


def test_extra_fields_keep_quoted_delimiters(read):
    assert rows(read('a,b\n1,2,"x,y","say ""hi""",\n').with_parsed_extra())[0][2] == ["x,y", 'say "hi"', None]


def test_record_size(read):
    text = f"name,data\nA,short\nB,{'x' * 200}\nC,tiny\n"
    t = read(text, max_record_size=50)
    assert len(rows(t)) == 3 and errors(t) == [("MaxRecordSize", 1)]
    assert t.errors().head().message == "Record at row 1 exceeds maximum size of 50 bytes (got 201)"
    assert [r[0] for r in rows(read(text, max_record_size=50, skip_records_with_error=True))] == ["A", "C"]


def test_empty_records(read):
    assert len(rows(read("name,age,city\nAlice,30,NYC\n\n\nBob,25,LA\n\nCharlie,35,Chicago\n"))) == 3
    assert len(rows(read("name,age,city\nAlice,30,NYC\n,,\nBob,25,LA\n,,\n", skip_records_with_empty_values=True))) == 2
    greedy = "name,age\nAlice,30\n   ,   \nBob,25\n  \t , \nCharlie,35\n"
    assert len(rows(read(greedy, skip_empty_rows="greedy"))) == 3
    assert len(rows(read(greedy))) == 5
    assert len(rows(read("a,b\n1,2\n\n3,4\n", skip_empty_rows=False))) == 3


def test_trim_keeps_headers(read):
    text = '"  name  ",age\n  Alice  ,　30 \n'
    assert read(text, trim=True).columns == ["  name  ", "age"]
    assert rows(read(text, trim=True)) == [("Alice", "30")]
    assert rows(read(text, ltrim=True)) == [("Alice  ", "30 ")]
    assert rows(read(text, rtrim=True)) == [("  Alice", "　30")]
    assert rows(read('a\n"  "\n', trim=True))[0][0] == ""


def test_ranges(read):
    text = "name,val\n" + "".join(f"{c},{k}\n" for k, c in enumerate("ABCDEFGHIJ", 1))
    assert [r[0] for r in rows(read(text, from_line=4))] == list("CDEFGHIJ")
    assert [r[0] for r in rows(read(text, to_line=4))] == list("ABC")
    assert [r[0] for r in rows(read(text, from_line=4, to_line=6))] == list("CDE")
    t = read(text, preview=3)
    assert [r[0] for r in rows(t)] == list("ABC") and t.meta["truncated"]


def test_comments_and_preamble(read):
    assert [r[0] for r in rows(read("#x\nname,note\nAlice,a\n# y\nBob,b\n", comments=True))] == ["Alice", "Bob"]
    assert len(rows(read('name,note\nAlice,"# no"\nBob,b\n', comments=True))) == 2
    assert len(rows(read("name\n;x\nBob\n", comments=";"))) == 1
    assert [r[0] for r in rows(read("Generated: 1\nSource: 2\n" + PEOPLE, skip_first_n_lines=2))] == ["Alice", "Bob", "Charlie"]


def test_hooks(read):
    assert rows(read("a;b\n1;2\n", before_first_chunk=lambda s: s.replace(";", ",")))[0][:2] == ("1", "2")
    t = read(PEOPLE, on_record=lambda values, info: None if info["index"] == 1 else [values[0].upper(), str(info["index"]), values[2]])
    assert [r[:3] for r in rows(t)] == [("ALICE", "0", "NYC"), ("CHARLIE", "2", "Chicago")]
    t = read(PEOPLE, transform=lambda c, name: F.upper(c) if name == "city" else c)
    assert [r[2] for r in rows(t)] == ["NYC", "LA", "CHICAGO"]


def test_dynamic_typing_and_casts(read):
    t = read("name,age,score,active,code\nAlice,30,95.5,true,007\nBob,25,1e2,FALSE,008\nEve,,2.5E-3,True,\n", dynamic_typing=True)
    assert rows(t) == [("Alice", 30, 95.5, True, 7), ("Bob", 25, 100.0, False, 8), ("Eve", None, 0.0025, True, None)]
    t = read("a,b\n1,2\n", dynamic_typing={"a": True})
    assert rows(t)[0][:2] == (1, "2")
    assert rows(read("a,b\n1,2\n", dynamic_typing=lambda n: n == "b"))[0][:2] == ("1", 2)
    assert rows(read("a,b\n+1,1_0\n", dynamic_typing=True))[0][:2] == ("+1", "1_0")
    t = read("name,age\nAlice,30\nBob,\n", dynamic_typing=True, cast={"age": lambda c: F.concat(F.lit("age:"), c)})
    assert [r[1] for r in rows(t)] == ["age:30", None]


def test_declared_types(read):
    t = read('price,share,flag,day,n\n"$1,234.50",12%,Yes,2024-02-03,"1,200.9"\n(5),7,no,bad,x\n,,,,\n')
    schema = {"price": "currency", "share": "percent", "flag": "boolean", "day": {"type": "date", "nullable": True}, "n": {"type": "integer", "default": 9}}
    got = typed_table(t, schema).map({k: F.col(k) for k in ("price", "share", "flag", "n")})
    assert [tuple(r) for r in got.collect()] == [(1234.5, 0.12, True, 1200), (-5.0, 0.07, False, None), (None, None, None, 9)]
    bad = typing_errors(t, {"day": {"type": "date", "nullable": True}, "n": "integer"}).orderBy("row", "column").collect()
    assert [(r.row, r.column) for r in bad] == [(1, "day"), (1, "n"), (2, "n")]


def test_encodings(spark, read):
    text = "name,city\nJosé,Zürich\n日本,x\n"
    for encoding in ("utf-8-sig", "utf-16", "utf-16-le", "utf-16-be"):
        assert [r[0] for r in rows(read(text.encode(encoding)))][:1] == ["José"], encoding
    latin = "name\ncafé\nnaïve and more text\n".encode("cp1252")
    assert [r[0] for r in rows(read(latin))] == ["café", "naïve and more text"]
    assert [r[0] for r in rows(read("name\n日本\n".encode("shift_jis"), encoding="Shift_JIS"))] == ["日本"]
    assert detect.detect_encoding("plain".encode()) == "UTF-8" and detect.detect_encoding(b"\xff\xfe\x00\x00a") == "UTF-32LE"


def test_custom_quote_and_fast_mode(read):
    assert rows(read("a,b\n'x,y',2\n", quote_char="'"))[0][:2] == ("x,y", "2")
    assert rows(read('a,b\n"x",2\n', fast_mode=True))[0][:2] == ('"x"', "2")


def test_strict_quotes(read):
    assert list(strict.records('a"b,c"d,2\r\n"x\ny",\n')) == [['a"b,c"d', "2"], ['"x\ny"', ""]]
    assert rows(read('a,b\nx"y,z"w,2\n"two\r\nlines",3\n', strict=True)) == [('x"y,z"w', "2"), ("two\r\nlines", "3")]


def test_many_files_keep_name_order(spark, tmp_path):
    for name, n in (("b", 50), ("a", 1), ("c", 3)):
        (tmp_path / f"{name}.csv").write_text("k,f\n" + "".join(f"{k},{name}\n" for k in range(n)))
    t = read_csv(spark, str(tmp_path))
    assert [r[1] for r in rows(t)] == ["a"] + ["b"] * 50 + ["c"] * 3
    assert t.at(1)[0] == "0" and t.last(1).collect()[0][0] == "2"


@pytest.mark.parametrize("copied", [True, False])
def test_split_reading_gives_dense_positions(spark, tmp_path, monkeypatch, copied):
    monkeypatch.setattr(reader, "SPOOL_BYTES", 1 << 30 if copied else 10)
    path = tmp_path / "big.csv"
    path.write_text("pre\nk,v\n" + "".join(f"{k},{'x' * 20}\n" for k in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        t = read_csv(spark, str(path), skip_first_n_lines=1, splittable=True, from_line=30_002)
        got = [int(r[0]) for r in rows(t)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(30_000, 40_000))


def test_sources(spark, read, tmp_path):
    import io

    assert len(rows(read_csv(spark, io.BytesIO(PEOPLE.encode())))) == 3
    assert len(rows(read_csv(spark, iter([b"name,age\n", b"A,1\n"])))) == 1
    assert read_csv(spark, b"").columns == []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(PEOPLE.encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert len(rows(read_csv(spark, f"{base}/ok"))) == 3
    with pytest.raises(OSError):
        read_csv(spark, f"{base}/no")
    server.shutdown()
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(TypeError, match="unknown options"):
        read_csv(spark, b"a\n", quotechar="'")


def test_long_first_record_and_empty_first_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text('"' + "x\n" * 90_000 + '",2,3\n4,5,6\n')
    t = read_csv(spark, str(tmp_path), has_header=False)
    assert t.columns == ["col0", "col1", "col2"] and [r[1] for r in rows(t)] == ["2", "5"]
