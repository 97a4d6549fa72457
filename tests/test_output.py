"""Serializers, writers, generators, streams and the command line."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomframe import CSVWriter, Table, convert, read_csv, unparse
from loomframe.cli import COMMANDS, load_config, run
from loomframe.sources import strict
from loomframe.sources.sinks import convert_to, write_file
from loomframe.sources.synthetic import awkward_lines, csv_text, generated_lines
from loomframe.streaming.stream import Handle, batches, chunked, read_stream, run_batches, step


def test_unparse(spark):
    rows = [{"a": 1, "b": 'x "y"'}, {"a": None, "b": " z"}]
    assert unparse(spark, rows) == 'a,b\r\n1,"x ""y"""\r\n," z"'
    assert unparse(spark, rows, header=False, newline="\n", delimiter=";") == '1;"x ""y"""\n;" z"'
    assert unparse(spark, rows, quotes=True, newline="\n").split("\n")[1] == '"1","x ""y"""'
    assert unparse(spark, rows, quotes=[False, True], newline="\n").split("\n")[2] == '," z"'
    assert unparse(spark, rows, columns=["b"], newline="\n").split("\n")[0] == "b"
    assert unparse(spark, [["a", "b"], ["1", "2"]]) == "a,b\r\n1,2"
    assert unparse(spark, {"fields": ["x", "y"], "data": [[1, 2.5], [3, 4.0]]}) == "x,y\r\n1,2.5\r\n3,4"
    assert unparse(spark, '[{"a": true}, {"a": false}]') == "a\r\ntrue\r\nfalse"
    assert unparse(spark, [{"a": "=1+1", "b": "@x"}], escape_formulae=True) == "a,b\r\n'=1+1,'@x"
    assert unparse(spark, [{"a": ""}, {"a": "x"}, {"a": " "}], skip_empty_lines=True, newline="|") == 'a|x|" "'
    assert unparse(spark, [{"a": ""}, {"a": "x"}, {"a": " "}], skip_empty_lines="greedy", newline="|") == "a|x"
    assert unparse(spark, [{"u": {"n": "A", "g": 3}, "s": 5}, {"u": {"n": "B"}, "s": 6}], flatten_objects=True).split("\r\n")[0] in ("u.g,u.n,s", "u.n,u.g,s")
    assert unparse(spark, []) == ""


def test_writer(tmp_path):
    path = tmp_path / "w.csv"
    with CSVWriter(str(path), quote_style="non-numeric", escape_formulae=True) as w:
        w.write_header(["a", "b"]), w.write_row([1, 'x"y']), w.write_row([None, "=1"]), w.write_object({"b": True, "a": 2.0}, ["a", "b"])
    assert path.read_text() == '"a","b"\n1,"x""y"\n,"\'=1"\n2,true\n'
    with CSVWriter(str(path), append=True, line_ending="\r\n") as w:
        w.write_rows([["p q", "r,s"]])
    assert path.read_bytes().endswith(b'p q,"r,s"\r\n') and w.rows_written == 1


def test_convert(spark, tmp_path):
    t = read_csv(spark, b'a,b\n1,"x\ty"\n,"p,""q"""\n', relax_column_count=True)
    assert json.loads(convert(t, "json")) == [{"a": "1", "b": "x\ty"}, {"a": None, "b": 'p,"q"'}]
    assert convert(t, "jsonl").split("\n")[1] == '{"a":null,"b":"p,\\"q\\""}'
    assert convert(t, "tsv") == 'a\tb\n1\tx\\ty\n\tp,"q"'
    assert convert(t, "csv") == 'a,b\n1,x\ty\n,"p,""q"""'
    with pytest.raises(ValueError, match="unknown format"):
        convert(t, "xml")
    convert_to(t, str(tmp_path / "j"), "jsonl")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_generators(spark):
    columns = ["id:integer", "n:name", "d:date", "f:float", "ok:boolean", "free"]
    made = generated_lines(spark, 300, columns, seed=7)
    text = csv_text(made, columns)
    assert text == csv_text(generated_lines(spark.newSession(), 300, columns, seed=7).repartition(5), columns)
    assert text.startswith("id,n,d,f,ok,free\n") and text != csv_text(generated_lines(spark, 300, columns, seed=8), columns)
    got = read_csv(spark, text.encode(), dynamic_typing=True)
    assert got.count() == 300 and dict(got.to_df().dtypes) == {"id": "double", "n": "string", "d": "string", "f": "double", "ok": "boolean", "free": "string"} | {k: v for k, v in got.to_df().dtypes if k == "id"}
    with pytest.raises(ValueError, match="unknown kind"):
        generated_lines(spark, 1, ["a:colour"])


@pytest.mark.parametrize("wide,longest", [(False, 0), (True, 500)])
def test_awkward_lines_round_trip(spark, wide, longest):
    text = csv_text(awkward_lines(spark, 400, wide=wide, longest=longest), ["a", "b", "c"])
    want = [[strict.field(f) for f in r] for r in strict.records(text)][1:]
    assert len(want) == 400 and {len(r) for r in want} == {3}
    first = read_csv(spark, text.encode(), strict=True)
    again = read_csv(spark, unparse(spark, first, newline="\n").encode(), strict=True)
    # the serializer writes null and empty text alike
    assert [[v or None for v in r] for r in first.collect()] == [[v or None for v in r] for r in want]
    assert [[v or None for v in r] for r in again.collect()] == [[v or None for v in r] for r in want]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\r\x00"), min_size=1), st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\r\x00"), min_size=1)), min_size=1, max_size=5))
def test_written_rows_read_back(spark, rows):
    """What the serializer writes, the strict tokenizer reads."""
    text = unparse(spark, [{"a": a, "b": b} for a, b in rows], newline="\n", quotes=True)
    assert [tuple(strict.field(f) for f in r) for r in strict.records(text)][1:] == rows


def test_pull_iteration(spark):
    t = Table.from_rows(spark, [{"k": k} for k in range(25)])
    seen = []
    out = step(t, lambda e, h: (seen.append(e["data"]["k"]), h.abort() if len(seen) == 5 else None))
    assert seen == [0, 1, 2, 3, 4] and out == {"rows": 5, "aborted": True, "paused": False}
    sizes = []
    assert chunked(t, lambda rows, h: sizes.append(len(rows)), 10)["chunks"] == 3 and sizes == [10, 10, 5]
    handle = Handle()
    assert chunked(t, lambda rows, h: h.pause(), 10, handle)["rows"] == 10
    assert [len(b) for b in batches(t, 20)] == [20, 5]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    (source / "a.csv").write_text("k,v\n1, x \n2,y\n")
    stream = lambda: read_stream(spark, str(source), ["k", "v"], strip=True, where="k > 1")
    go = lambda: run_batches(stream(), lambda df, n: seen.extend((r["k"], r["v"]) for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    go()
    assert seen == [("2", "y")]
    (source / "b.csv").write_text("k,v\n3, z\n")
    go()
    assert seen == [("2", "y"), ("3", "z")]


@pytest.fixture
def cli(spark, tmp_path, capsys):
    path = tmp_path / "data.csv"
    path.write_text("name,age,city\nAlice,30,New York\nBob,25,London\nEve,35,Paris\n")

    def go(*args):
        code = run([a.replace("FILE", str(path)) for a in args], spark)
        return code, capsys.readouterr().out.strip()

    return go


def test_commands(cli, tmp_path):
    assert cli("count", "FILE") == (0, "3")
    assert cli("head", "FILE", "-n", "1", "--format", "csv", "--relax-columns-more")[1].split("\n")[1].startswith("Alice,30,New York")
    assert cli("tail", "FILE", "-n", "1", "--format", "jsonl")[1].startswith('{"name":"Eve"')
    assert cli("select", "age,0", "FILE", "--format", "csv")[1].split("\n")[:2] == ["age,name", "30,Alice"]
    assert cli("filter", "age > 26 && city != 'Paris'", "FILE", "--format", "csv")[1].split("\n")[1].startswith("Alice")
    assert cli("sort", "-c", "age", "--desc", "FILE", "--format", "csv")[1].split("\n")[1].startswith("Eve")
    assert " | " in cli("stats", "FILE", "--format", "table")[1]
    assert cli("validate", "FILE")[0] == 0
    assert len(json.loads(cli("convert", "FILE", "-t", "json")[1])) == 3
    assert cli("convert", "FILE", "-t", "tsv", "-o", str(tmp_path / "o.tsv"))[0] == 0 and (tmp_path / "o.tsv").exists()
    assert json.loads(cli("benchmark", "FILE", "-n", "1")[1])["runs"] == 1
    for shell in ("bash", "zsh", "fish"):
        assert all(c in cli("completions", shell)[1] for c in COMMANDS)


def test_broken_file_fails_validation(cli, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1\n")
    assert cli("validate", str(bad))[0] == 1


def test_config(tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / ".loomframerc").write_text('{"delimiter": ";", "format": "csv"}')
    assert load_config(str(tmp_path / "x"), {}) == {"delimiter": ";", "format": "csv"}
    assert load_config(str(tmp_path / "x"), {"LOOMFRAME_DELIMITER": "|"})["delimiter"] == "|"


def test_single_file(spark, tmp_path):
    write_file(Table.from_rows(spark, [{"a": k, "b": f"x{k}"} for k in range(3)]), str(tmp_path / "f.csv"))
    assert (tmp_path / "f.csv").read_text() == "a,b\n0,x0\n1,x1\n2,x2\n"
