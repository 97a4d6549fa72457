"""skip_first_n_lines gives one result, whoever copies the body."""

import pytest

from loomframe import read_csv
from loomframe.sources import reader

BODY = 'k,note\n1,"two\nlines"\n2,"a\n\nb"\n\n3,"x, ""y"""\n4,é\n'
WANT = [("1", "two\nlines"), ("2", "a\n\nb"), ("3", 'x, "y"'), ("4", "é")]


def rows(table):
    return [tuple(r)[:2] for r in table.collect()]


@pytest.mark.parametrize("size", [1 << 30, 10])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16"])
def test_every_size_reads_alike(spark, tmp_path, monkeypatch, size, encoding):
    monkeypatch.setattr(reader, "SPOOL_BYTES", size)
    path = tmp_path / "x.csv"
    path.write_bytes(("Made: ਊ\nBy, \"us\n" + BODY).encode(encoding))
    given = {"skip_first_n_lines": 2}
    t = read_csv(spark, str(path), **given)
    assert t.meta["fields"] == ["k", "note"]
    assert rows(t) == WANT
    assert rows(read_csv(spark, str(path), strict=True, **given)) == WANT
    assert rows(read_csv(spark, str(path), skip_empty_rows=False, **given)) == [*WANT[:2], (None, None), *WANT[2:]]
    assert rows(read_csv(spark, str(path), has_header=False, **given)) == [("k", "note"), *WANT]
    assert read_csv(spark, str(path), skip_first_n_lines=99).columns == []


@pytest.mark.parametrize("size", [1 << 30, 10])
def test_files_of_a_folder_are_one_text(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(reader, "SPOOL_BYTES", size)
    for name, text in (("a", "one\n"), ("b", "two\nk,v\n1,x\n"), ("c", "2,y\n" * 9)):
        (tmp_path / f"{name}.csv").write_text(text)
    assert rows(read_csv(spark, str(tmp_path), skip_first_n_lines=2)) == [("1", "x")] + [("2", "y")] * 9


def test_lines_across_blocks():
    import io

    from loomframe import session

    class Stream(io.BytesIO):
        readNBytes = io.BytesIO.read  # noqa: N815  as in Java

    text = "aਊb\n\ncd\nrest"
    for encoding, newline in (("utf-8", b"\n"), ("utf-16-le", b"\n\0"), ("utf-16-be", b"\0\n")):
        for n in range(4):
            want = len("".join(text.splitlines(True)[:n]).encode(encoding))
            assert session._lines_end(Stream(text.encode(encoding)), newline, n, 4) == (want, 0)
        assert session._lines_end(Stream(text.encode(encoding)), newline, 5, 4) == (len(text.encode(encoding)), 2)
