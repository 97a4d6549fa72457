"""Writing: exact lines as expressions, written by the executors or gathered in order on request."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomframe.functions.text import FORMULA, escape_formula, is_number, quote_field, serialize, tsv_field
from loomframe.operators.nested import flatten
from loomframe.operators.table import Table, col
from loomframe.plans.order import sort_columns


def lines(table: Table, delimiter: str = ",", quote_char: str = '"', escape_char: str | None = None, quotes: bool | Sequence[bool] | str = False, escape_formulae: bool | str = False, columns: Sequence[str] | None = None, skip_empty_lines: bool | str = False, spaces: bool = True, mark_empty: bool = False) -> DataFrame:
    """(line) of each row, with the table's hidden order columns; `quotes` may be "non-numeric".  With `mark_empty` empty text is quoted and null is not."""
    names = list(columns) if columns else table.columns
    shown = table.select(*names, lenient=True)
    types = {f.name: f.dataType for f in shown._df.schema}
    out = []
    for k, name in enumerate(names):
        text = serialize(col(name), types[name])
        if escape_formulae:
            text = escape_formula(text, FORMULA if escape_formulae is True else escape_formulae)
        force = not is_number(types[name]) if quotes == "non-numeric" else quotes if isinstance(quotes, bool) else k < len(quotes) and quotes[k]
        field = quote_field(text, delimiter, quote_char, escape_char, bool(force), spaces)
        if mark_empty:
            field = F.when(text == "", F.lit(quote_char * 2)).otherwise(field)
        out.append(F.when(col(name).isNull(), F.lit("")).otherwise(field) if mark_empty or quotes == "non-numeric" else field)
    df = shown._df
    if skip_empty_lines:
        texts = F.array(*[serialize(col(n), types[n]) for n in names])
        df = df.where(F.exists(texts, (lambda t: F.trim(t) != "") if skip_empty_lines == "greedy" else (lambda t: t != "")))
    return df.select(F.concat_ws(delimiter, *out).alias("line"), *map(col, shown.hidden))


def header_line(names: Iterable[str], delimiter: str = ",", quote_char: str = '"', escape_char: str | None = None, quotes: Any = False, escape_formulae: bool | str = False) -> str:
    import re

    out = []
    for k, name in enumerate(names):
        if escape_formulae and re.search(FORMULA if escape_formulae is True else escape_formulae, name):
            name = "'" + name
        force = quotes is True or quotes == "non-numeric" or (not isinstance(quotes, (bool, str)) and k < len(quotes) and quotes[k])
        need = any(c in name for c in (delimiter, quote_char, "\n", "\r")) or name != name.strip(" ")
        out.append(quote_char + name.replace(quote_char, (escape_char or quote_char) + quote_char) + quote_char if force or need else name)
    return delimiter.join(out)


def _ordered(made: DataFrame, table: Table) -> DataFrame:
    return made.orderBy(*sort_columns(table._order)) if table._order else made


def as_table(spark: SparkSession, data: Any) -> Table:
    """What the serializer takes: a Table, rows as dicts or lists, {fields, data}, or a JSON text of these."""
    if isinstance(data, Table):
        return data
    if isinstance(data, str):
        data = json.loads(data)
    if isinstance(data, dict):
        names, rows = list(data["fields"]), [dict(zip(data["fields"], r, strict=False)) if isinstance(r, (list, tuple)) else r for r in data["data"]]
    elif data and isinstance(data[0], (list, tuple)):
        names = [str(k) for k in range(max(map(len, data)))]
        rows = [dict(zip(names, r, strict=False)) for r in data]
    else:
        names = list(dict.fromkeys(k for r in data for k in r))
        rows = list(data)
    rows = [{n: r.get(n) for n in names} for r in rows]
    if any(isinstance(v, dict) for r in rows for v in r.values()):
        # parallelize(): the JSON reader infers one struct over all rows
        df = spark.read.json(spark.sparkContext.parallelize([json.dumps({**r, "__o0": k}) for k, r in enumerate(rows)]))
        return Table(df.select(*[col(n) for n in names], "__o0"), [("__o0", True)])
    kinds = {n: {type(r[n]) for r in rows if r[n] is not None} for n in names}
    if any(len(k) > 1 for k in kinds.values()):  # columns do not mix types: such ones become text
        text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        rows = [{n: text(r[n]) if len(kinds[n]) > 1 else r[n] for n in names} for r in rows]
    names_sql = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    schema = ", ".join(f"`{n}` {names_sql.get(next(iter(kinds[n]), str) if len(kinds[n]) == 1 else str, 'string')}" for n in names)
    return Table.from_rows(spark, rows, schema) if names else Table(spark.createDataFrame([], StructType([])))


def unparse(spark: SparkSession, data: Any, header: bool = True, newline: str = "\r\n", flatten_objects: bool | str = False, **options: Any) -> str:
    """The whole text of a table, without a newline at its end; gathers the lines on the driver."""
    matrix = isinstance(data, (list, tuple)) and bool(data) and isinstance(data[0], (list, tuple))
    table = as_table(spark, data)
    if flatten_objects:
        table = flatten(table, flatten_objects if isinstance(flatten_objects, str) else ".")
    if not table.columns:
        return ""
    names = list(options.get("columns") or table.columns)
    top = [header_line(names, **{k: v for k, v in options.items() if k in ("delimiter", "quote_char", "escape_char", "quotes", "escape_formulae")})] if header and not matrix else []
    made = _ordered(lines(table, **options), table)
    return newline.join([*top, *[r["line"] for r in made.select("line").toLocalIterator()]])


def write_lines(table: Table, path: str, **options: Any) -> None:
    """The executors write the lines as text files in row order, a range of rows each; no header."""
    _ordered(lines(table, **options), table).select("line").write.text(path)


def write_file(table: Table, path: str, header: bool = True, newline: str = "\n", **options: Any) -> None:
    """One local file, streamed through the driver partition by partition and renamed when it is whole."""
    part = f"{path}.part-{os.getpid()}"
    with open(part, "w", encoding="utf-8", newline="") as out:
        if header:
            out.write(header_line(table.columns) + newline)
        for row in _ordered(lines(table, **options), table).select("line").toLocalIterator(prefetchPartitions=True):
            out.write(row["line"] + newline)
    os.replace(part, path)


class CSVWriter:
    """Rows to one local file: minimal quoting, or all, or all that is not a number."""

    def __init__(self, path: str, delimiter: str = ",", quote_char: str = '"', line_ending: str = "\n", quote_style: str = "minimal", flush_every: int = 1000, append: bool = False, escape_formulae: bool | str = False):
        self.delimiter, self.quote, self.end, self.style, self.every, self.formulae = delimiter, quote_char, line_ending, quote_style, flush_every, escape_formulae
        self.file = open(path, "a" if append else "w", encoding="utf-8", newline="")  # noqa: SIM115
        self.held: list[str] = []
        self.rows_written = 0

    def _field(self, value: Any) -> str:
        import re

        if value is None:
            return ""
        text = str(value).lower() if isinstance(value, bool) else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
        if self.formulae and re.search(FORMULA if self.formulae is True else self.formulae, text):
            text = "'" + text
        need = self.style == "all" or (self.style == "non-numeric" and not isinstance(value, (int, float))) or any(c in text for c in (self.delimiter, self.quote, "\n", "\r"))
        return self.quote + text.replace(self.quote, self.quote * 2) + self.quote if need else text

    def write_row(self, values: Iterable[Any]) -> None:
        self.held.append(self.delimiter.join(map(self._field, values)) + self.end)
        self.rows_written += 1
        if len(self.held) >= self.every:
            self.flush()

    write_header = write_row

    def write_rows(self, rows: Iterable[Iterable[Any]]) -> None:
        for row in rows:
            self.write_row(row)

    def write_object(self, row: dict[str, Any], columns: Sequence[str] | None = None) -> None:
        self.write_row(row.get(c) for c in (columns or row))

    def flush(self) -> None:
        self.file.write("".join(self.held))
        self.file.flush()
        self.held.clear()

    def close(self) -> None:
        self.flush()
        self.file.close()

    def __enter__(self) -> CSVWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def json_lines(table: Table) -> DataFrame:
    """(line) of each row as a JSON object with nulls, with the hidden order columns."""
    shown = F.to_json(F.struct(*map(col, table.columns)), {"ignoreNullFields": "false"})
    return table._df.select(shown.alias("line"), *map(col, table.hidden))


def tsv_lines(table: Table) -> DataFrame:
    types = {f.name: f.dataType for f in table._df.schema}
    return table._df.select(F.concat_ws("\t", *[tsv_field(serialize(col(n), types[n])) for n in table.columns]).alias("line"), *map(col, table.hidden))


def convert(table: Table, to: str) -> str:
    """The whole table as json, jsonl (ndjson), tsv or csv text on the driver."""
    kind = to.lower()
    if kind in ("json", "jsonl", "ndjson"):
        made = [r["line"] for r in _ordered(json_lines(table), table).select("line").toLocalIterator()]
        return json.dumps([json.loads(x) for x in made], indent=2, ensure_ascii=False) if kind == "json" else "\n".join(made)
    if kind == "tsv":
        return "\n".join(["\t".join(table.columns), *[r["line"] for r in _ordered(tsv_lines(table), table).select("line").toLocalIterator()]])
    if kind == "csv":
        return "\n".join([",".join(table.columns), *[r["line"] for r in _ordered(lines(table, spaces=False), table).select("line").toLocalIterator()]])
    raise ValueError(f"unknown format {to!r}; known: csv, tsv, json, jsonl")


def convert_to(table: Table, path: str, to: str) -> None:
    """The same, written by the executors as a folder of text files in row order (no header, no array brackets)."""
    made = {"jsonl": json_lines, "ndjson": json_lines, "tsv": tsv_lines, "csv": lines}[to.lower()](table)
    _ordered(made, table).select("line").write.text(path)
