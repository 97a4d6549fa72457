"""Reading delimited text as an ordered table.

The driver looks at the first bytes (encoding, delimiter, header); Spark's CSV source does the rest.
Records are numbered after comments and blank lines are gone, then the policies apply in this order:
record size, number of fields, line range, record hook, trim, transform, empty records, typing, casts.
Records with a wrong number of fields are recognised by the source itself and taken apart by string
expressions, so no policy needs a Python worker; only user functions on rows and `strict` do.

`strict` follows the exact quote rules and reads parts of a file in parallel, as record sizes and blank
records need it anyway; the default leaves quotes to the source, one task a file, and `splittable=True`
reads parts in parallel with it (records must not contain line ends).
"""

from __future__ import annotations

import base64
import os
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from loomframe.functions import typing as ty
from loomframe.functions.text import blank, trim
from loomframe.operators.table import Table, col
from loomframe.plans.order import positions, scan_positions
from loomframe.session import files, head_bytes, recoded, spool, spool_body
from loomframe.sources import detect, parallel, strict
from loomframe.sources.errors import no_errors

_RAW, _POS, _EXTRA, _N, _SIZE = "__raw", "__pos", "__parsed_extra", "__n_fields", "__size"
HEAD = 1 << 16
#: Bytes that a preview takes to the driver at most; a longer one reads the table.
_MOST_LEAD = 16 << 20
#: Of larger inputs the body behind skipped lines is not taken into the driver's Python; the JVM streams it to the copy.
SPOOL_BYTES = 64 << 20


@dataclass
class ReadOptions:
    """Every reader option; names follow the table of options in the README."""

    delimiter: str = ","
    delimiters_to_guess: Sequence[str] = detect.DELIMITERS
    quote_char: str = '"'
    escape_char: str | None = None
    has_header: bool = True
    skip_empty_rows: bool | str = True
    comments: bool | str = False
    preview: int = 0
    skip_first_n_lines: int = 0
    encoding: str | None = None
    schema: dict[str, Any] | None = None
    on_error: Callable[[dict], None] | None = None
    dynamic_typing: bool | dict[str, bool] | Callable[[str], bool] = False
    transform: Callable[[Column, str], Column] | None = None
    transform_header: Callable[[str, int], str] | None = None
    download_headers: dict[str, str] = field(default_factory=dict)
    with_credentials: bool = False
    skip_records_with_error: bool = False
    skip_records_with_empty_values: bool = False
    max_record_size: int = 0
    relax_column_count: bool = False
    relax_column_count_less: bool = False
    relax_column_count_more: bool = False
    trim: bool = False
    ltrim: bool = False
    rtrim: bool = False
    from_line: int | None = None
    to_line: int | None = None
    fast_mode: bool = False
    cast: ty.Cast | dict[str, ty.Cast] | None = None
    duplicate_headers: str = "rename"
    before_first_chunk: Callable[[str], str | None] | None = None
    on_record: Callable[[list, dict], list | None] | None = None
    strict: bool = False
    splittable: bool = False
    line_end: str | None = None

    def __post_init__(self) -> None:
        if self.duplicate_headers not in ("rename", "error"):
            raise ValueError("duplicate_headers is rename or error")
        if self.delimiter != "auto" and len(self.delimiter) != 1:
            raise ValueError("a delimiter is one character, or auto")
        if self.line_end not in (None, "\n"):
            raise ValueError("a line end that holds for all files is LF; others are found in each file")

    @property
    def comment(self) -> str | None:
        """What a comment begins with: one character, in fast mode as many as are given."""
        return None if not self.comments else "#" if self.comments is True else self.comments if self.fast_mode else self.comments[0]


def header_names(raw: Sequence[str | None], options: ReadOptions) -> list[str]:
    """Column names of a header record: empty cells become col{i}; repeated names get _1, _2, ... or raise."""
    out: list[str] = []
    for k, cell in enumerate(raw):
        name = cell or ("" if options.fast_mode else f"col{k}")
        if options.transform_header:
            name = options.transform_header(name, k)
        if name in out:
            if options.duplicate_headers == "error":
                raise ValueError(f"the header has {name!r} twice")
            n = 1
            while f"{name}_{n}" in out or f"{name}_{n}" in raw[k + 1 :]:
                n += 1
            name = f"{name}_{n}"
        out.append(name)
    return out


def _download(url: str, options: ReadOptions) -> bytes:
    """The body of an answer; a non-2xx one raises.  With credentials, a name and password in the URL and cookies set on the way are sent."""
    parts = urllib.parse.urlsplit(url)
    headers = dict(options.download_headers)
    handlers: list[urllib.request.BaseHandler] = []
    if parts.username is not None:
        url = urllib.parse.urlunsplit(parts._replace(netloc=parts.netloc.rpartition("@")[2]))
    if options.with_credentials:
        handlers.append(urllib.request.HTTPCookieProcessor())
        if parts.username is not None:
            given = f"{urllib.parse.unquote(parts.username)}:{urllib.parse.unquote(parts.password or '')}"
            headers.setdefault("Authorization", "Basic " + base64.b64encode(given.encode()).decode())
    with urllib.request.build_opener(*handlers).open(urllib.request.Request(url, headers=headers)) as answer:  # noqa: S310
        return answer.read()


def _source(spark: SparkSession, source: Any, options: ReadOptions) -> str:
    """A path that Spark can read: buffers, streams, URLs and hooks are spooled to the shared folder."""
    data: bytes | None = None
    if isinstance(source, (bytes, bytearray, memoryview)):
        data = bytes(source)
    elif isinstance(source, (str, os.PathLike)):
        source = os.fspath(source)
        if source.startswith(("http://", "https://")):
            data = _download(source, options)
    elif hasattr(source, "read"):
        data = source.read()
        data = data.encode() if isinstance(data, str) else data
    elif isinstance(source, Iterable):
        data = b"".join(x.encode() if isinstance(x, str) else bytes(x) for x in source)
    else:
        raise TypeError(f"cannot read {type(source).__name__}")
    if data is None and (options.before_first_chunk or options.skip_first_n_lines):
        size = sum(n for _, n, _ in files(spark, source))
        if size <= SPOOL_BYTES or options.before_first_chunk:
            data = b"".join(head_bytes(spark, p, n) for p, n, _ in files(spark, source))
        else:
            found = [(p, n) for p, n, _ in files(spark, source) if n]
            head = head_bytes(spark, found[0][0], HEAD)
            encoding = options.encoding or detect.detect_encoding(head)
            _, mark = detect.detect_mark(head)
            path = spool_body(spark, [p for p, _ in found], mark, options.skip_first_n_lines, encoding)
            options.encoding, options.skip_first_n_lines = "UTF-8", 0
            return path
    if data is None:
        return source
    if options.skip_first_n_lines or options.before_first_chunk:
        encoding = options.encoding or detect.detect_encoding(data)
        _, mark = detect.detect_mark(data)
        text = data[mark:].decode(encoding, "replace")
        if options.before_first_chunk:
            changed = options.before_first_chunk(text)
            text = changed if isinstance(changed, str) else text
        for _ in range(options.skip_first_n_lines):
            at = text.find("\n")
            text = text[at + 1 :] if at >= 0 else ""
        data, options.encoding, options.skip_first_n_lines = text.encode(), "UTF-8", 0
    return spool(spark, data)


def _head(spark: SparkSession, path: str, options: ReadOptions) -> tuple[str, list[str], str, str]:
    """(delimiter, names, encoding, line end) from the first file that holds anything; reads on until one record is whole."""
    found = files(spark, path)
    first, size = next(((p, n) for p, n, _ in found if n), found[0][:2])
    quote = "" if options.fast_mode else options.quote_char
    most = HEAD
    while True:
        raw = head_bytes(spark, first, most)
        encoding = options.encoding or detect.detect_encoding(raw)
        _, mark = detect.detect_mark(raw)
        text = raw[mark:].decode(encoding, "replace")
        delimiter = detect.detect_delimiter(text, options.delimiters_to_guess, quote) if options.delimiter == "auto" else options.delimiter
        lead, whole, end = None, False, 0
        for record, at in strict.ended_records(text, delimiter, quote):
            end = end or at
            if lead is not None:
                whole = True
                break
            if record != [""] and not (options.comment and record[0].startswith(options.comment)):
                lead = record
        if whole or most >= size:
            break
        most *= 4
    if lead is None:
        return delimiter, [], encoding, "\n"
    names = header_names([strict.field(f, quote) for f in lead], options) if options.has_header else [f"col{k}" for k in range(len(lead))]
    # what ends the first record, not what may stand in its quotes
    return delimiter, names, encoding, detect.detect_linebreak(text[max(0, end - 2) : end])


def _lead(spark: SparkSession, path: str, delimiter: str, encoding: str, o: ReadOptions) -> bytes | None:
    """The first records of a file that is much longer than a preview needs, None of others."""
    first, size = next(((p, n) for p, n, _ in files(spark, path) if n), ("", 0))
    if size <= 4 * HEAD:
        return None
    quote, want, most = "" if o.fast_mode else o.quote_char, o.preview + bool(o.has_header), HEAD
    while 4 * most <= size and most <= _MOST_LEAD:
        raw = head_bytes(spark, first, most)
        _, mark = detect.detect_mark(raw)
        text, found = raw[mark:].decode(encoding, "replace"), 0
        for record, end in strict.ended_records(text, delimiter, quote):
            found += record == [""] and o.skip_empty_rows is False or record != [""] and not (o.comment and record[0].startswith(o.comment))
            if found == want and end < len(text) - 1:
                return text[:end].encode()
        most *= 4
    return None


def _strict(spark: SparkSession, path: str, names: list[str], delimiter: str, encoding: str, o: ReadOptions) -> DataFrame:
    """One task a file, for encodings that lines cannot be split in: exact quote rules, raw line ends kept."""
    schema = StructType([StructField(n, StringType()) for n in names]).add(_RAW, StringType()).add(_N, IntegerType()).add(_SIZE, LongType()).add("__in_file", LongType()).add("__file", StringType())
    quote, comment, header, width, keep_blank = "" if o.fast_mode else o.quote_char, o.comment, o.has_header, len(names), o.skip_empty_rows is False

    def run(parts: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                content = bytes(content)
                _, mark = detect.detect_mark(content)
                rows, k, todo = [], 0, header
                for record in strict.records(content[mark:].decode(encoding, "replace"), delimiter, quote):
                    if (record == [""] and not keep_blank) or (comment and record[0].startswith(comment)):
                        continue
                    if todo:
                        todo = False
                        continue
                    values = [strict.field(f, quote) for f in record]
                    wrong = delimiter.join(record) if len(record) != width else None
                    rows.append([*(values + [None] * width)[:width], wrong, len(record), sum(len(f.encode()) for f in record), k, name])
                    k += 1
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=schema.names)
                        rows = []
                yield pd.DataFrame(rows, columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _tokens(raw: Column, delimiter: str, quote: str) -> Column:
    """The raw fields of one record, by string expressions."""
    d, q = (f"\\Q{x}\\E" for x in (delimiter, quote))
    body = f"(?:{q}(?:(?!{q}).|{q}{q})*(?:{q}|$)|(?!{d}|{q}).)*" if quote else f"(?:(?!{d}).)*"
    # a delimiter in front makes every field, empty ones too, begin alike
    return F.regexp_extract_all(F.concat(F.lit(delimiter), raw), F.lit(f"(?s){d}({body})"), 1)


def _value(raw: Column, quote: str) -> Column:
    if not quote:
        return F.nullif(raw, F.lit(""))
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit(quote * 2), F.lit(quote))
    return F.when((F.length(raw) > 1) & F.startswith(raw, F.lit(quote)) & F.endswith(raw, F.lit(quote)), inner).otherwise(F.nullif(raw, F.lit("")))


def _scan(spark: SparkSession, path: str, names: list[str], delimiter: str, encoding: str, o: ReadOptions, raw: bool, linebreak: str | None = None) -> DataFrame:
    """All-text scan; unquoted empty fields are null, quoted ones empty text.

    `linebreak` ends the records of all files.  Without it the source takes the first line end of each file, even one in
    quotes: after a CR there, it takes records apart wrongly and changes the line ends in quotes.
    """
    schema = StructType([StructField(n, StringType()) for n in names])
    if raw:
        schema = schema.add(_RAW, StringType())
    quote = "" if o.fast_mode else o.quote_char
    settings = {
        "sep": delimiter, "quote": quote, "escape": quote if o.escape_char is None else o.escape_char, "comment": o.comment or "", "encoding": encoding, "nullValue": f"\x00{uuid.uuid4().hex}", "emptyValue": "",
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW, "maxCharsPerColumn": "-1", "columnPruning": str(not raw).lower(), "enforceSchema": "true",
    }
    if not quote:
        settings |= {"quote": "\x00", "escape": "\x00"}
    elif settings["escape"] == quote:
        # by default NUL, which the source then leaves out of quoted text
        settings["charToEscapeQuoteEscaping"] = quote
    multi = not (o.splittable or o.fast_mode)
    if multi and linebreak == "\n":
        settings["lineSep"] = linebreak
    return spark.read.schema(schema).options(**settings, header=str(o.has_header).lower(), multiLine=str(multi).lower()).csv(path)


def read_csv(spark: SparkSession, source: Any, options: ReadOptions | None = None, **given: Any) -> Table:
    """Read a path, pattern, URL, buffer, file object or iterable of chunks as a Table."""
    known = {f.name for f in fields(ReadOptions)}
    if unknown := set(given) - known:
        raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
    base = {f.name: getattr(options, f.name) for f in fields(ReadOptions)} if options else {}
    o = ReadOptions(**(base | given))
    path = _source(spark, source, o)
    delimiter, names, encoding, linebreak = _head(spark, path, o)
    meta = {"delimiter": delimiter, "linebreak": linebreak, "encoding": encoding, "fields": names if o.has_header else None, "truncated": False, "aborted": False, "path": path, "files": files(spark, path)}
    if o.preview and (short := _lead(spark, path, delimiter, encoding, o)) is not None:
        path, encoding = spool(spark, short), "UTF-8"
    if not names:
        return Table(spark.createDataFrame([], StructType([])), [], meta=meta)
    if encoding.lower() in ("windows-1252", "shift_jis", "cp1252") and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        # the source reads these under a session setting only, which is not ours to change
        path, encoding = recoded(spark, [p for p, n, _ in meta["files"] if n], encoding), "UTF-8"
    quote = "" if o.fast_mode else o.quote_char
    checks = o.has_header and not o.relax_column_count
    raw = o.has_header or o.max_record_size > 0
    exact = o.strict or o.skip_empty_rows is False or bool(o.max_record_size) or len(o.comment or "") > 1
    if exact and encoding.upper() in ("UTF-8", "US-ASCII"):
        df = parallel.scan(spark, path, names, delimiter, quote, o.comment, o.has_header, o.skip_empty_rows is False)
        order, single = parallel.ORDER, False
    elif exact:
        df = _strict(spark, path, names, delimiter, encoding, o)
        order, single = [("__file", True), ("__in_file", True)], False
    else:
        df = _scan(spark, path, names, delimiter, encoding, o, raw, o.line_end or (linebreak if len(meta["files"]) == 1 else None))
        if raw:
            # the source refuses queries that read the raw text alone, so a data column takes part
            some = F.coalesce(F.length(col(names[0])) * 0, F.lit(0))
            df = df.withColumn(_N, F.when(F.col(_RAW).isNull(), len(names)).otherwise(F.size(_tokens(F.col(_RAW), delimiter, quote)) + some))
        single = len(meta["files"]) == 1
        if single:
            df, order = df.withColumn("__seq0", F.monotonically_increasing_id()), [("__seq0", True)]
        else:
            df = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__seq0"))
            order = [("__file", True), ("__block", True), ("__seq0", True)]
    number = lambda frame: scan_positions(frame, _POS) if single else positions(frame, order, _POS)
    ranged = o.from_line is not None or o.to_line is not None
    numbered = None
    if ranged or o.preview or o.on_record or o.skip_empty_rows is False:
        numbered = df = number(df)
        order = [(_POS, True)]
    if o.preview:
        df = df.where(F.col(_POS) < o.preview)
        meta["truncated"] = True
    scanned = df
    # record size and number of fields
    wrong = []
    if o.max_record_size:
        size = F.col(_SIZE)
        too_big = size > o.max_record_size
        message = lambda: F.concat(F.lit("Record at row "), F.col(_POS).cast("string"), F.lit(f" exceeds maximum size of {o.max_record_size} bytes (got "), size.cast("string"), F.lit(")"))
        wrong.append(("RecordSize", "MaxRecordSize", too_big, message))
    if checks:
        message = lambda: F.concat(F.lit(f"Expected {len(names)} fields but found "), F.col(_N).cast("string"))
        if not o.relax_column_count_more:
            wrong.append(("FieldMismatch", "TooManyFields", F.col(_N) > len(names), message))
        if not o.relax_column_count_less:
            wrong.append(("FieldMismatch", "TooFewFields", F.col(_N) < len(names), message))

    def errors() -> DataFrame:
        if not wrong:
            return no_errors(spark)
        found = scanned if _POS in scanned.columns else number(scanned)
        structs = [F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(code).alias("code"), text().alias("message"), F.col(_POS).alias("row"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("column"))) for kind, code, test, text in wrong]
        return found.select(F.explode(F.array_compact(F.array(*structs))).alias("e")).select("e.*")

    if o.skip_records_with_error and wrong:
        bad = wrong[0][2]
        for _, _, test, _ in wrong[1:]:
            bad = bad | test
        df = df.where(~bad)
    if ranged:
        skip = 1 + (1 if o.has_header else 0)
        if o.from_line is not None:
            df = df.where(F.col(_POS) >= max(0, o.from_line - skip))
        if o.to_line is not None:
            df = df.where(F.col(_POS) <= o.to_line - skip)
    if raw and o.has_header and not o.relax_column_count_more or (raw and o.relax_column_count):
        tokens = _tokens(F.col(_RAW), delimiter, quote)
        extra = F.transform(F.slice(tokens, len(names) + 1, F.greatest(F.col(_N) - len(names), F.lit(0))), lambda t: _value(t, quote))
        df = df.withColumn(_EXTRA, F.when(F.col(_N) > len(names), extra))
    if o.on_record:
        df = _records(df, names, o.on_record)
    if o.trim or o.ltrim or o.rtrim:
        df = df.withColumns({n: trim(col(n), o.trim or o.ltrim, o.trim or o.rtrim) for n in names})
    if o.transform:
        df = df.withColumns({n: F.when(col(n).isNotNull(), o.transform(col(n), n)) for n in names})
    greedy = o.skip_empty_rows == "greedy" or o.skip_records_with_empty_values == "greedy"
    if greedy or o.skip_records_with_empty_values:
        df = df.where(~F.forall(F.array(*map(col, names)), lambda c: blank(c, greedy)))
    df = df.drop(_RAW, _N, _SIZE)
    if o.dynamic_typing:
        pick = o.dynamic_typing
        on = [n for n in names if pick is True or (pick(n) if callable(pick) else pick.get(n, False))]
        df = ty.dynamic(df, on)
    if o.cast:
        df = ty.cast_columns(df, o.cast, names)
    table = Table(df, order, errors, meta)
    if o.on_error:
        for row in errors().toLocalIterator():
            o.on_error(row.asDict())
    table.meta["schema"] = o.schema
    return table


def _records(df: DataFrame, names: list[str], hook: Callable[[list, dict], list | None]) -> DataFrame:
    """A user function on each record: None drops it, a list replaces its values."""

    def run(parts: Iterator[Any]) -> Iterator[Any]:
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            made = [hook(list(values), {"index": int(k), "columns": names}) for values, k in zip(part[names].itertuples(index=False), part[_POS], strict=True)]
            keep = [k for k, r in enumerate(made) if r is not None]
            out = part.iloc[keep].copy()
            for j, name in enumerate(names):
                out[name] = [made[k][j] if j < len(made[k]) else None for k in keep]
            yield out

    return df.mapInPandas(run, df.schema)


def changed_since_read(spark: SparkSession, table: Table) -> list[str]:
    """The files of a read table that were changed, added or taken away since (by size and time)."""
    then = {p: (n, t) for p, n, t in table.meta["files"]}
    try:
        now = {p: (n, t) for p, n, t in files(spark, table.meta["path"])}
    except FileNotFoundError:
        now = {}
    return sorted(p for p in then.keys() | now.keys() if then.get(p) != now.get(p))


def typed_table(table: Table, schema: dict[str, Any]) -> Table:
    """Declared types on a text table: {name: type} or {name: {"type", "nullable", "default", "col"}}."""
    made = {}
    for name, spec in schema.items():
        spec = {"type": spec} if isinstance(spec, str) else spec
        at = table.columns[spec["col"]] if isinstance(spec.get("col"), int) else spec.get("col", name)
        made[name] = ty.typed(col(at), spec["type"], spec.get("nullable", False), spec.get("default"))
    return table.with_columns(made)


def typing_errors(table: Table, schema: dict[str, Any]) -> DataFrame:
    """Values that break a declared type, as rows of the error channel."""
    structs = []
    for name, spec in schema.items():
        spec = {"type": spec} if isinstance(spec, str) else spec
        bad = ty.type_error(col(name), spec["type"], spec.get("nullable", False), spec.get("default"))
        text = F.concat(F.lit(f"Cannot read {name!r} as {spec['type']}: "), F.coalesce(col(name), F.lit("null")))
        structs.append(F.when(bad, F.struct(F.lit("Typing").alias("type"), F.lit("InvalidCast").alias("code"), text.alias("message"), F.col("__position").alias("row"), F.lit(None).cast("int").alias("index"), F.lit(name).alias("column"))))
    return table.with_positions().select(F.explode(F.array_compact(F.array(*structs))).alias("e")).select("e.*")
