"""Trimming, and the writing side: how a value becomes a field of a delimited line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType, NumericType, TimestampNTZType, TimestampType

#: White space as JavaScript's trim() sees it.
_BLANK = r"[\s   -     　﻿\x0b]"
#: A cell that begins with one of these may be run as a formula.
FORMULA = r"^[=+\-@\t\r]"


def trim(c: Column, left: bool = True, right: bool = True) -> Column:
    for wanted, pattern in ((left, rf"^{_BLANK}+"), (right, rf"{_BLANK}+$")):
        if wanted:
            c = F.regexp_replace(c, pattern, "")
    return c


def blank(c: Column, greedy: bool) -> Column:
    return c.isNull() | ((trim(c) if greedy else c) == "")


def escape_formula(c: Column, pattern: str = FORMULA) -> Column:
    return F.when(c.rlike(pattern), F.concat(F.lit("'"), c)).otherwise(c)


def serialize(c: Column, kind: DataType) -> Column:
    """A value as text: null is empty, times are ISO in UTC, whole doubles have no fraction."""
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(kind, DateType):
        out = F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    elif isinstance(kind, (DoubleType, FloatType)):
        whole = (F.abs(c) < 1e15) & (c == F.floor(c))
        out = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def quote_field(text: Column, delimiter: str = ",", quote: str = '"', escape: str | None = None, force: bool = False, spaces: bool = True) -> Column:
    """Quoted where it has to be: delimiter, quote, line ends and (with `spaces`) blanks at an end."""
    escaped = F.replace(text, F.lit(quote), F.lit((escape or quote) + quote))
    made = F.concat(F.lit(quote), escaped, F.lit(quote))
    if force:
        return made
    need = F.contains(text, F.lit(delimiter)) | F.contains(text, F.lit(quote)) | text.rlike(r"[\n\r]")
    if spaces:
        need = need | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    return F.when(need, made).otherwise(text)


def tsv_field(text: Column) -> Column:
    for sign, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(shown))
    return text


def is_number(kind: DataType) -> bool:
    return isinstance(kind, NumericType)
