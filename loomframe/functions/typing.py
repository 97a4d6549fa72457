"""From text to typed values: declared types, per-column sniffing and JavaScript-like number prefixes.

All results are expressions; what cannot be read is null (nothing raises under ANSI mode).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What dynamic typing takes for a number; no plus sign, no thousands separators.
NUMBER = r"^-?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_INT_PREFIX = r"^\s*([+-]?\d+)"
TYPES = ("string", "number", "integer", "float", "boolean", "date", "currency", "percent")
#: Words that the boolean type takes, in any case.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def _found(c: Column, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast(kind)


def parse_float(c: Column) -> Column:
    """The number that the text begins with: 12abc is 12, abc is null."""
    return _found(c, _PREFIX, "double")


def parse_int(c: Column) -> Column:
    return _found(c, _INT_PREFIX, "bigint")


def parse_loose(c: Column) -> Column:
    """A whole text as number, without leading $, trailing % (not divided by 100) and commas."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[\s$€£]+", ""), r"[\s%]+$", ""), ",", "")
    return F.when(bare.rlike(NUMBER) | bare.rlike(r"^\+\d"), bare.try_cast("double"))


def _accounting(c: Column, drop: str) -> Column:
    """Without the signs in `drop`; (123) is -123."""
    return F.regexp_replace(F.regexp_replace(c, drop, ""), r"^\((.*)\)$", "-$1")


def coerce(c: Column, kind: str) -> Column:
    """Text as one of TYPES; null where it cannot be read."""
    if kind == "string":
        return c
    if kind in ("number", "float"):
        bare = _accounting(F.trim(c), "[$€£¥,]")
        value = parse_float(F.regexp_replace(bare, "%$", ""))
        return F.when(F.endswith(F.trim(c), F.lit("%")), value / 100).otherwise(value)
    if kind == "integer":
        return parse_int(F.regexp_replace(c, ",", ""))
    if kind == "boolean":
        word = F.lower(F.trim(c))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if kind == "date":
        # a date alone is midnight UTC, as in ISO 8601 for JavaScript
        return F.try_to_timestamp(c)
    if kind == "currency":
        return parse_float(_accounting(c, r"[$€£¥,\s]"))
    if kind == "percent":
        return parse_float(F.regexp_replace(F.regexp_replace(F.trim(c), "%$", ""), ",", "")) / 100
    raise ValueError(f"unknown type {kind!r}; known: {', '.join(TYPES)}")


def typed(c: Column, kind: str, nullable: bool = False, default: object = None) -> Column:
    """A declared field: null stays null if nullable, else becomes the default; unreadable text is null too."""
    value = coerce(c, kind)
    return value if nullable or default is None else F.when(c.isNull(), F.lit(default)).otherwise(value)


def type_error(c: Column, kind: str, nullable: bool = False, default: object = None) -> Column:
    """Whether a value breaks its declared field: unreadable, or null where that is not allowed."""
    unreadable = c.isNotNull() & coerce(c, kind).isNull()
    return unreadable if nullable or default is not None else unreadable | c.isNull()


def sniff(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """The type of each text column under dynamic typing: one pass over the table.

    A column is boolean (bigint, double) if every value that is not empty reads so, else it stays text:
    columns do not mix types.
    """
    names = [n for n in names if dict(df.dtypes)[n] == "string"]
    if not names:
        return {}
    made = []
    for k, name in enumerate(names):
        c = F.col(f"`{name}`")
        some = c.isNotNull() & (c != "")
        made += [F.count_if(some).alias(f"n{k}"), F.count_if(some & F.lower(c).isin("true", "false")).alias(f"b{k}"), F.count_if(some & c.rlike(NUMBER)).alias(f"f{k}"), F.count_if(some & c.rlike(r"^-?\d{1,15}$")).alias(f"i{k}")]
    row = df.agg(*made).head()
    out = {}
    for k, name in enumerate(names):
        n, b, f, i = (row[f"{x}{k}"] for x in "nbfi")
        out[name] = "string" if not n else "boolean" if b == n else "bigint" if i == n else "double" if f == n else "string"
    return out


def dynamic(df: DataFrame, names: Iterable[str], types: dict[str, str] | None = None) -> DataFrame:
    """`df` with dynamic typing on `names`; empty text becomes null in every text column."""
    types = sniff(df, names) if types is None else types
    made = {}
    for name, kind in df.dtypes:
        if kind == "string" and not name.startswith("__"):
            c = F.nullif(F.col(f"`{name}`"), F.lit(""))
            to = types.get(name, "string")
            made[name] = F.lower(c) == "true" if to == "boolean" else c.try_cast(to) if to != "string" else c
    return df.withColumns(made) if made else df


Cast = Callable[[Column], Column]


def cast_columns(df: DataFrame, cast: Cast | dict[str, Cast], names: list[str]) -> DataFrame:
    """User casts after typing: a function of a text column for all columns, or one for each name; nulls stay."""
    pick = {n: cast for n in names} if callable(cast) else {n: f for n, f in cast.items() if n in names}
    made = {n: F.when(F.col(f"`{n}`").isNotNull(), f(F.col(f"`{n}`").cast("string"))) for n, f in pick.items()}
    return df.withColumns(made) if made else df
