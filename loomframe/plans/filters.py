"""The filter language: a text becomes a Column, without evaluating any code.

One comparison (`age > 30`, `city = New York`, `name contains "li"`, `sku matches ^A`):
equality is on text and a null equals nothing; `!=` keeps nulls; `> >= < <=` read the number that a
cell begins with; word operators see null as empty text.  Values may be bare or quoted.

Compound expressions (`&& || !`, `and or not`, parentheses) compare more freely: against a number a
cell counts as a number, two texts are compared as texts.  Names may be in backticks; unknown names
are an error.  Numeric columns are compared as numbers throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from loomframe.functions.typing import NUMBER, parse_float

_NAME = r"(?:`(?P<tick>[^`]+)`|(?P<name>\w+))"
_VALUE = r"""(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^"'&|()]+?))"""
_ONE = re.compile(rf"^\s*{_NAME}\s*(?P<op>===?|!==?|>=|<=|=|>|<)\s*{_VALUE}\s*$")
_WORDS = re.compile(rf"^\s*{_NAME}\s+(?P<op>contains|startsWith|endsWith|matches)\s+{_VALUE}\s*$", re.I)
_MATCHES = re.compile(rf"^\s*{_NAME}\s+matches\s+(?:/(?P<slash>.*)/|(?P<rest>.+?))\s*$", re.I)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|`(?P<tick>[^`]+)`|(?P<name>\w+)|(?P<sign>===|!==|==|!=|>=|<=|&&|\|\||[=<>!()-]))""")
_REL = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


class FilterError(ValueError):
    """A filter text that cannot be understood."""


class _Operand:
    def __init__(self, column: Column, kind: str, text: str | None = None):
        self.column, self.kind, self.text = column, kind, text  # kind: cell, num (column), flag, number, string, bool


class _Compiler:
    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema if not f.name.startswith("__")}

    def cell(self, name: str) -> _Operand:
        if name not in self.types:
            raise FilterError(f"unknown column {name!r}; columns: {', '.join(self.types)}")
        kind = self.types[name]
        return _Operand(F.col(f"`{name}`"), "num" if isinstance(kind, NumericType) else "flag" if isinstance(kind, BooleanType) else "cell")

    # one comparison
    def single(self, text: str) -> Column | None:
        if m := _WORDS.match(text):
            if m["op"].lower() != "matches":
                value = F.lit(next(v for v in (m["dq"], m["sq"], m["bare"]) if v is not None))
                shown = F.coalesce(self.cell(m["tick"] or m["name"]).column.cast("string"), F.lit(""))
                return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[m["op"].lower()](shown, value)
        if m := _MATCHES.match(text):
            pattern = m["slash"] if m["slash"] is not None else m["rest"]
            if len(pattern) > 1 and pattern[0] == pattern[-1] and pattern[0] in "\"'":
                pattern = pattern[1:-1]
            return F.coalesce(self.cell(m["tick"] or m["name"]).column.cast("string"), F.lit("")).rlike(pattern)
        m = _ONE.match(text)
        if not m:
            return None
        value = next(v for v in (m["dq"], m["sq"], m["bare"]) if v is not None)
        cell = self.cell(m["tick"] or m["name"])
        op = m["op"]
        if op in _REL:
            try:
                goal = float(value)
            except ValueError:
                raise FilterError(f"{op} needs a number, not {value!r}") from None
            number = cell.column.cast("double") if cell.kind == "num" else parse_float(cell.column.cast("string"))
            return F.coalesce(getattr(number, _REL[op])(F.lit(goal)), F.lit(False))
        if cell.kind == "num":
            number = F.lit(value).try_cast("double")
            same = F.coalesce(cell.column.cast("double") == number, F.lit(False))
        else:
            same = F.coalesce(cell.column.cast("string") == F.lit(value), F.lit(False))
        return ~same if op.startswith("!") else same

    # compound expressions
    def compound(self, text: str) -> Column:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise FilterError(f"cannot read {text[at:]!r}")
            kind = m.lastgroup or ""
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0
        out = self.either()
        if self.at < len(self.tokens):
            raise FilterError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        kind, value = self.peek()
        if kind in ("sign", "name") and (value in values or (kind == "name" and value.lower() in values and value.lower() in ("and", "or", "not"))):
            self.at += 1
            return True
        return False

    def either(self) -> Column:
        out = self.both()
        while self.take("||", "or"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.denied()
        while self.take("&&", "and"):
            out = out & self.denied()
        return out

    def denied(self) -> Column:
        if self.take("!", "not"):
            return ~self.denied()
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise FilterError("a parenthesis is not closed")
            return out
        return self.comparison()

    def operand(self) -> _Operand:
        minus = self.take("-")
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            number = -float(value) if minus else float(value)
            return _Operand(F.lit(number), "number", value)
        if minus:
            raise FilterError("a minus sign needs a number")
        if kind in ("dq", "sq"):
            return _Operand(F.lit(value), "string", value)
        if kind == "name" and value in ("true", "false"):
            return _Operand(F.lit(value == "true"), "bool", value)
        if kind == "name" and value in ("null", "undefined"):
            return _Operand(F.lit(None).cast("string"), "null", value)
        if kind in ("name", "tick"):
            return self.cell(value)
        raise FilterError(f"unexpected {value or 'end'!r}")

    def comparison(self) -> Column:
        left = self.operand()
        kind, op = self.peek()
        if kind == "name" and op.lower() in ("contains", "startswith", "endswith", "matches"):
            self.at += 1
            right = self.operand()
            shown = F.coalesce(left.column.cast("string"), F.lit(""))
            if op.lower() == "matches":
                return shown.rlike(right.text or "")
            return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op.lower()](shown, right.column.cast("string"))
        if kind != "sign" or op not in ("=", "==", "===", "!=", "!==", *_REL):
            return self.truth(left)
        self.at += 1
        right = self.operand()
        if op in _REL:
            a, b = (_text(x) for x in (left, right)) if _texts(left, right) else (_number(x, True) for x in (left, right))
            return F.coalesce(getattr(a, _REL[op])(b), F.lit(False))
        if "null" in (left.kind, right.kind):
            other = right if left.kind == "null" else left
            same = other.column.isNull()
        elif _texts(left, right):
            same = left.column.cast("string").eqNullSafe(right.column.cast("string"))
        else:
            same = F.coalesce(_number(left, False) == _number(right, False), F.lit(False))
        return ~same if op.startswith("!") else same

    @staticmethod
    def truth(x: _Operand) -> Column:
        if x.kind in ("num", "number"):
            return F.coalesce((x.column != 0) & ~F.isnan(x.column.cast("double")), F.lit(False))
        if x.kind in ("flag", "bool"):
            return F.coalesce(x.column, F.lit(False))
        return F.coalesce(x.column != "", F.lit(False))


def _texts(a: _Operand, b: _Operand) -> bool:
    return {a.kind, b.kind} <= {"cell", "string"}


def _text(x: _Operand) -> Column:
    return x.column.cast("string")


def _number(x: _Operand, null_is_zero: bool) -> Column:
    """As a number: empty text is 0, other text that is no number is null (and compares false)."""
    if x.kind in ("num", "number", "flag", "bool"):
        out = x.column.cast("double")
    else:
        bare = F.trim(x.column.cast("string"))
        out = F.when(bare == "", 0.0).when(bare.rlike(NUMBER) | bare.rlike(r"^\+(\d|\.\d)"), bare.try_cast("double"))
    return F.when(x.column.isNull(), F.lit(0.0)).otherwise(out) if null_is_zero else out


def compile_filter(df: DataFrame, text: str) -> Column:
    compiler = _Compiler(df)
    one = compiler.single(text)
    return compiler.compound(text) if one is None else one
