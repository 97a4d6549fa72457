"""Nested structs to flat columns with dotted names, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomframe.operators.table import Table, col


def _leaves(schema: StructType, path: Column | None, name: str, separator: str) -> list[Column]:
    out = []
    for field in schema.fields:
        at = col(field.name) if path is None else path.getField(field.name)
        full = f"{name}{separator}{field.name}" if name else field.name
        if isinstance(field.dataType, StructType):
            out += _leaves(field.dataType, at, full, separator)
        else:
            out.append(at.alias(full))
    return out


def flatten_df(df: DataFrame, separator: str = ".") -> DataFrame:
    """Every leaf of every struct as a column; arrays and maps are leaves, empty structs vanish."""
    return df.select(*_leaves(df.schema, None, "", separator))


def flatten(table: Table, separator: str = ".") -> Table:
    shown = table._df.select(*map(col, table.columns)).schema
    return table._with(table._df.select(*_leaves(shown, None, "", separator), *map(col, table.hidden)))


def unflatten(table: Table, separator: str = ".") -> Table:
    """Columns `a.b` and `a.c` become a struct `a` with fields b and c."""
    tree: dict = {}
    for name in table.columns:
        at, parts = tree, name.split(separator)
        for part in parts[:-1]:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name!r} is both a value and a parent")
        if isinstance(at.get(parts[-1]), dict):
            raise ValueError(f"{name!r} is both a value and a parent")
        at[parts[-1]] = name

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else col(v)).alias(k) for k, v in node.items()]

    return table._with(table._df.select(*build(tree), *map(col, table.hidden)))
