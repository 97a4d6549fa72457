"""Positional edits as an overlay: the table stays as it is, the changes are applied in one plan.

The log is what a user typed, so it is small and is sent to every task as literals; the table is read
once to number its rows.  An insertion at p stands at output position p (at the end beyond that).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import functions as F

from loomframe.operators.table import POSITION, Table, col


class EditLog:
    """Cell edits, deleted rows and inserted rows over one table."""

    def __init__(self, table: Table):
        self.table = table
        self.cells: dict[tuple[int, str], str] = {}
        self.deleted: set[int] = set()
        self.inserted: dict[int, list[str | None]] = {}

    def set_cell(self, row: int, column: str | int, value: Any) -> None:
        name = self.table.columns[column] if isinstance(column, int) else column
        if name not in self.table.columns:
            raise KeyError(f"unknown column {name!r}")
        self.cells[row, name] = value

    def delete_row(self, row: int) -> None:
        self.deleted.add(row)

    def insert_row(self, position: int, values: Sequence[str | None] | dict[str, Any]) -> None:
        if isinstance(values, dict):
            values = [values.get(c) for c in self.table.columns]
        self.inserted[position] = list(values)

    def get_cell(self, row: int, column: str | int) -> Any:
        """The edited value, None in a deleted row, else what the table holds."""
        name = self.table.columns[column] if isinstance(column, int) else column
        if (row, name) in self.cells:
            return self.cells[row, name]
        found = None if row in self.deleted else self.table.at(row)
        return None if found is None else found[name]

    def is_deleted(self, row: int) -> bool:
        return row in self.deleted

    @property
    def modification_count(self) -> int:
        return len(self.cells) + len(self.deleted) + len(self.inserted)

    @property
    def has_unsaved_changes(self) -> bool:
        return self.modification_count > 0

    def discard(self) -> None:
        self.cells.clear(), self.deleted.clear(), self.inserted.clear()

    def apply(self) -> Table:
        """The table with all changes."""
        t, df = self.table, self.table.with_positions()
        spark = df.sparkSession
        if self.cells:
            by_column: dict[str, list[tuple[int, Any]]] = {}
            for (row, name), value in self.cells.items():
                by_column.setdefault(name, []).append((row, value))
            for name, pairs in by_column.items():
                kind = dict(df.dtypes)[name]
                lookup = F.create_map(*[x for row, value in pairs for x in (F.lit(row).cast("bigint"), F.lit(value).cast(kind))])
                df = df.withColumn(name, F.when(F.col(POSITION).isin([row for row, _ in pairs]), F.try_element_at(lookup, F.col(POSITION))).otherwise(col(name)))
        position = F.col(POSITION)
        if self.deleted:
            gone = sorted(self.deleted)
            df = df.where(~F.col(POSITION).isin(gone))
            position = position - F.size(F.filter(F.array(*map(F.lit, gone)), lambda d: d < F.col(POSITION)))
        df = df.withColumn("__p", position.cast("bigint"))
        df = df.select(*map(col, t.columns), "__p")
        if self.inserted:
            spots = sorted(self.inserted)
            before = F.array(*[F.lit(p - k) for k, p in enumerate(spots)])
            df = df.withColumn("__p", F.col("__p") + F.size(F.filter(before, lambda x: x <= F.col("__p"))))
            schema = df.schema
            rows = [(*[v if k < len(self.inserted[p]) else None for k, v in enumerate((self.inserted[p] + [None] * len(t.columns))[: len(t.columns)])], p) for p in spots]
            new = spark.createDataFrame([tuple("" if v is None and schema[k].dataType.simpleString() == "string" else v for k, v in enumerate(r)) for r in rows], schema)
            df = df.unionByName(new)
        return Table(df, [("__p", True)])

    def save(self, path: str, **options: Any) -> None:
        """Write the changed table as one file, by way of a temporary one, and clear the log."""
        from loomframe.sources.sinks import write_file

        write_file(self.apply(), path, **options)
        self.discard()
