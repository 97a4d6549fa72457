"""Relational operators over ordered tables."""

from loomframe.operators.table import GroupedTable, Table

__all__ = ["GroupedTable", "Table"]
