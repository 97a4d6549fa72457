"""A Spark-native toolkit for delimited text, ordered tables and training corpora.

Names are loaded when they are first used, so that Python workers import only what they run.
"""

from __future__ import annotations

import importlib

_HOME = {
    "Table": "operators.table", "GroupedTable": "operators.table", "EditLog": "operators.edits", "flatten": "operators.nested", "unflatten": "operators.nested", "profile": "operators.profile", "validate": "operators.profile",
    "ReadOptions": "sources.reader", "read_csv": "sources.reader", "typed_table": "sources.reader", "typing_errors": "sources.reader", "CSVWriter": "sources.sinks", "convert": "sources.sinks", "unparse": "sources.sinks",
}
__all__ = [*_HOME]


def __getattr__(name: str) -> object:
    if name not in _HOME:
        raise AttributeError(name)
    found = importlib.import_module(f"{__name__}.{_HOME[name]}")
    return found if name == _HOME[name] else getattr(found, name)
