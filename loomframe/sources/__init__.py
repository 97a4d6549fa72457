"""Reading and writing delimited text."""

from loomframe.sources.reader import ReadOptions, read_csv

__all__ = ["ReadOptions", "read_csv"]
