"""Rows one by one, in chunks, or as a stream of micro-batches."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from loomframe.functions.text import trim
from loomframe.operators.table import Table, col
from loomframe.plans.filters import compile_filter


class Handle:
    """What a callback gets to stop or hold the iteration."""

    def __init__(self) -> None:
        self.aborted = self.paused = False

    def abort(self) -> None:
        self.aborted = True

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False


def step(table: Table, call: Callable[[dict[str, Any], Handle], None], handle: Handle | None = None, start: int = 0) -> dict[str, Any]:
    """Call back for each row {data, errors, meta} until aborted; a pause ends the call.

    `start` is the `cursor` of the last row seen, to go on from there.  `errors` are those of the row, by its
    place in the table; both are read side by side in order, so neither is held whole.
    """
    handle = handle or Handle()
    n = start
    found = (r.asDict() for r in table.errors().where(F.col("row") >= start).orderBy("row").toLocalIterator())
    error = next(found, None)
    for row in islice(table.rows(), start, None):
        mine = []
        while error is not None and error["row"] <= n:
            mine += [error] if error["row"] == n else []
            error = next(found, None)
        n += 1
        call({"data": row, "errors": mine, "meta": {**table.meta, "cursor": n}}, handle)
        if handle.aborted or handle.paused:
            break
    return {"rows": n - start, "aborted": handle.aborted, "paused": handle.paused}


async def rows_async(table: Table) -> AsyncIterator[dict[str, Any]]:
    """Rows one by one; the event loop goes on while Spark works."""
    rows, end = table.rows(), object()
    while (row := await asyncio.to_thread(next, rows, end)) is not end:
        yield row


def chunked(table: Table, call: Callable[[list[dict[str, Any]], Handle], None], size: int = 1000, handle: Handle | None = None) -> dict[str, Any]:
    """Call back for each `size` rows; stops at chunk borders."""
    handle = handle or Handle()
    rows, n, chunks = table.rows(), 0, 0
    while not (handle.aborted or handle.paused):
        part = list(islice(rows, size))
        if not part:
            break
        n, chunks = n + len(part), chunks + 1
        call(part, handle)
    return {"rows": n, "chunks": chunks, "aborted": handle.aborted, "paused": handle.paused}


def batches(table: Table, size: int = 1000) -> Iterator[list[list[Any]]]:
    """Rows as lists, `size` at a time."""
    rows = table.arrays()
    while part := list(islice(rows, size)):
        yield part


def read_stream(spark: SparkSession, folder: str, columns: list[str], delimiter: str = ",", quote: str = '"', comment: str | None = None, has_header: bool = True, multi_line: bool = True, strip: bool = False, where: str | None = None, max_files: int | None = None) -> DataFrame:
    """A streaming DataFrame over the CSV files that arrive in a folder, with the stateless policies applied.

    Each file has its own header; `__file` names the file a row is from.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])
    reader = spark.readStream.schema(schema).options(header=str(has_header).lower(), sep=delimiter, quote=quote, escape=quote, comment=comment or "", multiLine=str(multi_line).lower(), nullValue="\x00", emptyValue="")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.csv(folder)
    if strip:
        df = df.withColumns({c: trim(col(c)) for c in columns})
    if where:
        df = df.where(compile_filter(df, where))
    return df.select("*", F.col("_metadata.file_path").alias("__file"))


def run_batches(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every micro-batch to `call`; a restart goes on from the checkpoint.  `once` stops when the folder is done."""
    writer = stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
