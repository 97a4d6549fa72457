"""The exact tokenizer over parts of files in parallel, one behaviour at every size.

Spark's text source deals lines to tasks, whatever is quoted.  A first pass counts the quotes of each
part; their running parity within a file tells which parts begin inside quotes.  With that, each part
is taken apart on its own; what a part begins or ends with of a record that goes over its border is a
fragment, and the few fragments (two a part at most) are put together afterwards.

Lines are split at LF here and at CR inside the tokenizer, so a file with CR alone is one line.  Bytes that
are no UTF-8 are replaced.  An unclosed quote takes the rest of its file, with a line end at its very end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.sources import strict

ORDER = [("__file", True), ("__block", True), ("__seq0", True), ("__k", True)]
_RECORD, _HEAD, _THROUGH, _TAIL = range(4)
_AT_ONCE = 4096


def scan(spark: SparkSession, path: str, names: list[str], delimiter: str, quote: str, comment: str | None, header: bool, keep_blank: bool) -> DataFrame:
    """Columns `names`, `__raw` (records of another width only), `__n_fields`, `__size` (bytes of the raw fields) and ORDER."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__seq0"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit(""))) if quote else F.lit(0)
    parts = text.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), quotes.alias("q")).groupBy("__file", "__block").agg(F.sum("q").alias("q"))
    # a row a part
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("__file", "__block", "q", F.coalesce(F.sum("q").over(before), F.lit(0)).alias("before"))
    starts = sums.select("__file", "__block", (F.col("before") % 2 == 1).alias("inside"), ((F.col("before") + F.col("q")) % 2 == 1).alias("open"))
    told = lines.join(F.broadcast(starts), ["__file", "__block"])
    width = len(names)
    schema = f"{', '.join(f'v{k} string' for k in range(width))}, raw string, n int, size bigint, __file string, __block bigint, __seq0 bigint, __k bigint, kind int, lead boolean"
    columns = [*(f"v{k}" for k in range(width)), "raw", "n", "size", "__file", "__block", "__seq0", "__k", "kind", "lead"]

    def split(content: str) -> Iterator[list[str]]:
        for record in strict.records(content, delimiter, quote):
            if (record != [""] or keep_blank) and not (comment and record[0].startswith(comment)):
                yield record

    def row(record: list[str], where: tuple, k: int) -> list[Any]:
        values = [strict.field(f, quote) for f in record]
        wrong = delimiter.join(record) if len(record) != width else None
        return [*(values + [None] * width)[:width], wrong, len(record), sum(len(f.encode()) for f in record), *where, k, _RECORD, False]

    def batch(rows: list[list[Any]]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * (width + 1), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], columns)

    def parts_of(fragments: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[list[Any]] = []
            part, pending, inside, begun, todo, seq = None, [], False, False, False, 0

            def close() -> None:
                if part is not None and pending:
                    kind = _THROUGH if begun and inside else _HEAD if begun else _TAIL
                    rows.append([*[None] * width, "\n".join(pending), 0, 0, *part, seq, 0, kind, todo])
                    pending.clear()

            for given in batches:
                for line, file, block, number, starts_inside in zip(*(given.column(c).to_pylist() for c in ("line", "__file", "__block", "__seq0", "inside")), strict=True):
                    if (file, block) != part:
                        close()
                        part, inside, begun, todo = (file, block), starts_inside, starts_inside, header and block == 0
                    content = line.decode("utf-8", "replace")
                    if block == 0 and not pending and content.startswith("﻿"):
                        content = content[1:]
                    pending.append(content)
                    seq = number
                    if quote and content.count(quote) % 2:
                        inside = not inside
                    if inside:
                        continue
                    if begun:  # the end of a record of an earlier part
                        begun = False
                        rows.append([*[None] * width, "\n".join(pending), 0, 0, *part, seq, 0, _HEAD, False])
                    elif not fragments or todo:
                        for k, record in enumerate(split("\n".join(pending) + "\n")):
                            if todo:
                                todo = False
                            elif not fragments:
                                rows.append(row(record, (*part, seq), k))
                    pending.clear()
                    if len(rows) >= _AT_ONCE:
                        yield batch([r for r in rows if (r[-2] != _RECORD) == fragments])
                        rows.clear()
            close()
            if rows:
                yield batch([r for r in rows if (r[-2] != _RECORD) == fragments])

        return run

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows = []
            for raw, *where, lead in zip(*(given.column(c).to_pylist() for c in ("raw", "__file", "__block", "__seq0", "lead")), strict=True):
                for k, record in enumerate(split(raw + "\n")):
                    if k or not lead:
                        rows.append(row(record, tuple(where), k))
            if rows:
                yield batch(rows)

    whole = told.mapInArrow(parts_of(False), schema)
    # only parts that a record goes into or out of have any
    pieces = told.where("inside or open").mapInArrow(parts_of(True), schema).select("raw", "__file", "__block", "__seq0", "kind", "lead")
    # each tail begins a record that the pieces after it go on with
    along = Window.partitionBy("__file").orderBy("__block", "kind")
    chained = pieces.withColumn("chain", F.sum(F.when(F.col("kind") == _TAIL, 1).otherwise(0)).over(along))
    put = chained.groupBy("__file", "chain").agg(F.array_sort(F.collect_list(F.struct("__block", "kind", "raw"))).alias("all"), F.min(F.struct("__block", "__seq0", "lead")).alias("first"))
    stitched = put.select(F.expr("array_join(transform(all, x -> x.raw), '\n')").alias("raw"), "__file", "first.*").mapInArrow(joined, schema)
    out = whole.unionByName(stitched)
    return out.select(*[F.col(f"v{k}").alias(n) for k, n in enumerate(names)], F.col("raw").alias("__raw"), F.col("n").alias("__n_fields"), F.col("size").alias("__size"), *[c for c, _ in ORDER])
