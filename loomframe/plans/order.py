"""Row order without a single-partition window.

A table's order is a list of hidden sort columns.  Dense positions are made only when an operator needs
them: the rows are range-sorted and written once, each partition is counted, and a row's position is
its place in the partition plus the rows of the partitions before it (a map over a small table, one row a partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import cut

Order = list[tuple[str, bool]]
_PID, _SEQ = "__pid", "__seq"


def sort_columns(order: Order) -> list[Column]:
    """Nulls come first in ascending order and last in descending order."""
    return [F.col(f"`{n}`").asc_nulls_first() if up else F.col(f"`{n}`").desc_nulls_last() for n, up in order]


def _placed(marked: DataFrame, name: str) -> DataFrame:
    counts = {r[_PID]: r["count"] for r in marked.groupBy(_PID).count().collect()}  # one row a partition
    total, made = 0, []
    for pid in sorted(counts):
        made.append((pid, total))
        total += counts[pid]
    starts = marked.sparkSession.createDataFrame(made, f"{_PID} int, __start bigint")
    at = (F.col(_SEQ) - F.shiftleft(F.col(_PID).cast("bigint"), 33) + F.col("__start")).cast("bigint")
    return marked.join(F.broadcast(starts), _PID).withColumn(name, at).drop(_PID, _SEQ, "__start")


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumn(_PID, F.spark_partition_id()).withColumn(_SEQ, F.monotonically_increasing_id())


def scan_positions(df: DataFrame, name: str) -> DataFrame:
    """Dense positions of a scan of one file, whose partitions are in file order: a map-only plan.

    The scan is read once more to count; both reads must see the same splits.
    """
    marked = _marked(df)
    return _placed(marked, name)


def positions(df: DataFrame, order: Order, name: str) -> DataFrame:
    """`df` with its dense position (from 0) under `order`; written once to the shared folder."""
    marked = cut(_marked(df.orderBy(*sort_columns(order))))
    return _placed(marked, name)


def median(df: DataFrame, value: Column) -> float | None:
    """The exact median of a column: values with their counts in range order, and the totals of the partitions tell which holds the middle."""
    counts = cut(df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").count().orderBy("v").withColumn(_PID, F.spark_partition_id()))
    totals = sorted((r[_PID], r["n"]) for r in counts.groupBy(_PID).agg(F.sum("count").alias("n")).collect())  # one row a partition
    n = sum(k for _, k in totals)
    if not n:
        return None
    picked = []
    for rank in sorted({(n - 1) // 2, n // 2}):
        before = 0
        for pid, k in totals:
            if rank < before + k:
                break
            before += k
        here = counts.where(F.col(_PID) == pid).withColumn("upto", F.sum("count").over(Window.partitionBy(_PID).orderBy("v")))
        picked.append(here.where(F.col("upto") > rank - before).agg(F.min("v")).head()[0])
    return sum(picked) / len(picked)
