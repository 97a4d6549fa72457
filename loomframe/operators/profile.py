"""Column profiles and validation: each one aggregation over the table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.functions.typing import parse_float
from loomframe.operators.table import Table, col

PROFILE = "column string, count bigint, null_count bigint, unique_count bigint, type string, min string, max string, mean double"


def profile(table: Table, approximate: bool = False) -> DataFrame:
    """A row for each column: count, null_count (null or empty), unique_count, type, min, max, mean.

    A column is `number` if every value that is not empty begins with a number, else `categorical` with
    at most 10 distinct values in more than 100 rows, else `string`.  Distinct values are grouped as
    (column, value) rows, combined before their shuffle; `approximate` counts them by a sketch instead,
    which spares that shuffle on very large tables.
    """
    df, names = table.to_df(), table.columns
    made = []
    for k, name in enumerate(names):
        text = F.nullif(col(name).cast("string"), F.lit(""))
        number = parse_float(text)
        made += [F.count(text).alias(f"some{k}"), *([F.approx_count_distinct(text).alias(f"unique{k}")] if approximate else []), F.count(number).alias(f"number{k}"), F.min(number).alias(f"low{k}"), F.max(number).alias(f"high{k}"), F.avg(number).alias(f"mean{k}"), F.min(text).alias(f"least{k}"), F.max(text).alias(f"most{k}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *made)
    if not approximate:
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.nullif(col(n).cast("string"), F.lit("")).alias("v")) for k, n in enumerate(names)])
        values = df.select(F.explode(cells).alias("c")).select("c.*").where("v is not null").groupBy("k", "v").agg(F.lit(1).alias("one"))
        counts = values.groupBy("k").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("unique"))  # a row of one number a column
        one = one.crossJoin(F.broadcast(counts)).select("*", *[F.coalesce(F.try_element_at("unique", F.lit(k)), F.lit(0)).alias(f"unique{k}") for k in range(len(names))])
    rows = []
    for k, name in enumerate(names):
        numeric = (F.col(f"some{k}") > 0) & (F.col(f"number{k}") == F.col(f"some{k}"))
        grouped = (F.col(f"unique{k}") <= 10) & (F.col("n") > 100)
        kind = F.when(numeric, "number").when(grouped, "categorical").otherwise("string")
        show = lambda low, least: F.when(numeric, F.col(low).cast("string")).when(~grouped, F.col(least))
        fields = {"column": F.lit(name), "count": F.col("n"), "null_count": F.col("n") - F.col(f"some{k}"), "unique_count": F.col(f"unique{k}"), "type": kind, "min": show(f"low{k}", f"least{k}"), "max": show(f"high{k}", f"most{k}"), "mean": F.when(numeric, F.col(f"mean{k}"))}
        rows.append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validate(table: Table, most: int = 10) -> dict[str, Any]:
    """Rows, columns, and the first problems the reader met."""
    errors = table.errors()
    n_errors = errors.count()
    return {"valid": n_errors == 0, "rows": table.count(), "columns": len(table.columns), "headers": table.columns, "n_errors": n_errors, "errors": [r.asDict() for r in errors.orderBy("row").limit(most).collect()]}
