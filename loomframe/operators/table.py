"""Ordered tables on top of Spark DataFrames.

A Table is a DataFrame with hidden columns (names that begin with `__`) that hold its row order.
Everything is a lazy plan; only `collect`, `count`, `at`, `head`, positions and exports run jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NumericType, StringType, StructType

from loomframe.functions.typing import parse_loose
from loomframe.plans.filters import compile_filter
from loomframe.plans.order import Order, median, positions, sort_columns

POSITION = "__position"
#: The reader's column of fields beyond the header; hidden until it is asked for.
EXTRA = "__parsed_extra"
AGGREGATES = ("count", "sum", "min", "max", "mean", "median", "stddev", "first", "last", "concat")
JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "cross": "cross"}


def col(name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


class Table:
    """A DataFrame with a row order."""

    def __init__(self, df: DataFrame, order: Order = (), errors: Callable[[], DataFrame] | None = None, meta: dict[str, Any] | None = None):
        self._df, self._order, self._errors, self.meta = df, list(order), errors, dict(meta or {})

    @classmethod
    def from_df(cls, df: DataFrame, order_by: str | Sequence[str] = ()) -> Table:
        """A table over a DataFrame; `order_by` names the columns that say where a row stands."""
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        return cls(df.withColumns({f"__o{k}": col(n) for k, n in enumerate(names)}) if names else df, [(f"__o{k}", True) for k in range(len(names))])

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[dict[str, Any]], schema: StructType | str | None = None) -> Table:
        """A small table of given rows, in their order; columns are the keys of the first row."""
        if schema is None and not rows:
            return cls(spark.createDataFrame([], StructType([])))
        if schema is None:
            names = list(rows[0])
            probe = spark.createDataFrame([Row(*[r.get(n) for n in names]) for r in rows], names).schema
        else:
            probe = spark.createDataFrame([], schema).schema
        full = StructType([*probe.fields]).add("__o0", LongType(), False)
        data = [(*[r.get(f.name) for f in probe], k) for k, r in enumerate(rows)]
        return cls(spark.createDataFrame(data, full), [("__o0", True)])

    # what there is
    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if not c.startswith("__") or (c == EXTRA and self.meta.get("extra"))]

    @property
    def hidden(self) -> list[str]:
        shown = set(self.columns)
        return [c for c in self._df.columns if c not in shown]

    def with_parsed_extra(self) -> Table:
        """The table with the reader's `__parsed_extra` shown: the fields beyond the header, null where there are none."""
        df = self._df if EXTRA in self._df.columns else self._df.withColumn(EXTRA, F.lit(None).cast("array<string>"))
        return Table(df, self._order, self._errors, {**self.meta, "extra": True})

    def to_df(self) -> DataFrame:
        """The visible columns, in no promised order."""
        return self._df.select(*map(col, self.columns))

    def ordered_df(self) -> DataFrame:
        """The visible columns in row order (a range-partitioned sort)."""
        df = self._df.orderBy(*sort_columns(self._order)) if self._order else self._df
        return df.select(*map(col, self.columns))

    def errors(self) -> DataFrame:
        """What the reader found wrong: type, code, message, row, index, column."""
        from loomframe.sources.errors import no_errors

        return self._errors() if self._errors else no_errors(self._df.sparkSession)

    def _with(self, df: DataFrame, order: Order | None = None) -> Table:
        return Table(df, self._order if order is None else order, self._errors, self.meta)

    # projections and filters
    def select(self, *names: str | int, lenient: bool = False) -> Table:
        """Columns by name or place, in the given order; with `lenient` an unknown one is null."""
        out = []
        for name in names:
            if isinstance(name, int):
                name = self.columns[name]
            if name not in self.columns and not lenient:
                raise KeyError(f"unknown column {name!r}; columns: {', '.join(self.columns)}")
            out.append(col(name) if name in self.columns else F.lit(None).cast("string").alias(name))
        return self._with(self._df.select(*out, *map(col, self.hidden)))

    def filter(self, condition: str | Column) -> Table:
        """Rows for which a Column or a text of the filter language is true."""
        return self._with(self._df.where(compile_filter(self._df, condition) if isinstance(condition, str) else condition))

    def filter_index(self, test: Callable[[Column], Column]) -> Table:
        """Rows whose position (from 0) passes `test`, a function from Column to Column."""
        return self._with(self.with_positions().where(test(F.col(POSITION))).drop(POSITION))

    def filter_rows(self, test: Callable[[dict[str, Any]], Any]) -> Table:
        """Rows for which a Python function is true; runs in Arrow batches, use `filter` where it can be a Column."""
        names = self.columns

        def run(parts: Iterator[Any]) -> Iterator[Any]:
            for part in parts:
                yield part[[bool(test(r)) for r in part[names].to_dict("records")]]

        return self._with(self._df.mapInPandas(run, self._df.schema))

    def map(self, columns: dict[str, Column]) -> Table:
        """A new row of expressions for each row."""
        return self._with(self._df.select(*[c.alias(n) for n, c in columns.items()], *map(col, self.hidden)))

    def with_columns(self, columns: dict[str, Column]) -> Table:
        return self._with(self._df.withColumns(columns))

    def map_rows(self, make: Callable[[dict[str, Any]], dict[str, Any] | None], schema: StructType | str) -> Table:
        """A new row of a Python function for each row (None drops it), in Arrow batches."""
        import pandas as pd

        names, hidden = self.columns, self.hidden
        shape = self._df.sparkSession.createDataFrame([], schema).schema
        full = StructType([*shape.fields, *[f for f in self._df.schema if f.name in hidden]])

        def run(parts: Iterator[Any]) -> Iterator[Any]:
            for part in parts:
                made = [make(r) for r in part[names].astype(object).where(part[names].notna(), None).to_dict("records")]
                keep = [k for k, r in enumerate(made) if r is not None]
                out = pd.DataFrame({n: pd.Series([made[k].get(n) for k in keep], dtype=object) for n in shape.names})
                for n in hidden:
                    out[n] = part[n].iloc[keep].to_numpy()
                yield out

        return self._with(self._df.mapInPandas(run, full))

    def drop_column(self, *names: str) -> Table:
        return self._with(self._df.drop(*names))

    # order
    def sort(self, name: str, descending: bool = False, numeric: bool = False) -> Table:
        """A stable sort by one column (nulls lowest); with `numeric`, texts are compared by their number."""
        key = f"__s{len(self._order)}"
        value = parse_loose(col(name).cast("string")) if numeric else col(name)
        return self._with(self._df.withColumn(key, value), [(key, not descending), *self._order])

    def with_positions(self) -> DataFrame:
        """All columns, hidden ones too, plus the dense position under the table's order."""
        if not self._order:
            raise ValueError("this table has no row order: give order_by")
        return positions(self._df, self._order, POSITION)

    def first(self, n: int = 1) -> Table:
        return self._with(self._df.orderBy(*sort_columns(self._order)).limit(n) if self._order else self._df.limit(n))

    def last(self, n: int = 1) -> Table:
        if not self._order:
            raise ValueError("this table has no row order: give order_by")
        back = [(F.col(f"`{name}`").desc_nulls_last() if up else F.col(f"`{name}`").asc_nulls_first()) for name, up in self._order]
        return self._with(self._df.orderBy(*back).limit(n))

    def at(self, i: int) -> Row | None:
        """The row at a position, None beyond the end."""
        found = [] if i < 0 else self.first(i + 1).last(1)._df.select(*map(col, self.columns)).collect() if i < 10_000 else self._with(self.with_positions().where(F.col(POSITION) == i)).to_df().head(1)
        return found[0] if found and (i >= 10_000 or self.count() > i) else None

    # results
    def count(self) -> int:
        return self._df.count()

    def collect(self) -> list[Row]:
        return self.ordered_df().collect()

    def rows(self) -> Iterator[dict[str, Any]]:
        """Rows one by one in order; the driver holds two partitions at most."""
        for row in self.ordered_df().toLocalIterator(prefetchPartitions=True):
            yield row.asDict()

    def arrays(self) -> Iterator[list[Any]]:
        for row in self.ordered_df().toLocalIterator(prefetchPartitions=True):
            yield list(row)

    def to_arrow(self) -> Any:
        return self.ordered_df().toArrow()

    # groups and joins
    def group_by(self, name: str) -> GroupedTable:
        if name not in self.columns:
            raise KeyError(f"unknown column {name!r}")
        return GroupedTable(self, name)

    def aggregate(self, specs: dict[str, tuple[str, str]], loose: bool = False) -> DataFrame:
        """One row over the whole table: {output: (column, function)}; `loose` reads texts as numbers.

        A median is found here and now, by range order: the others are one lazy aggregation.
        """
        made = []
        for out, (c, fn) in specs.items():
            if fn == "median":
                _aggregate(self, c, fn, False, loose)  # for its checks
                value = parse_loose(col(c)) if isinstance(self._df.schema[c].dataType, StringType) else col(c)
                made.append(F.lit(median(self._df, value) or 0.0).cast("double").alias(out))
            else:
                made.append(_aggregate(self, c, fn, False, loose).alias(out))
        return self._df.agg(*made) if any(fn != "median" for _, fn in specs.values()) else self._df.sparkSession.range(1).select(*made)

    def join(self, other: Table, on: str | tuple[str, str] | None = None, how: str = "inner") -> Table:
        """One-key join; null keys match each other, a column that both have comes from the right where it matched.

        Rows keep the left order, unmatched right rows follow in theirs.  Catalyst picks the strategy.
        """
        if how not in JOINS:
            raise ValueError(f"unknown join {how!r}; known: {', '.join(JOINS)}")
        rename = {c: f"__r{c}" if c.startswith("__") else f"__right_{c}" for c in other._df.columns}
        right = other._df.select(*[col(c).alias(n) for c, n in rename.items()], F.lit(True).alias("__right"))
        left = self._df.withColumn("__left", F.lit(True))
        if JOINS[how] == "cross":
            joined = left.crossJoin(right)
        else:
            if on is None:
                raise ValueError("a join needs `on`")
            mine, theirs = (on, on) if isinstance(on, str) else on
            a, b = (dict(t._df.dtypes)[n] for t, n in ((self, mine), (other, theirs)))
            if a != b:
                raise TypeError(f"join keys differ in type: {a} and {b}; cast one of them")
            joined = left.join(right, col(mine).eqNullSafe(col(rename[theirs])), JOINS[how])
        shown = [F.when(F.col("__right"), col(rename[c])).otherwise(col(c)).alias(c) if c in other.columns else col(c) for c in self.columns]
        shown += [col(rename[c]).alias(c) for c in other.columns if c not in self.columns]
        # unmatched right rows come last: order first by whether there is a left row
        keys = {"__j": F.col("__left").isNull(), **{f"__jl{k}": col(n) for k, (n, _) in enumerate(self._order)}, **{f"__jr{k}": col(rename[n]) for k, (n, _) in enumerate(other._order)}}
        order = [("__j", True), *[(f"__jl{k}", up) for k, (_, up) in enumerate(self._order)], *[(f"__jr{k}", up) for k, (_, up) in enumerate(other._order)]]
        return Table(joined.select(*shown, *[c.alias(n) for n, c in keys.items()]), order)


class GroupedTable:
    """Groups of one key; null is a group.  Results come in order of first appearance."""

    def __init__(self, table: Table, name: str):
        self.table, self.name = table, name

    def count_groups(self) -> int:
        return self.table._df.select(col(self.name)).distinct().count()

    def aggregate(self, specs: dict[str, tuple[str, str | Callable[[Column], Column]]], compat: bool = False, loose: bool = False) -> Table:
        """{output: (column, function)}: a name of AGGREGATES, or a function from Column to an aggregate Column.

        `compat` gives the infinities of an empty minimum and maximum instead of null.
        """
        made = []
        for out, (name, fn) in specs.items():
            made.append((fn(col(name)) if callable(fn) else _aggregate(self.table, name, fn, compat, loose)).alias(out))
        t = self.table
        key = f"__k{self.name}"
        order = []
        if t._order and all(up for _, up in t._order):
            made.append(F.min(F.struct(*[col(n) for n, _ in t._order])).alias("__o0"))
            order = [("__o0", True)]
        elif t._order:
            made.append(F.min_by(F.struct(*[col(n) for n, _ in t._order]), _rank(t)).alias("__first"))
        df = t._df.groupBy(col(self.name).alias(key)).agg(*made).withColumnRenamed(key, self.name)
        if t._order and not order:
            df = df.select("*", *[F.col(f"__first.`{n}`").alias(f"__o{k}") for k, (n, _) in enumerate(t._order)]).drop("__first")
            order = [(f"__o{k}", up) for k, (_, up) in enumerate(t._order)]
        return Table(df, order)

    def apply(self, name: str, make: Callable[[list[Any]], Any], schema: str, out: str = "value") -> Table:
        """A Python function over the ordered values of each group (called once a group; a group must fit a worker)."""
        t = self.table

        @F.udf(returnType=schema, useArrow=True)
        def run(values: list[Any]) -> Any:
            return make([v[1] for v in values])

        rank = _rank(t) if t._order else F.lit(0)
        lists = t._df.groupBy(col(self.name)).agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), col(name).alias("v")))).alias("__v"))
        return Table(lists.select(col(self.name), run("__v").alias(out)), [])


def _rank(t: Table) -> Column:
    """One orderable value for a table's order; only numbers and times can be taken in reverse."""
    parts = []
    for n, up in t._order:
        kind = t._df.schema[n].dataType
        parts.append(col(n) if up else -col(n).cast("double") if isinstance(kind, NumericType) else -F.unix_micros(col(n).cast("timestamp")))
    return F.struct(*parts)


def _aggregate(t: Table, name: str, fn: str, compat: bool, loose: bool) -> Column:
    c = col(name)
    kind = t._df.schema[name].dataType
    if fn == "count":
        return F.count(F.nullif(c, F.lit(""))) if loose and isinstance(kind, StringType) else F.count(F.lit(1))
    if fn in ("first", "last"):
        if not t._order:
            raise ValueError("first and last need a row order: give order_by")
        return (F.min_by if fn == "first" else F.max_by)(c, _rank(t))
    if fn == "concat":
        shown = F.coalesce(c.cast("string"), F.lit(""))
        if not t._order:
            raise ValueError("concat needs a row order: give order_by")
        pairs = F.array_sort(F.collect_list(F.struct(_rank(t).alias("k"), shown.alias("v"))))
        return F.array_join(F.transform(pairs, lambda p: p.getField("v")), ", ")
    if fn not in AGGREGATES:
        raise ValueError(f"unknown function {fn!r}; known: {', '.join(AGGREGATES)}")
    if isinstance(kind, StringType):
        if not loose:
            raise TypeError(f"{fn} needs a numeric column and {name!r} is text: type it, or use loose=True")
        c = parse_loose(c)
    elif not isinstance(kind, NumericType):
        raise TypeError(f"{fn} needs a numeric column; {name!r} is {kind.simpleString()}")
    if fn in ("min", "max"):
        out = (F.min if fn == "min" else F.max)(c)
        return F.coalesce(out.cast("double"), F.lit(float("inf") if fn == "min" else float("-inf"))) if compat else out
    out = {"sum": F.sum, "mean": F.avg, "median": F.median, "stddev": F.stddev_pop}[fn](c.cast("double") if fn != "sum" else c)
    return F.coalesce(out, F.lit(0).cast("double") if fn != "sum" else F.lit(0))
