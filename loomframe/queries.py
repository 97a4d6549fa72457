"""The registered queries of the toolkit: each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import typing as ty
from loomframe.functions.text import escape_formula, trim
from loomframe.operators.edits import EditLog
from loomframe.operators.nested import flatten, unflatten
from loomframe.operators.profile import profile, validate
from loomframe.operators.table import Table, col
from loomframe.session import fresh
from loomframe.sources.reader import read_csv
from loomframe.sources.sinks import json_lines, lines, tsv_lines
from loomframe.streaming.stream import batches, read_stream, run_batches

KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id", "documents": "doc_id", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table.from_df(raw(spark, sf_dir, name), KEYS.get(name, ()))


def _csv(spark: SparkSession, df: DataFrame, **options: object) -> Table:
    """`df` written as CSV into the shared folder by the executors, and read back by the reader; null and empty text differ."""
    folder = fresh(spark, "csv")
    made = Table(df)
    lines(made, mark_empty=True).select("line").write.text(f"{folder}/body")
    names = df.columns
    got = read_csv(spark, f"{folder}/body", has_header=False, encoding="UTF-8", line_end="\n", **options)
    if not got.columns:  # no rows
        return Table(df.limit(0))
    return Table(got._df.select(*[col(f"col{k}").alias(n) for k, n in enumerate(names)], *map(col, got.hidden)), got._order, meta=got.meta)


# projections, filters, order
@query
def select_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey").to_df()


@query
def select_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(1, "c_acctbal", 0).to_df()


def _filtered(name: str, source: str, columns: list[str], text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).filter(text).select(*columns).to_df()

    run.__name__ = name
    query(run)


_filtered("filter_eq", "customer", ["c_custkey", "c_mktsegment"], "c_mktsegment == BUILDING")
_filtered("filter_num", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity >= 45")
_filtered("filter_contains", "part", ["p_partkey", "p_type"], "p_type contains 'AND'")
_filtered("filter_startswith", "part", ["p_partkey", "p_type"], "p_type startsWith PROMO")
_filtered("filter_endswith", "part", ["p_partkey", "p_type"], "p_type endsWith MO")
_filtered("filter_matches", "customer", ["c_custkey", "c_name"], "c_name matches 0+[1-9]7$")
_filtered("filter_bool", "orders", ["o_orderkey"], "(o_orderstatus == 'O' || o_orderstatus == 'F') && o_totalprice > 100000 && !(o_orderpriority == '1-URGENT')")


@query
def filter_ne_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    return t.map({"c_custkey": col("c_custkey"), "segment": F.nullif("c_mktsegment", F.lit("BUILDING"))}).filter("segment != MACHINERY").to_df()


@query
def filter_number_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric comparison on text reads the number that a cell begins with."""
    t = table(spark, sf_dir, "part")
    return t.map({"p_partkey": col("p_partkey"), "size": F.concat(col("p_size").cast("string"), F.lit(" cm"))}).filter("size < 7").to_df()


@query
def filter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter_index(lambda i: i % 7 == 3).select("o_orderkey").to_df()


@query
def map_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor(col("l_extendedprice") * (1 - col("l_discount")) * (1 + col("l_tax")) * 100 + 0.5) / 100
    return table(spark, sf_dir, "lineitem").map({"l_orderkey": col("l_orderkey"), "l_linenumber": col("l_linenumber"), "charge": price}).to_df()


@query
def sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a stable descending sort and a limit."""
    return table(spark, sf_dir, "orders").sort("o_totalprice", descending=True).first(25).select("o_orderkey", "o_totalprice").to_df()


@query
def sort_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its place after a stable sort by a column with ties."""
    t = table(spark, sf_dir, "orders").sort("o_orderpriority", descending=True)
    return t.with_positions().select("o_orderkey", col("__position").alias("place"))


@query
def sort_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").map({"p_partkey": col("p_partkey"), "price": F.concat(F.lit("$"), col("p_retailprice").cast("decimal(12,2)").cast("string"))})
    return t.sort("price", numeric=True).with_positions().select("p_partkey", col("__position").alias("place"))


@query
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").first(10).select("event_id", "event_type").to_df()


@query
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").last(10).select("event_id", "event_type").to_df()


@query
def at(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").at(17)
    return spark.createDataFrame([row], "o_orderkey bigint, o_totalprice double")


# groups
@query
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, group and aggregate over the largest table."""
    out = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").group_by("l_returnflag").aggregate({"sum_qty": ("l_quantity", "sum"), "avg_price": ("l_extendedprice", "mean"), "n": ("l_orderkey", "count")}).to_df()
    return out.select("l_returnflag", F.round("sum_qty", 2).alias("sum_qty"), F.round("avg_price", 4).alias("avg_price"), "n")


def _grouped(fn: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = table(spark, sf_dir, "orders").group_by("o_orderpriority").aggregate({"value": ("o_totalprice", fn)}).to_df()
        return out.select("o_orderpriority", "value" if fn == "count" else F.round("value", 2).alias("value"))

    run.__name__ = f"group_{fn}"
    query(run)


for _fn in ("count", "sum", "min", "max", "mean", "median", "stddev"):
    _grouped(_fn)


def _segments(spark: SparkSession, sf_dir: str) -> Table:
    t = table(spark, sf_dir, "customer")
    return t.with_columns({"segment": F.nullif("c_mktsegment", F.lit("BUILDING")), "name": F.when(col("c_custkey") % 3 != 1, col("c_name"))})


@query
def group_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).group_by("c_nationkey").aggregate({"value": ("name", "first")}).to_df()


@query
def group_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).group_by("c_nationkey").aggregate({"value": ("name", "last")}).to_df()


@query
def group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).group_by("c_nationkey").aggregate({"value": ("name", "concat")}).to_df()


@query
def group_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).group_by("segment").aggregate({"n": ("c_custkey", "count"), "largest": ("c_acctbal", "max")}).to_df()


@query
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in order of first appearance."""
    t = _segments(spark, sf_dir).group_by("segment").aggregate({"n": ("c_custkey", "count")})
    return t.with_positions().select("segment", "n", col("__position").alias("place"))


@query
def group_custom_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread: Callable[[Column], Column] = lambda c: F.max(c) - F.min(c)
    out = table(spark, sf_dir, "events").group_by("event_type").aggregate({"spread": ("value", spread)}).to_df()
    return out.select("event_type", F.round("spread", 4).alias("spread"))


@query
def group_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function over each group's ordered values."""
    return table(spark, sf_dir, "nation").group_by("n_regionkey").apply("n_name", lambda values: "/".join(v[:2] for v in values), "string", "value").to_df()


@query
def group_count_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(_segments(spark, sf_dir).group_by("segment").count_groups(),)], "n bigint")


@query
def global_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").aggregate({f: ("l_extendedprice", f) for f in ("sum", "min", "max", "mean", "median", "stddev", "count")})
    return out.select(*[(F.round(c, 2) if c != "count" else F.col(c)).alias(f"{c}_price") for c in out.columns])


@query
def global_aggs_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts such as $1,234.50 and 12% read as numbers."""
    t = table(spark, sf_dir, "customer").map({"money": F.concat(F.lit("$"), F.format_number(F.abs(col("c_acctbal")), 2)), "share": F.concat((col("c_custkey") % 100).cast("string"), F.lit("%"))})
    out = t.aggregate({"money": ("money", "sum"), "share": ("share", "mean"), "most": ("money", "max"), "n": ("share", "count")}, loose=True)
    return out.select(F.round("money", 2).alias("money"), F.round("share", 4).alias("share"), "most", "n")


# joins
def _sides(spark: SparkSession, sf_dir: str) -> tuple[Table, Table]:
    left = table(spark, sf_dir, "orders").filter("o_totalprice > 150000").map({"o_orderkey": col("o_orderkey"), "custkey": col("o_custkey"), "note": col("o_orderstatus")})
    right = table(spark, sf_dir, "customer").filter("c_acctbal > 3000").map({"custkey": col("c_custkey"), "note": col("c_mktsegment"), "c_acctbal": col("c_acctbal")})
    return left, right


def _joined(how: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        left, right = _sides(spark, sf_dir)
        return left.join(right, "custkey", how).to_df()

    run.__name__ = f"join_{how}"
    query(run)


for _how in ("inner", "left", "right", "full"):
    _joined(_how)


@query
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the cross product; both tables have a fixed few rows."""
    return table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), how="cross").select("r_name", "n_name").to_df()


@query
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").map({"n_name": col("n_name"), "key": F.nullif("n_regionkey", F.lit(2))})
    right = table(spark, sf_dir, "region").map({"r_name": col("r_name"), "key": F.nullif("r_regionkey", F.lit(2))})
    return left.join(right, "key").to_df()


@query
def join_two_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), ("s_nationkey", "n_nationkey")).select("s_suppkey", "s_nationkey", "n_nationkey", "n_name").to_df()


@query
def join_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left order first, unmatched right rows at the end."""
    left, right = _sides(spark, sf_dir)
    t = left.join(right, "custkey", "full")
    return t.with_positions().select("o_orderkey", "custkey", col("__position").alias("place"))


# profiles and typing
def _profiled(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = profile(Table(raw(spark, sf_dir, name)))
        return out.withColumn("mean", F.round("mean", 3)).withColumnsRenamed({"count": "n_rows", "column": "name", "type": "kind", "min": "least", "max": "most", "mean": "average"})

    run.__name__ = f"profile_{name}"
    query(run)


_profiled("customer")
_profiled("part")


@query
def dynamic_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns as text, typed again by what they hold."""
    df = raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("big"))
    text = df.select(*[col(c).cast("string").alias(c) for c in df.columns])
    return ty.dynamic(text, text.columns)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(col("c_acctbal") * 100).cast("bigint")
    plain = F.concat((F.abs(cents) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    return raw(spark, sf_dir, "customer").select("c_custkey", F.when(cents < 0, F.concat(F.lit("($"), plain, F.lit(")"))).otherwise(F.concat(F.lit("$"), plain)).alias("money"), F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("%")).alias("share"), F.element_at(F.array(*map(F.lit, ("yes", "NO", "true", "0", "maybe"))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("flag"), F.concat(F.col("c_custkey").cast("string"), F.lit("abc")).alias("prefixed"))


@query
def typed_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _texts(spark, sf_dir)
    return df.select("c_custkey", F.round(ty.coerce(col("money"), "currency"), 2).alias("money"), F.round(ty.coerce(col("share"), "percent"), 4).alias("share"), F.round(ty.coerce(col("share"), "number"), 4).alias("number"), ty.coerce(col("flag"), "boolean").alias("flag"), ty.coerce(col("prefixed"), "integer").alias("prefixed"))


@query
def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = raw(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return text.select("o_orderkey", F.date_format(ty.coerce(F.when(col("o_orderkey") % 11 == 0, F.lit("no date")).otherwise(col("day")), "date"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def typed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that break their declared type."""
    from loomframe.sources.reader import typing_errors

    t = Table.from_df(_texts(spark, sf_dir).select("c_custkey", "flag"), "c_custkey")
    return typing_errors(t, {"flag": "boolean"}).select("code", "row", col("column").alias("name"))


# policies
@query
def trim_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = raw(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" \t "), "p_name", F.lit("　  ")).alias("padded"))
    return padded.select("p_partkey", trim(col("padded")).alias("both"), trim(col("padded"), right=False).alias("lead"), trim(col("padded"), left=False).alias("rest"))


@query
def from_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a range of records, by number."""
    df = raw(spark, sf_dir, "customer").select("c_custkey", "c_name").coalesce(1).sortWithinPartitions("c_custkey")
    return _csv(spark, df, from_line=4, to_line=60).select("c_custkey", "c_name").to_df()


@query
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw(spark, sf_dir, "customer").select("c_custkey", "c_name").coalesce(1).sortWithinPartitions("c_custkey")
    return _csv(spark, df, preview=12).select("c_custkey", "c_name").to_df()


@query
def skip_empty_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("n_nationkey") % 3 == 0
    df = raw(spark, sf_dir, "nation").select(F.when(odd, F.lit(" ")).otherwise(F.col("n_name")).alias("name"), F.when(odd, F.lit("")).otherwise(F.col("n_regionkey").cast("string")).alias("region"))
    return _csv(spark, df, skip_records_with_empty_values="greedy").select("name", "region").to_df()


# serialization
@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line ends and quotes, written and read again."""
    t = _csv(spark, raw(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return t.to_df().select(col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


@query
def csv_roundtrip_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _csv(spark, raw(spark, sf_dir, "customer"), dynamic_typing=True)
    return t.to_df().select("c_custkey", "c_name", "c_nationkey", col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query
def escape_formulae(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = raw(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", "\t", ""))), (F.col("p_partkey") % 6 + 1).cast("int")), "p_name").alias("v"))
    return made.select("p_partkey", escape_formula(col("v")).alias("v"))


@query
def unparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(Table(raw(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select("line")


@query
def unparse_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(Table(raw(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")), delimiter=";", quotes="non-numeric").select("line")


@query
def tsv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv_lines(Table(raw(spark, sf_dir, "documents").select("doc_id", "text"))).select("line")


@query
def to_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = json_lines(Table(raw(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))))
    return made.select(F.get_json_object("line", "$.c_custkey").cast("bigint").alias("c_custkey"), F.get_json_object("line", "$.segment").alias("segment"), F.contains("line", F.lit('"segment":null')).alias("has_null"))


@query
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw(spark, sf_dir, "events").select("event_id", F.struct(F.col("user_id").alias("id"), F.struct(F.from_json("props", "k bigint").getField("k").alias("k")).alias("props")).alias("user"))
    return flatten(Table(df)).to_df().withColumnsRenamed({"user.id": "user_id", "user.props.k": "user_props_k"})


@query
def unflatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("who.name"), F.col("c_nationkey").alias("who.home.nation"))
    out = unflatten(Table(df)).to_df()
    return out.select("id", F.to_json("who").alias("who"))


@query
def edits_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = EditLog(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    log.set_cell(0, "c_name", "edited"), log.set_cell(5, 1, "edited too"), log.set_cell(5, "c_name", "edited last")
    log.delete_row(2), log.delete_row(7)
    log.insert_row(0, [-1, "first"]), log.insert_row(1, [-2, "second"]), log.insert_row(6, [-3, "sixth"]), log.insert_row(10**9, [-4, "end"])
    return log.apply().with_positions().select("c_custkey", "c_name", col("__position").alias("place"))


# streams
@query
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder in micro-batches, each appended by its batch number, against the batch result."""
    base = fresh(spark, "stream")
    df = raw(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    lines(Table(df.repartition(4, "o_orderkey"))).select("line").write.text(f"{base}/in")
    stream = read_stream(spark, f"{base}/in", df.columns, has_header=False, where="o_totalprice > 50000", max_files=1)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote
        batch.select(*df.columns).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run_batches(stream, keep, f"{base}/state").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


# reader options on files that need them
def _file(spark: SparkSession, head: str, df: DataFrame, key: str) -> str:
    """A folder with one CSV file: the head, then column `line` in the order of `key` (small tables, as the head stands once)."""
    folder = fresh(spark, "file")
    first = spark.range(1).select(F.lit(-1).cast("bigint").alias("k"), F.lit(head).alias("line"))
    first.unionByName(df.select(col(key).cast("bigint").alias("k"), "line")).orderBy("k").select("line").coalesce(1).write.text(folder)
    return folder


def _customers(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").select("c_custkey", F.expr(line).alias("line"))


@query
def csv_headed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files, each with its header, every value quoted."""
    folder = fresh(spark, "headed")
    raw(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").repartition(5, "c_custkey").write.csv(folder, header=True, quoteAll=True)
    return read_csv(spark, folder).to_df()


@query
def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark, "k,name", _customers(spark, sf_dir, "concat_ws(',', c_custkey, if(c_custkey % 7 = 1, null, c_name), if(c_custkey % 7 = 0, 'one,\"t,wo\"', null))"), "c_custkey")
    return read_csv(spark, folder).with_parsed_extra().to_df().select("k", "name", F.array_join("__parsed_extra", "|").alias("extra"))


@query
def csv_ragged_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark, "k,name", _customers(spark, sf_dir, "concat_ws(',', c_custkey, if(c_custkey % 7 = 1, null, c_name), if(c_custkey % 7 = 0, 'one', null))"), "c_custkey")
    return read_csv(spark, folder).errors().select("code", "row", "message")


@query
def csv_skip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark, "k,name", _customers(spark, sf_dir, "concat_ws(',', c_custkey, if(c_custkey % 7 = 1, null, c_name))"), "c_custkey")
    return read_csv(spark, folder, skip_records_with_error=True).to_df()


@query
def csv_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark, "# a comment\nk,name", _customers(spark, sf_dir, "concat(if(c_custkey % 5 = 0, '#', ''), c_custkey, ',', c_name)"), "c_custkey")
    return read_csv(spark, folder, comments=True).to_df()


@query
def csv_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark, "made, by \"us\nsecond line\nk,name", _customers(spark, sf_dir, "concat(c_custkey, ',\"', c_name, '\n', c_mktsegment, '\"')"), "c_custkey")
    return read_csv(spark, folder, skip_first_n_lines=2).to_df()


@query
def csv_record_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes count towards the size of a record."""
    folder = _file(spark, "k,name", _customers(spark, sf_dir, "concat(c_custkey, ',', if(c_custkey % 2 = 1, concat('\"', c_name, '\"'), c_name))"), "c_custkey")
    return read_csv(spark, folder, max_record_size=21, skip_records_with_error=True).to_df()


@query
def csv_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark, "k|name|segment", _customers(spark, sf_dir, "concat_ws('|', c_custkey, c_name, c_mktsegment)"), "c_custkey")
    return read_csv(spark, folder, delimiter="auto").to_df()


@query
def csv_twice_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark, "k,v,v,", _customers(spark, sf_dir, "concat_ws(',', c_custkey, c_name, c_mktsegment, c_nationkey)"), "c_custkey")
    return read_csv(spark, folder).to_df()


@query
def csv_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast mode: quotes are text, comment signs may be long."""
    folder = _file(spark, "k,name", _customers(spark, sf_dir, "concat(if(c_custkey % 5 = 0, '//', ''), c_custkey, ',\"', c_name)"), "c_custkey")
    return read_csv(spark, folder, fast_mode=True, comments="//").to_df()


@query
def csv_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "wide")
    raw(spark, sf_dir, "customer").select("c_custkey", "c_name").coalesce(1).write.csv(folder, header=True, encoding="UTF-16LE")
    return read_csv(spark, folder).to_df()


@query
def csv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line ends and doubled quotes, read in parts by the exact rules."""
    folder = fresh(spark, "texts")
    raw(spark, sf_dir, "documents").select(F.expr("concat(doc_id, ',\"', replace(coalesce(text, ''), '\"', '\"\"'), '\"')").alias("value")).write.text(folder)
    got = read_csv(spark, folder, has_header=False, strict=True).to_df()
    return got.select(col("col0").cast("bigint").alias("doc_id"), F.octet_length("col1").cast("bigint").alias("n_bytes"), F.md5("col1").alias("digest"))


@query
def csv_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and value transforms, a cast, and a hook on records."""
    folder = _file(spark, "k,name", _customers(spark, sf_dir, "concat_ws(',', c_custkey, c_name)"), "c_custkey")
    keep = lambda values, at: None if at["index"] % 3 == 0 else [values[0], values[1] + "!"]
    got = read_csv(spark, folder, transform_header=lambda name, k: f"{name}{k}", on_record=keep, transform=lambda c, name: F.upper(c) if name == "name1" else c, cast={"k0": lambda c: c.cast("bigint") * 2})
    return got.to_df()


@query
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark, "k,name", _customers(spark, sf_dir, "concat_ws(',', c_custkey, if(c_custkey % 7 = 1, null, c_name))"), "c_custkey")
    r = validate(read_csv(spark, folder))
    return spark.createDataFrame([(r["valid"], r["rows"], r["columns"], r["n_errors"])], "valid boolean, n_rows bigint, n_columns bigint, n_errors bigint")


@query
def pull_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows pulled in order, ten at a time."""
    made = [(k, len(part), part[0][1]) for k, part in enumerate(batches(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 10))]
    return spark.createDataFrame(made, "chunk bigint, n bigint, first string")


def csv_export(spark: SparkSession, sf_dir: str) -> str:
    """A folder with lineitem as CSV, each file with a header."""
    folder = fresh(spark, "scan")
    raw(spark, sf_dir, "lineitem").write.csv(folder, header=True)
    return folder
