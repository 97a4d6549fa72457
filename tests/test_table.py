"""Tables: order, filters, groups, joins, edits, nesting, profiles."""

import pytest
from pyspark.sql import functions as F

from loomframe import EditLog, Table, flatten, profile, read_csv, unflatten, validate
from loomframe.plans.filters import FilterError

CLI = "name,age,city,country\nAlice,30,New York,USA\nBob,25,London,UK\nCharlie,35,Paris,France\nDiana,28,Tokyo,Japan\nEve,22,Boston,USA\nFrank,45,Berlin,Germany\nGrace,33,Miami,USA\nHenry,29,Rome,Italy\nIvy,31,Oslo,Norway\nJack,27,Austin,USA\n"


@pytest.fixture
def people(spark):
    return read_csv(spark, CLI.encode())


def names(table):
    return [r["name"] for r in table.rows()]


@pytest.mark.parametrize("text,want", [
    ("country == USA", ["Alice", "Eve", "Grace", "Jack"]), ("country = 'USA'", ["Alice", "Eve", "Grace", "Jack"]), ("age > 30", ["Charlie", "Frank", "Grace", "Ivy"]), ("city contains York", ["Alice"]),
    ("city == New York", ["Alice"]), ("name startsWith 'A'", ["Alice"]), ("name ENDSWITH e", ["Alice", "Charlie", "Eve", "Grace"]), ("name matches ^[AB]", ["Alice", "Bob"]), ("name matches /^(Ivy|Bob)$/", ["Bob", "Ivy"]),
    ("age > 30 && country != 'USA'", ["Charlie", "Frank", "Ivy"]), ("!(age > 23) || name == 'Bob'", ["Bob", "Eve"]), ("not age > 23 or name = 'Bob'", ["Bob", "Eve"]), ("(age >= 45)", ["Frank"]), ("`age` <= 22", ["Eve"]), ("country != 'USA' && (city contains 'o') && age < 30", ["Bob", "Diana", "Henry"]),
])
def test_filters(people, text, want):
    assert names(people.filter(text)) == want


@pytest.mark.parametrize("text", ["nope == 1", "age > x y", "age >", "(age > 1", "name == 'a' &&", "__seq0 == 1", "age @ 3"])
def test_bad_filters(people, text):
    with pytest.raises(FilterError):
        people.filter(text)


def test_filter_nulls(spark):
    t = Table.from_rows(spark, [{"a": "x"}, {"a": None}, {"a": "12abc"}])
    assert t.filter("a != x").count() == 2 and t.filter("a == x").count() == 1 and t.filter("a > 11").count() == 1
    assert t.filter("a == null").count() in (0, 1) and t.filter("(a == null)").count() == 1


def test_order(people):
    assert names(people.sort("age", descending=True).first(3)) == ["Frank", "Charlie", "Grace"]
    assert names(people.last(2)) == ["Ivy", "Jack"] and people.last(0).count() == 0
    assert people.at(2)["name"] == "Charlie" and people.at(10) is None and people.at(-1) is None
    assert names(people.filter_index(lambda i: i % 4 == 0)) == ["Alice", "Eve", "Ivy"]
    assert names(people.sort("country").sort("name", descending=True).first(1)) == ["Jack"]
    again = people.filter("country == USA").filter_index(lambda i: i == 1)
    assert names(again) == ["Eve"]
    assert people.count() == 10 and people.columns == ["name", "age", "city", "country"]


def test_nulls_sort_lowest(spark):
    t = Table.from_rows(spark, [{"a": 2, "b": "x"}, {"a": None, "b": "y"}, {"a": 1, "b": "z"}])
    assert [r["b"] for r in t.sort("a").rows()] == ["y", "z", "x"] and [r["b"] for r in t.sort("a", descending=True).rows()] == ["x", "z", "y"]


def test_select_and_maps(people):
    assert people.select("age", 0).columns == ["age", "name"]
    with pytest.raises(KeyError):
        people.select("none")
    assert people.select("none", lenient=True).first(1).collect()[0]["none"] is None
    assert names(people.filter_rows(lambda r: r["city"].startswith("B"))) == ["Eve", "Frank"]
    made = people.map_rows(lambda r: None if r["name"] == "Bob" else {"name": r["name"], "n": len(r["city"])}, "name string, n bigint")
    assert [tuple(r) for r in made.first(2).collect()] == [("Alice", 8), ("Charlie", 5)]


def test_groups(spark):
    data = [("North", 100, 10), ("North", 150, 15), ("South", 200, 20), ("South", 180, 18), ("East", 120, 12)]
    t = Table.from_rows(spark, [dict(zip(("region", "sales", "units"), r, strict=True)) for r in data])
    got = t.group_by("region").aggregate({"total": ("sales", "sum"), "avg": ("sales", "mean"), "most": ("units", "max"), "n": ("units", "count"), "all": ("units", "concat"), "spread": ("sales", lambda c: F.max(c) - F.min(c))}).collect()
    assert [tuple(r) for r in got] == [("North", 250, 125.0, 15, 2, "10, 15", 50), ("South", 380, 190.0, 20, 2, "20, 18", 20), ("East", 120, 120.0, 12, 1, "12", 0)]
    got = t.sort("sales", descending=True).group_by("region").aggregate({"f": ("sales", "first"), "l": ("sales", "last")}).collect()
    assert [tuple(r) for r in got] == [("South", 200, 180), ("North", 150, 100), ("East", 120, 120)]
    assert t.group_by("region").apply("sales", lambda v: max(v) - min(v), "bigint").filter("value == 50").count() == 1
    with pytest.raises(TypeError, match="numeric"):
        t.group_by("sales").aggregate({"x": ("region", "sum")})


def test_empty_groups_of_numbers(spark):
    t = Table.from_rows(spark, [{"k": None, "v": None}, {"k": None, "v": None}, {"k": "a", "v": 3.0}], "k string, v double")
    fns = ("count", "sum", "min", "max", "mean", "median", "stddev")
    got = t.group_by("k").aggregate({f: ("v", f) for f in fns}).collect()
    assert tuple(got[0]) == (None, 2, 0.0, None, None, 0.0, 0.0, 0.0)
    got = t.group_by("k").aggregate({f: ("v", f) for f in fns}, compat=True).collect()
    assert tuple(got[0])[3:5] == (float("inf"), float("-inf"))
    assert t.group_by("k").count_groups() == 2


def test_joins(spark):
    orders = Table.from_rows(spark, [{"orderId": 1, "customerId": "D"}, {"orderId": 2, "customerId": "E"}, {"orderId": 3, "customerId": "?"}, {"orderId": 4, "customerId": None}])
    customers = Table.from_rows(spark, [{"customerId": "D", "name": "d"}, {"customerId": "E", "name": "e"}, {"customerId": "O", "name": "o"}, {"customerId": None, "name": "none"}])
    assert [orders.join(customers, "customerId", how).count() for how in ("inner", "left", "right", "full", "cross") if how != "cross"] == [3, 4, 4, 5]
    got = [tuple(r) for r in orders.join(customers, "customerId", "full").collect()]
    assert got == [(1, "D", "d"), (2, "E", "e"), (3, "?", None), (4, None, "none"), (None, "O", "o")]
    assert orders.join(customers, how="cross").count() == 16
    with pytest.raises(TypeError, match="differ in type"):
        orders.join(customers, ("orderId", "customerId"))
    with pytest.raises(ValueError, match="unknown join"):
        orders.join(customers, "customerId", "semi")


def test_edits(spark, tmp_path):
    t = read_csv(spark, b"name,age,city\nAlice,30,New York\nBob,25,Los Angeles\nCharlie,35,Chicago\n")
    log = EditLog(t)
    log.set_cell(0, "age", "31"), log.set_cell(1, 0, "Robert"), log.delete_row(2), log.insert_row(0, ["Diana", "28", "Seattle"])
    assert log.modification_count == 4 and log.get_cell(0, "age") == "31" and log.get_cell(2, 0) is None and log.get_cell(1, "city") == "Los Angeles" and log.is_deleted(2)
    log.save(str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_text() == "name,age,city\nDiana,28,Seattle\nAlice,31,New York\nRobert,25,Los Angeles\n"
    assert not log.has_unsaved_changes
    log.insert_row(0, ["a"]), log.insert_row(1, ["b"]), log.insert_row(99, {"name": "z"})
    assert [r["name"] for r in log.apply().rows()] == ["a", "b", "Alice", "Bob", "Charlie", "z"]
    with pytest.raises(KeyError):
        log.set_cell(0, "none", 1)


def test_nesting(spark):
    df = spark.createDataFrame([(("Alice", 30), ("NYC", "1"), 5)], "user struct<name: string, age: bigint>, address struct<city: string, zip: string>, score bigint")
    flat = flatten(Table(df))
    assert flat.columns == ["user.name", "user.age", "address.city", "address.zip", "score"]
    assert unflatten(flat).to_df().schema["user"].dataType == df.schema["user"].dataType
    assert flatten(Table(df), "_").columns[0] == "user_name"
    with pytest.raises(ValueError, match="both"):
        unflatten(Table(spark.createDataFrame([(1, 2)], "`a` int, `a.b` int")))


def test_profile_and_validate(spark):
    t = read_csv(spark, ("day,kind,note\n" + "".join(f"2020-08-{k % 28 + 1:02d},{'ab'[k % 2]},n{k}\n" for k in range(120)) + ",,\n").encode(), relax_column_count=True)
    got = {r["column"]: r for r in profile(t).collect()}
    assert (got["day"]["type"], got["day"]["min"], got["kind"]["type"], got["kind"]["unique_count"], got["kind"]["null_count"]) == ("number", "2020.0", "categorical", 2, 1)
    assert (got["note"]["type"], got["note"]["min"], got["note"]["max"]) == ("string", "n0", "n99")
    report = validate(read_csv(spark, b"a,b\n1\n1,2\n"))
    assert not report["valid"] and report["rows"] == 2 and report["errors"][0]["code"] == "TooFewFields"
