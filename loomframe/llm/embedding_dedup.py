"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A vector is rotated by three rounds of random signs and Hadamard transforms; the axis it then lies
nearest to is one hash.  A table's key is several such hashes; besides its own bucket a vector is put
into those where one hash is its second choice (multiprobe).  The number of hashes grows with the
rows so that buckets stay small, and the number of tables follows from the threshold and the
dimension, so that the chance to miss a pair at the threshold is about 1e-6 (measured in tests
against brute force).

Equal vectors are one class.  In each bucket classes are compared with the smallest (a star), then
those of buckets that still hold several components with each other.  Both that and the count of
links inside each component are matrix products over pairs of blocks of BLOCK classes, dealt to tasks
one by one: no pair is a row, and of the links between two components a pair of blocks returns one.
A component of m classes copies each vector m / BLOCK times, as links are counted one and all.
Every link is verified by its cosine in double precision.

Cases: null or zero vectors, null labels or ids, and null or non-finite components link with
nothing; finite ones of any size count (a vector is scaled by its largest component first).  Vectors
of different length link with nothing.  Repeated rows are copies of each other.  A vector is held whole
by one task, however long.  Columns but vec_id, embedding and label are not read and not returned.
Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, ship
from .components import components

THRESHOLD = 0.98
#: Classes in a block; a task holds two blocks.
BLOCK = 4096
#: Rows of a block that are multiplied at once.
_STRIPE = 512
_MISS = 1e-6
#: Tables beyond which the hashes do not pay; a threshold that needs more is refused.
MOST_TABLES = 1000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), -1)
        half *= 2
    return x / math.sqrt(n)


@lru_cache(maxsize=64)
def _agreement(threshold: float, dim: int) -> tuple[float, float]:
    """Chances that a pair at the threshold agrees in one hash, and that one's second choice is the other's first."""
    n = max(2000, 1_000_000 // dim)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(n, dim))
    y = threshold * x + math.sqrt(1 - threshold**2) * rng.normal(size=(n, dim))
    top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
    size = np.abs(np.take_along_axis(x, top, 1))
    top = np.where(size[:, :1] >= size[:, 1:], top, top[:, ::-1])
    there = np.argmax(np.abs(y), axis=1)
    sign = np.take_along_axis(y, there[:, None], 1) > 0
    equal = (top == there[:, None]) & ((np.take_along_axis(x, top, 1) > 0) == sign)
    return float(equal[:, 0].mean()), float(equal[:, 1].mean())


def plan(n_rows: int, dim: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(hashes in a key, tables) for that many vectors."""
    padded = 1 << max(1, math.ceil(math.log2(max(2, dim))))
    hashes = max(2, math.ceil(math.log(max(2, n_rows)) / math.log(2 * padded)))
    first, second = _agreement(threshold, padded)
    hit = first**hashes + hashes * first ** (hashes - 1) * second
    tables = math.ceil(math.log(_MISS) / math.log(1 - hit)) if 0 < hit < 1 else 1 if hit else MOST_TABLES + 1
    if tables > MOST_TABLES:
        raise ValueError(f"a threshold of {threshold} in {dim} dimensions needs over {MOST_TABLES} tables")
    return hashes, tables


def bucket_keys(x: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """(rows, tables * (hashes + 1)) of 64-bit keys: the nearest bucket and the probes of each table."""
    dim = 1 << max(1, math.ceil(math.log2(max(2, x.shape[1]))))
    padded = np.zeros((len(x), dim))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng(20_240 + dim).choice([-1.0, 1.0], (tables, hashes, 3, dim))
    out = []
    for table in range(tables):
        choice = []
        for k in range(hashes):
            y = padded
            for round_ in range(3):
                y = hadamard(y * signs[table, k, round_])
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.abs(np.take_along_axis(y, top, 1))
            top = np.where((size[:, :1] >= size[:, 1:]), top, top[:, ::-1])
            choice.append(top * 2 + (np.take_along_axis(y, top, 1) > 0))
        for probe in range(-1, hashes):
            key = np.full(len(x), table + 1, np.uint64)
            for k in range(hashes):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + choice[k][:, int(k == probe)].astype(np.uint64))
            out.append(key)
    return np.column_stack(out) if out else np.zeros((len(x), 0), np.uint64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Those of `pairs` (a, b) whose cosine reaches the threshold."""
    side = lambda x: vectors.select(F.col("rep").alias(x), F.col("v").alias(f"v_{x}"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = batch.column("size").to_numpy()
                ok = np.zeros(batch.num_rows, bool)
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    x, y = (_matrix(batch.column(c).take(pa.array(at))) for c in ("v_a", "v_b"))
                    ok[at] = (_unit(x) * _unit(y)).sum(1) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where("size(v_a) = size(v_b)")
    return both.select("a", "b", "v_a", "v_b", F.size("v_a").alias("size")).mapInArrow(test, "a bigint, b bigint")


def _dealt(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """`rows` (group, rep, v, ...) once for each pair of blocks (low, high) of the group that they belong to."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    blocks = rows.join(sizes, group).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    blocks = blocks.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(group, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "rep", *columns, "v")


def _close(group: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the low block, rows of the high block, links between them) in stripes; vectors of one length link."""
    mine, low, high = group.column("mine").to_numpy(), group.column("low")[0].as_py(), group.column("high")[0].as_py()
    column = group.column("v").combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    for d in np.unique(size):
        x = np.zeros((len(size), d))
        x[size == d] = _unit(_matrix(column.filter(pa.array(size == d))))
        a, b = np.flatnonzero((mine == low) & (size == d)), np.flatnonzero((mine == high) & (size == d))
        for at in range(0, len(a), _STRIPE):
            some = a[at : at + _STRIPE]
            yield some, b, (x[some] @ x[b].T >= threshold) | (some[:, None] == b)


def _counts(placed: DataFrame, threshold: float) -> DataFrame:
    """(rep, linked): vectors linked with each class, itself included, by blocks of its component."""

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, weight = group.column("rep").to_numpy(), group.column("weight").to_numpy()
        linked = np.zeros(len(rep), np.int64)
        twice = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        for a, b, close in _close(group, threshold):
            linked[a] += close @ weight[b]
            if twice:
                linked[b] += weight[a] @ close
        return pa.table({"rep": rep, "linked": linked})

    return _dealt(placed, "component", "weight").groupBy("component", "low", "high").applyInArrow(count, "rep bigint, linked bigint").groupBy("rep").agg(F.sum("linked").alias("linked"))


def _across(open_: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components of one bucket: one at least for each two that have any."""

    def find(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, component = group.column("rep").to_numpy(), group.column("component").to_numpy()
        label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        pairs = [np.zeros((0, 4), np.int64)]
        for a, b, close in _close(group, threshold):
            i, j = np.nonzero(close & (component[a][:, None] != component[b]) & (label[a][:, None] == label[b]))
            found = np.column_stack([component[a[i]], component[b[j]], rep[a[i]], rep[b[j]]])
            pairs.append(found[np.unique(found[:, :2], axis=0, return_index=True)[1]])
        made = np.concatenate(pairs)
        return pa.table({"a": made[:, 2], "b": made[:, 3]})

    return _dealt(open_, "key", "component", "label").groupBy("key", "low", "high").applyInArrow(find, "a bigint, b bigint").distinct()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding, label)."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    usable = "vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    classes = cut(rows.where(usable).groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    n = classes.count()

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v) for v in batch.column("v")], np.int64)
            for d in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                hashes, tables = plan(n, int(d), threshold)
                for at in range(0, part.num_rows, 2000):
                    some = part.slice(at, 2000)
                    keys = bucket_keys(_unit(_matrix(some.column("v"))), hashes, tables).view(np.int64)
                    ends = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                    yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))], ["rep", "label", "keys"])

    hashed = classes.select("rep", "label", "v").mapInArrow(hash_all, f"rep bigint, label {dict(rows.dtypes)['label']}, keys array<bigint>")
    banded = hashed.select("rep", F.explode("keys").alias("key"), "label").select("rep", F.xxhash64("label", "key").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub != last").select("key", "hub")
    members = cut(banded.join(shared, "key").select("key", "rep", "hub"))
    # the bucket key is a hash: labels are compared once more with the pair
    labelled = classes.select("rep", "v", "weight", "label")
    tag = lambda x: labelled.select(F.col("rep").alias(x), F.col("label").alias(f"l_{x}"))
    same = lambda pairs: pairs.join(tag("a"), "a").join(tag("b"), "b").where("l_a = l_b").select("a", "b")
    stars = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    linked = cut(_verified(same(stars), labelled, threshold).distinct())
    found = components(linked)
    placed = members.select("key", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    open_ = cut(placed.join(apart, "key"))
    late = cut(_across(open_.join(labelled.select("rep", "v", "label"), "rep"), threshold))
    if late.head(1):
        found = components(linked.unionByName(late))
    found = found.select(F.col("node").alias("rep"), "component")
    counts = _counts(labelled.join(found, "rep"), threshold)
    done = classes.join(found, "rep", "left").join(counts, "rep", "left").select("label", "v", F.coalesce("component", "rep").alias("component"), (F.coalesce("linked", "weight") - 1).alias("n_links"))
    # rows of a class are equal in label and vector; a long vector travels as its hash
    fields = ["label", "v"]
    mark = lambda df: df.withColumn("h1", F.xxhash64(*fields)).withColumn("h2", F.xxhash64(F.lit(5), *fields)).drop(*fields)
    out = mark(rows.withColumn("ok", F.coalesce(F.expr(usable), F.lit(False)))).join(mark(done), ["h1", "h2"], "left")
    component = F.when(F.col("ok"), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
