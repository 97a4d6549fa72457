"""Line dedup: sharded cuckoo filters before exact reference counts, reversible by document.

`LineIndex` holds the lines of its documents by key (a hash of 128 bits), from which a key's reference
count and smallest document follow exactly, and a cuckoo filter of the keys for each shard.  A batch's
keys are dealt to the shards and probed: what a filter does not know is new, and only the rest is looked
up in the exact table.  Deletion takes documents out of the table, and the keys that nobody holds any
more out of the filters, so that the index is as if they had never come.  The number of shards doubles
with the keys, so that a task holds about SHARD_KEYS of them however many there are.

`drop_repeated_lines` loads its documents into an index in batches and applies the counts to them.

Cases: null or empty text is one empty line.  Rows without a doc_id keep all their lines and count
for nothing.  Rows that share a doc_id are one document.  Extra columns of any name stay, but for n_lines
and n_dropped, which are replaced.  A text is held whole by one task.  An empty table gives an empty result.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, plain_names, ship
from .cuckoo import CuckooFilter

MIN_CHARS = 10
#: Keys in one filter, on average at most.
SHARD_KEYS = 100_000
#: Batches that a table is loaded in.
BATCHES = 2
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2")]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, k1, k2) of the lines that can be dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = rows.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("doc_id", "text_hash", "pos", *_hashes(F.col("key")))


def reference_counts(lines: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, first_doc): counts are combined before each shuffle, so a hot key costs one row a task."""
    held = lines.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def _without(docs: DataFrame, lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """`docs` without those of `lines` whose key another document holds first."""
    results = ["n_lines", "n_dropped"]
    plain, names, (doc, text) = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results]), "doc_id", "text")
    gone = lines.join(repeated, ["k1", "k2"]).where("doc_id != first_doc")
    # one bit for each dropped line, in words of 64 lines
    bits = gone.groupBy("doc_id", "text_hash", F.expr("cast(pos div 64 as int)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    marks = bits.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("map"))
    marks = marks.withColumn("words", F.expr("transform(sequence(0, array_max(map_keys(map))), w -> coalesce(map[w], 0L))")).drop("map")
    joined = plain.withColumn("h", F.xxhash64(text)).join(marks.hint("shuffle_hash"), (F.col(doc) == F.col("id")) & (F.col("h") == F.col("hash")), "left")
    stays = "filter(lines, (x, i) -> (shiftrightunsigned(coalesce(try_element_at(words, cast(i div 64 as int) + 1), 0L), i % 64) & 1L) = 0)"
    out = (
        joined.withColumn("lines", F.expr(f"split(coalesce({text}, ''), '\\n', -1)"))
        .withColumn("kept", F.when(F.col("words").isNull(), F.col("lines")).otherwise(F.expr(stays)))
        .withColumn("n_lines", F.size("lines").cast("bigint"))
        .withColumn("n_dropped", F.col("n_lines") - F.size("kept"))
        .withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col(text)))
    )
    return out.select(*plain.columns, *results).toDF(*names, *results)


class LineIndex:
    """Documents' lines and the filters of their keys, as tables; each change gives an index of its own."""

    def __init__(self, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        self.min_chars, self.shard_keys = min_chars, shard_keys
        self.parts: list[DataFrame] = []  # (doc_id, text_hash, pos, k1, k2)
        self.filters: DataFrame | None = None  # (shard, filter)
        self.n_keys, self.n_shards = 0, 1
        self.tables: Scratch | None = None

    def _with(self, parts: list[DataFrame], filters: DataFrame | None, n_keys: int, n_shards: int) -> LineIndex:
        out = LineIndex(self.min_chars, self.shard_keys)
        out.parts, out.filters, out.n_keys, out.n_shards, out.tables = parts, filters, n_keys, n_shards, self.tables
        return out

    @property
    def lines(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def counts(self) -> DataFrame:
        return reference_counts(self.lines)

    @staticmethod
    def _dealt(keys: DataFrame, n_shards: int) -> DataFrame:
        return keys.select("k1", F.pmod("k1", F.lit(n_shards)).cast("int").alias("shard"))

    def _built(self, keys: DataFrame, n_shards: int) -> DataFrame:
        size = self.shard_keys

        def make(part: pa.Table) -> pa.Table:
            held = part.column("k1").to_numpy()
            made = CuckooFilter.sized(max(size, len(held)))
            made.insert(held)
            return pa.table({"shard": part.column("shard").slice(0, 1), "filter": pa.array([made.dump()], pa.binary())})

        return self.tables.save(self._dealt(keys, n_shards).groupBy("shard").applyInArrow(make, "shard int, filter binary"))

    def _changed(self, filters: DataFrame, keys: DataFrame, n_shards: int, change: str) -> DataFrame:
        """The filters with `keys` inserted or deleted; only shards that have such keys are written anew."""
        size = self.shard_keys

        def alter(part: pa.Table, cells: pa.Table) -> pa.Table:
            if not part.num_rows:
                return cells
            held = CuckooFilter.load(cells.column("filter")[0].as_py()) if cells.num_rows else CuckooFilter.sized(max(size, part.num_rows))
            getattr(held, change)(part.column("k1").to_numpy())
            return pa.table({"shard": part.column("shard").slice(0, 1), "filter": pa.array([held.dump()], pa.binary())})

        dealt = self._dealt(keys, n_shards)
        return self.tables.save(dealt.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(alter, "shard int, filter binary"))

    def _probed(self, keys: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
        def look(part: pa.Table, cells: pa.Table) -> pa.Table:
            seen = CuckooFilter.load(cells.column("filter")[0].as_py()).contains(part.column("k1").to_numpy()) if cells.num_rows and part.num_rows else np.zeros(part.num_rows, bool)
            return pa.table({"k1": part.column("k1"), "maybe": pa.array(seen)})

        return self._dealt(keys, n_shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(look, "k1 bigint, maybe boolean")

    def probe(self, batch: DataFrame) -> DataFrame:
        """(k1, maybe) of a batch's distinct keys: false means that no document of the index has the key."""
        ship(batch.sparkSession)
        keys = _lines(batch, self.min_chars).select("k1").distinct()
        return keys.withColumn("maybe", F.lit(False)) if self.filters is None else self._probed(keys, self.filters, self.n_shards)

    def insert(self, batch: DataFrame, replace: bool = True) -> LineIndex:
        """The index with a batch's documents in it.  replace=False: none of its doc_ids is in the index yet."""
        spark = batch.sparkSession
        ship(spark)
        self.tables = self.tables or Scratch(spark)
        if self.parts and replace:
            return self.delete(batch.select("doc_id"))._added(batch)
        return self._added(batch)

    def _added(self, batch: DataFrame) -> LineIndex:
        tables = self.tables
        lines = tables.save(_lines(batch, self.min_chars))
        keys = tables.save(lines.select("k1").distinct())
        n_keys, n_shards, filters = self.n_keys + keys.count(), self.n_shards, self.filters
        while n_keys > n_shards * self.shard_keys:
            n_shards *= 2
        if filters is None:
            return self._with([lines], self._built(keys, n_shards), n_keys, n_shards)
        if n_shards != self.n_shards:
            filters = self._built(self.lines.select("k1").distinct(), n_shards)
        probed = tables.save(self._probed(keys, filters, n_shards))
        known = tables.save(probed.where("maybe").select("k1").join(self.lines.select("k1").distinct(), "k1", "left_semi"))
        fresh = tables.save(probed.select("k1").join(known, "k1", "left_anti"))
        out = self._with([*self.parts, lines], self._changed(filters, fresh, n_shards, "insert"), self.n_keys + fresh.count(), n_shards)
        tables.drop(keys, probed, known, fresh)
        return out

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without documents; a key becomes free when its last document goes."""
        if not self.parts:
            return self
        ids = self.tables.save(doc_ids.select("doc_id").where("doc_id is not null").distinct())
        lines = self.lines
        left = self.tables.save(lines.join(ids, "doc_id", "left_anti").select(*lines.columns))
        gone = lines.join(ids, "doc_id", "left_semi").select("k1").distinct()
        freed = self.tables.save(gone.join(left.select("k1").distinct(), "k1", "left_anti"))
        out = self._with([left], self._changed(self.filters, freed, self.n_shards, "delete"), self.n_keys - freed.count(), self.n_shards)
        self.tables.drop(ids, freed)
        return out

    def apply(self, docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
        """`docs` deduplicated against the index; `lines`: theirs, if the index has them already."""
        tables = self.tables = self.tables or Scratch(docs.sparkSession)
        lines = _lines(docs, self.min_chars) if lines is None else lines
        if not self.parts:
            return _without(docs, lines, lines.select("k1", "k2", F.col("doc_id").alias("first_doc")).limit(0))
        return _without(docs, lines, tables.save(self.counts().where("n_docs > 1").select("k1", "k2", "first_doc")))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """`docs` with repeated lines gone from `text`, plus n_lines (before) and n_dropped.

    A key found in two documents or more stays only in the smallest doc_id that holds it.
    """
    index = LineIndex(min_chars)
    for k in range(batches):
        index = index.insert(docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), replace=False)
    return index.apply(docs, index.lines)
