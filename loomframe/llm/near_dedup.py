"""MinHash near-dedup with HyperMinHash registers.

Each document's shingles fall into REGISTERS buckets by hash; a bucket keeps its smallest hash as a
register of 16 bits (leading zeros and ten mantissa bits).  Each set is looked up by keys:

* A set of few shingles is put in one order, rare shingles first, and its keys are the first ones, so
  many that linked sets share one of them for certain: no link of small sets is missed.
* Larger sets have BANDS bands of REGISTERS // BANDS consecutive registers as keys: two sets of
  similarity 0.85 share none with probability 7e-9, of 0.8 with 3e-6.
* Sets that may be linked with sets of both kinds have both kinds of keys.

Documents with equal sets are one class.  Classes that share a key are first compared with the
smallest class there (a star): a pair is kept by the registers' collision-corrected Jaccard estimate
(with a margin of six standard errors), then confirmed on both full sets.  Classes that share a key
with another component after that are searched once more, exactly: each set is put in one order,
rare shingles first, and pairs across components are those that share a shingle of both prefixes
where positions and sizes still allow the threshold.  Texts that merely share a passage or a template,
however many, share no such place, so groups of them cost no pairs.  These too are confirmed on both
full sets.

Cases: null texts and texts without words have no set: they link with nothing and are components of
their own.  Fewer words than a shingle give one shingle.  Rows without a doc_id are left out.  Rows
that share a doc_id and a set are one row's worth; rows that share a doc_id with other sets belong
together, as the id is what is linked.  A text is held whole by one task, however long.  Columns but
doc_id and text are not read and not returned.  Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, chunks, cut, mix, prefix_hash, range_hash, ship, words
from .components import components

REGISTERS = 160
BANDS = 32
MANTISSA_BITS = 10
EMPTY = 0xFFFF
#: Counters that tell frequent shingles from rare ones; only the order of search depends on them.
COUNTERS = 1 << 20
#: Sets with one token beyond which they are told apart by size as well, in classes that grow by SIZE_STEP.
COMMON = 100
SIZE_STEP = 1.02
#: Pairs that one copy of a set serves.
TOGETHER = 256
#: Ids that may be sent to every task (16 MB at most); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    texts.data = LOWER[texts.data]
    start, end, first = words(texts, _IS_WORD)
    w = range_hash(prefix_hash(texts.data), start, end)
    runs = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for k in range(size):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(runs)]
    runs = mix(runs)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
        elif hi > lo:
            one = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                one = one * np.uint64(0xC2B2AE3D27D4EB4F) + w[k]
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, REGISTERS) of uint16: leading zeros of the smallest hash in the bucket, then its next bits."""
    n = len(sets)
    least = np.full(n * REGISTERS, 1 << 32, np.uint64)
    every = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    bucket = ((every >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    value = mix(every) >> np.uint64(32)
    np.minimum.at(least, row * REGISTERS + bucket.astype(np.int64), value)
    part, power = np.frexp(least.astype(np.float64))  # value = part * 2**power, part in [0.5, 1)
    zeros = np.where(least > 0, 32 - power, 32).astype(np.int64)
    mantissa = np.where(least > 0, (part * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.int64)
    out = (zeros << MANTISSA_BITS | mantissa).astype(np.uint16)
    out[least == 1 << 32] = EMPTY
    return out.reshape(n, REGISTERS)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of row pairs from registers, without the matches expected by chance.

    Two unrelated registers are equal with a probability that their density gives: about
    2**-(MANTISSA_BITS + 1) once shingles outnumber buckets, as hashes of one magnitude share leading zeros.
    """
    used = (left != EMPTY) | (right != EMPTY)
    equal = ((left == right) & used).sum(1)
    total = np.maximum(used.sum(1), 1)
    chance = total * 2.0 ** -(MANTISSA_BITS + 1) * (np.minimum(n_left, n_right) > 0)
    return np.clip((equal - chance) / np.maximum(total - chance, 1), 0, 1)


def _is_large(n: int, num: int, den: int) -> bool:
    """Whether sets of n shingles are looked up by bands, unless the other set of a pair is not large."""
    return n * (den - num) + num >= BANDS * num


def _meets_small(n: int, num: int, den: int) -> bool:
    """Whether sets of n shingles may be linked with sets that are not large."""
    return n == 0 or not _is_large(-(-n * num // den), num, den)


def _prefix(one: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set, rare ones first: of two linked sets these share one at least."""
    n = len(one)
    order = np.lexsort((one, common[(one & np.uint64(COUNTERS - 1)).astype(np.int64)]))
    return one[order[: n - -(-num * n // den) + 1]]


def lookup_keys(sets: list[np.ndarray], regs: np.ndarray, common: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """64-bit keys of each set: linked small sets share one for certain, larger ones nearly so."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(sets)
    with np.errstate(over="ignore"):
        rows = [i for i, one in enumerate(sets) if _is_large(len(one), num, den)]
        if rows:
            part = regs[rows]
            # bands of equal width that cover every register
            edges = np.linspace(0, REGISTERS, BANDS + 1).astype(int)
            salt = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64))
            mixed = mix(part.astype(np.uint64) + salt)
            mixed[part == EMPTY] = 0
            sums = np.add.reduceat(mixed, edges[:-1], axis=1)
            full = np.add.reduceat((part != EMPTY).astype(np.int64), edges[:-1], axis=1) > 0
            keys = mix(sums + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(17)))
            for i, k, ok in zip(rows, keys, full, strict=True):
                out[i] = k[ok]
        for i, one in enumerate(sets):
            if len(one) and _meets_small(len(one), num, den):
                out[i] = np.concatenate([out[i], mix(_prefix(one, common, num, den) + np.uint64(1017))])
    return out


def _sketches(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, regs, keys): s1 and s2 tell sets apart."""
    sent = docs.sparkSession.sparkContext.broadcast(_rarity(docs.where("doc_id is not null"), size, lambda n: _meets_small(n, num, den)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(Texts(part.column("text")), size)
                n = np.array([len(s) for s in sets], np.int64)
                regs = registers(sets)
                keys = lookup_keys(sets, regs, sent.value, num, den)
                with np.errstate(over="ignore"):
                    s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    s2 = np.array([mix(s + np.uint64(77)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                flat = np.concatenate(keys).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2), pa.array([r.tobytes() for r in regs], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "n_shingles", "s1", "s2", "regs", "keys"],
                )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(make, "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, regs binary, keys array<bigint>")


def _likely(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose registers estimate one within six standard errors."""
    side = lambda x: sketches.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")
    goal = num / den

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n_a, n_b = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                left, right = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                used = np.maximum(1, ((left != EMPTY) | (right != EMPTY)).sum(1))
                ok = estimate(left, right, n_a, n_b) >= goal - 6 * np.sqrt(goal * (1 - goal) / used)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(keep, "a bigint, b bigint")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in `ids`, which must hold each doc_id once."""
    few = ids.count() <= BROADCAST_IDS
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id")


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of `pairs` whose full sets are similar enough.

    The set of `a` is sent once for each TOGETHER of its pairs, and read before theirs.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                made = shingle_sets(Texts(part.column("text")), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in made], pa.binary())], ["id", "set"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for a, b, part in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("set"), strict=True):
                y = np.frombuffer(part.as_buffer(), np.uint64)
                if b is None:
                    first, x = a, y.copy()
                    ok.append(False)
                    continue
                if a != first:
                    raise RuntimeError(f"the set of {a} is missing")
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * same >= num * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    full = cut(_texts_of(docs, wanted).mapInArrow(sets, "id bigint, set binary"))
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    heads = many.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"))
    rows = heads.join(full, F.col("a") == F.col("id")).unionByName(dealt.join(full, F.col("b") == F.col("id"))).select("a", "part", "b", "set")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "set").mapInArrow(test, "a bigint, b bigint").distinct()


def _rarity(texts: DataFrame, size: int, counted: Callable[[int], bool] = bool) -> np.ndarray:
    """How common shingles are in sets of `counted` sizes, in COUNTERS hashed counters: a table of fixed size.

    Each task leaves out what it has seen once; the counts steer the order of search and nothing else.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                for one in shingle_sets(Texts(part.column("text")), size):
                    if not counted(len(one)):
                        continue
                    total[(one & np.uint64(COUNTERS - 1)).astype(np.int64)] += 1
        some = np.flatnonzero(total > 1)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for row in texts.select("text").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["at"]] = row["n"]
    return out


def _across(placed: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of `placed` (doc_id, component) from different components that prefixes and positions leave."""
    spark = docs.sparkSession
    texts = _texts_of(docs, placed)
    sent = spark.sparkContext.broadcast(_rarity(texts, size))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = sent.value
        for batch in batches:
            for part in chunks(batch):
                rows, tokens, places, sizes = [], [], [], []
                for i, one in enumerate(shingle_sets(Texts(part.column("text")), size)):
                    n = len(one)
                    if n:
                        tokens.append(_prefix(one, common, num, den))
                        keep = len(tokens[-1])
                        rows.append(np.full(keep, i))
                        places.append(np.arange(keep))
                        sizes.append(np.full(keep, n))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    flat = [pa.array(np.concatenate(x).astype(np.int64)) for x in (places, sizes)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("component").take(at), pa.array(np.concatenate(tokens).view(np.int64)), *flat], ["doc_id", "component", "token", "place", "n"])

    found = cut(texts.mapInArrow(prefixes, "doc_id bigint, component bigint, token bigint, place bigint, n bigint"))
    shared = found.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("times")).where("low != high").select("token", "times")
    found = found.join(shared, "token")
    # of a common token, by classes of the partner's size that the place still allows
    own = f"cast(floor(ln(n) / {math.log(SIZE_STEP)}) as int)"
    least, most = f"cast(floor(ln(ceil(n * {num} / {den})) / {math.log(SIZE_STEP)}) as int)", f"cast(floor(ln(greatest(1, floor((n - place) * {num + den} / {num}) - n)) / {math.log(SIZE_STEP)}) as int)"
    keyed = found.withColumn("own", F.expr(f"if(times > {COMMON}, {own}, 0)")).withColumn("other", F.explode(F.expr(f"if(times > {COMMON}, if({least} <= {most}, sequence({least}, {most}), array()), array(0))")))
    keyed = keyed.select("doc_id", "component", "token", "place", "n", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    key = ["token", "low", "high"]
    open_ = keyed.groupBy(*key).agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("own").alias("o1"), F.max("own").alias("o2")).where("c1 != c2 and o1 = low and o2 = high").select(*key)
    keyed = cut(keyed.join(open_, key, "left_semi"))
    side = lambda x: keyed.select(*key, *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "component", "place", "n", "own")])
    bound = f"{num + den} * least(n_a - place_a, n_b - place_b) >= {num} * (n_a + n_b)"
    both = side("a").join(side("b"), key)
    # the smaller size class comes first, so that each pair is met once
    return both.where(f"own_a = low and own_b = high and (low != high or doc_id_a < doc_id_b) and component_a != component_b and {bound}").select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` that has a doc_id.

    Links: den * |intersection| >= num * |union| of the distinct `size`-word shingles.
    """
    ship(docs.sparkSession)
    rows = cut(_sketches(docs, size, num, den))
    slim = rows.select("doc_id", "n_shingles", "s1", "s2")
    same = ["n_shingles", "s1", "s2"]
    # classes of equal sets; the smallest id of a class stands for it
    classes = cut(slim.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")))
    sketches = rows.join(classes, same).where("doc_id = rep").dropDuplicates(["rep", *same])
    banded = sketches.select("rep", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub != last").select("key", "hub")
    members = cut(banded.join(shared, "key").select("key", "rep", "hub"))
    stars = members.where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    linked = cut(_confirm(cut(_likely(stars, sketches.select("rep", "n_shingles", "regs"), num, den)), docs, size, num, den))
    found = components(linked)
    # classes that share a key with another component
    placed = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    left = cut(placed.join(apart, "key").select(F.col("rep").alias("doc_id"), "component").distinct())
    late = cut(_confirm(cut(_across(left, docs, size, num, den)), docs, size, num, den))
    # an id that carries several texts joins their classes
    member = slim.where("n_shingles > 0").join(classes, same)
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")
    more = cut(late.unionByName(twice))
    if more.head(1):
        found = components(linked.unionByName(more))
    out = slim.join(classes, same, "left").join(found, F.col("rep") == found.node, "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
