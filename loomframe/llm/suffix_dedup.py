"""Exact removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else.  Only some
suffixes are indexed: each string of `length` bytes names one *anchor*, the place of the smallest hash
of GRAM bytes among its first SPAN places, so equal strings name the same place and one suffix in about
SPAN / 2 is enough.  An entry of an array is such a suffix:

* `head`: its first eight bytes, as a number of the same order; the array is in this order.
* `core`: a hash of its first `length` - SPAN + 1 bytes, which all strings of the anchor share.
* `whole`: a hash of all bytes around the anchor that its strings reach.  Entries of equal core and
  whole are one entry with a count and one place, so copies of a passage are one entry.

Arrays lie in shards by core and whole, one sorted block of numbers each, so Spark moves blocks and
numpy sorts and scans them.  A batch gets an array, and each shard of it is merged with those of the
family: what becomes neighbours and is equal (by 128 bits) matches as a whole, for every string of the
anchor.  Cores found with different wholes match in part: these anchors wait until the strings are asked
for.  Then the bytes around them are fetched from the texts, once for all batches, sorted in suffix order
and in the order of what stands before the anchor, and compared with their neighbours, byte by byte: a
string that reaches d bytes back has a match if another anchor agrees with it in d bytes before and
`length` - d bytes after.  Cores with over COMMON kinds of surroundings are first cut into blocks of BLOCK
strings and then single strings, which are counted by two hashes of 64 bits, so no task gathers such a
group.  Before a batch comes, arrays of one rank merge into one of the next rank, so n batches keep
log2(n) arrays.  Copies are combined before they are sent, and a shard whose places are many is dealt to
several tasks.

Cases: null text is empty.  Texts shorter than `length` lose nothing.  Rows are documents, whatever
their doc_id: of two equal rows both lose their bytes.  Matches never cross rows.  Extra columns stay, of
any name but those of the results, which are replaced.  An empty table gives an empty result.  A text
is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Texts, _power, chunks, mix, plain_names, prefix_hash, range_hash, ship

LENGTH = 200
#: Strings that one anchor can stand for; `length` must be larger by GRAM.
SPAN = 160
#: Strings in a block of a suffix with many surroundings.
BLOCK = 16
#: Bytes whose hash ranks a place.
GRAM = 8
#: Bytes of text worked on at once: a place in it and 15 bits of its hash share one number.
PIECE = 1 << 17
#: Surroundings of one suffix that a task may compare.
COMMON = 1000
#: Surroundings compared at once, if no suffix has more.
_AT_ONCE = 1 << 14
#: Batches that a table is inserted in.
BATCHES = 3
#: Entries that a task gathers before it deals them to shards.
GATHERED = 1 << 18
#: Bytes of a table for which there is one shard more.
SHARD_BYTES = 4 << 20
#: Entries of a shard for one task, where places are marked.
DEALT = 1 << 21

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _second_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums like prefix_hash(), with a number of 64 bits for each byte."""
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def _ranks(data: np.ndarray) -> np.ndarray:
    """For each place but the last GRAM - 1: a hash of the GRAM bytes there, and the place in the lower bits (32 bits are worked on fastest)."""
    wide = data.astype(np.uint32)
    two = wide[:-1] | wide[1:] << np.uint32(8)
    four = two[:-2] | two[2:] << np.uint32(16)
    rank = four[:-4] * np.uint32(0x9E3779B1) + four[4:] * np.uint32(0x85EBCA6B)
    rank ^= rank >> np.uint32(15)
    rank *= np.uint32(0xC2B2AE35)
    rank ^= rank >> np.uint32(13)
    rank *= np.uint32(0x27D4EB2F)
    rank &= ~np.uint32(PIECE - 1)
    rank |= np.arange(len(rank), dtype=np.uint32)
    return rank


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def anchors(texts: Texts, length: int, piece: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, low, high): the strings that start low to high bytes before the place name it."""
    data, piece = texts.data, piece or PIECE - 2 * length
    long = np.flatnonzero(texts.end - texts.start >= length)
    found = []
    for at in range(0, len(data) if len(long) else 0, piece):
        part = data[at : at + piece + SPAN + GRAM - 2]
        if len(part) < SPAN + GRAM - 1:
            break
        best = _least(_ranks(part), SPAN)
        low = np.clip(texts.start[long] - at, 0, len(best))
        high = np.clip(texts.end[long] - length + 1 - at, low, len(best))
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        low, high = low[some], high[some]
        # strings that follow one another in a row and name one place
        lead = np.unique(np.concatenate([np.flatnonzero(best[1:] != best[:-1]) + 1, low, high]))
        last = np.append(lead[1:], len(best)) - 1
        mine = np.searchsorted(low, lead, "right") - 1
        keep = (mine >= 0) & (lead < high[mine])
        lead, last = lead[keep], last[keep]
        place = (best[lead] & np.uint32(PIECE - 1)).astype(np.int64)
        found.append((place + at, place - last, place - lead))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    place, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    row = np.searchsorted(texts.offsets, place - high, "right") - 1
    # the last strings of a piece and the first of the next may name one place: that is one anchor
    lead = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    return row[lead], place[lead], np.minimum.reduceat(low, lead), np.maximum.reduceat(high, lead)


def _hashes(texts: Texts, row: np.ndarray, place: np.ndarray, first: np.ndarray, block: int, length: int, piece: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(core, whole) of the blocks of strings that start `first` to `first + block - 1` bytes before each place."""
    core, whole, piece = np.empty(len(place), np.uint64), np.empty(len(place), np.uint64), piece or PIECE
    for at in range(0, len(texts.data), piece):
        some = np.flatnonzero((place >= at) & (place < at + piece)) if len(texts.data) > piece else np.arange(len(place))
        if not len(some):
            continue
        base = max(0, at - SPAN)
        part = texts.data[base : at + piece + length]
        x, f, r = place[some], first[some], row[some]
        sums = prefix_hash(part)
        # with `first` in the hash, the entries of a core in one round come from those of one core in the round before
        core[some] = mix(range_hash(sums, x - f - base, x - f - block + 1 + length - base) + f.astype(np.uint64))
        low = np.maximum(texts.start[r], x - f - block + 1)
        high = np.minimum(texts.end[r], x - f + length)
        # how far the text reaches belongs to the hash: blocks cut short match only blocks cut alike
        reach = (x - low).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (high - x).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        whole[some] = mix(range_hash(_second_prefix(part) if block == 1 else sums, low - base, high - base) + reach)
    return core, whole


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a column whose values are all `width` bytes long."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    column = column.cast(pa.large_binary())
    return np.frombuffer(column.buffers()[2], np.uint8)[column.offset * width :][: len(column) * width].reshape(-1, width)


def _pack(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return place << 16 | high << 8 | low


# columns of a block of entries, and of a block of an array
_E_CORE, _E_WHOLE, _E_DOC, _E_AT, _E_HEAD = range(5)
_A_CORE, _A_WHOLE, _A_N, _A_DOC, _A_AT, _A_HEAD = range(6)


def _block(value: pa.Scalar | bytes, width: int) -> np.ndarray:
    return np.frombuffer(value if isinstance(value, bytes) else value.as_buffer(), np.int64).reshape(-1, width)


def _dealt(key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, its rows), rows of one key together already."""
    if len(key):
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            yield int(key[lo]), rows[lo:hi]


def _blocks_batch(made: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([len(m) for _, m in made], pa.int64()), pa.array([m.tobytes() for _, m in made], pa.binary())], ["s", "size", "block"])


_BLOCKS = "s bigint, size bigint, block binary"


def _shard_of(core: np.ndarray, whole: np.ndarray, shards: int) -> np.ndarray:
    return (mix(core.view(np.uint64) ^ mix(whole.view(np.uint64))) % np.uint64(shards)).astype(np.int64)


def _core_shard(core: np.ndarray, shards: int) -> np.ndarray:
    return (mix(core.view(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _entries(texts: DataFrame, length: int, shards: int) -> DataFrame:
    """Blocks of entries by shard, one for each anchor of `texts` (doc, text), sorted by core and whole."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        key = _shard_of(rows[:, _E_CORE], rows[:, _E_WHOLE], shards)
        order = np.lexsort((rows[:, _E_WHOLE], rows[:, _E_CORE], key))
        return _blocks_batch(list(_dealt(key[order], rows[order])))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in chunks(batch, most=PIECE):
                texts = Texts(part.column("text"))
                row, place, low, high = anchors(texts, length)
                if not len(row):
                    continue
                # the first eight bytes of a suffix as a number of the same order
                head = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(texts.data, 8)[place]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                core, whole = _hashes(texts, row, place, np.zeros_like(place), SPAN, length)
                held.append(np.column_stack([core.view(np.int64), whole.view(np.int64), part.column("doc").to_numpy()[row], _pack(place - texts.start[row], low, high), head.view(np.int64)]))
                if sum(map(len, held)) >= GATHERED:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return texts.mapInArrow(make, _BLOCKS)


def _combined(rows: np.ndarray) -> np.ndarray:
    """Rows of an array sorted by core and whole: equal ones as one, with the count (2 at most) and the first place."""
    lead = np.flatnonzero(np.concatenate([[True], (rows[1:, _A_CORE] != rows[:-1, _A_CORE]) | (rows[1:, _A_WHOLE] != rows[:-1, _A_WHOLE])])) if len(rows) else np.zeros(0, np.int64)
    out = rows[lead].copy()
    if len(lead):
        out[:, _A_N] = np.minimum(np.add.reduceat(rows[:, _A_N], lead), 2)
    return out


def _by_shard(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """(s, rows of it): rows of one s follow one another; only one s is held."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        for s, *values in zip(batch.column("s").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if s != last and held:
                yield last, held
                held = []
            last = s
            held.append(tuple(values))
    if held:
        yield last, held


def _array(blocks: DataFrame) -> DataFrame:
    """One block a shard, in suffix order, from blocks of arrays."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _by_shard(batches, "block"):
            joined = np.concatenate([_block(b, 6) for (b,) in rows])
            yield _blocks_batch([(s, _combined(joined[np.lexsort((joined[:, _A_WHOLE], joined[:, _A_CORE], joined[:, _A_HEAD]))]))])

    return blocks.repartition("s").sortWithinPartitions("s").mapInArrow(merge, _BLOCKS)


def _first_array(entries: DataFrame) -> DataFrame:
    """The array of a batch; each block of entries is combined before it is sent."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for s, block in zip(batch.column("s").to_pylist(), batch.column("block"), strict=True):
                e = _block(block, 5)
                made.append((s, _combined(np.column_stack([e[:, _E_CORE], e[:, _E_WHOLE], np.ones(len(e), np.int64), e[:, _E_DOC], e[:, _E_AT], e[:, _E_HEAD]]))))
            yield _blocks_batch(made)

    return _array(entries.mapInArrow(combine, _BLOCKS))


def _scanned(array: DataFrame, known: DataFrame | None) -> DataFrame:
    """(s, equal, old): the wholes of a new array that have a match, and the places in known arrays that were alone until now."""
    rows = array.select("s", F.lit(1).alias("new"), "block")
    if known is not None:
        rows = rows.unionByName(known.select("s", F.lit(0).alias("new"), "block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, parts in _by_shard(batches, "new", "block"):
            blocks = [(new, _block(b, 6)) for new, b in parts]
            new = np.concatenate([np.full(len(m), k) for k, m in blocks])
            m = np.concatenate([m for _, m in blocks])
            order = np.lexsort((m[:, _A_WHOLE], m[:, _A_CORE]))
            m, new = m[order], new[order]
            lead = np.flatnonzero(np.concatenate([[True], (m[1:, :2] != m[:-1, :2]).any(1)])) if len(m) else np.zeros(0, np.int64)
            group = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(m))))
            hit = (np.add.reduceat(m[:, _A_N], lead) > 1) & (np.maximum.reduceat(new, lead) > 0) if len(lead) else np.zeros(0, bool)
            alone = hit[group] & (new == 0) & (m[:, _A_N] == 1)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([m[lead[hit], :2].tobytes()], pa.binary()), pa.array([m[alone][:, [_A_DOC, _A_AT]].tobytes()], pa.binary())], ["s", "equal", "old"])

    return rows.repartition("s").sortWithinPartitions("s").mapInArrow(scan, "s bigint, equal binary, old binary")


def _mixed(array: DataFrame, known: DataFrame | None, shards: int) -> DataFrame:
    """(s, block): the cores by shard of theirs that have different wholes, one at least in the new array."""
    rows = array.select(F.lit(1).alias("new"), "block")
    if known is not None:
        rows = rows.unionByName(known.select(F.lit(0).alias("new"), "block"))

    def kinds(core: np.ndarray, low: np.ndarray, high: np.ndarray, new: np.ndarray) -> np.ndarray:
        lead = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]])) if len(core) else np.zeros(0, np.int64)
        return np.column_stack([core[lead], np.minimum.reduceat(low, lead), np.maximum.reduceat(high, lead), np.maximum.reduceat(new, lead)]) if len(lead) else np.zeros((0, 4), np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for new, block in zip(batch.column("new").to_pylist(), batch.column("block"), strict=True):
                m = _block(block, 6)  # equal cores follow one another, as their heads are equal
                some = kinds(m[:, _A_CORE], m[:, _A_WHOLE], m[:, _A_WHOLE], np.full(len(m), new))
                key = _core_shard(np.ascontiguousarray(some[:, 0]), shards)
                order = np.argsort(key, kind="stable")
                yield _blocks_batch(list(_dealt(key[order], some[order])))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, parts in _by_shard(batches, "block"):
            m = np.concatenate([_block(b, 4) for (b,) in parts])
            m = m[np.argsort(m[:, 0], kind="stable")]
            some = kinds(*m.T)
            yield _blocks_batch([(s, np.ascontiguousarray(some[(some[:, 1] != some[:, 2]) & (some[:, 3] > 0), :1]))])

    return rows.mapInArrow(send, _BLOCKS).repartition("s").sortWithinPartitions("s").mapInArrow(meet, _BLOCKS).where("size > 0")


def _told(rows: DataFrame, told: DataFrame, test: Callable[[np.ndarray, bytes], pa.RecordBatch], width: int, schema: str) -> DataFrame:
    """Blocks (s, size, block) met with what is told (s, block) of their shard; a large shard is dealt to several tasks, each of which is told."""
    parts = F.broadcast(rows.groupBy("s").agg(F.ceil(F.sum("size") / DEALT).alias("parts")))  # a row a shard
    left = rows.join(parts, "s").select("s", F.pmod(F.xxhash64("block"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), "block")
    right = told.join(parts, "s").select("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, said = None, b""
        for batch in batches:
            for s, part, kind, block in zip(*(batch.column(c).to_pylist() for c in ("s", "part", "kind", "block")), strict=True):
                if kind == 0:
                    at, said = (s, part), block
                elif at == (s, part) and said:
                    yield test(_block(block, width), said)

    return right.unionByName(left).repartition("s", "part").sortWithinPartitions("s", "part", "kind").mapInArrow(run, schema)


def _marked(entries: DataFrame, equal: DataFrame) -> DataFrame:
    """(doc, at) of the entries whose whole is among `equal`."""

    def test(e: np.ndarray, said: bytes) -> pa.RecordBatch:
        told = _block(said, 2)
        one = lambda m: mix(m[:, 0].view(np.uint64) + mix(np.ascontiguousarray(m[:, 1]).view(np.uint64)))
        key = one(np.ascontiguousarray(told))
        order = np.argsort(key)
        there = order[np.minimum(np.searchsorted(key[order], one(np.ascontiguousarray(e[:, :2]))), len(key) - 1)]
        e = e[(told[there] == e[:, :2]).all(1)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, _E_DOC])), pa.array(np.ascontiguousarray(e[:, _E_AT]))], ["doc", "at"])

    return _told(entries, equal, test, 5, "doc bigint, at bigint")


def _chosen(arrays: DataFrame, mixed: DataFrame, shards: int) -> DataFrame:
    """(core, doc, at, n) of the rows of arrays whose core is among `mixed`."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                m = _block(block, 6)
                key = _core_shard(np.ascontiguousarray(m[:, _A_CORE]), shards)
                order = np.argsort(key, kind="stable")
                yield _blocks_batch(list(_dealt(key[order], m[order][:, [_A_CORE, _A_DOC, _A_AT, _A_N]])))

    def test(m: np.ndarray, said: bytes) -> pa.RecordBatch:
        m = m[np.isin(m[:, 0], _block(said, 1)[:, 0])]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in m.T], ["core", "doc", "at", "n"])

    return _told(arrays.select("block").mapInArrow(send, _BLOCKS), mixed.select("s", "block"), test, 4, "core bigint, doc bigint, at bigint, n bigint")


def _places(blocks: DataFrame, column: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(column):
                m = _block(block, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m[:, k])) for k in (0, 1)], ["doc", "at"])

    return blocks.select(column).mapInArrow(read, "doc bigint, at bigint")


def _surroundings(texts: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(suffix, doc, at, n, common, around) of the anchors `chosen` (doc, at, n, common): the SPAN - 1 bytes before and `length` after each, or zeros beyond the text."""
    before, width = SPAN - 1, length - SPAN + 1
    lists = chosen.groupBy("doc").agg(*[F.collect_list(c).alias(c) for c in ("at", "n", "common")])
    joined = texts.join(lists.hint("shuffle_hash"), "doc").select("doc", "text", "at", "n", "common")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                held, lists = Texts(part.column("text")), part.column("at")
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                every, more = lists.flatten().to_numpy(), [part.column(c).flatten() for c in ("n", "common")]
                for a in range(0, len(row), _AT_ONCE):
                    r, at = row[a : a + _AT_ONCE], every[a : a + _AT_ONCE]
                    spot = ((at >> 16) + held.start[r])[:, None] + np.arange(-before, length)
                    inside = (spot >= held.start[r][:, None]) & (spot < held.end[r][:, None])
                    around = np.where(inside, held.data[np.where(inside, spot, 0)], 0).astype(np.uint8)
                    made = [_binary(around[:, before : before + width]), part.column("doc").take(pa.array(r)), pa.array(at), *[c.slice(a, _AT_ONCE) for c in more], _binary(around)]
                    yield pa.RecordBatch.from_arrays(made, ["suffix", "doc", "at", "n", "common", "around"])

    return joined.mapInArrow(make, "suffix binary, doc bigint, at bigint, n bigint, common boolean, around binary")


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings and how many bytes each shares with the one before it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
    sorted_rows = rows[order]
    same = np.ones((len(rows), rows.shape[1] + 1), bool)
    same[:, -1] = False
    same[0, 0] = False
    same[1:, :-1] = sorted_rows[1:] == sorted_rows[:-1]
    return order, np.argmin(same, 1)


def matched(around: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """[k, d]: whether string d of anchor k (from d bytes before it) has an equal one among the other anchors' strings."""
    n, out = len(around), np.zeros((len(around), SPAN), bool)
    if n < 2:
        return out
    after, shared_after = _runs(around[:, SPAN - 1 :])
    before, shared_before = _runs(around[:, SPAN - 2 :: -1])
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        has = np.flatnonzero((low <= d) & (d <= high))
        one[after] = np.cumsum(shared_after < length - d)
        two[before] = np.cumsum(shared_before < d)
        key = one[has] * (n + 1) + two[has]
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        out[has[order], d] = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    return out


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of each run of set flags."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _compared(around: DataFrame, length: int) -> DataFrame:
    """(doc, at) of the strings that have a match; rows of a suffix must lie together."""

    def scan(rows: pa.Table) -> pa.RecordBatch:
        at, n = rows.column("at").to_numpy(), rows.column("n").to_numpy()
        found = matched(_matrix(rows.column("around").combine_chunks(), SPAN - 1 + length), at & 255, at >> 8 & 255, length)
        found[n > 1] = False  # marked as a whole
        row, low, high = _stretches(found)
        return pa.RecordBatch.from_arrays([rows.column("doc").combine_chunks().take(pa.array(row)), pa.array(_pack(at[row] >> 16, low, high))], ["doc", "at"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < _AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            suffix = rows.column("suffix").combine_chunks()
            same = pc.equal(suffix, suffix[len(suffix) - 1]).to_numpy(zero_copy_only=False)
            end = len(suffix) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last suffix may go on
            if end:
                yield scan(rows.slice(0, end))
            held = rows.slice(end).combine_chunks().to_batches()
        if held:
            yield scan(pa.Table.from_batches(held))

    return around.sortWithinPartitions("suffix").mapInArrow(make, "doc bigint, at bigint")


def _blocks(around: DataFrame, block: int, length: int) -> DataFrame:
    """(core, whole, doc, at, n) of the blocks of `block` strings of each anchor; `core` is a hash of what all of them share."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(a, _AT_ONCE)
                at, size = part.column("at").to_numpy(), SPAN - 1 + length
                held = Texts(_binary(np.zeros((0, 1), np.uint8)))
                held.data = _matrix(part.column("around"), size).ravel()
                low, high = at & 255, at >> 8 & 255
                parts = high // block - low // block + 1
                row = np.repeat(np.arange(len(at)), parts)
                first = (low[row] // block + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * block
                place = row * size + SPAN - 1
                # strings outside low to high belong to other anchors or to no text: what they cover is not part of a block
                held.start, held.end = place - np.minimum(high[row], first + block - 1), place - np.maximum(low[row], first) + length
                some = np.arange(len(row))
                core, whole = _hashes(held, some, place, first, block, length)
                spots = _pack(at[row] >> 16, np.maximum(low[row], first), np.minimum(high[row], first + block - 1))
                made = [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), part.column("doc").take(pa.array(row)), pa.array(spots), part.column("n").take(pa.array(row))]
                yield pa.RecordBatch.from_arrays(made, ["core", "whole", "doc", "at", "n"])

    return around.mapInArrow(make, "core bigint, whole bigint, doc bigint, at bigint, n bigint")


def _one_each(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("core", "whole").agg(F.sum("n").alias("n"), F.first("doc").alias("doc"), F.first("at").alias("at"))


class SuffixIndex:
    """The family of arrays over the batches inserted so far, and what matches in them.

    `spans` may be asked for after any batch.  Batches are (doc, text) with a number of its own for each row;
    they must read the same whenever they are read.
    """

    def __init__(self, length: int = LENGTH, shards: int = 8):
        if length < SPAN + GRAM:
            raise ValueError(f"length must be {SPAN + GRAM} at least")
        self.length, self.shards = length, shards
        self.levels: list[tuple[int, DataFrame]] = []  # (rank, array), ranks fall
        self.texts: list[DataFrame] = []
        self.marks: list[DataFrame] = []  # (doc, at)
        self.partial: list[DataFrame] = []  # (core, doc, at, n) of anchors to compare
        self.tables: Scratch | None = None

    def insert(self, texts: DataFrame) -> SuffixIndex:
        """Scan a batch against itself and the arrays, and add its array to them."""
        ship(texts.sparkSession)
        self.tables = tables = self.tables or Scratch(texts.sparkSession)
        self._merge()
        self.texts.append(texts)
        entries = tables.save(_entries(texts, self.length, self.shards))
        array = tables.save(_first_array(entries))
        known = reduce(DataFrame.unionByName, [x for _, x in self.levels]) if self.levels else None
        scanned = tables.save(_scanned(array, known))
        self.marks.append(tables.save(_marked(entries, scanned.select("s", F.col("equal").alias("block")))))
        tables.drop(entries)
        if known is not None:
            self.marks.append(_places(scanned, "old"))
        mixed = tables.save(_mixed(array, known, self.shards))
        self.partial.append(tables.save(_chosen(array if known is None else array.unionByName(known), mixed, self.shards)))
        tables.drop(mixed)
        self.levels.append((0, array))
        return self

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self.tables.save(_array(a.unionByName(b)))))
            self.tables.drop(a, b)

    def _resolve(self) -> None:
        """Compare the anchors that match others in part."""
        if not self.partial:
            return
        tables, length = self.tables, self.length
        chosen = reduce(DataFrame.unionByName, self.partial)
        if len(self.partial) > 1:
            chosen = chosen.groupBy("doc", "at").agg(F.max("n").alias("n"), F.first("core").alias("core"))
        common = tables.save(chosen.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > COMMON).select("core", F.lit(True).alias("common")))
        chosen = chosen.join(common, "core", "left").select("doc", "at", "n", F.coalesce("common", F.lit(False)).alias("common"))
        around = tables.save(_surroundings(reduce(DataFrame.unionByName, self.texts), chosen, length))
        tables.drop(*self.partial)
        self.partial = []
        self.marks.append(tables.save(_compared(around.where("not common").select("suffix", "doc", "at", "n", "around").repartition("suffix"), length)))
        if common.head(1):
            self._resolve_common(around.where("common").select("doc", "at", "n", "around"))
        tables.drop(common, around)

    def _resolve_common(self, around: DataFrame) -> None:
        """The same for suffixes with many surroundings: blocks of strings, then single ones, are counted."""
        tables, length = self.tables, self.length
        blocks = tables.save(_blocks(around, BLOCK, length))
        kinds = tables.save(_one_each(blocks))
        self.marks.append(tables.save(blocks.select("core", "whole", "doc", "at").join(kinds.where("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("doc", "at")))
        mixed = kinds.groupBy("core").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a != b").select("core")
        inner = kinds.select("core", "doc", "at", "n").join(mixed, "core", "left_semi").select("doc", F.shiftright("at", 16).alias("place"), F.col("at").alias("part"), F.least("n", F.lit(2)).alias("n"))
        singles = around.select("doc", F.shiftright("at", 16).alias("place"), "around").join(inner, ["doc", "place"]).select("doc", F.col("part").alias("at"), "n", "around")
        strings = tables.save(_blocks(singles, 1, length))
        twice = strings.groupBy("core", "whole").agg(F.sum("n").alias("n")).where("n > 1").select("core", "whole")
        self.marks.append(tables.save(strings.select("core", "whole", "doc", "at").join(twice, ["core", "whole"], "left_semi").select("doc", "at")))
        tables.drop(blocks, kinds, strings)

    def spans(self) -> DataFrame:
        """(doc, spans): what to remove of each document that has any, as start, end, start, end, ... in bytes."""
        length = self.length
        self._resolve()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column, out = batch.column("at"), []
                ends, flat = column.offsets.to_numpy(), column.flatten().to_numpy()
                for lo, hi in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True):
                    at = flat[lo:hi]
                    place, low, high = at >> 16, at & 255, at >> 8 & 255
                    order = np.argsort(place - high)
                    start, end = (place - high)[order], np.maximum.accumulate((place - low)[order] + length)
                    new = np.concatenate([[True], start[1:] > end[:-1]])
                    last = np.concatenate([new[1:], [True]])
                    out.append(np.column_stack([start[new], end[last]]).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.list_(pa.int64()))], ["doc", "spans"])

        marks = reduce(DataFrame.unionByName, self.marks)
        return marks.groupBy("doc").agg(F.collect_list("at").alias("at")).mapInArrow(merge, "doc bigint, spans array<bigint>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """`docs` plus kept (bytes that stay), n_bytes, n_removed and n_spans; rows go in as `batches` batches."""
    results = ["kept", "n_bytes", "n_removed", "n_spans"]
    plain, names, (text,) = plain_names(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results]), "text")
    tables = Scratch(docs.sparkSession)
    # numbers of their own for the rows, equal or not, that stay the same whenever a task runs again
    rows = tables.save(plain.withColumn("doc", F.monotonically_increasing_id()).withColumn("batch", F.pmod("doc", F.lit(batches))), "batch")
    index = SuffixIndex(length, max(1, tables.size(rows) // SHARD_BYTES))
    index.tables = tables
    for k in range(batches):
        index.insert(rows.where(F.col("batch") == k).select("doc", F.col(text).alias("text")))
    columns = plain.columns
    joined = rows.drop("batch").join(index.spans().hint("shuffle_hash"), "doc", "left").drop("doc")

    def take(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in chunks(batch, text):
                held, column = Texts(part.column(text)), part.column("spans")
                kept, removed, n_spans = [], [], []
                for i in range(part.num_rows):
                    data = held.data[held.start[i] : held.end[i]]
                    cuts = np.zeros(0, np.int64) if not column[i].is_valid else column[i].values.to_numpy()
                    edges = np.concatenate([[0], cuts, [len(data)]])
                    kept.append(b"".join(data[a:b].tobytes() for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True)))
                    removed.append(int((cuts[1::2] - cuts[0::2]).sum())), n_spans.append(len(cuts) // 2)
                made = [pa.array(kept, pa.binary()), pa.array(held.end - held.start), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *made], [*columns, *results])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return joined.mapInArrow(take, schema + ", kept binary, n_bytes bigint, n_removed bigint, n_spans bigint").toDF(*names, *results)
