"""Benchmark decontamination: prefix-filtered join of documents with item-sized windows.

A window is `size` consecutive words of an item (the whole item where it has fewer).  Windows are
seen as sequences of five-word shingles; shingles are ordered by how often they occur in the
documents, and each window is looked for by its rarest shingle alone (for containment of all
shingles the necessary prefix is one).  A hit gives the only place where the window could start;
it must lie inside the document with its full length, and its words are then compared one by one, by
two hashes of 64 bits each.

Cases: null text has no words.  An item without words has no window; a null item_id counts as an
item named "".  Rows of one item_id are one item.  Repeated documents are judged row by row,
each text whole in one task; extra columns of any name stay, but for those of the results, which are
replaced.  Empty tables on either side give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, _power, chunks, mix, plain_names, prefix_hash, range_hash, ship, words

WINDOW = 10
SHINGLE = 5
#: Characters of items that are held at once; a larger benchmark is taken in blocks, each in one pass over the documents.
BLOCK_CHARS = 16_000_000

_IS_WORD = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _IS_WORD[_low : _high + 1] = False

_FOUND = "n_words bigint, runs array<bigint>, items array<string>"


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each lower-cased word, and where each row's words begin."""
    texts.data = LOWER[texts.data]
    start, end, first = words(texts, _IS_WORD)
    return range_hash(prefix_hash(texts.data), start, end), first


def _checks(texts: Texts) -> np.ndarray:
    """Another 64-bit hash of each word, of which only places that matched already are compared."""
    start, end, _ = words(texts, _IS_WORD)
    up, down = _power(len(texts.data) + 1)
    sums = np.zeros(len(texts.data) + 1, np.uint64)
    np.cumsum(_BYTE[texts.data] * up[: len(texts.data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def _shingles(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place on."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return mix(out + np.uint64(size))


@dataclass
class _Index:
    """Windows of a block of items, reached by the hash of one shingle.

    words: all items' words in a row.  key_*: shingles (by hash) with their size.  For an entry, `at`
    is where the window starts in words, `length` its words, `offset` the place of its shingle.
    """

    words: np.ndarray
    checks: np.ndarray
    sizes: list[int]
    key: np.ndarray
    at: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    item: np.ndarray
    names: list[str]


def _windows(rows: list, size: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], list[str]]:
    """All words by both hashes, (start, length, item) of each window, and the items' names."""
    texts = Texts(pa.array([r["text"] for r in rows], pa.string()))
    w, first = _word_hashes(texts)
    names = sorted({"" if r["item_id"] is None else str(r["item_id"]) for r in rows})
    number = {name: k for k, name in enumerate(names)}
    out = []
    for row, lo, hi in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True):
        item, n = number["" if row["item_id"] is None else str(row["item_id"])], hi - lo
        out += [(at, min(size, n), item) for at in range(lo, hi - min(size, n) + 1)] if n else []
    return w, _checks(texts), out, names


def _candidates(w: np.ndarray, windows: list[tuple[int, int, int]]) -> dict[int, np.ndarray]:
    """For each shingle size in use, its hash at every place of w."""
    return {size: _shingles(w, size) for size in sorted({min(SHINGLE, length) for _, length, _ in windows})}


def _frequencies(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, int]:
    """How often each wanted shingle occurs in all documents; partial counts leave each batch."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({size: np.unique(h) for size, h in wanted.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        total = {size: np.zeros(len(keys), np.int64) for size, keys in tables.items()}
        for batch in batches:
            for part in chunks(batch):
                w, first = _word_hashes(Texts(part.column("text")))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for size, keys in tables.items():
                    h = _shingles(w, size)
                    h = h[row[: len(h)] == row[size - 1 : size - 1 + len(h)]]
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    total[size] += np.bincount(at[keys[at] == h], minlength=len(keys))
        for size, keys in tables.items():
            some = total[size] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[size][some])], ["key", "n"])

    counted = docs.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"]: r["n"] for r in counted}


def _index(docs: DataFrame, rows: list, size: int) -> _Index | None:
    w, checks, windows, names = _windows(rows, size)
    if not windows:
        return None
    hashes = _candidates(w, windows)
    often = _frequencies(docs, hashes)
    counts = {s: np.array([often.get(k, 0) for k in h.view(np.int64).tolist()], np.int64) for s, h in hashes.items()}
    keys, at, length, offset, item = [], [], [], [], []
    for start, n, name in windows:
        s = min(SHINGLE, n)
        rarest = int(np.argmin(counts[s][start : start + n - s + 1]))
        keys.append(hashes[s][start + rarest])
        at.append(start), length.append(n), offset.append(rarest), item.append(name)
    order = np.argsort(np.array(keys, np.uint64), kind="stable")
    pick = lambda x, kind=np.int64: np.array(x, kind)[order]
    return _Index(w, checks, sorted(hashes), pick(keys, np.uint64), pick(at), pick(length), pick(offset), pick(item), names)


def _scan(w: np.ndarray, first: np.ndarray, index: _Index, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, item) of each window found among the rows' words."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found: list[tuple[np.ndarray, ...]] = []
    checks = None
    for size in index.sizes:
        h = _shingles(w, size)
        low = np.searchsorted(index.key, h, "left")
        hit = np.flatnonzero((low < len(index.key)) & (index.key[np.minimum(low, len(index.key) - 1)] == h))
        if not len(hit):
            continue
        n = np.searchsorted(index.key, h[hit], "right") - low[hit]
        place = np.repeat(hit, n)
        entry = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = place - index.offset[entry]
        end = start + index.length[entry]
        # bounds: the shingle size belongs to the window, and the window lies in the same row
        ok = (np.minimum(SHINGLE, index.length[entry]) == size) & (start >= 0) & (end <= len(w))
        start, end, entry = start[ok], end[ok], entry[ok]
        ok = row[start] == row[end - 1]
        start, end, entry = start[ok], end[ok], entry[ok]
        same = np.ones(len(start), bool)
        for k in range(int(index.length[entry].max()) if len(entry) else 0):
            inside = k < index.length[entry]
            here, there = start[inside] + k, index.at[entry[inside]] + k
            checks = _checks(texts) if checks is None else checks
            same[inside] &= (w[here] == index.words[there]) & (checks[here] == index.checks[there])
        found.append((start[same], end[same], index.item[entry[same]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _find(docs: DataFrame, text: str, index: _Index | None) -> DataFrame:
    """`docs` with n_words, hit runs (start, end, start, end, ... in words) and the names of items found."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part in chunks(batch, text):
                texts = Texts(part.column(text))
                w, first = _word_hashes(texts)
                runs: list[list[int]] = [[] for _ in range(part.num_rows)]
                items: list[list[str]] = [[] for _ in range(part.num_rows)]
                if index is not None and len(w):
                    start, end, item = _scan(w, first, index, texts)
                    order = np.argsort(start, kind="stable")
                    row = np.searchsorted(first, start, "right") - 1
                    for k in order.tolist():
                        r, base = int(row[k]), int(first[row[k]])
                        s, e = int(start[k]) - base, int(end[k]) - base
                        if runs[r] and s <= runs[r][-1]:
                            runs[r][-1] = max(runs[r][-1], e)
                        else:
                            runs[r] += [s, e]
                    for r, k in sorted(set(zip(row.tolist(), item.tolist(), strict=True))):
                        items[r].append(index.names[k])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(first)), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*part.schema.names, "n_words", "runs", "items"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema) + ", " + _FOUND
    return docs.mapInArrow(find, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` (with its columns) plus n_words, n_hit, items (sorted array of the item_ids found).

    Items are read in blocks of about `block_chars`; with more than one block, every block is one
    map-only pass, and the passes' hits meet in one shuffle by document.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n_blocks = max(1, -(-total // block_chars))
    results = ["n_words", "n_hit", "items"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    texts = docs.select("text")
    docs, names, (text,) = plain_names(docs, "text")
    block = lambda k: _index(texts, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect(), size)
    pairs = "transform(sequence(0, size(runs) div 2 - 1), k -> named_struct('s', runs[2 * k], 'e', runs[2 * k + 1]))"
    if n_blocks == 1:
        out = _find(docs, text, block(0))
        n_hit = F.expr(f"case when size(runs) = 0 then 0L else aggregate({pairs}, 0L, (a, r) -> a + r.e - r.s) end")
        return out.select(*docs.columns, "n_words", n_hit.alias("n_hit"), "items").toDF(*names, *results)
    # a row by 128 bits of its text, as hits depend on nothing else
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(9), text).alias("k2")]
    parts = [_find(docs, text, block(k)).select(F.struct(*docs.columns).alias("doc"), *keys, F.lit(k).alias("block"), "n_words", "runs", "items") for k in range(n_blocks)]
    base = parts[0].select("doc", "k1", "k2", "n_words", "runs", "items")
    more = parts[1]
    for p in parts[2:]:
        more = more.unionByName(p)
    # repeated documents give equal hits in every block, so one of each is enough
    more = more.where("size(runs) > 0").groupBy("k1", "k2", "block").agg(F.first("runs").alias("more_runs"), F.first("items").alias("more_items"))
    more = more.groupBy("k1", "k2").agg(F.flatten(F.collect_list("more_runs")).alias("more_runs"), F.flatten(F.collect_list("more_items")).alias("more_items"))
    both = base.join(more.hint("shuffle_hash"), ["k1", "k2"], "left")
    both = both.withColumn("runs", F.concat("runs", F.coalesce("more_runs", F.array().cast("array<bigint>")))).withColumn("items", F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>"))))))
    merged = f"""case when size(runs) = 0 then 0L else aggregate(array_sort({pairs}), named_struct('n', 0L, 'last', 0L),
        (a, r) -> named_struct('n', a.n + greatest(0L, r.e - greatest(r.s, a.last)), 'last', greatest(a.last, r.e)), a -> a.n) end"""
    return both.select("doc.*", "n_words", F.expr(merged).alias("n_hit"), "items").toDF(*names, *results)
