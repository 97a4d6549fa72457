"""op9_line_dedup and its index against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import line_dedup
from loomframe.llm.cuckoo import CuckooFilter
from loomframe.llm.line_dedup import LineIndex, drop_repeated_lines


def batch(seed, ids):
    pick = random.Random(seed)
    pool = [f"a line that may repeat {k}" for k in range(40)]
    line = lambda: pick.choice([pick.choice(pool), f"  {pick.choice(pool).upper()}\t", f"only here {pick.random()}", "short", ""])
    return [(k, "\n".join(line() for _ in range(pick.randint(1, 90)))) for k in ids]


def keys(text):
    return [k if len(k) >= 10 else None for k in (x.strip(" \t\n\x0b\x0c\r").lower() for x in text.split("\n"))]


def first_docs(rows):
    held = {}
    for d, t in rows:
        for k in set(keys(t)) - {None}:
            held.setdefault(k, set()).add(d)
    return {k: min(ds) for k, ds in held.items() if len(ds) > 1}


def deduplicated(rows, first):
    return {d: "\n".join(x for x, k in zip(t.split("\n"), keys(t), strict=True) if first.get(k, d) == d) for d, t in rows}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_dropped_lines_are_those_of_brute_force(make, batches):
    rows = batch(1, range(150))
    got = {r.doc_id: r.text for r in drop_repeated_lines(make(rows), batches=batches).collect()}
    assert got == deduplicated(rows, first_docs(rows))


def test_index_inserts_and_deletes_as_brute_force(make):
    a, b, again = batch(1, range(40)), batch(2, range(40, 80)), batch(3, range(30, 45))
    index, now = LineIndex(shard_keys=300), {}

    def agrees():
        held = {k for t in now.values() for k in keys(t)} - {None}
        for rows in (a, b, again):
            maybe = {r.k1: r.maybe for r in index.probe(make(rows)).collect()}
            wanted = line_dedup._lines(make(rows), 10).select("k1", "k2", "doc_id", "pos").collect()
            text = dict(rows)
            assert all(maybe[r.k1] for r in wanted if keys(text[r.doc_id])[r.pos] in held)
            if not held & {k for t in text.values() for k in keys(t)}:
                assert sum(maybe.values()) <= 0.01 * len(maybe)
        assert index.n_keys == len(held)
        rows = list(now.items())
        assert {r.doc_id: r.text for r in index.apply(make(rows)).collect()} == deduplicated(rows, first_docs(rows))

    for rows in (a, b, again):
        index = index.insert(make(rows))
        now |= dict(rows)
        agrees()
    for gone in ([*range(0, 30)], [*range(35, 78)]):
        index = index.delete(make([(d, "") for d in gone]))
        now = {d: t for d, t in now.items() if d not in gone}
        agrees()


def test_filters_insert_and_delete():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**62), 2**62, 9000)
    held = CuckooFilter.sized(100)  # far too small: most fingerprints wait in `spare`
    for part in (keys[:100], keys[100:110], keys[110:700]):
        held.insert(part)
        held = CuckooFilter.load(held.dump())
    assert held.contains(keys[:700]).all() and held.spare
    held.delete(keys[:650])
    assert held.contains(keys[650:700]).all()
    held.delete(keys[650:700])
    assert not held.cells.any() and not held.spare
    full = CuckooFilter.sized(9000)
    full.insert(keys)
    assert full.contains(keys).all() and not full.spare
    assert full.contains(rng.integers(-(2**62), 2**62, 10**5)).mean() < 0.001


def test_lines_of_odd_rows_and_clashing_names(make, odd):
    rows = [(d, t) for d, t in odd if t is None or len(t) < 50_000]
    docs = make(rows).withColumns({c: F.lit(1) for c in ("__id", "__h", "__lines", "words", "h", "id", "lines", "kept", "n_lines")}).withColumn("x.y", F.lit(2))
    out = drop_repeated_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.n_lines, r["x.y"]) for r in out.collect())
    kept = [(d, t or "") for d, t in rows if d is not None]
    held = {}
    for d, t in kept:
        for k in set(keys(t)) - {None}:
            held.setdefault(k, set()).add(d)
    first = {k: min(ds) for k, ds in held.items() if len(ds) > 1}
    text = lambda d, t: t if d is None else "\n".join(x for x, k in zip(t.split("\n"), keys(t), strict=True) if first.get(k, d) == d)
    assert got == sorted((d is None, d or 0, text(d, t or ""), (t or "").count("\n") + 1, 2) for d, t in rows)
    assert drop_repeated_lines(make([])).collect() == []
