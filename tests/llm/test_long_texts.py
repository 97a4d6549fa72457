"""op2_suffix_dedup on texts that are read in several pieces."""

import random
from functools import partial

import pytest
from test_contracts import repeated_texts, without_repeats

from loomframe.llm import suffix_dedup
from loomframe.llm.common import CHUNK_BYTES
from loomframe.llm.suffix_dedup import remove_repeats


@pytest.mark.parametrize("piece,batches", [(300, 1), (1000, 2), (64, 1)])
def test_repeats_across_small_pieces_are_those_of_brute_force(make, monkeypatch, piece, batches):
    for name in ("anchors", "_hashes"):
        monkeypatch.setattr(suffix_dedup, name, partial(getattr(suffix_dedup, name), piece=piece))
    texts = repeated_texts()
    got = {r.doc_id: r for r in remove_repeats(make(list(enumerate(texts))), 200, batches).collect()}
    for k, (kept, removed, spans) in enumerate(without_repeats(texts, 200)):
        assert (bytes(got[k].kept), got[k].n_removed, got[k].n_spans) == (kept, removed, spans), k


def test_long_texts_lose_only_what_repeats(make):
    pick = random.Random(3)
    once = lambda n: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    unique, passage = once(3 * CHUNK_BYTES + 777), "<" + once(900) + ">"
    # the passage lies across the border of two pieces
    head, tail = once(CHUNK_BYTES - 400), once(CHUNK_BYTES)
    got = {r.doc_id: r for r in remove_repeats(make([(1, unique), (2, head + passage + tail), (3, passage)])).collect()}
    assert (bytes(got[1].kept).decode() == unique, got[1].n_removed, got[1].n_spans) == (True, 0, 0)
    assert (bytes(got[2].kept).decode() == head + tail, got[2].n_removed, got[2].n_spans) == (True, len(passage), 1)
    assert (bytes(got[3].kept), got[3].n_removed) == (b"", len(passage))
