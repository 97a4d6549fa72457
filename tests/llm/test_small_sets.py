"""op5_near_dedup on short documents against brute force."""

import random

import pytest

from loomframe.llm.near_dedup import near_duplicates


def brute_force(rows, size, num, den):
    sets = {}
    for k, text in rows:
        w = text.split(" ")
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    places = {}
    for k, s in sets.items():
        for x in s:
            places.setdefault(x, []).append(k)
    for k, s in sets.items():
        for o in {o for x in s for o in places[x] if o > k}:
            same = len(s & sets[o])
            if den * same >= num * (len(s) + len(sets[o]) - same):
                a, b = sorted((root(k), root(o)))
                parent[b] = a
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("size,num,den", [(3, 85, 100), (5, 80, 100)])
def test_links_of_small_sets_are_those_of_brute_force(make, size, num, den):
    pick = random.Random(11)
    word = lambda: f"w{pick.randrange(10**7)}"
    rows = []
    # a text and the same with one to three words more, at all sizes up to where bands begin
    for n in [*[n for n in range(4, 14) for _ in range(60)], *range(14, 260, 2)]:
        base = [word() for _ in range(n + size - 1)]
        more = [word() for _ in range(pick.choice([1, 1, 2, 3]))]
        rows += [(2 * len(rows), " ".join(base)), (2 * len(rows) + 1, " ".join(pick.choice([base + more, more + base, base[1:] + more[:1]])))]
    got = {r.doc_id: r.component_id for r in near_duplicates(make(rows), size, num, den).collect()}
    assert got == brute_force(rows, size, num, den)
