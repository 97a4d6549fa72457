"""op7_embedding_dedup and op8_decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from loomframe.llm import embedding_dedup
from loomframe.llm.decontaminate import find_leaks
from loomframe.llm.embedding_dedup import bucket_keys, near_vectors, plan


def pairs_at(rng, n, dim, cosine):
    """Unit vectors and others at exactly that cosine from them."""
    a, b = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("rows,dim", [(3000, 64), (10**5, 64), (10**7, 64), (10**5, 768)])
def test_pairs_at_the_threshold_share_a_bucket(rows, dim):
    hashes, tables = plan(rows, dim)
    n = 6000 if dim == 64 else 1500
    left, right = (bucket_keys(x, hashes, tables) for x in pairs_at(np.random.default_rng(rows), n, dim, 0.98))
    found = np.zeros(len(left), bool)
    for k in range(left.shape[1]):
        found |= (left[:, k : k + 1] == right).any(1)
    assert found.all()


def test_vector_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(4)
    base, near = pairs_at(rng, 1500, 64, 0.985)
    v = np.concatenate([base, near, pairs_at(rng, 300, 64, 0.975)[1], near[:200] + rng.normal(size=(200, 64)) * 0.01]).astype(np.float32).astype(np.float64)
    label = rng.integers(0, 2, len(v))
    label[1500:3000] = label[:1500]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame([(k, x.tolist(), int(y)) for k, (x, y) in enumerate(zip(v, label, strict=True))], "vec_id bigint, embedding array<double>, label int")).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    root = np.arange(len(v))
    while True:
        least = np.minimum(root, np.where(links, root, len(v)).min(1))
        if (least == root).all():
            break
        root = least
    assert got == {k: (int(links[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(v))}


def test_leaks_are_those_of_brute_force(make, spark):
    pick = random.Random(8)
    word = lambda: f"w{pick.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(pick.choice([1, 3, 4, 5, 9, 10, 14, 30])))) for k in range(60)]
    docs = []
    for k in range(300):
        parts = []
        for _ in range(pick.randint(0, 6)):
            w = pick.choice(items)[1].split(" ")
            a = pick.randint(0, len(w) - 1)
            parts += pick.choice([w, w[a : a + pick.randint(8, 12)], [word() for _ in range(20)]])
        docs.append((k, pick.choice([" ", ", ", "\n"]).join(w.upper() if pick.random() < 0.1 else w for w in parts)))
    windows = {}
    for item, text in items:
        w = text.split(" ")
        n = min(10, len(w))
        for p in range(len(w) - n + 1):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(item))
    want = {}
    for k, text in docs:
        w, hit, found = re.findall("[a-z0-9]+", text.lower()), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if here := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= here
        want[k] = (len(w), len(hit), sorted(found))
    got = find_leaks(make(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == want


@pytest.mark.parametrize("rows,dim,threshold", [(3000, 64, 0.9), (3000, 16, 0.95), (10**5, 32, 0.99)])
def test_other_thresholds_and_dimensions_miss_no_pair(rows, dim, threshold):
    hashes, tables = plan(rows, dim, threshold)
    left, right = (bucket_keys(x, hashes, tables) for x in pairs_at(np.random.default_rng(rows + dim), 1500, dim, threshold))
    found = np.zeros(len(left), bool)
    for k in range(left.shape[1]):
        found |= (left[:, k : k + 1] == right).any(1)
    assert found.mean() >= 0.999


def test_vectors_of_any_size_and_shape(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 2)
    rows = [
        (1, [1e-200, 0.0], "a", 1), (2, [1e200, 0.0], "a", 1), (3, [2e200, 1e190], "a", 1), (4, [1.0, 0.0], "a", 1), (5, [5e-324, 0.0], "a", 1),
        (6, [0.0, 1e300], "a", 1), (7, [0.0, 2.0], "a", 1), (8, [0.0, 2.0], "b", 1), (9, [0.0, 2.0], None, 1), (10, None, "a", 1), (11, [0.0, 0.0], "a", 1),
        (12, [float("nan"), 1.0], "a", 1), (13, [float("inf"), 1.0], "a", 1), (14, [1.0, None], "a", 1), (15, [], "a", 1), (16, [1.0, 0.0, 0.0], "a", 1), (None, [1.0, 0.0], "a", 1),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string, rep int")).collect()}
    want = {k: (0, k, True) for k, *_ in rows if k is not None} | {k: (4, 1, k == 1) for k in range(1, 6)} | {6: (1, 6, True), 7: (1, 6, False), None: (0, None, True)}
    assert got == want
