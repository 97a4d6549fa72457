"""The pipeline's five stages, each against plain Python on what the stage before kept."""

import hashlib
import re

import pyarrow as pa
import pytest
from test_line_index import deduplicated, first_docs

import corpus_pipeline as pipeline
from loomframe.llm import quality
from loomframe.llm.common import Texts, table

SF = "/root/testdata/sf0.01"


def near_copies(rows, size, num, den):
    """Documents that are not the smallest of their group."""
    sets, parent = {}, {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        parent[k] = k

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
    return {k for k in sets if root(k) != k}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def windows(items):
    out = set()
    for text in items:
        w = words(text or "")
        n = min(10, len(w))
        out |= {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if n else set()
    return out


def test_stages_are_those_of_plain_python(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs, raw = table(spark, SF, "documents"), {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    results = []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        results.append(docs.collect())
        assert name.strip() and (len(results) == 5 or docs.columns == pipeline.COLUMNS)
        docs = spark.createDataFrame(results[-1], docs.schema)
    good, lines, single, clean, coded = ({r.doc_id: r for r in rows} for rows in results)
    # quality: those that the model keeps, read one by one
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    score = model.score(*quality.line_features(Texts(pa.array([raw[k] for k in sorted(raw)]))))
    assert set(good) == {k for k, s in zip(sorted(raw), score, strict=True) if s >= 0.3}
    assert all((good[k].text or "") == raw[k] for k in good)
    # line dedup
    rows = [(k, r.text or "") for k, r in good.items()]
    want = deduplicated(rows, first_docs(rows))
    assert {k: r.text or "" for k, r in lines.items()} == want
    assert all(r.n_chars == len(r.text or "") for k, r in lines.items() if want[k] != raw[k])
    # near-dedup: one document of each group
    rows = [(k, r.text or "") for k, r in lines.items()]
    assert set(single) == set(lines) - near_copies(rows, 5, 80, 100)
    # decontamination
    known = windows([r.text for r in table(spark, SF, "benchmark").collect()])
    lengths = {len(w) for w in known}
    leaks = {k for k, r in single.items() for w in [words(r.text or "")] if any(tuple(w[p : p + n]) in known for n in lengths for p in range(len(w) - n + 1))}
    assert set(clean) == set(single) - leaks and leaks
    # tokens
    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    lib.no_truncation(), lib.no_padding()
    assert set(coded) == set(clean)
    for k, r in coded.items():
        ids = lib.encode(clean[k].text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert sorted(r.doc_id for r in pipeline.run(spark, SF).collect()) == sorted(coded)


def test_pipeline_of_odd_and_empty_tables(spark, make, odd, tmp_path):
    from pyspark.sql import functions as F

    shape = lambda df: df.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("x").alias("source"), F.length("text").cast("bigint").alias("n_chars"), F.lit(1).alias("__id"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id bigint, quality int, toxic int")
    for name, rows in (("odd", [(d, t) for d, t in odd if t is None or len(t) < 50_000]), ("empty", [])):
        for t, df in (("documents", shape(make(rows))), ("labels", labels if rows else labels.limit(0)), ("benchmark", spark.createDataFrame([("i", "same text same text same")] if rows else [], "item_id string, text string"))):
            df.write.parquet(f"{tmp_path}/{name}/{t}.parquet")
        got = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(got) > 0) == bool(rows)
