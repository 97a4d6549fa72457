"""Extra columns of clashing names go through every operator unharmed; repeated rows and ids are defined."""

import pytest
from pyspark.sql import functions as F

from loomframe.llm import html_text, pii, quality, secrets
from loomframe.llm.bpe import encode_documents
from loomframe.llm.decontaminate import find_leaks
from loomframe.llm.near_dedup import near_duplicates
from loomframe.llm.suffix_dedup import remove_repeats

CLASHES = ["x.y", "c0", "c1", "text2", "doc", "batch", "spans", "__spans", "__ref", "__key", "runs", "k1", "h", "size", "s", "row"]


@pytest.fixture
def crowded(make):
    docs = make([(1, "pwd: hunter2Xy77 and secret=abcdef12 mail a@b.cd"), (2, None), (2, "same words again and again and again"), (None, "")])
    return docs.withColumns({c: F.lit(f"kept {c}") for c in CLASHES})


def same(out, given, more):
    assert out.columns == given.columns + more
    strip = lambda rows: sorted((tuple(r[c] for c in given.columns) for r in rows), key=repr)
    rows = out.collect()
    assert strip(rows) == strip(given.collect())
    return rows


def test_columns_of_any_name_stay(crowded, spark):
    items = spark.createDataFrame([(7, "same words again and again", 1)], "item_id bigint, text string, runs int")
    same(secrets.scan_secrets(crowded, None), crowded, ["secrets"])
    same(pii.scan_pii(crowded, None), crowded, ["pii"])
    same(remove_repeats(crowded), crowded, ["kept", "n_bytes", "n_removed", "n_spans"])
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 1)], "doc_id bigint, quality int, text int")
    same(quality.score(crowded, quality.train(crowded, labels)), crowded, ["score", "predicted"])
    for block in (10**6, 1):
        found = same(find_leaks(crowded, items.unionByName(items.withColumn("item_id", F.lit(8).cast("bigint"))), block_chars=block), crowded, ["n_words", "n_hit", "items"])
        assert sorted(r.n_hit for r in found) == [0, 0, 0, 5] and [sorted(r["items"]) for r in found if r["items"]] == [["7", "8"]]
    pages = crowded.withColumnRenamed("text", "html")
    same(html_text.extract_text(pages), pages, ["text"])
    try:
        import public_tokenizers
    except ImportError:
        return
    same(encode_documents(crowded, public_tokenizers.path("byte_bpe_50k.json")), crowded, ["ids", "decoded"])


def test_near_duplicates_of_odd_rows(make, odd):
    rows = [(d, t) for d, t in odd if t is None or len(t) < 50_000]
    got = near_duplicates(make(rows).withColumns({c: F.lit(1) for c in CLASHES}), 3, 85, 100).collect()
    assert len(got) == sum(d is not None for d, _ in rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(make([])).collect() == []


def test_texts_of_one_template_cost_no_pairs(make):
    """Twelve words that differ in the last: every text shares nine shingles with each other, and none is linked."""
    base = " ".join(f"w{k}" for k in range(11))
    rows = [(k, f"{base} own{k}") for k in range(3000)]
    got = near_duplicates(make(rows), 3, 85, 100).collect()
    assert all(r.kept for r in got)
