import json

import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows."""

    def docs(rows):
        return spark.createDataFrame(rows, "doc_id bigint, text string")

    return docs


@pytest.fixture(scope="session")
def real():
    """A few hundred real rows of a table of the driver's."""
    import pyarrow.parquet as pq

    def rows(name, columns, sf="0.001"):
        return [tuple(r.values()) for r in pq.read_table(f"/root/testdata/sf{sf}/{name}.parquet", columns=columns).to_pylist()]

    return rows


#: Texts that every operator on documents must survive.
ODD = [
    None, "", " ", "\n", "\n\n\n", "a", "a b", "é", "𝒳𝒴 𝒵", "\x00\x01", "word " * 60_000, "x" * 300_000,
    "@" * 2000, "a@" * 3000 + "b.c", "1" * 6000 + ".1.1.1", "+1" + "(" * 4000, "<|endoftext|>x<|endoftext|>", "'s 'll 　 \t\r\n", json.dumps({"k": "v" * 500}),
    "same text " * 40, "same text " * 40,
]


@pytest.fixture(scope="session")
def odd():
    return [(k, t) for k, t in enumerate(ODD)] + [(None, "no id " * 50), (3, "twice the same id " * 30), (4, "\n\n\n")]
