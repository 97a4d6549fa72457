"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
`documents`.  `run` writes each result as Parquet in the cluster's shared folder and reads it again,
so that a lost executor costs a stage's tasks only.

Cases: rows without a doc_id pass line dedup and near-dedup unchanged.  Null texts count as empty.
A document whose lines were all dropped stays with an empty text.  Rows that share a doc_id are one
document.  Extra columns are not carried on.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import quality
from loomframe.llm.bpe import encode_documents
from loomframe.llm.common import Scratch, cut, table
from loomframe.llm.decontaminate import find_leaks
from loomframe.llm.line_dedup import drop_repeated_lines
from loomframe.llm.near_dedup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it is trained on the raw documents' labels."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document of smaller id has."""
    out = drop_repeated_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group (five-word shingles, similarity 0.8 or more)."""
    gone = cut(near_duplicates(docs.select("doc_id", "text"), size=5, num=80, den=100).where("not kept").select("doc_id").distinct())
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): what the ids decode to is hashed."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    out = encode_documents(docs.select("doc_id", "text"), vocabulary)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    tables = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done, docs = docs, tables.save(stage(spark, docs, sf_dir))
        if k:
            tables.drop(done)
    return docs
