"""A corpus pipeline; each stage is one of the operators in tidemark.llm.

Every stage takes the documents that the one before left, and all but the last return them
with the columns of documents. Documents that mixing takes twice come twice.

Defined results: nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns as the
operators define them. Texts without words, null ones and those that have lost all, are near-duplicates of each other, are
drawn by mixing like any other, and packed as an end id. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, mixing, packing, similar, substring, toxicity
from tidemark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go."""
    return toxicity.reject(docs, common.read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup at a similarity: one document stays of those that links of 5-word similarity of 0.8 join."""
    return similar.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the windows that occur elsewhere, too."""
    out = substring.removed(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mixture takes it."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and global parses have no SQL form; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = common.read(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir))
        if before is not None:
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
