"""The document pipeline: each stage applies one operator to all that its predecessor kept.

``STAGES`` lists (name, function) in order; a function takes (spark, docs,
sf_dir) and returns the documents that go on, all their columns unchanged; the
last one returns what is read back from the record files.  Every stage handles
null, empty and very long texts, repeated rows, empty tables and further
columns as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, mixing, quality_rules, records, simhash
from linkloom.llm.queries import tokenizer_path
from linkloom.session import discard, materialize, scratch_scope
from linkloom.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.take(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as record files; the rows are what the files hold."""
    return records.encode_and_read(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token records", token_records),
]

#: Fingerprints and token ids come from libraries (XXH64, tokenizers) that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and deleted once the next one is there."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch_scope() as made:  # what a stage wrote on its way goes with it
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            made[:] = [df for df in made if df is not docs]
        if before is not None:
            discard(before)
        before = docs
    return docs
