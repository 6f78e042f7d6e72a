"""From raw documents to token ids: five operators, one after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet to the
shared folder and read again as the next stage's docs, so a lost executor costs one stage at most.
All stages but the last return the columns of documents.  Every stage works on whatever the one
before kept, also on nothing.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import bpe, contamination, exact, language, near
from lanewise.llm.common import table
from lanewise.session import delete_folder, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without any letter, or without text, go.

    All others stay, also where no language could be learned: they are in one without a name then.
    """
    named = docs.filter(docs["lang"] != language.UNKNOWN)
    samples = language.sampled(language.training_rows(named)) or {"": []}
    found = language.predicted(docs, samples)
    return found.filter(found["lang_pred"] != language.UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that differ in white space only."""
    return exact.distinct_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8."""
    return near.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest and that of the decoded text."""
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"),
                       ("ids", "ids_sha256", "decoded_sha256"), with_text=False)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

# Cross-parsing and byte-pair merges are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; a stage's rows are deleted once the next stage's are written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents", *COLUMNS), None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            delete_folder(spark, before)
        before = out
    return docs
