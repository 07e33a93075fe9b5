"""A corpus pipeline: quality classifier, near-duplicates, decontamination, personal data, tokens.

Each stage takes what its predecessor kept, whole texts and all rows of it, and its decisions take effect: rejected
documents go, one document of each near-duplicate group stays, documents that hold a benchmark item go, found spans
are replaced by their kind, and what is left becomes token ids. All stages but the last return the columns of documents.

Defined cases, of every stage and of run(): an empty table gives an empty result with the same columns; null and empty
texts are scored like any other and, where they are kept, are near copies of each other, hold no item and no personal
data, stay null or empty, and have 0 tokens; texts of any length are read whole; a null doc_id is a row like another one;
extra columns pass by untouched, whatever their names, up to the last stage, which drops them; ties are decided as each
stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.llm import bpe_dp, decontamination, pii, quality_fm, simhash
from evispark.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the factorisation machine scores 0.7 or more; rows that repeat are judged alike.

    Without any usable label every document scores 0.5, and none is kept.
    """
    return quality_fm.accepted(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group linked by SimHash.

    Of rows that share that doc_id, the one with the least hash of text and columns stays; a group whose ids are all null
    keeps one row.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item; an empty benchmark keeps all, and rows that repeat are judged alike."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with personal data replaced by its kind; n_chars counts the new text where it changes."""
    return pii.redact(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of their decoding, a row for each row."""
    import public_tokenizers

    return bpe_dp.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("bpe", token_stage),
]

#: The stages are models and iterative algorithms; the tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage's result written and read again in between."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        after = scratch.table(stage(spark, docs, sf_dir))
        scratch.free(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
