"""The corpus pipeline: language ID, near-dedup, secret redaction, mixing, encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
documents. run() writes each stage's result as Parquet in the shared folder and reads it back as the
next one's docs, so a lost executor costs rerun tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, minhash, mixing, secrets
from tidemark.llm.bpe import encode_documents
from tidemark.llm.common import materialize, table
from tidemark.llm.queries import VOCABULARY

#: Least share of words in one language.
LEAST_SCORE = 0.5
#: Share of tokens that mixing keeps at weight 1.
BUDGET = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or without a majority language, go.

    The model is learned from docs' own labels; each row is decided by its own text.
    """
    model = language.learn(docs.select("doc_id", "text", "lang"))
    return language.keep_identified(docs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (four fifths of shingles of five words): that with the smallest doc_id.

    Rows without doc_id go.
    """
    return minhash.drop_near_duplicates(docs, percent=80, width=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts blanked out."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents by probabilities calibrated to tempered source and language shares."""
    return mixing.sample_mix(docs, budget=BUDGET)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and digests of the ids and of what they decode to."""
    ids = encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return ids.select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: Viterbi, near-dedup and the transducer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

