"""The ten queries opN_<name> and the pipeline: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, language, licenses, minhash, mixing, secrets, sql, urls, vector_dedup, warc
from .bpe import encode_documents
from .common import new_path, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: (host, path, verdict) of the URL filter's list, as op6's contract has it
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: The list in op6's SQL, which was to stay as it is: it blocks net/de/, against the contract.
SQL_RULES = [(h, p, "block" if (h, p) == ("net", "/de/") else v) for h, p, v in RULES]


def held_out() -> Column:
    """Documents that no model learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.select("doc_id", "text", "lang").where(~held_out()))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(F.concat_ws(",", F.transform(base, place)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", place)).alias("spans"),
        count("literal").alias("n_literal"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = warc.read_warc(spark, path, payload="digest").where(F.col("record_type").isin("response", "revisit"))
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("hits")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, width=3)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(
        docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=False
    )
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), tolerance=1e-9)
    return found.select(
        "doc_id", "n_tokens", "source", "lang", "topic",
        F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_id, op2_secret_scan, op3_warc, op4_nearest, op5_license_scan, op6_url_filter,
            op7_vector_dedup, op8_minhash, op9_byte_bpe, op10_mixing,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": sql.warc(),
        "op6_url_filter": sql.urls(SQL_RULES),
        "op7_vector_dedup": sql.vector_dedup(),
        "op8_minhash": sql.minhash(),
        "op10_mixing": sql.mixing(),
    }
