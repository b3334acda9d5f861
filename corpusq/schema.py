"""Table schemas, value sets and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of processing, review and dates.
PROCESSING = ("pending", "running", "succeeded", "failed", "skipped", "not_applicable")
METADATA_SOURCE = ("verified", "deterministic", "ai", "unknown")
REVIEW = ("unreviewed", "verified", "needs_review", "incorrect_metadata", "duplicate", "ocr_poor", "source_uncertain")
DATE_PRECISION = ("exact", "month", "year", "decade", "unknown")

# Schemas as DDL text, which Spark's readers and createDataFrame take.

DOCUMENTS = (
    "doc_pk long, document_id string, title string, author string, doc_date string, date_precision string, document_type string, "
    "language string, page_count int, source_id long, collection_id long, source_url string, archived_url string, local_path string, "
    "mime_type string, file_size long, sha256 string, retrieved_at timestamp, rights_status string, access_status string, "
    "metadata_only boolean, download_status string, text_extraction_status string, ocr_status string, metadata_status string, "
    "index_status string, embedding_status string, metadata_source string, review_status string, duplicate_of_id long, is_demo boolean, created_at timestamp"
)
PAGES = ("doc_pk long, page_number int, text string, char_count int, text_source string, ocr_confidence double")
CHUNKS = ("chunk_id string, doc_pk long, page_number int, chunk_index int, text string, char_start int, char_end int, token_estimate int")
CITATIONS = ("run_id long, citation_ref string, document_id long, chunk_id string, page_number int, quote string, validated boolean, validation_note string")


def in_set(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value is one of a fixed set (null is not)."""
    return F.coalesce(value.isin(*allowed), F.lit(False))


def split_by_set(df: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is allowed, and the rejected rest."""
    return df.where(in_set(F.col(column), allowed)), df.where(~in_set(F.col(column), allowed))


def key_violations(df: DataFrame, *key: str) -> DataFrame:
    """Key values that occur more than once, with their number; empty if the key is unique."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    known = parent.select(F.col(key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(known, column, "left_anti")
