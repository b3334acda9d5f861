"""Registered queries of the training-data operators, with their SQL where SQL
can express them.  Each query reads whole tables and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import crc_bucket, prepare, scratch, stored, table
from .decontaminate import find_leaks
from .embedding_dedup import embedding_links
from .filter_audit import SQL as FILTER_SQL
from .filter_audit import filter_audit
from .html_text import extract_text, learn_pages
from .importance import SQL as IMPORTANCE_SQL
from .importance import importance_resample
from .language_id import learn_profiles, predict_language
from .language_model import code_documents, count_words, learn_lexicon, learn_model, score_documents
from .line_dedup import SQL as LINE_SQL
from .line_dedup import apply_bitmaps, keep_bitmaps
from .quality import learn_quality, score_quality
from .simhash import simhash_groups
from .token_count import token_count
from .token_store import read_tokens, write_tokens


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by word_bpe_49k.json, written and read back."""
    prepare(spark)
    path = scratch(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles of the learning share."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_bucket("doc_id", 4) == 2)
    profiles = learn_profiles(docs.where(~F.col("held_out")))
    return predict_language(docs, profiles, keep=["doc_id", "held_out"])


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 likelihood of every document, learnt from the learning share."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_bucket("doc_id", 7) == 2)
    counts = stored(count_words(docs.where(~F.col("held_out"))))
    lexicon = learn_lexicon(counts)
    coded = code_documents(docs, lexicon, keep=["doc_id", "held_out"])
    return score_documents(coded, counts, lexicon, learn_model(coded.where("not kept.held_out"), lexicon))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json."""
    prepare(spark)
    return token_count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: one row for each document and item."""
    prepare(spark)
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document by byte_bpe_50k.json, as digests."""
    prepare(spark)
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    coded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by an additive model of the learning share."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_bucket("doc_id", 3) == 1)
    model = learn_quality(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=["doc_id", "held_out"])


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by a chain over its leaf blocks."""
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, learn_pages(pages))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.93 inside labels."""
    prepare(spark)
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by SimHash."""
    prepare(spark)
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by source, over all documents."""
    prepare(spark)
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share, as digests."""
    docs = table(spark, sf_dir, "documents")
    left = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their importance for the benchmark; a twentieth is drawn."""
    prepare(spark)
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_language_id,
        op3_language_model,
        op4_token_count,
        op5_decontaminate,
        op6_bpe_codec,
        op7_quality,
        op8_html_text,
        op9_embedding_dedup,
        op10_simhash,
        op11_filter_audit,
        op12_line_dedup,
        op13_importance,
    )
}

#: SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op11_filter_audit": FILTER_SQL, "op12_line_dedup": LINE_SQL, "op13_importance": IMPORTANCE_SQL}
