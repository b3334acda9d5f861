"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  Whatever a stage rejects is gone for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import crc_bucket, passing, prepare, stored, table
from corpusq.llm.decontaminate import find_leaks
from corpusq.llm.language_id import learn_profiles, predict_language
from corpusq.llm.quality import learn_quality, score_quality
from corpusq.llm.queries import digests
from corpusq.llm.simhash import simhash_groups

#: A text whose n-grams are this far from every learned language is rejected.
LEAST_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.  Null and empty texts, those
    without letters, and those far from every language profile are rejected.
    Each row stands alone: repeated rows share their fate, an empty table stays
    empty, a text of any length is read whole."""
    prepare(spark)
    profiles = learn_profiles(docs.where(crc_bucket("doc_id", 4) != 2))
    found = predict_language(docs, profiles, keep=docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model predicts to be good (a score of 0.5, as
    all have where nothing could be learnt, is enough).  Each row stands alone:
    null and empty texts are scored as well, repeated rows share their fate, an
    empty table stays empty."""
    prepare(spark)
    model = learn_quality(docs.where(crc_bucket("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=docs.columns).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id
    (null ids last, then the smallest hash of its text; a row repeated as a
    whole stays once).  Null and empty texts are one class; an empty table
    stays empty.

    What is kept is one row for each class, so the text is dealt out once, by
    the columns of both the join and the repeated rows.
    """
    prepare(spark)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = docs.select("doc_id", "text", text.alias("hash"))
    least = simhash_groups(marked, keep=["doc_id", "hash"]).groupBy("class_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("kept"))
    kept = least.select(F.coalesce("kept.doc_id", F.lit(0)).alias("__id"), F.col("kept.last").alias("__last"), F.col("kept.hash").alias("__hash"))
    keys = ["__id", "__last", "__hash"]
    keyed = docs.withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__last", F.col("doc_id").isNull()).withColumn("__hash", text)
    return keyed.join(kept.hint("merge"), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs.  Null and empty texts hold
    none and stay; repeated rows share their fate; an empty table stays empty.
    Items shorter than a q-gram stand in clean documents as well, so they reject
    none (``find_leaks`` reports them)."""
    prepare(spark)
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns, short_items=False).where(F.size("leaks") == 0).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text decoded from them, as counts and digests; null
    text counts as empty.  One row for each row, an empty table gives none."""
    prepare(spark)
    return digests(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot express these stages; tests/llm compares them with plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for _, stage in first:
        with passing(spark) as kept:  # what a stage wrote for itself goes with it
            kept.append(docs := stored(stage(spark, docs, sf_dir)))
    return last(spark, docs, sf_dir)
