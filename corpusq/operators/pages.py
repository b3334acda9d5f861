"""Pages of documents: cutting, triage for text recognition, merging its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import strip

#: Fixed value: fewer characters than this and a page is taken for an image.
LEAST_CHARS = 40


def segment_pages(docs: DataFrame, pages: Column, key: str = "doc_pk") -> DataFrame:
    """One row for each text of the array column ``pages``, numbered from 1."""
    cut = docs.select(key, F.posexplode(pages).alias("at", "text"))
    return cut.select(key, (F.col("at") + 1).alias("page_number"), "text", F.length("text").alias("char_count"))


def line_pages(text: Column, lines: int = 10) -> Column:
    """Runs of ``lines`` lines as page texts, each line a paragraph."""
    parts = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / lines).cast("int"))
    return F.transform(starts, lambda k: F.array_join(F.slice(parts, k * lines + 1, lines), "\n\n"))


def needs_ocr(text: Column, forced: bool = False) -> Column:
    """Little or no text on the page, or recognition of every page asked for."""
    return F.lit(True) if forced else F.length(strip(F.coalesce(text, F.lit("")))) < LEAST_CHARS


def merge_ocr(pages: DataFrame, recognised: DataFrame, forced: bool = False) -> DataFrame:
    """Take recognised text for the pages that need it where it is longer than
    their own (or always, if forced); ``recognised`` has doc_pk, page_number,
    ocr_text and confidence."""
    size = lambda c: F.length(strip(F.coalesce(c, F.lit(""))))
    joined = pages.join(recognised.hint("merge"), ["doc_pk", "page_number"], "left")
    take = F.col("ocr_text").isNotNull() & needs_ocr(F.col("text"), forced)
    if not forced:
        take = take & (size(F.col("ocr_text")) > size(F.col("text")))
    text = F.when(take, F.col("ocr_text")).otherwise(F.col("text"))
    return joined.select(
        "doc_pk",
        "page_number",
        text.alias("text"),
        F.length(text).alias("char_count"),
        F.when(take, F.lit("ocr")).otherwise(F.lit("embedded")).alias("text_source"),
        F.when(take, F.col("confidence")).alias("ocr_confidence"),
    )


def ocr_summary(merged: DataFrame) -> DataFrame:
    """Per document: recognition used, pages it gave, mean confidence (null if none)."""
    done = F.col("text_source") == "ocr"
    return merged.groupBy("doc_pk").agg(
        F.coalesce(F.bool_or(done), F.lit(False)).alias("used_ocr"),
        F.count_if(done).alias("ocr_pages"),
        F.avg("ocr_confidence").alias("mean_confidence"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("total_chars"),
        F.count("*").alias("page_count"),
    )
