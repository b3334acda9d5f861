"""Document identity, naming, metadata and step states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.dates import chosen_date
from corpusq.functions.text import safe_filename, sniff_mime, strip, title_from_path


def new_sources(configured: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing sources as they are, and configured ones that were missing; the
    prefix is the key in capitals, eight characters at most."""
    fresh = configured.join(existing.select("source_key").hint("merge"), "source_key", "left_anti")
    return existing.unionByName(fresh.withColumn("doc_prefix", F.substring(F.upper("source_key"), 1, 8)).withColumn("next_seq", F.lit(1)), allowMissingColumns=True)


def document_ids(docs: DataFrame, sources: DataFrame, order: str = "doc_pk", bucket: int = 100_000) -> DataFrame:
    """Add ``document_id``: the source's prefix and a running number in order of
    arrival, from the source's ``next_seq``.

    A source may hold most of the rows, so numbers are given in two steps: inside
    buckets of the order key, then by the rows of the buckets before.
    """
    keyed = docs.withColumn("__b", F.floor(F.col(order) / bucket))
    before = Window.partitionBy("source_key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source_key", "__b").agg(F.count("*").alias("__n")).select("source_key", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    own = F.row_number().over(Window.partitionBy("source_key", "__b").orderBy(order))
    numbered = keyed.withColumn("__own", own).join(offsets.hint("merge"), ["source_key", "__b"]).join(sources.select("source_key", "doc_prefix", "next_seq").hint("merge"), "source_key")
    number = F.col("__off") + F.col("__own") + F.col("next_seq") - 1
    return numbered.withColumn("document_id", F.format_string("%s-%05d", "doc_prefix", number)).drop("__b", "__own", "__off")


def version_names(files: DataFrame, order: str = "seq") -> DataFrame:
    """Add ``stored_name``: a second file of the same name gets .v1 before its
    extension, a third .v2; nothing is overwritten."""
    named = files.withColumn("safe_name", safe_filename(F.col("name")))
    n = F.row_number().over(Window.partitionBy("doc_pk", "role", "safe_name").orderBy(order)) - 1
    stem, ending = F.regexp_extract("safe_name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("safe_name", r"^(.+?)(\.[^.]*)?$", 2)
    return named.withColumn("version", n).withColumn("stored_name", F.when(F.col("version") == 0, F.col("safe_name")).otherwise(F.concat(stem, F.lit(".v"), F.col("version"), ending)))


def file_facts(files: DataFrame) -> DataFrame:
    """Hash, size and type of files read as bytes: the type by first bytes, else
    as declared, else unknown."""
    mime = F.coalesce(sniff_mime(F.col("content")), F.col("declared_mime"), F.lit("application/octet-stream"))
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("file_size", F.length("content").cast("long")).withColumn("mime_type", mime).withColumn("is_pdf", F.col("mime_type") == "application/pdf")


def metadata(docs: DataFrame) -> DataFrame:
    """Add title, author, date, precision and notes from a file's own metadata
    (meta_title, meta_author, created, modified), its URL and its first page.
    An author is never guessed."""
    own = F.nullif(strip(F.coalesce("meta_title", F.lit(""))), F.lit(""))
    named = title_from_path(F.col("source_url"))
    date = chosen_date(F.col("created"), F.col("modified"), F.col("first_page"))
    from_text = F.col("__date.date").isNotNull() & F.coalesce(~F.when(F.coalesce("created", F.lit("")) != "", F.col("created")).otherwise(F.col("modified")).rlike(r"D:\d{4}"), F.lit(True))
    notes = F.array_compact(F.array(F.when(own.isNull() & named.isNotNull(), F.lit("title derived from filename")), F.when(from_text, F.lit("year derived from first-page text"))))
    return (
        docs.withColumn("__date", date)
        .withColumn("title", F.coalesce(own, named))
        .withColumn("author", F.nullif(strip(F.coalesce("meta_author", F.lit(""))), F.lit("")))
        .withColumn("doc_date", F.col("__date.date"))
        .withColumn("date_precision", F.col("__date.precision"))
        .withColumn("notes", F.array_join(notes, "; "))
        .drop("__date")
    )


def step_states(is_pdf: Column, failed: Column, used_ocr: Column, has_chunks: Column, embedder: bool, embed_failed: Column) -> list[Column]:
    """State of each step of a document from what happened to it."""
    ok, no, bad, skip = (F.lit(x) for x in ("succeeded", "not_applicable", "failed", "skipped"))
    ocr = F.when(~is_pdf, no).when(failed, F.when(used_ocr, bad).otherwise(no)).when(used_ocr, ok).otherwise(no)
    embedding = F.when(~is_pdf, F.lit("pending")).when(F.lit(not embedder) | ~has_chunks, skip).when(embed_failed, bad).otherwise(ok)
    return [
        ok.alias("download_status"),
        F.when(~is_pdf, no).when(failed, bad).otherwise(ok).alias("text_extraction_status"),
        ocr.alias("ocr_status"),
        ok.alias("metadata_status"),
        F.when(~is_pdf, no).otherwise(ok).alias("index_status"),
        embedding.alias("embedding_status"),
    ]
