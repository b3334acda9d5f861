"""Exports: manifest, catalogue, BibTeX, run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of the exports, in order.
MANIFEST = "document_id title author date document_type source_url archived_url local_path sha256 mime_type file_size page_count ocr_status index_status rights_status retrieved_at".split()
SUMMARY = "id document_id title author date date_precision document_type page_count language source_url archived_url rights_status access_status sha256 is_demo ocr_status text_extraction_status index_status embedding_status metadata_source review_status retrieved_at".split()


def iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss+00:00")


def _rows(docs: DataFrame, fields: list[str], include_demo: bool) -> DataFrame:
    """The fields of each document; a column that the table lacks is null."""
    mine = docs if include_demo else docs.where(~F.col("is_demo"))
    named = {"date": "doc_date", "id": "doc_pk"}

    def field(f):
        c = named.get(f, f)
        if c not in docs.columns:
            return F.lit(None).cast("string").alias(f)
        return (iso(c) if f == "retrieved_at" else F.col(c)).alias(f)

    return mine.select(*[field(f) for f in fields])


def manifest(docs: DataFrame, include_demo: bool = False, type_name: str = "document_type") -> DataFrame:
    """Rows of the manifest; the script flavour names the type ``type``."""
    return _rows(docs, MANIFEST, include_demo).withColumnRenamed("document_type", type_name)


def catalogue(docs: DataFrame, include_demo: bool = False) -> DataFrame:
    return _rows(docs, SUMMARY, include_demo)


def bibtex(docs: DataFrame, include_demo: bool = False) -> DataFrame:
    """One entry for each document; empty fields are left out."""
    mine = docs if include_demo else docs.where(~F.col("is_demo"))
    wrap = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise("Untitled")
    note = F.concat(F.lit("  note = {Document ID "), "document_id", F.lit("; SHA256 "), F.coalesce(F.nullif("sha256", F.lit("")), F.lit("unknown")), F.lit("}"))
    body = F.concat_ws(",\n", wrap("title", title), wrap("author", F.col("author")), wrap("year", F.substring("doc_date", 1, 4)), wrap("url", F.col("source_url")), note)
    return mine.select("document_id", F.concat(F.lit("@misc{"), F.replace("document_id", F.lit("-"), F.lit("")), F.lit(",\n"), body, F.lit("\n}")).alias("entry"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.option("lineSep", "\n\n").text(path)


def report_markdown(report: DataFrame, errors: int = 50) -> DataFrame:
    """A crawl report as JSON and as Markdown with its first errors."""
    names = [c for c in report.columns if c not in ("run_id", "errors")]
    lines = [F.concat(F.lit(f"- {n}: "), F.col(n).cast("string")) for n in names]
    shown = F.slice(F.filter(F.split("errors", "\n"), lambda x: x != ""), 1, errors)
    text = F.concat_ws("\n", F.concat(F.lit("# Crawl "), F.col("run_id").cast("string")), *lines, F.lit("## Errors"), F.transform(shown, lambda x: F.concat(F.lit("- "), x)))
    return report.select("run_id", F.to_json(F.struct(*report.columns)).alias("json"), text.alias("markdown"))


def session_rows(answers: DataFrame) -> DataFrame:
    """Research sessions: the question's first 120 characters, citations and sources as JSON."""
    return answers.select(F.substring("question", 1, 120).alias("title"), "question", "answer", F.to_json("citations").alias("citations_json"), F.to_json("sources").alias("sources_json"))


def read_sessions(sessions: DataFrame, citations: str, sources: str) -> DataFrame:
    """Saved sessions with their JSON parsed again, to the DDL types given; null
    where it is broken."""
    return sessions.select("title", "question", "answer", F.from_json("citations_json", citations).alias("citations"), F.from_json("sources_json", sources).alias("sources"))
