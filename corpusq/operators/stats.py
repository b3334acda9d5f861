"""Dashboard counts, one pass for each table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embed import has_embedding


def document_counts(docs: DataFrame, include_demo: bool = False) -> DataFrame:
    """All, recognised, failed, indexed and embedded documents, and distinct
    authors (of all documents, as the authors' list shows them), in one row."""
    mine = F.lit(True) if include_demo else ~F.col("is_demo")
    n = lambda c, v: F.count_if(mine & (F.col(c) == v))
    return docs.agg(
        F.count_if(mine).alias("documents"),
        n("ocr_status", "succeeded").alias("ocr_succeeded"),
        n("text_extraction_status", "failed").alias("extraction_failed"),
        n("index_status", "succeeded").alias("indexed"),
        n("embedding_status", "succeeded").alias("embedded"),
        F.count_distinct("author").alias("authors"),
    )


def child_counts(children: DataFrame, docs: DataFrame, include_demo: bool = False) -> DataFrame:
    """Rows of pages or chunks whose document counts."""
    mine = docs if include_demo else docs.where(~F.col("is_demo"))
    return children.join(mine.select("doc_pk").hint("merge"), "doc_pk", "left_semi").agg(F.count("*").alias("n"))


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def group_counts(docs: DataFrame, label, keep_null: bool, include_demo: bool = False) -> DataFrame:
    """Documents by a label; null labels are kept or dropped."""
    mine = docs if include_demo else docs.where(~F.col("is_demo"))
    out = mine.select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return out if keep_null else out.where("label is not null")


def status_counts(docs: DataFrame, columns: list[str], include_demo: bool = False) -> DataFrame:
    """``(kind, label, n)`` of several state columns in one pass; nulls stay."""
    mine = docs if include_demo else docs.where(~F.col("is_demo"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("label")) for c in columns]))
    return mine.select(pairs.alias("p")).groupBy("p.kind", "p.label").agg(F.count("*").alias("n"))


def counts_with_zero(parents: DataFrame, children: DataFrame, key: str, child_id: str) -> DataFrame:
    """Parents with the number of their children, zero included."""
    n = children.groupBy(key).agg(F.count(child_id).alias("n"))
    return parents.join(n.hint("merge"), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bars(counts: DataFrame, floor: float = 3.0) -> DataFrame:
    """Add each count as a percentage of the largest, ``floor`` at least."""
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("label", "n", F.round(F.greatest(F.lit(floor), F.col("n") / F.col("top") * 100), 6).alias("percent"))


MOST_ROWS = 200


def page_of(docs: DataFrame, order: str, limit: int, offset: int = 0, key: str | None = None) -> DataFrame:
    """Newest rows first: one page of a listing, of 1 to ``MOST_ROWS`` rows.
    Rows of one ``order`` value stand by ``key``, smaller first; null values last."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit is 1 to {MOST_ROWS}, offset at least 0")
    return docs.orderBy(F.desc(order), *([F.asc(key)] if key else [])).offset(offset).limit(limit)


def page_after(docs: DataFrame, order: str, limit: int, last: tuple | None = None, key: str = "doc_pk") -> DataFrame:
    """The page that follows the row whose ``(order, key)`` is ``last``: without an
    offset no row before it is read again, and none of its ties is lost."""
    if last is not None:
        value, own = F.col(order), last[1]
        tie = value.eqNullSafe(F.lit(last[0])) & (F.col(key) > F.lit(own))
        docs = docs.where(tie if last[0] is None else F.coalesce(value < F.lit(last[0]), F.lit(True)) | tie)
    return page_of(docs, order, limit, key=key)


def listing(docs: DataFrame, order: str, limit: int, offset: int = 0, unfiltered: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """A page of rows, each beside ``total``, the number of all that pass the
    filters.  ``unfiltered``: rows counted instead (the reference leaves the
    topic filter out of its total)."""
    total = (docs if unfiltered is None else unfiltered).agg(F.count("*").alias("total"))
    return page_of(docs, order, limit, offset, key).crossJoin(F.broadcast(total))  # one row


def search_fields(wanted: str, *columns: str) -> Column:
    """One of the columns contains the text, ignoring case; a null does not."""
    return reduce(or_, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted.lower())), F.lit(False)) for c in columns])


def list_entities(entities: DataFrame, entity_type: str | None = None, contains: str | None = None, limit: int = MOST_ROWS) -> DataFrame:
    """Entities of a type whose name contains a text, with the number of their
    mentions, most mentioned first (``entities``: a row for each mention)."""
    mine = entities if entity_type is None else entities.where(F.col("entity_type") == entity_type)
    mine = mine if contains is None else mine.where(search_fields(contains, "name"))
    return mine.groupBy("entity_type", "name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name", "entity_type").limit(limit)


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table."""
    counts = [F.broadcast(df.agg(F.count("*").alias(name))) for name, df in tables.items()]
    return reduce(DataFrame.crossJoin, counts)  # frames of one row


def embedded_counts(chunks: DataFrame, docs: DataFrame, include_demo: bool = False) -> DataFrame:
    """Chunks whose document counts, and those of them that have an embedding."""
    mine = docs if include_demo else docs.where(~F.col("is_demo"))
    kept = chunks.join(mine.select("doc_pk").hint("merge"), "doc_pk", "left_semi")
    return kept.agg(F.count("*").alias("chunks"), F.count_if(has_embedding(F.col("embedding"))).alias("embedded_chunks"))


def with_latest_review(docs: DataFrame, reviews: DataFrame, order: str = "ts", tie: str = "seq") -> DataFrame:
    """Documents with the status of their last review, or their own without one."""
    last = latest_by(reviews.select("doc_pk", order, tie, F.col("status").alias("__status")), "doc_pk", order, tie)
    joined = docs.join(last.select("doc_pk", "__status").hint("merge"), "doc_pk", "left")
    return joined.withColumn("review_status", F.coalesce("__status", "review_status")).drop("__status")


def run_stats(runs: DataFrame, fields: str, column: str = "stats") -> DataFrame:
    """Runs with their stored JSON as columns of the ``fields`` given (DDL); null
    where it is null, empty or broken."""
    parsed = F.from_json(column, fields)
    return runs.select(*[c for c in runs.columns if c != column], parsed.alias("stats"))


def latest_by(events: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
