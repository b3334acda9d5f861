"""Documents with what hangs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What a document's detail shows beyond its summary.
DETAIL = "subtitle publisher description mime_type file_size copyright_notes metadata_only duplicate_of_id created_at updated_at".split()


def document_detail(docs: DataFrame, topics: DataFrame, entities: DataFrame) -> DataFrame:
    """Documents with the fields of ``DETAIL`` (null where the table lacks one)
    and their topics and entities as sorted arrays of structs."""
    t = topics.groupBy("doc_pk").agg(F.sort_array(F.collect_set(F.struct("topic_key", "keyword"))).alias("topics"))
    e = entities.groupBy("doc_pk").agg(F.sort_array(F.collect_set(F.struct("name", "page_number", "mention"))).alias("entities"))
    whole = docs.withColumns({f: F.lit(None).cast("string") for f in DETAIL if f not in docs.columns})
    return whole.join(t.hint("merge"), "doc_pk", "left").join(e.hint("merge"), "doc_pk", "left")


def without_demo(docs: DataFrame, **children: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents that are no demo, and of each table those rows whose document is left."""
    left = docs.where(~F.col("is_demo"))
    keys = left.select("doc_pk").hint("merge")
    return left, {name: df.join(keys, "doc_pk", "left_semi") for name, df in children.items()}


def is_servable(metadata_only: Column, local_path: Column) -> Column:
    """The file of a document can be served: it has one, and a path to it."""
    return ~F.coalesce(metadata_only, F.lit(False)) & (F.coalesce(local_path, F.lit("")) != "")


def entity_documents(entities: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Documents that mention an entity, with page and mention."""
    return entities.where(F.col("name") == name).join(docs.select("doc_pk", "title", "doc_date").hint("merge"), "doc_pk")


def timeline(events: DataFrame, event_documents: DataFrame) -> DataFrame:
    """Events by date with the number of their documents and a label for their standing."""
    n = event_documents.groupBy("event_id").agg(F.count("*").alias("documents"))
    label = F.when(F.col("verified"), "verified").otherwise("AI-extracted (unverified)")
    return events.join(n.hint("merge"), "event_id", "left").select("event_id", "event_date", F.coalesce("documents", F.lit(0)).alias("documents"), label.alias("label"))


def coordinates(entities: DataFrame) -> DataFrame:
    """Every entity, with its coordinates as a struct: null unless its latitude is known."""
    return entities.withColumn("coordinates", F.when(F.col("latitude").isNotNull(), F.struct("latitude", "longitude")))
