"""Configurations as small tables: sources and taxonomy; files as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = "struct<max_pages: int, max_depth: int, requests_per_second: double, respect_robots: boolean>"
RIGHTS = "struct<status: string, access: string, notes: string>"
SOURCE = f"source_key string, name string, base_url string, seed_urls array<string>, allowed_domains array<string>, file_extensions array<string>, crawl_rules {RULES}, rights {RIGHTS}"


def source_table(spark: SparkSession, configured: list[dict]) -> DataFrame:
    """Configured sources as rows, crawl rules and rights nested; missing entries are null."""
    schema = spark.createDataFrame([], SOURCE).schema

    def value(given: dict | None, kind: T.StructType):
        return None if given is None else tuple(value(given.get(f.name), f.dataType) if isinstance(f.dataType, T.StructType) else given.get(f.name) for f in kind.fields)

    return spark.createDataFrame([value(s, schema) for s in configured], schema)


def taxonomy_tables(spark: SparkSession, topics: list[tuple[str, str, list[str]]], names: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Topics with their keywords in order, and names by type in order."""
    t = [(i, key, label, j, w) for i, (key, label, words) in enumerate(topics) for j, w in enumerate(words)]
    n = [(kind, name, i) for i, (kind, name) in enumerate(names)]
    return spark.createDataFrame(t, "topic_ord int, topic_key string, label string, kw_ord int, keyword string"), spark.createDataFrame(n, "entity_type string, name string, ord int")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as bytes, with hash and size."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
