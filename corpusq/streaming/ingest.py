"""Incremental ingest and live counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.chunk import chunk_pages
from corpusq.operators.dedup import dedup_archive
from corpusq.operators.pages import line_pages, segment_pages
from corpusq.shared import scratch


#: Parts of the archive's keys: a batch reads those that its own keys fall in
BUCKETS = 256
Outputs = dict[str, Callable[[DataFrame], DataFrame]]


def document_chunks(docs: DataFrame) -> DataFrame:
    return chunk_pages(segment_pages(docs, line_pages(F.col("text"))))


def ingest_stream(landing: DataFrame, folder: str, checkpoint: str, outputs: Outputs | None = None, buckets: int = BUCKETS, watermark: str | None = None) -> None:
    """Take documents (doc_pk, sha256, text, retrieved_at, and source_url if there
    is one) from a stream until nothing is left.

    A document is rejected if one before it has its hash, or else its URL:
    batch by batch, and by key inside a batch.  What is accepted goes to
    ``documents``, and what each of ``outputs`` makes of it (chunks, tags) to a
    table of that name.  Accepted hashes and URLs are kept in ``buckets`` by
    their hash, and a batch reads only the buckets of its own.  A batch that is
    run again after a failure replaces what it wrote (``epoch=...``).  With a
    ``watermark``, state drops repeats of a hash inside it first (any one of
    them stays).
    """
    spark = landing.sparkSession
    fresh = landing.withWatermark("retrieved_at", watermark).dropDuplicatesWithinWatermark(["sha256"]) if watermark else landing
    outputs = {"chunks": document_chunks} if outputs is None else outputs
    url = F.col("source_url") if "source_url" in fresh.columns else F.lit(None).cast("string")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

    def known(kind: str, keys: DataFrame, epoch: int) -> DataFrame:
        """Accepted keys of one kind, from the buckets that hold the batch's."""
        ours = [r[0] for r in keys.where("key <> ''").select(place(F.col("key"))).distinct().collect()]  # at most as many as there are buckets
        try:
            return spark.read.schema("seq long, key string, epoch int, bucket int").parquet(f"{folder}/{kind}").where(F.col("bucket").isin(ours) & (F.col("epoch") != epoch)).select("seq", "key")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "seq long, key string")

    def append(batch: DataFrame, epoch: int) -> None:
        batch = batch.dropDuplicates(["doc_pk"]).persist()
        keys = batch.select(F.col("doc_pk").alias("seq"), F.col("sha256").alias("h"), url.alias("u"))
        none = F.lit(None).cast("string")
        old = known("hashes", keys.select(F.col("h").alias("key")), epoch).select("seq", F.col("key").alias("h"), none.alias("u"))
        old = old.unionByName(known("urls", keys.select(F.col("u").alias("key")), epoch).select("seq", none.alias("h"), F.col("key").alias("u")))
        judged = dedup_archive(keys, old, sha="h", url="u")
        won = judged.where("accepted").select(F.col("seq").alias("doc_pk"))
        batch.join(won.hint("merge"), "doc_pk", "left_semi").write.mode("overwrite").parquet(f"{folder}/documents/epoch={epoch}")
        new = spark.read.schema(fresh.schema).parquet(f"{folder}/documents/epoch={epoch}")
        for kind, key in (("hashes", F.col("sha256")), ("urls", url)):
            held = new.select(F.col("doc_pk").alias("seq"), key.alias("key"), place(key).alias("bucket")).where("key <> ''")
            held.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{kind}/epoch={epoch}")
        for name, make in outputs.items():
            make(new).write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")
        batch.unpersist()

    fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def as_glob(path: str) -> str:
    """A pattern for the path alone: a stream may then read a table of one file."""
    return f"{path[:-1]}[{path[-1]}]"


def ingest_folder(spark: SparkSession, path: str, schema, prepare, outputs: Outputs | None = None) -> Callable[[str], DataFrame]:
    """Stream a folder of Parquet files through ``ingest_stream``; gives its
    tables by name."""
    base = scratch(spark)
    landing = prepare(spark.readStream.schema(schema).parquet(as_glob(path)))
    ingest_stream(landing, base, f"{base}/state", outputs)
    return lambda name: spark.read.parquet(f"{base}/{name}")


def live_counts(spark: SparkSession, path: str, schema, by, watermark: str | None = None) -> DataFrame:
    """Counts of a stream of Parquet files by a label (or by time window and label),
    as they stand when nothing is left."""
    base = scratch(spark)
    rows = spark.readStream.schema(schema).parquet(as_glob(path))
    if watermark:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/counts")

    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/counts")
