"""Pages, chunks, text functions, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.functions import text as X
from corpusq.functions.dates import chosen_date, file_date, within
from corpusq.operators import pages as P
from corpusq.operators import stats as A
from corpusq.operators.embed import hash_weights
from corpusq.operators.tag import dimension
from corpusq.shared import table

from . import fixtures as fx
from .registry import query


@query("SELECT doc_pk, page_number, CAST(length(text) AS BIGINT) AS char_count, md5(text) AS text_md5 FROM fx_pages")
def page_segmentation(spark, sf):
    p = fx.pages(spark, sf)
    return p.select("doc_pk", "page_number", F.col("char_count").cast("long").alias("char_count"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_pk, count(*) AS pages, CAST(count(*) FILTER (WHERE length(trim(text, chr(10) || ' ')) < 40) AS BIGINT) AS need_ocr FROM fx_pages GROUP BY doc_pk")
def page_triage(spark, sf):
    p = fx.pages(spark, sf).withColumn("need", P.needs_ocr(F.col("text")))
    return p.groupBy("doc_pk").agg(F.count("*").alias("pages"), F.count_if("need").alias("need_ocr"))


@query("""
WITH m AS (SELECT doc_pk, page_number, length(trim(text, chr(10) || ' ')) < 40 AND length('recognised text of page ' || page_number) > length(trim(text, chr(10) || ' ')) AND page_number % 2 = 1 AS take, length(text) AS n,
  length('recognised text of page ' || page_number) AS o, 0.5 + (doc_pk % 5) / 10.0 AS conf FROM fx_pages)
SELECT doc_pk, bool_or(take) AS used_ocr, CAST(count(*) FILTER (WHERE take) AS BIGINT) AS ocr_pages, round(avg(CASE WHEN take THEN conf END), 6) AS mean_confidence,
  CAST(sum(CASE WHEN take THEN o ELSE n END) AS BIGINT) AS total_chars, count(*) AS page_count FROM m GROUP BY doc_pk""")
def ocr_summary(spark, sf):
    p = fx.pages(spark, sf)
    seen = p.where("page_number % 2 = 1").select("doc_pk", "page_number", F.concat(F.lit("recognised text of page "), "page_number").alias("ocr_text"), (0.5 + (F.col("doc_pk") % 5) / 10).alias("confidence"))
    return P.ocr_summary(P.merge_ocr(p, seen)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(r"""SELECT doc_id, CASE WHEN b = '' THEN 'file' ELSE substr(b, 1, 200) END AS safe_name
FROM (SELECT doc_id, trim(regexp_replace(trim(text, chr(10) || ' '), '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS b FROM documents)""")
def safe_filename(spark, sf):
    """Of whole texts: only the operator cuts, after runs have collapsed."""
    return table(spark, sf, "documents").select("doc_id", X.safe_filename(F.col("text")).alias("safe_name"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS normal_md5, CAST(length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS BIGINT) AS n FROM documents")
def normalize_text(spark, sf):
    t = X.normalize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(t.cast("binary")).alias("normal_md5"), F.length(t).cast("long").alias("n"))


@query(r"""WITH s AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Bearer ' || md5(text) WHEN 1 THEN 'sk-' || md5(text) ELSE '' END || ' ' || text AS t FROM documents)
SELECT doc_id, md5(r) AS redacted_md5, contains(r, '[REDACTED]') AS had_secret FROM (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)bearer\s+[A-Za-z0-9._\-]+', 'Bearer [REDACTED]', 'g'), '\b(sk|gsk|xai|or)-[A-Za-z0-9._\-]{8,}\b', '[REDACTED]', 'g') AS r FROM s)""")
def redact_secrets(spark, sf):
    d, m = table(spark, sf, "documents"), F.md5(F.col("text").cast("binary"))
    t = F.concat(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Bearer "), m)).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("sk-"), m)).otherwise(""), F.lit(" "), "text")
    r = X.redact(t)
    return d.select("doc_id", F.md5(r.cast("binary")).alias("redacted_md5"), F.contains(r, F.lit("[REDACTED]")).alias("had_secret"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '[REDACTED]' ELSE event_type END AS token, event_type AS kind, '****' || right(md5(event_type || event_id), 4) AS hint FROM events")
def redact_records(spark, sf):
    kind = F.col("event_type")
    m = X.redact_map(F.create_map(F.when(kind == "error", F.lit("Token")).otherwise(F.lit("note")), kind, F.lit("kind"), kind))
    return table(spark, sf, "events").select("event_id", F.coalesce(m["Token"], m["note"]).alias("token"), m["kind"].alias("kind"), X.mask(F.md5(F.concat(kind, F.col("event_id")).cast("binary"))).alias("hint"))


@query("SELECT doc_id, md5(regexp_replace(text, '(?i)(the)', '<mark>\\1</mark>', 'g')) AS marked_md5, CAST((length(regexp_replace(text, '(?i)(the)', '<mark>\\1</mark>', 'g')) - length(text)) // 13 AS BIGINT) AS marks FROM documents")
def highlight_phrase(spark, sf):
    h = X.highlight(F.col("text"), "the")
    return table(spark, sf, "documents").select("doc_id", F.md5(h.cast("binary")).alias("marked_md5"), ((F.length(h) - F.length("text")) / 13).cast("long").alias("marks"))


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS token_estimate FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).cast("long").alias("token_estimate"))


@query("SELECT source AS prefix_of, upper(substr(source, 1, 8)) AS doc_prefix, CAST(1 AS INTEGER) AS next_seq FROM documents GROUP BY source")
def source_dimension(spark, sf):
    from corpusq.operators.ingest import new_sources

    keys = table(spark, sf, "documents").select(F.col("source").alias("source_key")).distinct()
    return new_sources(keys, keys.limit(0)).select(F.col("source_key").alias("prefix_of"), "doc_prefix", "next_seq")


_CHUNK_SQL = "SELECT chunk_id, doc_pk, page_number, chunk_index, char_start, char_end, token_estimate, md5(text) AS text_md5 FROM fx_chunks"


def _chunk_rows(c):
    return c.select("chunk_id", "doc_pk", "page_number", "chunk_index", "char_start", "char_end", "token_estimate", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(_CHUNK_SQL)
def chunk_pages(spark, sf):
    return _chunk_rows(fx.chunks(spark, sf))


@query(_CHUNK_SQL)
def chunk_pages_native(spark, sf):
    return _chunk_rows(fx.chunks(spark, sf, native=True))


@query("SELECT doc_pk, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS longest, CAST(sum(token_estimate) AS BIGINT) AS tokens FROM fx_chunks GROUP BY doc_pk")
def chunk_stats(spark, sf):
    n = F.length("text")
    return fx.chunks(spark, sf).groupBy("doc_pk").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"), F.sum("token_estimate").alias("tokens"))


@query("SELECT doc_pk, topic_key, label, keyword, md5(evidence) AS evidence_md5 FROM fx_topic_tags")
def topic_tags(spark, sf):
    return fx.topic_tags(spark, sf).select("doc_pk", "topic_key", "label", "keyword", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"))


@query("SELECT doc_pk, page_number, entity_type, name, mention FROM fx_entity_tags")
def entity_tags(spark, sf):
    return fx.entity_tags(spark, sf)


@query("SELECT t.topic_key, count(g.doc_pk) AS n FROM (SELECT DISTINCT topic_key FROM fx_topics) t LEFT JOIN fx_topic_tags g USING (topic_key) GROUP BY t.topic_key")
def topic_counts(spark, sf):
    keys = spark.createDataFrame([(k,) for k, _, _ in fx.TOPICS], "topic_key string")
    return A.counts_with_zero(keys, fx.topic_tags(spark, sf), "topic_key", "doc_pk")


@query("SELECT n.name, count(e.doc_pk) AS n FROM fx_names n LEFT JOIN fx_entity_tags e USING (name) GROUP BY n.name")
def entity_counts(spark, sf):
    names = spark.createDataFrame([(n,) for _, n in fx.NAMES], "name string")
    return A.counts_with_zero(names, fx.entity_tags(spark, sf), "name", "doc_pk")


@query("SELECT DISTINCT entity_type, name FROM fx_entity_tags UNION SELECT 'TERM', 'license'")
def entity_dimension(spark, sf):
    return dimension(fx.entity_tags(spark, sf), spark.createDataFrame([("TERM", "license")], "entity_type string, name string"), "entity_type", "name")


@query(r"""WITH w AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM fx_chunks),
h AS (SELECT chunk_id, md5(word) AS m FROM w),
b AS (SELECT chunk_id, CAST(('0x' || substr(m, 25, 8))::BIGINT % 256 AS INTEGER) AS idx, count(*) AS n FROM h GROUP BY ALL)
SELECT chunk_id, idx, round(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)), 6) AS weight FROM b""")
def hash_embedding(spark, sf):
    return hash_weights(fx.chunks(spark, sf), "chunk_id").withColumn("weight", F.round("weight", 6))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '20240' || (doc_id % 7) WHEN 1 THEN '2024' WHEN 2 THEN '202401' || (10 + doc_id % 10) END AS raw,
CASE doc_id % 4 WHEN 0 THEN '2024-0' || (doc_id % 7) WHEN 1 THEN '2024' WHEN 2 THEN '2024-01-' || (10 + doc_id % 10) END AS date,
CASE doc_id % 4 WHEN 0 THEN 'month' WHEN 1 THEN 'year' WHEN 2 THEN 'exact' ELSE 'unknown' END AS precision FROM documents""")
def partial_dates(spark, sf):
    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit("20240"), k % 7)).when(k % 4 == 1, "2024").when(k % 4 == 2, F.concat(F.lit("202401"), 10 + k % 10))
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"), file_date(F.concat(F.lit("D:"), raw)).alias("d")).select("doc_id", "raw", "d.date", "d.precision")


@query(r"""WITH t AS (SELECT doc_pk, regexp_extract(substr('printed ' || (1790 + doc_pk % 320) || '. ' || text, 1, 2000), '\b(1[89][0-9]{2}|20[0-9]{2})\b', 1) AS y, doc_date FROM fx_documents)
SELECT doc_pk, nullif(y, '') AS text_year, coalesce(doc_date >= '1962-01-01' AND doc_date <= '1975', false) AS in_range FROM t""")
def year_from_text(spark, sf):
    d = fx.documents(spark, sf)
    t = F.concat(F.lit("printed "), 1790 + F.col("doc_pk") % 320, F.lit(". "), "text")
    chosen = chosen_date(F.lit(None).cast("string"), F.lit(None).cast("string"), t)
    return d.select("doc_pk", chosen["date"].alias("text_year"), within(F.col("doc_date"), "1962-01-01", "1975").alias("in_range"))


@query("SELECT doc_pk, 'Doc ' || doc_pk AS title, CASE WHEN doc_pk % 7 = 0 THEN NULL ELSE 'Author ' || (doc_pk % 23) END AS author, 'title derived from filename' AS notes FROM fx_documents")
def metadata_title(spark, sf):
    from corpusq.operators.ingest import metadata

    d = fx.documents(spark, sf).select("doc_pk", "source_url", F.col("author").alias("meta_author"), F.lit(" ").alias("meta_title"), F.lit(None).cast("string").alias("created"), F.lit(None).cast("string").alias("modified"), F.lit("").alias("first_page"))
    return metadata(d).select("doc_pk", "title", "author", "notes")
