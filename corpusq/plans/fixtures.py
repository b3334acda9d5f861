"""An archive over the given tables: the same views in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.chunk import chunk_pages
from corpusq.operators.pages import line_pages, segment_pages
from corpusq.operators.tag import tag_entities, tag_topics
from corpusq.shared import stored, table

TOPICS = [
    ("license", "License", ["license"]),
    ("german", "German", ["keit"]),
    ("spanish", "Spanish", ["ción"]),
    ("english", "English", ["tion", "the"]),
    ("french", "French", ["ment", "que"]),
    ("absent", "Absent", ["war", "map"]),
]
NAMES = [("TERM", "License"), ("TERM", "token"), ("WORD", "that"), ("WORD", "die"), ("WORD", "les")]
#: Questions that are blank, unknown or repeat a word, beside those of the user turns
ODD_QUESTIONS = [("q1", "license"), ("q2", "token"), ("q3", "tion the"), ("q4", "   "), ("q5", "zzzunknownzzz"), ("q6", "the the")]

SQL_VIEWS: dict[str, str] = {
    "fx_documents": """
SELECT d.doc_id AS doc_pk, upper(substr(d.source, 1, 8)) || '-' || printf('%05d', d.doc_id) AS document_id, 'Doc ' || d.doc_id AS title,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE 'Author ' || (d.doc_id % 23) END AS author,
  CASE d.doc_id % 4 WHEN 0 THEN printf('%04d', 1950 + d.doc_id % 50) WHEN 1 THEN printf('%04d-%02d', 1950 + d.doc_id % 50, 1 + d.doc_id % 12)
    WHEN 2 THEN printf('%04d-%02d-%02d', 1950 + d.doc_id % 50, 1 + d.doc_id % 12, 1 + d.doc_id % 28) END AS doc_date,
  CASE d.doc_id % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'exact' ELSE 'unknown' END AS date_precision,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL WHEN d.doc_id % 3 = 0 THEN 'report' WHEN d.doc_id % 3 = 1 THEN 'letter' ELSE 'memo' END AS document_type,
  d.lang AS language, d.source AS source_key, 'https://archive.example.org/' || d.source || '/Doc_' || d.doc_id || '.pdf' AS source_url,
  sha256(d.text) AS sha256, CAST(length(d.text) AS BIGINT) AS file_size, d.doc_id % 10 = 0 AS is_demo,
  CASE d.doc_id % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'not_applicable' END AS ocr_status,
  CASE d.doc_id % 9 WHEN 0 THEN 'failed' ELSE 'succeeded' END AS text_extraction_status,
  CASE d.doc_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'pending' ELSE 'failed' END AS index_status,
  CASE d.doc_id % 2 WHEN 0 THEN 'succeeded' ELSE 'skipped' END AS embedding_status,
  CASE WHEN d.doc_id % 3 > 0 THEN 'Paper in ' || d.lang END AS description, CASE WHEN d.doc_id % 6 > 0 THEN 'col' || (d.doc_id % 4) END AS collection_key, d.text
FROM documents d""",
    "fx_pages": """
SELECT doc_pk, CAST(k + 1 AS INTEGER) AS page_number, array_to_string(list_slice(parts, k * 10 + 1, k * 10 + 10), chr(10) || chr(10)) AS text
FROM (SELECT doc_id AS doc_pk, parts, unnest(range(0, (len(parts) - 1) // 10 + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))""",
    "fx_folds": r"""
SELECT doc_pk, page_number, list_reduce(paras, lambda s, p: CASE
    WHEN length(CASE WHEN s.buf = '' THEN p ELSE s.buf || chr(10) || chr(10) || p END) <= 1200
    THEN {'buf': CASE WHEN s.buf = '' THEN p ELSE s.buf || chr(10) || chr(10) || p END, 'start': CASE WHEN s.buf = '' THEN s."cursor" ELSE s.start END, 'cursor': s."cursor" + length(p) + 2, 'done': s.done}
    ELSE {'buf': CASE WHEN s.buf = '' THEN p ELSE trim(right(s.buf, 150) || chr(10) || chr(10) || p, chr(10) || ' ') END, 'start': s."cursor", 'cursor': s."cursor" + length(p) + 2,
      'done': CASE WHEN trim(s.buf, chr(10) || ' ') = '' THEN s.done ELSE list_append(s.done, {'t': trim(s.buf, chr(10) || ' '), 's': s.start, 'e': s.start + length(s.buf)}) END} END,
    {'buf': '', 'start': 0::BIGINT, 'cursor': 0::BIGINT, 'done': []::STRUCT(t VARCHAR, s BIGINT, e BIGINT)[]}) AS s
FROM (SELECT doc_pk, page_number, list_filter(list_transform(regexp_split_to_array(trim(text, chr(10) || ' '), '\n\s*\n'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '') AS paras FROM fx_pages)""",
    "fx_cuts": """
SELECT doc_pk, page_number, CASE WHEN trim(s.buf, chr(10) || ' ') = '' THEN s.done ELSE list_append(s.done, {'t': trim(s.buf, chr(10) || ' '), 's': s.start, 'e': s.start + length(s.buf)}) END AS cuts FROM fx_folds""",
    "fx_chunks": """
SELECT doc_pk || '-c' || printf('%04d', base + i - 1) AS chunk_id, doc_pk, page_number, CAST(base + i - 1 AS INTEGER) AS chunk_index, cuts[i].t AS text,
  CAST(cuts[i].s AS INTEGER) AS char_start, CAST(cuts[i].e AS INTEGER) AS char_end, CAST(greatest(1, length(cuts[i].t) // 4) AS INTEGER) AS token_estimate
FROM (SELECT doc_pk, page_number, cuts, base, unnest(range(1, len(cuts) + 1)) AS i FROM (
  SELECT *, CAST(coalesce(sum(len(cuts)) OVER (PARTITION BY doc_pk ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM fx_cuts))""",
    "fx_questions": "SELECT conv_id || '-' || turn AS question_id, min(text) AS question FROM conversations WHERE role = 'user' AND conv_id % 20 = 0 GROUP BY conv_id, turn UNION ALL SELECT * FROM (VALUES "
    + ", ".join(f"('{i}', '{q}')" for i, q in ODD_QUESTIONS)
    + ") AS q(question_id, question)",
    "fx_topics": "SELECT * FROM (VALUES " + ", ".join(f"({o}, '{k}', '{label}', {j}, '{w}')" for o, (k, label, ws) in enumerate(TOPICS) for j, w in enumerate(ws)) + ") AS t(topic_ord, topic_key, label, kw_ord, keyword)",
    "fx_topic_tags": """
SELECT doc_pk, topic_key, label, keyword, trim(substr(text, greatest(1, pos - 40), pos + length(keyword) + 40 - greatest(1, pos - 40)), chr(10) || ' ') AS evidence
FROM (SELECT d.doc_id AS doc_pk, d.text, t.*, instr(lower(d.text), t.keyword) AS pos, row_number() OVER (PARTITION BY d.doc_id, t.topic_key ORDER BY t.kw_ord) AS n
  FROM documents d JOIN fx_topics t ON contains(lower(d.text), t.keyword)) WHERE n = 1""",
    "fx_names": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{n}')" for t, n in NAMES) + ") AS n(entity_type, name)",
    "fx_entity_tags": r"""
SELECT DISTINCT p.doc_pk, p.page_number, n.entity_type, n.name, regexp_extract(p.text, '(?i)(?:^|[^\p{L}\p{N}_])(' || n.name || ')(?:$|[^\p{L}\p{N}_])', 1) AS mention
FROM fx_pages p JOIN fx_names n ON regexp_matches(p.text, '(?i)(?:^|[^\p{L}\p{N}_])(' || n.name || ')(?:$|[^\p{L}\p{N}_])')""",
    "fx_citations": """
SELECT doc_pk AS run_id, 'c1' AS citation_ref, CASE WHEN doc_pk % 11 = 0 THEN 'nowhere' ELSE chunk_id END AS chunk_id,
  CASE WHEN doc_pk % 17 = 0 THEN 'OTHER-1' WHEN doc_pk % 2 = 0 THEN CAST(doc_pk AS VARCHAR) END AS document_id, CASE WHEN doc_pk % 13 = 0 THEN 9999 WHEN doc_pk % 6 = 1 THEN page_number END AS page,
  CASE WHEN doc_pk % 7 = 0 THEN 'no such quote' WHEN doc_pk % 3 = 1 THEN '  ' || lower(substr(text, 5, 40)) ELSE substr(text, 10, 60) END AS quote
FROM fx_chunks WHERE chunk_index = 0
UNION ALL SELECT doc_pk, 'c2', chunk_id, NULL, page_number, substr(text, 1, 25) FROM fx_chunks WHERE chunk_index = 1""",
    "fx_fetches": """
SELECT page_id % 5 AS run_id, page_id, url, CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 17 = 0 THEN NULL ELSE 200 END AS http_status,
  CASE WHEN page_id % 13 = 0 THEN 'application/pdf' WHEN page_id % 19 = 0 THEN 'image/gif' ELSE 'text/html' END AS content_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(page_id * 7 % 1000 AS BIGINT)) AS ts, split_part(split_part(url, '//', 2), '/', 1) AS host, html FROM pages""",
}


def documents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    year, month, day = 1950 + k % 50, 1 + k % 12, 1 + k % 28
    pick = lambda n, *values: F.when(F.lit(False), F.lit("")) if not values else _pick(k % n, values)
    return table(spark, sf, "documents").select(
        k.alias("doc_pk"),
        F.format_string("%s-%05d", F.upper(F.substring("source", 1, 8)), k).alias("document_id"),
        F.concat(F.lit("Doc "), k).alias("title"),
        F.when(k % 7 != 0, F.concat(F.lit("Author "), k % 23)).alias("author"),
        F.when(k % 4 == 0, F.format_string("%04d", year)).when(k % 4 == 1, F.format_string("%04d-%02d", year, month)).when(k % 4 == 2, F.format_string("%04d-%02d-%02d", year, month, day)).alias("doc_date"),
        pick(4, "year", "month", "exact", "unknown").alias("date_precision"),
        F.when(k % 11 != 0, pick(3, "report", "letter", "memo")).alias("document_type"),
        F.col("lang").alias("language"),
        F.col("source").alias("source_key"),
        F.concat(F.lit("https://archive.example.org/"), "source", F.lit("/Doc_"), k, F.lit(".pdf")).alias("source_url"),
        F.sha2("text", 256).alias("sha256"),
        F.length("text").cast("long").alias("file_size"),
        (k % 10 == 0).alias("is_demo"),
        pick(5, "succeeded", "failed", "skipped", "not_applicable").alias("ocr_status"),
        F.when(k % 9 == 0, "failed").otherwise("succeeded").alias("text_extraction_status"),
        pick(3, "succeeded", "pending", "failed").alias("index_status"),
        pick(2, "succeeded", "skipped").alias("embedding_status"),
        F.when(k % 3 > 0, F.concat(F.lit("Paper in "), "lang")).alias("description"),
        F.when(k % 6 > 0, F.concat(F.lit("col"), k % 4)).alias("collection_key"),
        "text",
    )


def _pick(rest, values):
    out = F.lit(None).cast("string")
    for n, v in enumerate(values):
        out = F.when(rest == n, F.lit(v)).otherwise(out)
    return out


def pages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_pk"), "text")
    return segment_pages(docs, line_pages(F.col("text")))


def chunks(spark: SparkSession, sf: str, native: bool = False) -> DataFrame:
    return chunk_pages(pages(spark, sf), native=native)


def kept_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks, written once for what reads them several times."""
    return stored(chunks(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Whole user turns of every 20th conversation, and the odd ones."""
    asked = table(spark, sf, "conversations").where("role = 'user' and conv_id % 20 = 0").groupBy("conv_id", "turn").agg(F.min("text").alias("question"))
    turns = asked.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), "question")
    return turns.unionByName(spark.createDataFrame(ODD_QUESTIONS, "question_id string, question string"))


def topic_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tag_topics(table(spark, sf, "documents").select(F.col("doc_id").alias("doc_pk"), "text"), TOPICS)


def entity_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tag_entities(pages(spark, sf), NAMES)


def citations(spark: SparkSession, sf: str) -> DataFrame:
    c, k = chunks(spark, sf), F.col("doc_pk")
    first = c.where("chunk_index = 0").select(
        k.alias("run_id"),
        F.lit("c1").alias("citation_ref"),
        F.when(k % 11 == 0, "nowhere").otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(k % 17 == 0, "OTHER-1").when(k % 2 == 0, k.cast("string")).alias("document_id"),
        F.when(k % 13 == 0, 9999).when(k % 6 == 1, F.col("page_number")).alias("page"),
        F.when(k % 7 == 0, "no such quote").when(k % 3 == 1, F.concat(F.lit("  "), F.lower(F.substring("text", 5, 40)))).otherwise(F.substring("text", 10, 60)).alias("quote"),
    )
    second = c.where("chunk_index = 1").select(k, F.lit("c2"), "chunk_id", F.lit(None).cast("string"), "page_number", F.substring("text", 1, 25))
    return first.union(second)


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, sf, "pages").select(
        (k % 5).alias("run_id"),
        k,
        "url",
        F.when(k % 11 == 0, 404).when(k % 17 == 0, F.lit(None)).otherwise(200).alias("http_status"),
        F.when(k % 13 == 0, "application/pdf").when(k % 19 == 0, "image/gif").otherwise("text/html").alias("content_type"),
        F.timestamp_seconds(F.lit(1704067200) + k * 7 % 1000).alias("ts"),
        F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"),
        "html",
        F.lit(None).cast("binary").alias("head"),
    )
