"""Ingest, dashboards, exploration, link graph, exports, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.functions import urls as U
from corpusq.operators import dedup as D
from corpusq.operators import explore as E
from corpusq.operators import ingest as I
from corpusq.operators import linkgraph as C
from corpusq.operators import stats as A
from corpusq.operators.gazetteer import tag_entities_by, tag_topics_by
from corpusq.schema import REVIEW, foreign_key_violations, split_by_set
from corpusq.schema import key_violations as violations
from corpusq.shared import table
from corpusq.sources import export as S
from corpusq.sources.catalogue import taxonomy_tables
from corpusq.streaming import ingest as Z

from . import fixtures as fx
from .registry import query


@query("SELECT doc_pk, n = 1 AS accepted, CASE WHEN n > 1 THEN first END AS duplicate_of FROM (SELECT doc_pk, row_number() OVER w AS n, min(doc_pk) OVER (PARTITION BY sha256) AS first FROM fx_documents WINDOW w AS (PARTITION BY sha256 ORDER BY doc_pk))")
def dedup_exact(spark, sf):
    return D.dedup_by_hash(fx.documents(spark, sf).select("doc_pk", "sha256"))


@query("SELECT doc_pk AS seq, n = 1 AS accepted, CASE WHEN n > 1 THEN first END AS duplicate_of, CASE WHEN n > 1 THEN 'sha256' END AS reason FROM (SELECT doc_pk, row_number() OVER (PARTITION BY sha256 ORDER BY doc_pk) AS n, min(doc_pk) OVER (PARTITION BY sha256) AS first FROM fx_documents)")
def dedup_rounds(spark, sf):
    found = D.dedup_archive(fx.documents(spark, sf).select(F.col("doc_pk").alias("seq"), "sha256", F.lit(None).cast("string").alias("url")))
    return found.drop("in_archive")


#: The rule, one arrival after the other, over the accepted rows so far.
_SEQUENTIAL = """WITH d AS (SELECT doc_pk AS seq, sha256 AS h, source_key || '/' || (doc_pk % 97) AS u, {old} AS old FROM fx_documents),
f AS (SELECT list_reduce((SELECT list({{'s': seq, 'h': h, 'u': u}} ORDER BY seq) FROM d WHERE NOT old), lambda s, x: CASE
    WHEN list_contains(s.hs, x.h) THEN {{'hs': s.hs, 'us': s.us, 'ids': s.ids, 'out': list_append(s.out, {{'seq': x.s, 'dup': s.ids[list_position(s.hs, x.h)], 'reason': 'sha256'}})}}
    WHEN list_contains(s.us, x.u) THEN {{'hs': s.hs, 'us': s.us, 'ids': s.ids, 'out': list_append(s.out, {{'seq': x.s, 'dup': s.ids[list_position(s.us, x.u)], 'reason': 'url'}})}}
    ELSE {{'hs': list_append(s.hs, x.h), 'us': list_append(s.us, x.u), 'ids': list_append(s.ids, x.s), 'out': list_append(s.out, {{'seq': x.s, 'dup': NULL::BIGINT, 'reason': NULL::VARCHAR}})}} END,
  (SELECT {{'hs': coalesce(list(h ORDER BY seq), []::VARCHAR[]), 'us': coalesce(list(u ORDER BY seq), []::VARCHAR[]), 'ids': coalesce(list(seq ORDER BY seq), []::BIGINT[]), 'out': []::STRUCT(seq BIGINT, dup BIGINT, reason VARCHAR)[]}} FROM d WHERE old)) AS s),
o AS (SELECT unnest(s.out) AS r FROM f)
SELECT r.seq AS seq, r.reason IS NULL AS accepted, r.dup AS duplicate_of, CASE WHEN r.dup IS NOT NULL THEN r.dup IN (SELECT seq FROM d WHERE old) END AS in_archive, r.reason AS reason FROM o"""


def _arrivals(spark, sf):
    return fx.documents(spark, sf).select(F.col("doc_pk").alias("seq"), "sha256", F.concat("source_key", F.lit("/"), F.col("doc_pk") % 97).alias("url"))


@query(_SEQUENTIAL.format(old="false"))
def dedup_archive(spark, sf):
    """Hashes, else URLs, in order of arrival."""
    return D.dedup_archive(_arrivals(spark, sf))


@query(_SEQUENTIAL.format(old="doc_pk % 3 = 0"))
def dedup_with_archive(spark, sf):
    """The same, where every third document is there before."""
    d = _arrivals(spark, sf)
    return D.dedup_archive(d.where("seq % 3 <> 0"), d.where("seq % 3 = 0"))


@query("SELECT first AS kept, count(*) - 1 AS copies FROM (SELECT min(doc_pk) OVER (PARTITION BY sha256) AS first FROM fx_documents) GROUP BY first HAVING count(*) > 1")
def duplicate_report(spark, sf):
    found = D.dedup_by_hash(fx.documents(spark, sf).select("doc_pk", "sha256"))
    return found.where("not accepted").groupBy(F.col("duplicate_of").alias("kept")).agg(F.count("*").alias("copies"))


@query("SELECT doc_pk, upper(substr(source_key, 1, 8)) || '-' || printf('%05d', row_number() OVER (PARTITION BY source_key ORDER BY doc_pk)) AS document_id FROM fx_documents")
def document_ids(spark, sf):
    docs = fx.documents(spark, sf).select("doc_pk", "source_key")
    sources = docs.select("source_key").distinct().select("source_key", F.substring(F.upper("source_key"), 1, 8).alias("doc_prefix"), F.lit(1).alias("next_seq"))
    return I.document_ids(docs, sources).select("doc_pk", "document_id")


@query("SELECT doc_pk, CASE WHEN n = 1 THEN 'scan_' || (doc_pk % 50) || '.pdf' ELSE 'scan_' || (doc_pk % 50) || '.v' || (n - 1) || '.pdf' END AS stored_name FROM (SELECT doc_pk, row_number() OVER (PARTITION BY doc_pk % 50 ORDER BY doc_pk) AS n FROM fx_documents)")
def version_names(spark, sf):
    k = F.col("doc_pk")
    files = fx.documents(spark, sf).select(k.alias("seq"), (k % 50).alias("doc_pk"), F.lit("original").alias("role"), F.concat(F.lit("scan "), k % 50, F.lit(".pdf")).alias("name"))
    return I.version_names(files).select(F.col("seq").alias("doc_pk"), "stored_name")


@query("SELECT coalesce(a.doc_pk, b.doc_pk) AS path, CASE WHEN b.doc_pk IS NULL THEN 'missing' WHEN a.doc_pk IS NULL THEN 'unknown' WHEN a.sha256 = b.sha256 THEN 'ok' ELSE 'changed' END AS state FROM (SELECT doc_pk, sha256 FROM fx_documents WHERE doc_pk % 13 <> 0) a FULL JOIN (SELECT doc_pk, CASE WHEN doc_pk % 19 = 0 THEN sha256('x') ELSE sha256 END AS sha256 FROM fx_documents WHERE doc_pk % 11 <> 0) b ON a.doc_pk = b.doc_pk WHERE coalesce(a.doc_pk, b.doc_pk) IS NOT NULL")
def fixity_audit(spark, sf):
    d = fx.documents(spark, sf).select(F.col("doc_pk").alias("path"), "sha256")
    changed = F.when(F.col("path") % 19 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256"))
    return D.fixity_audit(d.where("path % 13 <> 0"), d.where("path % 11 <> 0").select("path", changed.alias("sha256")))


@query("""SELECT doc_pk, 'succeeded' AS download_status, CASE WHEN doc_pk % 6 = 0 THEN 'not_applicable' WHEN doc_pk % 9 = 0 THEN 'failed' ELSE 'succeeded' END AS text_extraction_status,
CASE WHEN doc_pk % 6 = 0 THEN 'not_applicable' WHEN doc_pk % 9 = 0 THEN CASE WHEN doc_pk % 2 = 0 THEN 'failed' ELSE 'not_applicable' END WHEN doc_pk % 2 = 0 THEN 'succeeded' ELSE 'not_applicable' END AS ocr_status, 'succeeded' AS metadata_status,
CASE WHEN doc_pk % 6 = 0 THEN 'not_applicable' ELSE 'succeeded' END AS index_status, CASE WHEN doc_pk % 6 = 0 THEN 'pending' WHEN file_size < 40 THEN 'skipped' WHEN doc_pk % 23 = 0 THEN 'failed' ELSE 'succeeded' END AS embedding_status FROM fx_documents""")
def step_statuses(spark, sf):
    d, k = fx.documents(spark, sf), F.col("doc_pk")
    return d.select("doc_pk", *I.step_states(k % 6 != 0, k % 9 == 0, k % 2 == 0, F.col("file_size") >= 40, True, k % 23 == 0))


@query("""SELECT doc_id, sha256(from_hex(CASE doc_id % 6 WHEN 0 THEN '255044462D' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN 'FFD8FF' WHEN 3 THEN '49492A00' WHEN 4 THEN '4D4D002A' ELSE '' END || hex(encode(text)))) AS sha256,
CAST(strlen(text) + CASE doc_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 4 ELSE 0 END AS BIGINT) AS file_size,
CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 5 THEN CASE WHEN doc_id % 4 = 1 THEN 'text/plain' ELSE 'application/octet-stream' END ELSE 'image/tiff' END AS mime_type, doc_id % 6 = 0 AS is_pdf FROM documents""")
def file_facts(spark, sf):
    """Bytes with the beginnings of known types before them, declared types that
    are wrong, and unknown ones."""
    k = F.col("doc_id")
    start = F.lit("")
    for n, first in enumerate(("255044462D", "89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A")):
        start = F.when(k % 6 == n, F.lit(first)).otherwise(start)
    content = F.concat(F.unhex(start), F.col("text").cast("binary"))
    declared = F.when(k % 4 == 1, F.lit("text/plain"))
    return I.file_facts(table(spark, sf, "documents").select("doc_id", content.alias("content"), declared.alias("declared_mime"))).select("doc_id", "sha256", "file_size", "mime_type", "is_pdf")


@query("""SELECT (SELECT count(*) FROM fx_documents WHERE NOT is_demo) AS documents, (SELECT count(*) FROM fx_documents WHERE NOT is_demo AND ocr_status = 'succeeded') AS ocr_succeeded,
(SELECT count(*) FROM fx_documents WHERE NOT is_demo AND text_extraction_status = 'failed') AS extraction_failed, (SELECT count(*) FROM fx_documents WHERE NOT is_demo AND index_status = 'succeeded') AS indexed,
(SELECT count(*) FROM fx_documents WHERE NOT is_demo AND embedding_status = 'succeeded') AS embedded, (SELECT count(DISTINCT author) FROM fx_documents) AS authors,
(SELECT count(*) FROM fx_pages p JOIN fx_documents d USING (doc_pk) WHERE NOT d.is_demo) AS pages, (SELECT count(DISTINCT source) FROM documents) AS sources""")
def dashboard_stats(spark, sf):
    docs = fx.documents(spark, sf)
    pages = A.child_counts(fx.pages(spark, sf), docs).withColumnRenamed("n", "pages")
    sources = docs.agg(F.count_distinct("source_key").alias("sources"))
    return A.document_counts(docs).crossJoin(F.broadcast(pages)).crossJoin(F.broadcast(sources))  # three frames of one row


@query("SELECT substr(doc_date, 1, 4) AS label, count(*) AS n FROM fx_documents WHERE NOT is_demo AND doc_date IS NOT NULL GROUP BY 1")
def documents_by_year(spark, sf):
    return A.group_counts(fx.documents(spark, sf), F.substring("doc_date", 1, 4), keep_null=False)


@query("SELECT document_type AS label, count(*) AS n FROM fx_documents WHERE NOT is_demo AND document_type IS NOT NULL GROUP BY 1")
def documents_by_type(spark, sf):
    return A.group_counts(fx.documents(spark, sf), F.col("document_type"), keep_null=False)


@query("SELECT 'ocr_status' AS kind, ocr_status AS label, count(*) AS n FROM fx_documents WHERE NOT is_demo GROUP BY 2 UNION ALL SELECT 'index_status', index_status, count(*) FROM fx_documents WHERE NOT is_demo GROUP BY 2 UNION ALL SELECT 'embedding_status', embedding_status, count(*) FROM fx_documents WHERE NOT is_demo GROUP BY 2")
def status_distribution(spark, sf):
    return A.status_counts(fx.documents(spark, sf), ["ocr_status", "index_status", "embedding_status"])


@query("SELECT label, n, round(greatest(3.0, n / max(n) OVER () * 100), 6) AS percent FROM (SELECT language AS label, count(*) AS n FROM fx_documents WHERE NOT is_demo AND language IS NOT NULL GROUP BY 1)")
def language_bars(spark, sf):
    return A.bars(A.group_counts(fx.documents(spark, sf), F.col("language"), keep_null=False))


@query("SELECT source_key, count(doc_pk) AS n FROM (SELECT DISTINCT source AS source_key FROM documents UNION SELECT 'unused') s LEFT JOIN fx_documents USING (source_key) GROUP BY source_key")
def sources_with_counts(spark, sf):
    docs = fx.documents(spark, sf).select("doc_pk", "source_key")
    keys = docs.select("source_key").union(spark.createDataFrame([("unused",)], "source_key string")).distinct()
    return A.counts_with_zero(keys, docs, "source_key", "doc_pk")


@query("SELECT CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status, count(*) AS n FROM events GROUP BY 1")
def job_counts(spark, sf):
    k = F.col("event_type")
    return A.jobs_by_status(table(spark, sf, "events").select(F.when(k == "signup", "pending").when(k == "view", "running").when(k == "error", "failed").otherwise("succeeded").alias("status")))


@query("SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_reviews(spark, sf):
    return A.latest_by(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", F.col("event_type").alias("status"), "event_id")


@query("SELECT doc_pk, 'x' || (doc_pk % 3) AS review_status FROM fx_documents WHERE doc_pk % 3 > 0")
def review_rejects(spark, sf):
    d = fx.documents(spark, sf).select("doc_pk", F.when(F.col("doc_pk") % 3 == 0, REVIEW[0]).otherwise(F.concat(F.lit("x"), F.col("doc_pk") % 3)).alias("review_status"))
    return split_by_set(d, "review_status", REVIEW)[1]


@query("SELECT o_orderkey AS event_id, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS event_date, count(l_orderkey) AS documents, CASE WHEN o_orderkey % 5 = 0 THEN 'verified' ELSE 'AI-extracted (unverified)' END AS label FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def timeline(spark, sf):
    k = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    events = table(spark, sf, "orders").select(k.alias("event_id"), F.when(k % 3 == 0, F.substring(date, 1, 4)).when(k % 3 == 1, F.substring(date, 1, 7)).otherwise(date).alias("event_date"), (k % 5 == 0).alias("verified"))
    return E.timeline(events, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id")))


@query("SELECT e.doc_pk, e.page_number, e.entity_type, e.name, e.mention, d.title, d.doc_date FROM fx_entity_tags e JOIN fx_documents d USING (doc_pk) WHERE e.name = 'token'")
def entity_documents(spark, sf):
    return E.entity_documents(fx.entity_tags(spark, sf), fx.documents(spark, sf), "token")


@query("""SELECT d.doc_pk, d.title, coalesce(t.topics, '') AS topics, coalesce(e.entities, '') AS entities FROM fx_documents d
LEFT JOIN (SELECT doc_pk, string_agg(topic_key || ':' || keyword, ';' ORDER BY topic_key) AS topics FROM fx_topic_tags GROUP BY 1) t USING (doc_pk)
LEFT JOIN (SELECT doc_pk, string_agg(name || ':' || page_number || ':' || mention, ';' ORDER BY name, page_number, mention) AS entities FROM fx_entity_tags GROUP BY 1) e USING (doc_pk)""")
def document_detail(spark, sf):
    d = E.document_detail(fx.documents(spark, sf).select("doc_pk", "title"), fx.topic_tags(spark, sf), fx.entity_tags(spark, sf))
    t = F.array_join(F.transform("topics", lambda x: F.concat_ws(":", x["topic_key"], x["keyword"])), ";")
    e = F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["name"], x["page_number"].cast("string"), x["mention"])), ";")
    return d.select("doc_pk", "title", F.coalesce(t, F.lit("")).alias("topics"), F.coalesce(e, F.lit("")).alias("entities"))


@query("SELECT doc_pk, title FROM fx_documents WHERE contains(lower(title), 'doc 1') OR contains(lower(coalesce(author, '')), 'author 2') ORDER BY doc_pk DESC LIMIT 50 OFFSET 20")
def document_page(spark, sf):
    from corpusq.operators.search import contains_text

    d = fx.documents(spark, sf).where(contains_text(F.col("title"), "doc 1") | contains_text(F.col("author"), "author 2"))
    return A.page_of(d.select("doc_pk", "title"), "doc_pk", 50, 20)


@query("SELECT n_nationkey AS entity_id, n_name AS name, n_nationkey < 4 AS placed, CASE WHEN n_nationkey < 4 THEN n_nationkey * 1.5 END AS latitude, CASE WHEN n_nationkey < 2 THEN n_nationkey * 2.5 END AS longitude FROM nation")
def map_entities(spark, sf):
    k = F.col("n_nationkey")
    d = table(spark, sf, "nation").select(k.alias("entity_id"), F.col("n_name").alias("name"), F.when(k < 4, k * 1.5).alias("latitude"), F.when(k < 2, k * 2.5).alias("longitude"))
    return E.coordinates(d).select("entity_id", "name", F.col("coordinates").isNotNull().alias("placed"), "coordinates.latitude", "coordinates.longitude")


@query("""WITH m AS (SELECT doc_pk, title FROM fx_documents WHERE NOT is_demo AND (contains(lower(title), 'doc 1') OR contains(lower(coalesce(author, '')), 'author 2') OR contains(lower(coalesce(description, '')), 'in fr')) AND doc_pk IN (SELECT doc_pk FROM fx_topic_tags WHERE topic_key = 'english'))
SELECT doc_pk, title, (SELECT count(*) FROM m) AS total FROM m ORDER BY doc_pk DESC LIMIT 50 OFFSET 20""")
def document_listing(spark, sf):
    """A page of documents beside the number of all that pass."""
    mine = fx.documents(spark, sf).where(~F.col("is_demo")).where(A.search_fields("Doc 1", "title") | A.search_fields("author 2", "author") | A.search_fields("in fr", "description"))
    topic = fx.topic_tags(spark, sf).where("topic_key = 'english'").select("doc_pk")
    return A.listing(mine.join(topic.hint("merge"), "doc_pk", "left_semi").select("doc_pk", "title"), "doc_pk", 50, 20)


@query("SELECT doc_pk, doc_date FROM fx_documents WHERE doc_date < '1975' OR (doc_date = '1975' AND doc_pk > 125) OR doc_date IS NULL ORDER BY doc_date DESC NULLS LAST, doc_pk LIMIT 60")
def document_next_page(spark, sf):
    """The page after a row, without an offset: many documents share a date."""
    return A.page_after(fx.documents(spark, sf).select("doc_pk", "doc_date"), "doc_date", 60, last=("1975", 125))


@query("SELECT doc_pk, doc_date FROM fx_documents ORDER BY doc_date DESC NULLS LAST, doc_pk LIMIT 60 OFFSET 45")
def document_offset_page(spark, sf):
    """A page by its offset, ties by key."""
    return A.page_of(fx.documents(spark, sf).select("doc_pk", "doc_date"), "doc_date", 60, 45, key="doc_pk")


@query("SELECT c.collection_key, count(d.doc_pk) AS n FROM (SELECT DISTINCT collection_key FROM fx_documents WHERE collection_key IS NOT NULL UNION SELECT 'empty') c LEFT JOIN fx_documents d USING (collection_key) GROUP BY 1")
def collections_with_counts(spark, sf):
    docs = fx.documents(spark, sf).select("doc_pk", "collection_key")
    keys = docs.where("collection_key is not null").select("collection_key").union(spark.createDataFrame([("empty",)], "collection_key string")).distinct()
    return A.counts_with_zero(keys, docs, "collection_key", "doc_pk")


@query("""SELECT (SELECT count(DISTINCT collection_key) FROM fx_documents) AS collections, (SELECT count(DISTINCT source_key) FROM fx_documents) AS sources, (SELECT count(DISTINCT topic_key) FROM fx_topic_tags) AS topics,
(SELECT count(*) FROM (SELECT DISTINCT entity_type, name FROM fx_entity_tags)) AS entities, (SELECT count(DISTINCT run_id) FROM fx_fetches) AS crawl_runs""")
def table_counts(spark, sf):
    docs = fx.documents(spark, sf)
    one = lambda df, *c: df.select(*c).where(F.col(c[0]).isNotNull()).distinct()
    return A.table_counts(
        collections=one(docs, "collection_key"), sources=one(docs, "source_key"), topics=one(fx.topic_tags(spark, sf), "topic_key"),
        entities=one(fx.entity_tags(spark, sf), "entity_type", "name"), crawl_runs=one(fx.fetches(spark, sf), "run_id"),
    )


@query("SELECT entity_type, name, count(*) AS n FROM fx_entity_tags WHERE entity_type = 'WORD' AND contains(lower(name), 'e') GROUP BY 1, 2")
def entity_list(spark, sf):
    return A.list_entities(fx.entity_tags(spark, sf), "WORD", "E")


@query("SELECT count(*) AS chunks, CAST(count(*) FILTER (WHERE doc_pk % 3 = 1) AS BIGINT) AS embedded_chunks FROM fx_chunks JOIN fx_documents USING (doc_pk) WHERE NOT is_demo")
def embedded_chunks(spark, sf):
    k = F.col("doc_pk")
    vector = F.when(k % 3 == 1, F.array(F.lit(1.0))).when(k % 3 == 2, F.array().cast("array<double>"))
    return A.embedded_counts(fx.chunks(spark, sf).select("doc_pk", vector.alias("embedding")), fx.documents(spark, sf))


@query("SELECT doc_pk, coalesce(r.event_type, 'unreviewed') AS review_status FROM fx_documents LEFT JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) r ON r.user_id = doc_pk AND n = 1")
def review_overlay(spark, sf):
    docs = fx.documents(spark, sf).select("doc_pk", F.lit(REVIEW[0]).alias("review_status"))
    reviews = table(spark, sf, "events").select(F.col("user_id").alias("doc_pk"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))
    return A.with_latest_review(docs, reviews)


@query("SELECT page_id, CASE WHEN page_id % 4 < 2 THEN page_id * 2 END AS pages, CASE WHEN page_id % 4 = 1 THEN 'late' END AS note FROM pages")
def run_statistics(spark, sf):
    k = F.col("page_id")
    text = F.when(k % 4 == 0, F.concat(F.lit('{"pages": '), k * 2, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"pages": '), k * 2, F.lit(', "note": "late"}'))).when(k % 4 == 2, F.lit("not json"))
    found = A.run_stats(table(spark, sf, "pages").select("page_id", text.alias("stats")), "pages long, note string")
    return found.select("page_id", "stats.pages", "stats.note")


@query("SELECT 'documents' AS part, count(*) AS n FROM fx_documents WHERE NOT is_demo UNION ALL SELECT 'chunks', count(*) FROM fx_chunks WHERE doc_pk % 10 <> 0 UNION ALL SELECT 'pages', count(*) FROM fx_pages WHERE doc_pk % 10 <> 0")
def without_demo(spark, sf):
    docs, rest = E.without_demo(fx.documents(spark, sf), chunks=fx.chunks(spark, sf), pages=fx.pages(spark, sf))
    n = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n("documents", docs).union(n("chunks", rest["chunks"])).union(n("pages", rest["pages"]))


@query("SELECT doc_pk, doc_pk % 7 <> 0 AND doc_pk % 5 > 1 AS servable FROM fx_documents")
def servable(spark, sf):
    k = F.col("doc_pk")
    path = F.when(k % 5 == 0, F.lit("")).when(k % 5 > 1, F.concat(F.lit("/files/"), k))
    return fx.documents(spark, sf).select("doc_pk", E.is_servable(F.when(k % 7 == 0, True).when(k % 2 == 0, False), path).alias("servable"))


@query("SELECT doc_pk, subtitle IS NULL AS no_subtitle, description, file_size, topics FROM (SELECT doc_pk, NULL AS subtitle, description, file_size FROM fx_documents) d LEFT JOIN (SELECT doc_pk AS k, count(*) AS topics FROM fx_topic_tags GROUP BY 1) t ON t.k = d.doc_pk")
def detail_fields(spark, sf):
    """The fields beyond the summary; what the archive lacks is null."""
    d = E.document_detail(fx.documents(spark, sf).drop("text"), fx.topic_tags(spark, sf), fx.entity_tags(spark, sf))
    return d.select("doc_pk", F.col("subtitle").isNull().alias("no_subtitle"), "description", "file_size", F.size("topics").cast("long").alias("topics"))


@query("SELECT page_id AS run_id, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN page_id % 5 = 0 THEN 2 ELSE 0 END ELSE 0 END AS seeds, CASE WHEN page_id % 3 = 0 OR (page_id % 3 = 1 AND page_id % 5 = 0) THEN 'running' ELSE 'skipped' END AS status FROM pages")
def crawl_runs(spark, sf):
    """Seeds given, or those of the source, or none."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    none = F.array().cast("array<string>")
    asked = p.select(k.alias("run_id"), F.concat(F.lit("s"), k % 5).alias("source_key"), F.when(k % 3 == 0, F.array("url")).when(k % 3 == 2, none).alias("seed_urls"))
    sources = p.where("page_id < 5").select(F.concat(F.lit("s"), k % 5).alias("source_key"), F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).alias("seed_urls"))
    return C.crawl_runs(asked, sources).select("run_id", F.size("seeds").alias("seeds"), "status")


@query("""WITH i AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'page' ELSE 'skipped' END AS outcome FROM pages), d AS (SELECT sha256(text) AS h, min(doc_id) AS doc FROM documents GROUP BY 1), u AS (SELECT url, min(page_id) AS doc FROM pages WHERE page_id % 2 = 0 GROUP BY 1), x AS (SELECT i.*, coalesce(CASE WHEN page_id % 4 <> 0 THEN d.doc END, u.doc) AS doc FROM i LEFT JOIN documents t ON t.doc_id = page_id LEFT JOIN d ON d.h = sha256(t.text) LEFT JOIN u USING (url))
SELECT r.run_id, url, CASE WHEN outcome = 'downloaded' AND page_id % 12 = 0 THEN 'failed' ELSE outcome END AS outcome, CASE WHEN outcome = 'downloaded' AND page_id % 12 = 0 THEN 'ingest error: bad bytes' END AS reason, CASE WHEN outcome = 'downloaded' AND page_id % 12 <> 0 THEN doc END AS doc_pk
FROM (SELECT unnest(range(0, 7)) AS run_id) r LEFT JOIN x ON x.page_id % 5 = r.run_id""")
def crawl_items(spark, sf):
    """Runs with their items, joined to the documents that downloads became, by
    their bytes, else by their URL."""
    k = F.col("page_id")
    hashes = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 4 == 0, F.lit("elsewhere")).otherwise(F.sha2("text", 256)).alias("sha256"))
    urls = table(spark, sf, "pages").where("page_id % 2 = 0").select(k.alias("doc_pk"), F.concat(F.lit("bytes "), k).alias("sha256"), F.col("url").alias("source_url"))
    docs = fx.documents(spark, sf).select("doc_pk", "sha256", F.lit(None).cast("string").alias("source_url")).unionByName(urls)
    items = table(spark, sf, "pages").join(hashes.hint("merge"), "page_id", "left").select(
        (k % 5).alias("run_id"), "url", F.when(k % 3 == 0, "downloaded").when(k % 3 == 1, "page").otherwise("skipped").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.when(k % 12 == 0, "bad bytes").alias("ingest_error"), "sha256"
    )
    return C.run_items(spark.range(7).withColumnRenamed("id", "run_id"), C.ingested_items(items, docs))


@query("""SELECT url AS src, href, CAST(pos AS INTEGER) AS pos FROM (SELECT url, unnest(['/u' || page_id, '/q?a=' || page_id || '&b=2', '/two words', '']) AS href, unnest([0, 1, 2, 3]) AS pos FROM pages)""")
def extract_links_markup(spark, sf):
    """Anchors written in other ways: bare and odd values, references, comments, look-alikes."""
    k = F.col("page_id").cast("string")
    text = F.concat(
        F.lit('<p data-href="/no"><a title="a > b" href=/u'), k, F.lit('>x</a><!-- <a href="/gone">y</a> --><A\n HREF=\'/q?a='), k, F.lit("&amp;b=2'>z</A><abbr href='/no2'>"),
        F.lit('<a data-href="/no3" class=b>w</a><a id=c href = "/two&#32;words">v</a><script>"<a href=/js>"</script><a href="">u</a>'),
    )
    return C.extract_links(table(spark, sf, "pages").select("url", text.alias("html")))


@query("""SELECT page_id, CASE WHEN page_id % 8 < 5 THEN 'address not public' END AS why FROM pages""")
def address_scope(spark, sf):
    """Hosts written as addresses, of both versions, public or not."""
    k = F.col("page_id")
    tail = (k % 200).cast("string")
    host = F.when(k % 8 == 0, F.concat(F.lit("198.18.0."), tail)).when(k % 8 == 1, F.concat(F.lit("203.0.113."), tail)).when(k % 8 == 2, F.concat(F.lit("[fe80::"), tail, F.lit("]")))
    host = host.when(k % 8 == 3, F.concat(F.lit("[2001:db8::"), tail, F.lit("]"))).when(k % 8 == 4, F.concat(F.lit("192.0.2."), tail)).when(k % 8 == 5, F.concat(F.lit("100.64.0."), tail)).when(k % 8 == 6, F.concat(F.lit("[2606:4700::"), tail, F.lit("]"))).otherwise(F.concat(F.lit("8.8.4."), tail))
    return table(spark, sf, "pages").select("page_id", U.scope(F.concat(F.lit("https://"), host, F.lit(":8080/x")), []).alias("why"))


@query(r"""WITH p AS (SELECT page_id, url, lower(split_part(url, '://', 1)) AS s, regexp_extract(url, '^[^:]+://([^/?#]*)([^?#]*)(\?[^#]*)?', 1) AS a, regexp_extract(url, '^[^:]+://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) AS path, regexp_extract(url, '^[^:]+://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS q FROM pages)
SELECT page_id, s || '://' || lower(a) || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN q = '?' THEN '' ELSE coalesce(q, '') END AS normal, lower(regexp_replace(regexp_replace(a, '^.*@', ''), ':[0-9]*$', '')) AS host FROM p""")
def normalize_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("normal"), U.host(F.col("url")).alias("host"))


_LINKS = r"""WITH l AS (SELECT page_id, url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''>]*)["'']', 1) AS hrefs FROM pages WHERE html IS NOT NULL)),
k AS (SELECT url AS src, hrefs[i] AS href, CAST(i - 1 AS INTEGER) AS pos FROM l)"""


@query(f"{_LINKS} SELECT src, href, pos FROM k")
def extract_links(spark, sf):
    return C.extract_links(table(spark, sf, "pages"))


@query(rf"""{_LINKS}, r AS (SELECT src, pos, regexp_extract(src, '^([^:]+)://', 1) || '://' || lower(regexp_extract(src, '^[^:]+://([^/?#]*)', 1)) AS root, CASE WHEN href LIKE '/%' THEN href END AS path FROM k)
SELECT src, root || CASE WHEN path = '/' THEN '/' ELSE rtrim(regexp_replace(path, '[?#].*$', ''), '/') END || regexp_extract(path, '(\?[^#]+)?$', 1) AS dst, min(pos) AS pos FROM r WHERE path IS NOT NULL AND (root LIKE '%example.org' OR root LIKE '%example.net') GROUP BY 1, 2""")
def scoped_links(spark, sf):
    return C.scoped_links(C.extract_links(table(spark, sf, "pages")), ["example.org", "Example.net"])


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'address not public' WHEN page_id % 4 = 1 THEN 'scheme not allowed' WHEN url LIKE '%example.org%' OR url LIKE '%example.net%' THEN NULL ELSE 'host not in allowed domains' END AS why FROM pages")
def url_scope(spark, sf):
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.concat(F.lit("http://10.1.2."), k % 200, F.lit("/x"))).when(k % 4 == 1, F.concat(F.lit("ftp://example.org/"), k)).otherwise(F.col("url"))
    domains = ["example.org", "example.net", *(f"10.1.2.{n}" for n in range(0, 200, 4))]
    return table(spark, sf, "pages").select("page_id", U.scope(url, domains).alias("why"))


@query(rf"""WITH RECURSIVE {_LINKS.removeprefix("WITH ")}, r AS (SELECT src, pos, regexp_extract(src, '^([^:]+)://', 1) || '://' || lower(regexp_extract(src, '^[^:]+://([^/?#]*)', 1)) AS root, CASE WHEN href LIKE '/%' THEN href END AS path FROM k),
s AS (SELECT DISTINCT src, root || CASE WHEN path = '/' THEN '/' ELSE rtrim(regexp_replace(path, '[?#].*$', ''), '/') END || regexp_extract(path, '(\?[^#]+)?$', 1) AS dst FROM r WHERE path IS NOT NULL AND (root LIKE '%example.org' OR root LIKE '%example.net')),
p AS (SELECT page_id, url, regexp_extract(url, '^[^:]+://([^/?#]*)([^?#]*)(\?[^#]*)?', 1) AS a, regexp_extract(url, '^[^:]+://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) AS path, regexp_extract(url, '^[^:]+://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS q FROM pages),
n AS (SELECT page_id, url, lower(split_part(url, '://', 1)) || '://' || lower(a) || CASE WHEN path IN ('', '/') THEN '/' ELSE rtrim(path, '/') END || CASE WHEN q = '?' THEN '' ELSE coalesce(q, '') END AS normal FROM p),
e AS (SELECT DISTINCT n.normal AS src, s.dst FROM s JOIN n ON n.url = s.src),
b AS (SELECT normal AS node, 0 AS depth FROM n WHERE page_id % 20 = 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 4) SELECT node, min(depth) AS depth FROM b GROUP BY node""")
def crawl_bfs(spark, sf):
    """What every 20th page reaches over the links of the pages."""
    p = table(spark, sf, "pages")
    links = C.scoped_links(C.extract_links(p), ["example.org", "example.net"])
    edges = links.select(U.normalize_url(F.col("src")).alias("src"), "dst", "pos")
    seeds = p.where("page_id % 20 = 0").select(U.normalize_url(F.col("url")).alias("node"), F.col("page_id").alias("pos"))
    return C.breadth_first(edges, seeds, 4)


_OUTCOMES = """WITH o AS (SELECT *, CASE WHEN NOT (host LIKE '%.org' OR host LIKE '%.com') THEN 'blocked' WHEN http_status IS NULL OR http_status >= 400 THEN 'failed' WHEN content_type = 'application/pdf' THEN 'downloaded'
WHEN content_type = 'text/html' OR url LIKE '%.html' OR url LIKE '%/' THEN 'page' ELSE 'skipped' END AS outcome FROM fx_fetches)"""


@query(f"{_OUTCOMES} SELECT page_id, outcome FROM o")
def crawl_outcomes(spark, sf):
    return _classified(spark, sf).select("page_id", "outcome")


def _classified(spark, sf):
    return C.classify_fetches(fx.fetches(spark, sf), ["org", "com"], [".pdf"])


_REPORT = f"""{_OUTCOMES} SELECT run_id, count(*) AS urls_seen, count(*) FILTER (WHERE outcome = 'blocked') AS urls_blocked, count(*) FILTER (WHERE outcome = 'failed') AS urls_failed, count(*) FILTER (WHERE outcome = 'downloaded') AS urls_downloaded,
count(*) FILTER (WHERE outcome = 'skipped') AS urls_skipped, count(*) FILTER (WHERE outcome = 'page') AS pages_read, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2) AS duration_seconds, coalesce(string_agg(CASE WHEN outcome = 'failed' AND n <= 100 THEN url END, chr(10) ORDER BY ts, url), '') AS errors FROM (SELECT *, row_number() OVER (PARTITION BY run_id, outcome ORDER BY ts, url) AS n FROM o) GROUP BY run_id"""


@query(_REPORT)
def crawl_report(spark, sf):
    """With the reference's limit of 100 errors a report."""
    return C.crawl_report(_classified(spark, sf))


@query(f"""WITH r AS ({_REPORT})
SELECT run_id, md5('# Crawl ' || run_id || chr(10) || '- urls_seen: ' || urls_seen || chr(10) || '- urls_blocked: ' || urls_blocked || chr(10) || '- urls_failed: ' || urls_failed || chr(10) || '- urls_downloaded: ' || urls_downloaded || chr(10) || '- urls_skipped: ' || urls_skipped || chr(10)
|| '- pages_read: ' || pages_read || chr(10) || '- duration_seconds: ' || duration_seconds || chr(10) || '## Errors' || CASE WHEN errors = '' THEN '' ELSE chr(10) || '- ' || array_to_string(list_slice(string_split(errors, chr(10)), 1, 50), chr(10) || '- ') END) AS markdown_md5 FROM r""")
def crawl_report_markdown(spark, sf):
    """Counters and the first 50 errors as Markdown."""
    found = S.report_markdown(C.crawl_report(_classified(spark, sf)))
    return found.select("run_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query("SELECT page_id, gap_seconds FROM (SELECT page_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host ORDER BY ts, url)) / 1e6 AS gap_seconds FROM fx_fetches) WHERE gap_seconds < 20")
def politeness_gaps(spark, sf):
    return C.politeness_gaps(fx.fetches(spark, sf), 0.05).select("page_id", "gap_seconds")


@query("SELECT page_id, url NOT LIKE '%example.org/de%' OR url LIKE '%example.org/de/1%' AS allowed FROM pages")
def robots_rules(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    hosts = p.select(U.host(F.col("url")).alias("host")).distinct().where(F.col("host").endswith("example.org"))
    rules = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(n).alias("rule_ord"), F.lit(x).alias("prefix"), F.lit(ok).alias("allow")) for n, (x, ok) in enumerate((("/de/1", True), ("/de", False)))])).alias("r")).select("host", "r.*")
    return C.allowed_by_rules(p, rules).select("page_id", "allowed")


@query("SELECT document_id, title, author, doc_date AS date, document_type, source_url, CAST(NULL AS VARCHAR) AS archived_url, CAST(NULL AS VARCHAR) AS local_path, sha256, CAST(NULL AS VARCHAR) AS mime_type, file_size, CAST(NULL AS VARCHAR) AS page_count, ocr_status, index_status, CAST(NULL AS VARCHAR) AS rights_status, CAST(NULL AS VARCHAR) AS retrieved_at FROM fx_documents WHERE NOT is_demo")
def manifest(spark, sf):
    return S.manifest(fx.documents(spark, sf))


@query("""SELECT doc_pk AS id, document_id, title, author, doc_date AS date, date_precision, document_type, CAST(1 + doc_pk % 9 AS INTEGER) AS page_count, language, source_url, CASE WHEN doc_pk % 4 = 0 THEN 'https://web.example.org/' || doc_pk END AS archived_url,
'unknown' AS rights_status, 'open' AS access_status, sha256, is_demo, ocr_status, text_extraction_status, index_status, embedding_status, 'pdf' AS metadata_source, 'unreviewed' AS review_status, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_pk), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS retrieved_at FROM fx_documents""")
def catalogue(spark, sf):
    """All 22 fields of the summary."""
    return S.catalogue(_described(spark, sf), include_demo=True)


def _described(spark, sf):
    k = F.col("doc_pk")
    return fx.documents(spark, sf).select(
        "*", (1 + k % 9).cast("int").alias("page_count"), F.when(k % 4 == 0, F.concat(F.lit("https://web.example.org/"), k)).alias("archived_url"), F.lit("unknown").alias("rights_status"), F.lit("open").alias("access_status"),
        F.lit("pdf").alias("metadata_source"), F.lit("unreviewed").alias("review_status"), F.timestamp_seconds(F.lit(1704067200) + k).alias("retrieved_at"), F.concat(F.lit("/files/"), "document_id").alias("local_path"), F.lit("application/pdf").alias("mime_type"),
    )


@query("""SELECT document_id, title, author, doc_date AS date, document_type AS "type", source_url, CASE WHEN doc_pk % 4 = 0 THEN 'https://web.example.org/' || doc_pk END AS archived_url, '/files/' || document_id AS local_path, sha256, 'application/pdf' AS mime_type, file_size,
CAST(1 + doc_pk % 9 AS INTEGER) AS page_count, ocr_status, index_status, 'unknown' AS rights_status, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_pk), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS retrieved_at FROM fx_documents""")
def manifest_by_script(spark, sf):
    """The script's manifest: demo documents too, and a type of its own name."""
    return S.manifest(_described(spark, sf), include_demo=True, type_name="type")


@query("""SELECT document_id, '@misc{' || replace(document_id, '-', '') || ',' || chr(10) || concat_ws(',' || chr(10), '  title = {' || title || '}', '  author = {' || author || '}', '  year = {' || substr(doc_date, 1, 4) || '}', '  url = {' || source_url || '}', '  note = {Document ID ' || document_id || '; SHA256 ' || sha256 || '}') || chr(10) || '}' AS entry FROM fx_documents WHERE NOT is_demo""")
def bibtex(spark, sf):
    return S.bibtex(fx.documents(spark, sf))


@query("SELECT sha256, count(*) AS n FROM fx_documents GROUP BY 1 HAVING count(*) > 1")
def key_violations(spark, sf):
    return violations(fx.documents(spark, sf), "sha256")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)")
def fk_violations(spark, sf):
    return foreign_key_violations(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", table(spark, sf, "orders").where("o_orderkey % 7 <> 0"), "o_orderkey")


def _streamed(spark, sf, outputs=None):
    k = F.col("doc_id")
    prepare = lambda df: df.select(
        k.alias("doc_pk"), F.sha2("text", 256).alias("sha256"), "text", F.timestamp_seconds(F.lit(1704067200) + k).alias("retrieved_at"), F.concat("source", F.lit("/"), k % 97).alias("source_url")
    )
    return Z.ingest_folder(spark, f"{sf}/documents.parquet", table(spark, sf, "documents").schema, prepare, outputs)


_ACCEPTED = "WITH " + _SEQUENTIAL.format(old="false").removeprefix("WITH ").split("SELECT r.seq AS seq")[0] + ", accepted AS (SELECT r.seq AS doc_pk FROM o WHERE r.reason IS NULL)"


@query(f"{_ACCEPTED} SELECT c.chunk_id, c.page_number, md5(c.text) AS text_md5 FROM fx_chunks c WHERE c.doc_pk IN (SELECT doc_pk FROM accepted)")
def stream_ingest(spark, sf):
    """Chunks of what a stream of documents brings in, by hash, else URL."""
    return _streamed(spark, sf)("chunks").select("chunk_id", "page_number", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"{_ACCEPTED} SELECT doc_pk, topic_key, label, keyword, md5(evidence) AS evidence_md5 FROM fx_topic_tags WHERE doc_pk IN (SELECT doc_pk FROM accepted)")
def stream_tags(spark, sf):
    """Topics of what the stream brings in, tagged as it arrives."""
    topics, _ = taxonomy_tables(spark, fx.TOPICS, fx.NAMES)
    found = _streamed(spark, sf, {"topic_tags": lambda docs: tag_topics_by(docs, topics)})("topic_tags")
    return found.select("doc_pk", "topic_key", "label", "keyword", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"))


#: A taxonomy from the data: words of the benchmark as names and as keywords.
_WORDS = r"""WITH w AS (SELECT DISTINCT item_id, x AS word FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS x FROM benchmark)), v AS (SELECT word, min(item_id) AS item_id FROM w GROUP BY 1)"""


def _benchmark_words(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.min("item_id").alias("item_id"))


@query(rf"""{_WORDS}, p AS (SELECT DISTINCT doc_pk, page_number, t FROM (SELECT doc_pk, page_number, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM fx_pages))
SELECT doc_pk, page_number, 'ITEM' || (item_id % 4) AS entity_type, word AS name FROM p JOIN v ON t = word""")
def entity_tags_by_table(spark, sf):
    """Thousands of names in one pass over the pages."""
    names = _benchmark_words(spark, sf).select(F.concat(F.lit("ITEM"), F.col("item_id") % 4).alias("entity_type"), F.col("word").alias("name"))
    return tag_entities_by(fx.pages(spark, sf), names).drop("mention")


@query(f"""{_WORDS}, t AS (SELECT 'item' || item_id AS topic_key, word AS keyword, row_number() OVER (PARTITION BY item_id ORDER BY word DESC) AS kw_ord FROM v),
h AS (SELECT doc_id AS doc_pk, text, topic_key, keyword, instr(lower(text), keyword) AS pos, row_number() OVER (PARTITION BY doc_id, topic_key ORDER BY kw_ord) AS n FROM documents JOIN t ON contains(lower(text), keyword))
SELECT doc_pk, topic_key, keyword, md5(trim(substr(text, greatest(1, pos - 40), pos + length(keyword) + 40 - greatest(1, pos - 40)), chr(10) || ' ')) AS evidence_md5 FROM h WHERE n = 1""")
def topic_tags_by_table(spark, sf):
    """As many topics as the benchmark has items, by their words."""
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("word")))
    topics = _benchmark_words(spark, sf).select(F.concat(F.lit("item"), "item_id").alias("topic_key"), F.lit("Item").alias("label"), order.alias("kw_ord"), F.col("word").alias("keyword"))
    found = tag_topics_by(table(spark, sf, "documents").select(F.col("doc_id").alias("doc_pk"), "text"), topics)
    return found.select("doc_pk", "topic_key", "keyword", F.md5(F.col("evidence").cast("binary")).alias("evidence_md5"))


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf):
    return Z.live_counts(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema, [F.col("event_type").alias("label")])


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    found = Z.live_counts(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema, [F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("label")], watermark="1 hour")
    return found.select(F.col("w.start").cast(T.TimestampNTZType()).alias("hour"), "label", "n")
