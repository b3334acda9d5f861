"""Retrieval, evidence and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.functions.vectors import cosine
from corpusq.operators import evidence as V
from corpusq.operators import fulltext as T
from corpusq.operators import search as R
from corpusq.operators.cells import cells_topk
from corpusq.operators.embed import hash_vectors
from corpusq.shared import scratch, stored, table
from corpusq.sources import export as S

from . import fixtures as fx
from .registry import query

_TERMS = r"list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: x <> '')"
_HITS = f"""
asked AS (SELECT question_id, {_TERMS} AS terms FROM fx_questions),
hits AS (SELECT question_id, chunk_id, doc_pk, CAST(sum((length(low) - length(replace(low, t, ''))) // length(t)) AS BIGINT) AS hits, string_agg(CASE WHEN contains(low, t) THEN t END, ', ' ORDER BY i) AS matched
  FROM (SELECT question_id, unnest(terms) AS t, unnest(range(1, len(terms) + 1)) AS i FROM asked), (SELECT chunk_id, doc_pk, lower(text) AS low FROM pool) GROUP BY ALL HAVING sum((length(low) - length(replace(low, t, ''))) // length(t)) > 0)"""
_KEYWORD = "SELECT question_id, chunk_id, hits, matched, CAST(n AS INTEGER) AS rank, round(hits / max(hits) OVER (PARTITION BY question_id), 6) AS keyword_score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, chunk_id) AS n FROM hits) WHERE n <= 10"


@query(f"WITH pool AS (SELECT * FROM fx_chunks), {_HITS} {_KEYWORD}")
def keyword_search(spark, sf):
    found = R.keyword_search(fx.questions(spark, sf), fx.kept_chunks(spark, sf))
    return found.select("question_id", "chunk_id", "hits", "matched", "rank", F.round("keyword_score", 6).alias("keyword_score"))


@query(f"""WITH pool AS (SELECT * FROM fx_chunks WHERE doc_pk IN (SELECT doc_pk FROM fx_documents WHERE NOT is_demo AND contains(lower(author), 'author 1') AND language = 'en' AND doc_date >= '1962' AND doc_date <= '1990')
  AND doc_pk IN (SELECT doc_pk FROM fx_topic_tags WHERE topic_key = 'english')), {_HITS} {_KEYWORD}""")
def filtered_keyword_search(spark, sf):
    allowed = R.eligible(fx.documents(spark, sf), R.Filters(author="Author 1", language="en", date_from="1962", date_to="1990", topic_key="english"), topics=fx.topic_tags(spark, sf))
    found = R.keyword_search(fx.questions(spark, sf), stored(fx.chunks(spark, sf).join(allowed.hint("merge"), "doc_pk", "left_semi")))
    return found.select("question_id", "chunk_id", "hits", "matched", "rank", F.round("keyword_score", 6).alias("keyword_score"))


_BUCKET = r"""
cw0 AS (SELECT chunk_id, CAST(('0x' || substr(md5(word), 25, 8))::BIGINT % 256 AS INTEGER) AS idx, count(*) AS n FROM (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM fx_chunks) GROUP BY ALL),
cw AS (SELECT chunk_id, idx, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS w FROM cw0),
qw0 AS (SELECT question_id, CAST(('0x' || substr(md5(word), 25, 8))::BIGINT % 256 AS INTEGER) AS idx, count(*) AS n FROM (SELECT question_id, unnest(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: x <> '')) AS word FROM fx_questions) GROUP BY ALL),
qw AS (SELECT question_id, idx, n / sqrt(sum(n * n) OVER (PARTITION BY question_id)) AS w FROM qw0),
sem AS (SELECT question_id, chunk_id, round(sum(cw.w * qw.w), 9) AS semantic_score FROM cw JOIN qw USING (idx) GROUP BY ALL),
semtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY semantic_score DESC, chunk_id) AS sr FROM sem) WHERE sr <= 30)"""


@query(f"WITH {_BUCKET} SELECT question_id, chunk_id, round(semantic_score, 6) AS semantic_score, CAST(sr AS INTEGER) AS semantic_rank FROM semtop WHERE sr <= 10")
def vector_topk_sparse(spark, sf):
    found = R.sparse_topk(hash_vectors(fx.questions(spark, sf), "question_id", "question"), hash_vectors(fx.chunks(spark, sf), "chunk_id"), 10)
    return found.select("question_id", "chunk_id", F.round("semantic_score", 6).alias("semantic_score"), "semantic_rank")


@query("""WITH q AS (SELECT vec_id AS question_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT question_id, vec_id, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 9) AS score FROM q, embeddings)
SELECT question_id, vec_id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5""")
def vector_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return R.vector_topk(asked, v, 5).select("question_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_HYBRID = f"""WITH pool AS (SELECT * FROM fx_chunks), {_HITS}, {_BUCKET},
kw AS (SELECT question_id, chunk_id, matched, hits / max(hits) OVER (PARTITION BY question_id) AS keyword_score, kr FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, chunk_id) AS kr FROM hits) WHERE kr <= 30),
m AS (SELECT question_id, chunk_id, coalesce(keyword_score, 0.0) AS keyword_score, coalesce(semantic_score, 0.0) AS semantic_score, matched, kr, sr FROM kw FULL OUTER JOIN semtop USING (question_id, chunk_id)),
c AS (SELECT *, round(0.5 * keyword_score + 0.5 * greatest(semantic_score, 0.0), 9) AS combined_score FROM m),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY combined_score DESC, kr NULLS LAST, sr NULLS LAST, chunk_id) AS INTEGER) AS rank FROM c)"""


@query(f"{_HYBRID} SELECT question_id, chunk_id, round(keyword_score, 6) AS keyword_score, round(semantic_score, 6) AS semantic_score, round(combined_score, 6) AS combined_score, rank, 'hybrid' AS effective_mode FROM top WHERE rank <= 10")
def hybrid_search(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return _hybrid(spark, sf).select("question_id", "chunk_id", r("keyword_score"), r("semantic_score"), r("combined_score"), "rank", "effective_mode")


def _hybrid(spark, sf, c=None, k=10):
    c, q = fx.kept_chunks(spark, sf) if c is None else c, fx.questions(spark, sf)
    return R.hybrid_search(q, c, hash_vectors(q, "question_id", "question"), hash_vectors(c, "chunk_id"), k)


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


_INDEX = rf"""
fw AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM fx_chunks),
fp AS (SELECT chunk_id, term, pos FROM (SELECT chunk_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM fw) WHERE term NOT IN ({_STOPS})),
ft AS (SELECT chunk_id, term, count(*) AS tf FROM fp GROUP BY ALL), fl AS (SELECT chunk_id, sum(tf) AS dl FROM ft GROUP BY 1), fd AS (SELECT term, count(*) AS df FROM ft GROUP BY 1),
fn AS (SELECT (SELECT count(*) FROM fx_chunks) AS total, (SELECT avg(dl) FROM fl) AS mean)"""
_RANKED = """
score AS (SELECT h.question_id, h.chunk_id, round(coalesce(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 0), 9) AS score
  FROM (SELECT DISTINCT question_id, chunk_id FROM held) h LEFT JOIN (SELECT DISTINCT question_id, term FROM parts WHERE NOT minus) p USING (question_id) LEFT JOIN ft ON ft.chunk_id = h.chunk_id AND ft.term = p.term LEFT JOIN fd ON fd.term = ft.term LEFT JOIN fl ON fl.chunk_id = h.chunk_id, fn GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM score)
SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"""


@query(rf"""WITH {_INDEX},
parts AS (SELECT DISTINCT question_id, false AS minus, unnest(list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({_STOPS}))) AS term FROM fx_questions),
held AS (SELECT question_id, chunk_id FROM parts JOIN ft USING (term)), {_RANKED}""")
def fulltext_search(spark, sf):
    """Any word of a whole user turn."""
    words = F.regexp_extract_all(F.lower("question"), F.lit(T.WORD), F.lit(0))
    asked = fx.questions(spark, sf).select("question_id", F.array_join(words, " or ").alias("question"))
    return T.fulltext_search(asked, fx.kept_chunks(spark, sf)).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


#: Forms of questions, from the fifth to the twelfth word of a chunk: how they are
#: written, and their alternatives as (minus, words) with a word's place.
_FORMS = {
    "ors": ("%5 or %9 OR %12", [[(False, [5])], [(False, [9])], [(False, [12])]]),
    "phrase_or": ('"%5 %6" or %12', [[(False, [5, 6])], [(False, [12])]]),
    "or_minus": ("%9 or -%5", [[(False, [9])], [(True, [5])]]),
    "minus_phrase": ('%12 -"%5 %6"', [[(False, [12]), (True, [5, 6])]]),
    "joined": ("%5_%6", [[(False, [5, 6])]]),
    "phrase_and": ('%9 "%5 %6 %7"', [[(False, [9]), (False, [5, 6, 7])]]),
    "only_minus": ('-"%5 %6" -%9', [[(True, [5, 6]), (True, [9])]]),
    "ands_or": ("%5 %6 or %9 %12", [[(False, [5]), (False, [6])], [(False, [9]), (False, [12])]]),
}
_FORM_PARTS = ", ".join(f"('{f}', {a}, {p}, {'true' if minus else 'false'}, {at})" for f, (_, alts) in _FORMS.items() for a, ps in enumerate(alts) for p, (minus, words) in enumerate(ps) for at in words)


@query(rf"""WITH {_INDEX},
asked AS (SELECT chunk_id AS source, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM fx_chunks WHERE chunk_index = 0 AND doc_pk % 50 = 0), forms AS (SELECT * FROM (VALUES {_FORM_PARTS}) AS f(form, alt, part, minus, spot)),
parts AS (SELECT source || '-' || form AS question_id, alt, part, minus, ws[spot] AS term, spot AS place FROM asked, forms WHERE len(ws) >= 12 AND ws[spot] NOT IN ({_STOPS})),
sizes AS (SELECT question_id, alt, part, minus, count(*) AS n FROM parts GROUP BY ALL),
alts AS (SELECT question_id, alt, count(*) FILTER (WHERE NOT minus) AS need FROM sizes GROUP BY ALL),
met AS (SELECT DISTINCT question_id, alt, part, minus, chunk_id FROM (SELECT question_id, alt, part, minus, chunk_id, pos - place AS start, count(DISTINCT place) AS got FROM parts JOIN fp USING (term) GROUP BY ALL) JOIN sizes USING (question_id, alt, part, minus) WHERE got = n),
counted AS (SELECT question_id, alt, chunk_id, count(*) FILTER (WHERE NOT minus) AS have, count(*) FILTER (WHERE minus) AS bad FROM met GROUP BY ALL),
held AS (SELECT question_id, chunk_id FROM counted JOIN alts USING (question_id, alt) WHERE have = need AND bad = 0 AND need > 0
  UNION ALL SELECT question_id, chunk_id FROM alts, fx_chunks WHERE need = 0 AND NOT EXISTS (SELECT 1 FROM counted c WHERE c.question_id = alts.question_id AND c.alt = alts.alt AND c.chunk_id = fx_chunks.chunk_id AND bad > 0)), {_RANKED}""")
def fulltext_forms(spark, sf):
    """Chains of or, phrases in them, words and phrases left out, joined words."""
    c = fx.kept_chunks(spark, sf)
    words = F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))
    asked = c.where("chunk_index = 0 and doc_pk % 50 = 0").select("chunk_id", words.alias("ws")).where("size(ws) >= 12")
    filled = []
    for form, (written, _) in _FORMS.items():
        text = F.lit(written)
        for at in (12, 9, 7, 6, 5):
            text = F.replace(text, F.lit(f"%{at}"), F.element_at("ws", at))
        filled.append(F.struct(F.lit(form).alias("form"), text.alias("question")))
    each = asked.select("chunk_id", F.explode(F.array(*filled)).alias("q"))
    q = each.select(F.concat_ws("-", "chunk_id", "q.form").alias("question_id"), "q.question")
    return T.fulltext_search(q, c).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_EVIDENCE = f"""{_HYBRID}, five AS (SELECT * FROM top WHERE rank <= 5), e AS (SELECT *, 'c' || row_number() OVER (PARTITION BY question_id ORDER BY rank) AS ref
FROM (SELECT *, max(combined_score) OVER (PARTITION BY question_id) AS mx FROM five) WHERE combined_score >= 0.01 OR mx < 0.01)"""


def _evidence(spark, sf, c=None):
    return V.evidence_set(_hybrid(spark, sf, c).where("rank <= 5"))


@query(f"{_EVIDENCE} SELECT question_id, chunk_id, ref, round(combined_score, 4) AS score FROM e")
def evidence_set(spark, sf):
    return _evidence(spark, sf).select("question_id", "chunk_id", "ref", F.round("combined_score", 4).alias("score"))


@query(f"""{_EVIDENCE}, p AS (SELECT e.question_id, e.rank, '[' || ref || '] document_id=' || d.document_id || ' chunk_id=' || e.chunk_id || ' page=' || c.page_number || ' title=''' || d.title || '''' || chr(10) || trim(c.text, chr(10) || ' ') || chr(10) || '---' AS piece
  FROM e JOIN fx_chunks c USING (chunk_id) JOIN fx_documents d ON d.doc_pk = c.doc_pk)
SELECT question_id, md5('{V.BEGIN}' || chr(10) || string_agg(piece, chr(10) ORDER BY rank) || chr(10) || '{V.END}') AS block_md5 FROM p GROUP BY question_id""")
def evidence_block(spark, sf):
    c = fx.kept_chunks(spark, sf)
    d = fx.documents(spark, sf).select("doc_pk", "document_id", "title")
    e = stored(_evidence(spark, sf, c).select("question_id", "rank", "ref", "chunk_id"))
    e = T.of_hits(e, c.select("chunk_id", "doc_pk", "page_number", "text")).join(d.hint("merge"), "doc_pk")
    return V.evidence_block(e).select("question_id", F.md5(F.col("block").cast("binary")).alias("block_md5"))


@query(f"""{_EVIDENCE}, n AS (SELECT question_id, count(*) AS chunks, count(DISTINCT split_part(chunk_id, '-', 1)) AS docs FROM e GROUP BY 1)
SELECT q.question_id, CASE WHEN chunks IS NULL THEN 'insufficient' ELSE 'answer' END AS route, coalesce(docs, 0) AS documents_retrieved, coalesce(chunks, 0) AS chunks_retrieved, CAST(CASE WHEN chunks IS NULL THEN 3 ELSE 0 END AS INTEGER) AS suggestions FROM fx_questions q LEFT JOIN n USING (question_id)""")
def question_routes(spark, sf):
    e = _evidence(spark, sf).withColumn("doc_pk", F.split_part("chunk_id", F.lit("-"), F.lit(1)))
    return V.route(fx.questions(spark, sf), e, configured=True).drop("message").withColumn("suggestions", F.coalesce(F.size("suggestions"), F.lit(0)))


_VALID = f"""WITH pc AS (SELECT doc_pk, count(*) AS page_count FROM fx_pages GROUP BY 1), nz AS (SELECT c.*, k.doc_pk, k.page_number AS kp, trim(regexp_replace(lower(k.text), '\\s+', ' ', 'g')) AS kt, trim(regexp_replace(lower(coalesce(c.quote, '')), '\\s+', ' ', 'g')) AS nq, coalesce(c.page, k.page_number) AS resolved
  FROM fx_citations c LEFT JOIN fx_chunks k USING (chunk_id)),
j AS (SELECT nz.*, p.text AS pt, p.doc_pk IS NOT NULL AS has_page, pc.page_count FROM nz LEFT JOIN fx_pages p ON p.doc_pk = nz.doc_pk AND p.page_number = resolved LEFT JOIN pc ON pc.doc_pk = nz.doc_pk),
v AS (SELECT run_id, citation_ref, chunk_id, resolved AS page_number, concat_ws('; ', CASE WHEN doc_pk IS NULL THEN '{V.NOT_FOUND}' END, CASE WHEN doc_pk % 10 = 3 THEN '{V.NOT_EVIDENCE}' END,
  CASE WHEN doc_pk IS NOT NULL AND coalesce(document_id, '') <> '' AND document_id <> CAST(doc_pk AS VARCHAR) THEN 'document_id mismatch (chunk belongs to ' || doc_pk || ')' END,
  CASE WHEN doc_pk IS NOT NULL AND resolved IS NOT NULL AND NOT has_page AND page_count > 0 AND resolved > page_count THEN 'page ' || resolved || ' exceeds document page_count ' || page_count END,
  CASE WHEN doc_pk IS NOT NULL AND coalesce(quote, '') <> '' AND NOT contains(kt, nq) AND NOT contains(trim(regexp_replace(lower(coalesce(pt, '')), '\\s+', ' ', 'g')), nq) THEN '{V.NO_QUOTE}' END) AS note FROM j)"""


def _validated(spark, sf):
    pages = fx.pages(spark, sf)
    chunks = fx.chunks(spark, sf)
    docs = pages.groupBy("doc_pk").agg(F.count("*").alias("page_count")).withColumn("document_id", F.col("doc_pk").cast("string"))
    allowed = chunks.where("doc_pk % 10 <> 3").select(F.col("doc_pk").alias("run_id"), "chunk_id")
    return V.validate_citations(fx.citations(spark, sf), chunks, docs, pages, allowed)


@query(f"{_VALID} SELECT run_id, citation_ref, chunk_id, page_number, note = '' AS valid, CASE WHEN note = '' THEN 'ok' ELSE note END AS note FROM v")
def citation_validation(spark, sf):
    return _validated(spark, sf).select("run_id", "citation_ref", "chunk_id", "page_number", "valid", "note")


@query(f"""{_VALID}, b AS (SELECT run_id, count(*) AS total, CAST(count(*) FILTER (WHERE note = '') AS BIGINT) AS good, coalesce(string_agg(CASE WHEN note <> '' THEN citation_ref END, ', ' ORDER BY citation_ref), '') AS invalid_refs FROM v GROUP BY 1)
SELECT d.doc_id AS run_id, coalesce(total, 0) AS total, coalesce(good, 0) AS good, CASE WHEN coalesce(good, 0) = 0 THEN 'insufficient_evidence' WHEN good = total THEN 'supported' ELSE 'partially_supported' END AS confidence, coalesce(invalid_refs, '') AS invalid_refs
FROM documents d LEFT JOIN b ON b.run_id = d.doc_id""")
def answer_confidence(spark, sf):
    runs = table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"))
    return V.answer_confidence(_validated(spark, sf), runs)


@query("""SELECT run_id, citation_ref, chunk_id, page FROM fx_citations WHERE run_id % 9 <> 0""")
def parse_answers(spark, sf):
    """All citations out of the answers of all runs: some without ids, some with
    words around their JSON, some broken."""
    k = F.col("run_id")
    of = fx.citations(spark, sf).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("citation_ref", "chunk_id", "page"))).alias("cited"))
    one = lambda c: F.struct(F.when(k % 4 != 0, c["citation_ref"]).otherwise("").alias("id"), c["chunk_id"].alias("chunk_id"), c["page"].alias("page"))
    body = F.to_json(F.struct(F.lit("x").alias("answer"), F.transform("cited", one).alias("citations")))
    text = F.when(k % 9 == 0, F.concat(F.lit("oops "), F.substring(body, 1, 20))).when(k % 2 == 1, F.concat(F.lit("Sure! Here it is:\n"), body, F.lit("\nDone."))).otherwise(body)
    return V.parse_answers(of.select("run_id", text.alias("answer_text"))).select("run_id", "citation_ref", "chunk_id", "page")


@query(f"""WITH pool AS (SELECT * FROM fx_chunks), {_HITS}, k AS ({_KEYWORD})
SELECT k.question_id, k.chunk_id, k.rank, d.document_id, d.title, d.doc_date AS date, c.page_number, md5(substr(c.text, 1, 500)) AS passage_md5, 'Keyword match: ' || k.matched AS reason
FROM k JOIN fx_chunks c USING (chunk_id) LEFT JOIN fx_documents d ON d.doc_pk = c.doc_pk""")
def search_results(spark, sf):
    """Hits with their document's fields; a document may be missing."""
    docs = fx.documents(spark, sf).select("doc_pk", "document_id", "title", F.col("doc_date").alias("date"))
    found = R.keyword_search(fx.questions(spark, sf), fx.kept_chunks(spark, sf)).join(docs.hint("merge"), "doc_pk", "left")
    passage = F.md5(F.substring("text", 1, 500).cast("binary"))
    return found.select("question_id", "chunk_id", "rank", "document_id", "title", "date", "page_number", passage.alias("passage_md5"), F.concat(F.lit("Keyword match: "), "matched").alias("reason"))


@query(f"{_EVIDENCE} SELECT question_id, ref, e.chunk_id, round(keyword_score, 4) AS keyword_score, round(semantic_score, 4) AS semantic_score, round(combined_score, 4) AS combined_score, md5(substr(c.text, 1, 600)) AS passage_md5 FROM e JOIN fx_chunks c USING (chunk_id)")
def source_rows(spark, sf):
    """The sources shown beside an answer."""
    c = fx.kept_chunks(spark, sf)
    found = V.source_rows(_evidence(spark, sf, c), c)
    return found.withColumn("passage_md5", F.md5(F.col("passage").cast("binary"))).drop("passage")


@query(f"""{_HYBRID} SELECT question_id, rank, t.chunk_id, d.document_id, d.title, d.doc_date AS date, c.page_number, md5(substr(c.text, 1, 500)) AS passage_md5, round(keyword_score, 4) AS keyword_score, round(semantic_score, 4) AS semantic_score, round(combined_score, 4) AS combined_score,
concat_ws('; ', 'Keyword match: ' || matched, CASE WHEN sr IS NOT NULL THEN 'Lexical-hash similarity (test/demo embedder): ' || printf('%.2f', semantic_score) END) AS reason
FROM top t JOIN fx_chunks c USING (chunk_id) LEFT JOIN fx_documents d ON d.doc_pk = c.doc_pk WHERE rank <= 10""")
def hybrid_results(spark, sf):
    """Hybrid hits as they are shown, with all three scores and the reason."""
    c = fx.kept_chunks(spark, sf)
    found = V.search_rows(_hybrid(spark, sf, c), c, fx.documents(spark, sf))
    return found.withColumn("passage_md5", F.md5(F.col("passage").cast("binary"))).withColumn("reason", F.array_join("match_reasons", "; ")).drop("passage", "match_reasons")


@query("""SELECT doc_pk AS question_id, document_id, doc_pk, is_demo AS include_demo, CASE WHEN doc_pk % 2 = 0 THEN 12 ELSE 8 END AS top_k, CASE WHEN doc_pk % 2 = 0 THEN 'Summarize' ELSE 'What' END AS first_word FROM fx_documents WHERE doc_pk % 20 = 1 OR doc_pk % 20 = 10""")
def document_questions(spark, sf):
    """Questions about one document, and summaries."""
    d, k = fx.documents(spark, sf), F.col("doc_pk")
    asked = d.where((k % 20 == 1) | (k % 20 == 10)).select(k.alias("question_id"), "document_id", F.lit("What is it?").alias("question"), (k % 2 == 0).alias("summarize"))
    unknown = asked.select("question_id", F.lit("NOWHERE-1").alias("document_id"), "question", "summarize")
    found = V.document_questions(asked.union(unknown), d)
    return found.withColumn("first_word", F.split_part("question", F.lit(" "), F.lit(1))).drop("question")


@query("""SELECT run_id, CASE WHEN run_id % 9 = 0 THEN '' ELSE 'x' END AS answer, CAST(CASE WHEN run_id % 9 = 0 THEN 0 ELSE 2 END AS INTEGER) AS claims, CASE WHEN run_id % 9 > 0 THEN 'supported' END AS confidence FROM fx_citations WHERE citation_ref = 'c1'""")
def answer_parts(spark, sf):
    """Answer, claims and confidence out of an answer's JSON."""
    k = F.col("run_id")
    body = F.concat(F.lit('Here: {"answer":"x","claims":["one","two '), k, F.lit('"],"confidence":"supported","citations":[]}'))
    text = F.when(k % 9 == 0, F.substring(body, 1, 30)).otherwise(body)
    found = V.answer_parts(fx.citations(spark, sf).where("citation_ref = 'c1'").select(k, text.alias("answer_text")))
    return found.withColumn("claims", F.size("claims"))


@query(f"""{_VALID} SELECT run_id, CAST(count(*) FILTER (WHERE note <> '') AS VARCHAR) || ' citation(s) failed validation and are flagged: ' || string_agg(CASE WHEN note <> '' THEN citation_ref END, ', ' ORDER BY citation_ref) || '.' AS warning FROM v GROUP BY run_id HAVING count(*) FILTER (WHERE note <> '') > 0""")
def citation_warnings(spark, sf):
    runs = table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"))
    return V.warnings(V.answer_confidence(_validated(spark, sf), runs)).where("warning is not null").select("run_id", "warning")


@query("SELECT a.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark, sf):
    """Each vector with the one after it."""
    v = table(spark, sf, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after.hint("merge"), "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query()
def vector_topk_cells(spark, sf):
    """Approximate; a test measures its recall against ``vector_topk``."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return cells_topk(asked, v, 5)


@query("SELECT chunk_id FROM fx_chunks WHERE doc_pk IN (SELECT doc_pk FROM fx_documents WHERE NOT is_demo AND collection_key = 'col1')")
def collection_chunks(spark, sf):
    """Chunks of the documents of a collection."""
    allowed = R.eligible(fx.documents(spark, sf), R.Filters(collection_key="col1"))
    return fx.chunks(spark, sf).join(allowed.hint("merge"), "doc_pk", "left_semi").select("chunk_id")


@query("""SELECT substr(text, 1, 120) AS title, md5(text) AS question_md5, '[{"conv_id":' || conv_id || ',"turn":' || turn || '}]' AS citations_json, CAST(1 AS INTEGER) AS sources_back FROM conversations WHERE role = 'user'""")
def research_sessions(spark, sf):
    """Saved questions, with citations and sources as JSON and read back."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    one = F.array(F.struct("conv_id", "turn"))
    saved = S.session_rows(c.select(F.col("text").alias("question"), F.lit("").alias("answer"), one.alias("citations"), one.alias("sources")))
    back = S.read_sessions(saved, "array<struct<conv_id: long, turn: long>>", "array<struct<conv_id: long, turn: long>>")
    return back.select("title", F.md5(F.col("question").cast("binary")).alias("question_md5"), F.to_json("citations").alias("citations_json"), F.size("sources").alias("sources_back"))




@query(f"""{_VALID} SELECT run_id, CAST(1 AS BIGINT) AS runs, count(*) AS citations, CAST(sum(CASE WHEN note = '' THEN 1 ELSE 0 END) AS BIGINT) AS validated, string_agg(citation_ref || '=' || CASE WHEN note = '' THEN 'ok' ELSE note END, '|' ORDER BY citation_ref) AS notes FROM v GROUP BY run_id""")
def answer_audit(spark, sf):
    """What the audit tables keep of each run, written twice under one name."""
    base, valid = scratch(spark), stored(_validated(spark, sf))
    runs = valid.select("run_id").distinct()
    for _ in range(2):
        V.append_audit(valid, runs, f"{base}/runs", f"{base}/citations", "first")
    note = F.concat_ws("=", "citation_ref", "validation_note")
    kept = spark.read.parquet(f"{base}/citations").groupBy("run_id").agg(F.count("*").alias("citations"), F.count_if("validated").alias("validated"), F.array_join(F.sort_array(F.collect_list(note)), "|").alias("notes"))
    return spark.read.parquet(f"{base}/runs").groupBy("run_id").agg(F.count("*").alias("runs")).join(kept.hint("merge"), "run_id")


_ONE_DOCUMENT = rf"""WITH q AS (SELECT doc_pk AS question_id, doc_pk, CASE WHEN doc_pk % 2 = 0 THEN '{V.SUMMARIZE}' ELSE 'What is it, the most of it?' END AS question, CASE WHEN doc_pk % 2 = 0 THEN 12 ELSE 8 END AS k,
  CASE WHEN doc_pk % 3 = 0 OR (doc_pk % 3 = 1 AND doc_pk % 7 = 0) THEN 'keyword' WHEN doc_pk % 3 = 1 THEN 'semantic' ELSE 'hybrid' END AS mode, doc_pk % 3 <> 1 AS words, doc_pk % 3 <> 0 AND doc_pk % 7 <> 0 AS vectors FROM fx_documents WHERE doc_pk % 20 IN (1, 10)),
t AS (SELECT question_id, doc_pk, k, unnest({_TERMS}) AS t FROM q WHERE words),
h AS (SELECT question_id, k, chunk_id, sum((length(low) - length(replace(low, t, ''))) // length(t)) AS hits FROM t JOIN (SELECT chunk_id, doc_pk, lower(text) AS low FROM fx_chunks) c USING (doc_pk) GROUP BY ALL HAVING hits > 0),
kw AS (SELECT question_id, chunk_id, hits / max(hits) OVER (PARTITION BY question_id) AS keyword_score, kr FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, chunk_id) AS kr FROM h) WHERE kr <= greatest(3 * k, 30)),
cw0 AS (SELECT chunk_id, doc_pk, CAST(('0x' || substr(md5(word), 25, 8))::BIGINT % 256 AS INTEGER) AS idx, count(*) AS n FROM (SELECT chunk_id, doc_pk, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM fx_chunks) GROUP BY ALL),
cw AS (SELECT chunk_id, doc_pk, idx, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS w FROM cw0),
qw0 AS (SELECT question_id, doc_pk, k, CAST(('0x' || substr(md5(word), 25, 8))::BIGINT % 256 AS INTEGER) AS idx, count(*) AS n FROM (SELECT question_id, doc_pk, k, unnest({_TERMS}) AS word FROM q WHERE vectors) GROUP BY ALL),
qw AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY question_id)) AS w FROM qw0),
sem AS (SELECT question_id, k, chunk_id, round(sum(cw.w * qw.w), 9) AS semantic_score FROM cw JOIN qw USING (idx, doc_pk) GROUP BY ALL),
st AS (SELECT question_id, chunk_id, semantic_score, sr FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY semantic_score DESC, chunk_id) AS sr FROM sem) WHERE sr <= greatest(3 * k, 30)),
m AS (SELECT question_id, chunk_id, coalesce(keyword_score, 0.0) AS keyword_score, coalesce(semantic_score, 0.0) AS semantic_score, kr, sr FROM kw FULL OUTER JOIN st USING (question_id, chunk_id)),
c AS (SELECT m.*, mode, k, round(CASE mode WHEN 'keyword' THEN keyword_score WHEN 'semantic' THEN semantic_score ELSE 0.5 * keyword_score + 0.5 * greatest(semantic_score, 0.0) END, 9) AS combined_score FROM m JOIN q USING (question_id)),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY combined_score DESC, kr NULLS LAST, sr NULLS LAST, chunk_id) AS INTEGER) AS rank FROM c)"""


def _one_document(spark, sf):
    d, c, k = fx.documents(spark, sf), fx.kept_chunks(spark, sf), F.col("doc_pk")
    asked = d.where((k % 20 == 1) | (k % 20 == 10)).select(k.alias("question_id"), "document_id", F.lit("What is it, the most of it?").alias("question"), (k % 2 == 0).alias("summarize"))
    q = V.document_questions(asked, d).withColumn("mode", F.when(k % 3 == 0, "keyword").when(k % 3 == 1, "semantic").otherwise("hybrid"))
    q = stored(q.withColumn("pool", F.when(~F.col("include_demo"), "plain")))
    vectors = hash_vectors(q.where("doc_pk % 7 <> 0"), "question_id", "question")
    # every question is limited to a document: vectors of the others are never looked at
    asked_of = c.select("chunk_id", "doc_pk", "text").join(q.select("doc_pk").distinct().hint("merge"), "doc_pk", "left_semi")
    return R.hybrid_search(q, c, vectors, hash_vectors(asked_of, "chunk_id"), passed=R.pools(d, {"plain": R.Filters()}))


@query(f"{_ONE_DOCUMENT} SELECT question_id, chunk_id, round(keyword_score, 6) AS keyword_score, round(semantic_score, 6) AS semantic_score, round(combined_score, 6) AS combined_score, rank, mode AS effective_mode FROM top WHERE rank <= k")
def document_answers(spark, sf):
    """Questions to one document, and summaries: each with its own document,
    number of hits and mode; some have no vector."""
    r = lambda c: F.round(c, 6).alias(c)
    return _one_document(spark, sf).select("question_id", "chunk_id", r("keyword_score"), r("semantic_score"), r("combined_score"), "rank", "effective_mode")


@query(f"{_ONE_DOCUMENT}, f AS (SELECT *, max(combined_score) OVER (PARTITION BY question_id) AS mx FROM top WHERE rank <= k) SELECT question_id, chunk_id, 'c' || row_number() OVER (PARTITION BY question_id ORDER BY rank) AS ref FROM f WHERE combined_score >= 0.01 OR mx < 0.01")
def document_evidence(spark, sf):
    """The evidence for them."""
    return V.evidence_set(_one_document(spark, sf)).select("question_id", "chunk_id", "ref")


_MODE = "CASE conv_id % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'semantic' ELSE 'hybrid' END"


@query(f"""SELECT conv_id || '-' || turn AS question_id, {_MODE} AS requested_mode, CASE WHEN conv_id % 2 = 0 THEN 'keyword' ELSE {_MODE} END AS effective_mode,
CASE WHEN conv_id % 2 = 0 AND conv_id % 3 > 0 THEN '{R.NO_VECTORS}' END AS note FROM conversations WHERE role = 'user'""")
def search_notes(spark, sf):
    """Modes asked for and had, with and without vectors."""
    k = F.col("conv_id")
    mode = F.when(k % 3 == 0, "keyword").when(k % 3 == 1, "semantic").otherwise("hybrid")
    c = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.concat_ws("-", k.cast("string"), F.col("turn").cast("string")).alias("question_id"), mode.alias("mode"))
    return R.mode_notes(c, k % 2 == 1)
