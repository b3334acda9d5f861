"""Retrieval for a table of questions: filters, keyword, vector, hybrid.

A question may bring its own limits as columns: ``top_k`` (how many hits),
``doc_pk`` (only of that document), ``pool`` (which filters bind it) and ``mode``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusq.functions.dates import within
from corpusq.functions.text import let, occurrences, query_terms
from corpusq.shared import ship, stored

from .embed import DIMENSIONS, has_embedding
from .fulltext import MOST_HITS, of_hits, small_or_merged
from .scan import MOST_QUESTIONS, Dense, Sparse, Terms, best, pieces, scan_topk

#: What vectors of real meaning, and of hashed words, find.
SEMANTIC, LEXICAL = "Semantic similarity", "Lexical-hash similarity (test/demo embedder)"
#: Fixed value: what is said where a search by meaning was asked for and not had.
NO_VECTORS = "Semantic search unavailable (no embedding provider configured); results are keyword-only."
#: Columns by which a question may limit its own search
LIMITS = ("doc_pk", "pool", "top_k")
#: Characters from which a text is read once for all terms
LONG = 8192




@dataclass
class Filters:
    """Which documents may answer."""

    include_demo: bool = False
    author: str | None = None
    document_type: str | None = None
    language: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    document_id: int | None = None
    source_key: str | None = None
    collection_key: str | None = None
    topic_key: str | None = None
    entity_name: str | None = None


def contains_text(value: Column, wanted: str) -> Column:
    """Case-insensitive; % and _ stand for themselves; null does not contain."""
    return F.coalesce(F.contains(F.lower(value), F.lit(wanted.lower())), F.lit(False))


def eligible(docs: DataFrame, f: Filters, topics: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Keys of the documents that pass.  Topics and entities are tested without
    repeating a document."""
    ok = F.lit(True) if f.include_demo else ~F.col("is_demo")
    if f.author:
        ok = ok & contains_text(F.col("author"), f.author)
    for name in ("document_type", "language", "source_key", "collection_key"):
        if getattr(f, name):
            ok = ok & (F.col(name) == getattr(f, name))
    if f.date_from or f.date_to:
        ok = ok & within(F.col("doc_date"), f.date_from, f.date_to)
    if f.document_id is not None:
        ok = ok & (F.col("doc_pk") == f.document_id)
    found = docs.where(ok).select("doc_pk")
    if f.topic_key:
        found = found.join(topics.where(F.col("topic_key") == f.topic_key).select("doc_pk").hint("merge"), "doc_pk", "left_semi")
    if f.entity_name:
        found = found.join(entities.where(contains_text(F.col("name"), f.entity_name)).select("doc_pk").hint("merge"), "doc_pk", "left_semi")
    return found


def pools(docs: DataFrame, filters: dict[str, Filters], topics: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """``(doc_pk, pools)``: the names of the filters that each document passes.
    A question names one of them in its column ``pool``; null asks all."""
    passed = [eligible(docs, f, topics, entities).select("doc_pk", F.lit(name).alias("pool")) for name, f in filters.items()]
    return reduce(DataFrame.unionByName, passed).groupBy("doc_pk").agg(F.collect_set("pool").alias("pools"))


def limited(chunks: DataFrame, questions: DataFrame, passed: DataFrame | None) -> DataFrame:
    """Chunks with the ``pools`` of their document, if a question asks for one."""
    if "pool" not in questions.columns:
        return chunks
    if passed is None:
        raise ValueError("questions name a pool: the table of pools is needed")
    return chunks.drop("pools").join(passed.hint("merge"), "doc_pk", "left")


def hits_of(terms: Column, low: Column) -> Column:
    """How often terms stand in a text; null for never."""
    return F.nullif(F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + occurrences(low, t)), F.lit(0).cast("long")).cast("double")


def sparse_product(asked: Column, vector: Column) -> Column:
    """Inner product of sparse vectors; null if it is not positive."""
    weights = F.map_from_entries(vector)
    total = let(weights, lambda m: F.aggregate(asked, F.lit(0.0), lambda s, x: s + x["weight"] * F.coalesce(F.element_at(m, x["idx"]), F.lit(0.0))))
    return let(total, lambda s: F.when(s > 0, s))


def keyword_search(questions: DataFrame, chunks: DataFrame, k: int = 10, passed: DataFrame | None = None) -> DataFrame:
    """Chunks that contain a term of the question, by how often terms occur
    (a repeated term counts again), over the question's best.

    Blank questions find nothing.  Ties: smaller chunk id first.  Any number of
    questions: a pass over the chunks for each block of them, in which an
    automaton over their terms reads each chunk once (see ``Terms``).  Texts are
    fetched for the hits alone.  Questions may have the ``LIMITS``;
    ``passed`` is the table of ``pools``.
    """
    mine = [c for c in LIMITS if c in questions.columns]
    asked = stored(questions.select("question_id", query_terms(F.col("question")).alias("terms"), *mine).where("size(terms) > 0"))
    rows = limited(chunks, questions, passed)
    low = rows.where("text is not null").select("chunk_id", F.lower("text").alias("low"), *[c for c in ("doc_pk", "pools") if c in rows.columns])
    top = stored(scan_topk(asked, low, Terms, k, "hits", "rank", pair=hits_of))
    shown = of_hits(top, chunks.select("chunk_id", "doc_pk", "page_number", "text"))
    found = shown.join(matched_terms(top, asked, chunks).hint("merge"), ["question_id", "chunk_id"])
    most = F.max("hits").over(Window.partitionBy("question_id"))
    hits = found.select("question_id", "chunk_id", "doc_pk", "page_number", "text", F.col("hits").cast("long").alias("hits"), "matched", "rank")
    return hits.withColumn("keyword_score", F.col("hits") / most)


def terms_inside(texts: DataFrame) -> DataFrame:
    """``(chunk_id, term)``: which of the terms of each row ``(chunk_id, low,
    terms)`` stand in its text.  A long text is read once for all its terms."""
    ship(texts.sparkSession)
    kind = to_arrow_type(texts.schema["chunk_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keys, found = [], []
            for key, low, terms in zip(*(c.to_pylist() for c in b.columns)):
                if len(low) < LONG:
                    here = [t for t in terms if t in low]
                else:
                    tree = ahocorasick.Automaton()
                    for t in terms:
                        tree.add_word(t, t)
                    tree.make_automaton()
                    here = list({t for _, t in tree.iter(low)})
                keys += [key] * len(here)
                found += here
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(found, pa.string())], names=["chunk_id", "term"])

    return texts.mapInArrow(run, f"chunk_id {texts.schema['chunk_id'].dataType.simpleString()}, term string")


def matched_terms(top: DataFrame, asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(question_id, chunk_id, matched)``: the terms of a question that stand in
    each of its hits.  The hits of many questions are the same long chunks: a
    term is looked for once in a chunk, and no text is repeated for a question."""
    terms = asked.select("question_id", F.posexplode("terms").alias("place", "term"))
    each = stored(top.select("question_id", "chunk_id").join(terms.hint("merge"), "question_id"))
    of = each.select("chunk_id", "term").distinct().groupBy("chunk_id").agg(F.collect_list("term").alias("terms"))
    met = small_or_merged(stored(top.select("chunk_id").distinct()), MOST_HITS)
    texts = chunks.select("chunk_id", F.lower("text").alias("low")).join(met, "chunk_id", "left_semi")
    present = terms_inside(texts.join(of.hint("merge"), "chunk_id").select("chunk_id", "low", "terms"))
    kept = each.join(present.hint("merge"), ["chunk_id", "term"]).groupBy("question_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("kept"))
    return kept.select("question_id", "chunk_id", F.array_join(F.transform("kept", lambda t: t["term"]), ", ").alias("matched"))


def sparse_topk(questions: DataFrame, chunks: DataFrame, k: int, dims: int = DIMENSIONS) -> DataFrame:
    """Best chunks by inner product of sparse unit vectors: of ``(question_id,
    vector)`` with ``(chunk_id, vector)``.  Only chunks that share a dimension
    with the question count.  Questions may have the ``LIMITS``, and chunks then
    ``doc_pk`` and ``pools``."""
    mine = [c for c in LIMITS if c in questions.columns]
    limits = [c for c in ("doc_pk", "pools") if c in chunks.columns]
    return scan_topk(questions.select("question_id", "vector", *mine), chunks.select("chunk_id", "vector", *limits), partial(Sparse, dims=dims), k, "semantic_score", "semantic_rank", pair=sparse_product)


def vector_topk(questions: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block: int = MOST_QUESTIONS) -> DataFrame:
    """``(question_id, key, score)``: the k rows most similar by cosine to every
    question vector, exactly.  Vectors of another length than the question's are
    passed over; a zero vector scores 0."""
    part = lambda df, name, c: df.select(name, F.col(c).cast("array<double>").alias("vector")).where(has_embedding(F.col("vector")))
    return scan_topk(part(questions, "question_id", "embedding"), part(vectors, key, column), Dense, k, block=block)


def hybrid_search(
    questions: DataFrame,
    chunks: DataFrame,
    question_vectors: DataFrame | None,
    chunk_vectors: DataFrame | None,
    k: int = 10,
    weight: float = 0.5,
    mode: str = "hybrid",
    allowed: DataFrame | None = None,
    strict_filters: bool = True,
    passed: DataFrame | None = None,
    meaning: str = LEXICAL,
) -> DataFrame:
    """Keyword and vector candidates, max(3k, 30) of each, merged by chunk, with
    the reasons why each was found (``meaning`` names the vectors' similarity).

    Without vectors the effective mode is keyword.  A question may have a
    ``mode`` of its own, and the ``LIMITS``.  If vectors are there but its own
    is missing, that question alone falls back: a semantic one finds nothing, in
    mode keyword; a hybrid one keeps its keyword share.  ``allowed`` limits the
    documents of all questions, ``pool`` those of one; with
    ``strict_filters=False`` both bind keyword candidates only.
    """
    asked_mode = F.coalesce(F.col("mode"), F.lit(mode)) if "mode" in questions.columns else F.lit(mode)
    own_k = F.coalesce(F.col("top_k"), F.lit(k)) if "top_k" in questions.columns else F.lit(k)
    some = question_vectors is not None and chunk_vectors is not None
    asked = questions.withColumn("__k", own_k).withColumn("mode", asked_mode if some else F.lit("keyword"))
    if some:
        have = question_vectors.select("question_id", F.lit(True).alias("__vector"))
        asked = asked.join(have.hint("merge"), "question_id", "left")
    else:
        asked = asked.withColumn("__vector", F.lit(None).cast("boolean"))
    lost = F.col("__vector").isNull() & (F.col("mode") == "semantic")
    effective = F.when(lost, "keyword").otherwise(F.col("mode"))
    # a question that lost its vector finds nothing, though its mode is keyword
    asked = stored(asked.withColumn("effective_mode", effective).withColumn("__words", (effective != "semantic") & ~lost).withColumn("top_k", F.greatest(3 * F.col("__k"), F.lit(30))))
    mine = chunks if allowed is None else chunks.join(allowed.hint("merge"), "doc_pk", "left_semi")
    limits = [c for c in LIMITS if c in asked.columns]

    keyword = keyword_search(asked.where("__words").select("question_id", "question", *limits), mine, passed=passed)
    merged = keyword.select("question_id", "chunk_id", "keyword_score", F.col("rank").alias("keyword_rank"), "matched")
    if some:
        near = chunk_vectors
        if not strict_filters:
            limits = [c for c in limits if c != "pool"]
        elif allowed is not None:
            near = near.join(mine.select("chunk_id").hint("merge"), "chunk_id", "left_semi")
        if "pool" in limits or "doc_pk" in limits:
            near = near.select("chunk_id", "vector").join(chunks.select("chunk_id", "doc_pk").hint("merge"), "chunk_id")
            near = limited(near, asked.select(*limits), passed)
        open_ = asked.where("__vector and effective_mode in ('semantic', 'hybrid')").select("question_id", *limits)
        vectors = question_vectors.select("question_id", "vector").join(open_.hint("merge"), "question_id").select("question_id", "vector", *limits)
        merged = merged.join(sparse_topk(vectors, near, k).hint("merge"), ["question_id", "chunk_id"], "full_outer")
    else:
        merged = merged.withColumn("semantic_score", F.lit(None).cast("double")).withColumn("semantic_rank", F.lit(None).cast("int"))

    kw, sem, how = F.coalesce("keyword_score", F.lit(0.0)), F.coalesce("semantic_score", F.lit(0.0)), F.col("effective_mode")
    combined = F.when(how == "keyword", kw).when(how == "semantic", sem).otherwise((1 - weight) * kw + weight * F.greatest(sem, F.lit(0.0)))
    words = F.when(F.col("keyword_rank").isNotNull(), F.concat(F.lit("Keyword match: "), "matched"))
    # ties that a double holds exactly (eighths) go to the even digit
    shown = F.when(F.col("semantic_score") * 8 == F.floor(F.col("semantic_score") * 8), F.bround("semantic_score", 2)).otherwise(F.col("semantic_score"))
    near_ = F.when(F.col("semantic_rank").isNotNull(), F.concat(F.lit(meaning + ": "), F.format_string("%.2f", shown)))
    modes = asked.select("question_id", "effective_mode", F.col("__k").alias("__own_k"))
    scored = merged.join(modes.hint("merge"), "question_id").select(
        "question_id", "chunk_id", kw.alias("keyword_score"), sem.alias("semantic_score"), F.round(combined, 9).alias("combined_score"), "keyword_rank", "semantic_rank", "effective_mode", "__own_k", F.array_compact(F.array(words, near_)).alias("match_reasons")
    )
    w = Window.partitionBy("question_id").orderBy(F.desc("combined_score"), F.asc_nulls_last("keyword_rank"), F.asc_nulls_last("semantic_rank"), "chunk_id")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("__own_k"))
    return top.select("question_id", "chunk_id", "keyword_score", "semantic_score", "combined_score", "rank", "effective_mode", "match_reasons")


def mode_notes(questions: DataFrame, available: Column, mode: str = "hybrid") -> DataFrame:
    """``(question_id, requested_mode, effective_mode, note)`` of every question
    (with a ``mode`` of its own or without): without vectors all are keyword
    searches, and those that asked for more get a note."""
    asked = F.coalesce(F.col("mode"), F.lit(mode)) if "mode" in questions.columns else F.lit(mode)
    note = F.when((asked != "keyword") & ~available, F.lit(NO_VECTORS))
    return questions.select("question_id", asked.alias("requested_mode"), F.when(available, asked).otherwise("keyword").alias("effective_mode"), note.alias("note"))
