"""That work grows with the input: passes, tasks and what is held at once."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusq.operators import scan
from corpusq.operators import search as R
from corpusq.operators.chunk import cut_batches, cut_page
from corpusq.operators.embed import hash_vectors


def test_questions_of_one_document_pass_over_nothing_else(spark, monkeypatch):
    """However many they are, they are joined with their document's chunks."""
    passes = []
    monkeypatch.setattr(scan, "stored", lambda df, f=scan.stored: passes.append(1) or f(df))
    monkeypatch.setattr(scan.scan_topk, "__defaults__", ("score", "rank", 4))
    rng = random.Random(5)
    text = {f"c{i:02}": " ".join(rng.choice("ab aab ba abab".split()) for _ in range(6)) for i in range(40)}
    c = spark.createDataFrame([(k, int(k[1:]) % 7, 1, t) for k, t in text.items()], "chunk_id string, doc_pk long, page_number int, text string")
    q = spark.createDataFrame([(i, "aba AB b", i % 7, 3) for i in range(20)], "question_id int, question string, doc_pk long, top_k int")
    got = R.keyword_search(q, c).collect()
    for i in range(20):
        hits = sorted((-sum(t.count(w) for w in ("aba", "ab", "b")), k) for k, t in text.items() if int(k[1:]) % 7 == i % 7)
        assert [(-r.hits, r.chunk_id) for r in sorted((r for r in got if r.question_id == i), key=lambda r: r.rank)] == [h for h in hits if h[0]][:3]
    near = R.sparse_topk(hash_vectors(q, "question_id", "question").join(q.drop("question"), "question_id"), hash_vectors(c, "chunk_id").join(c.select("chunk_id", "doc_pk"), "chunk_id"), 3)
    assert all(int(r.chunk_id[1:]) % 7 == r.question_id % 7 and r.semantic_score > 0 for r in near.collect())
    assert not passes


def test_hashed_words_by_white_space_of_sql(spark):
    """Against md5 of the words as SQL cuts them; control characters are no white space there."""
    text = {1: "The the\u00a0x", 2: None, 3: " \n", 4: "a\x1cb c", 5: "é ü É"}
    got = {r.k: {x.idx: x.weight for x in r.vector} for r in hash_vectors(spark.createDataFrame(list(text.items()), "k int, text string"), "k").collect()}
    words = {1: ["the", "the", "x"], 4: ["a\x1cb", "c"], 5: ["é", "ü", "é"]}
    assert got.keys() == words.keys()
    for k, ws in words.items():
        n = Counter(int(hashlib.md5(w.encode()).hexdigest(), 16) % 256 for w in ws)
        norm = sum(v * v for v in n.values()) ** 0.5
        assert got[k] == {i: v / norm for i, v in n.items()}


def test_pieces_bound_rows_and_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["x" * 10000] * 3000)], names=["k", "t"])
    cut = list(scan.pieces([b]))
    assert sum(x.num_rows for x in cut) == 3000 and all(x.num_rows <= scan.PIECE and x.num_rows * 10000 <= scan.PIECE_BYTES for x in cut)


def test_pages_are_cut_a_few_at_a_time():
    """A full Arrow batch is not held as Python objects as a whole."""
    texts = [f"page {n}\n\n" + "\n\n".join("word " * 40 for _ in range(n % 9)) for n in range(5000)]
    b = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([1] * 5000, pa.int32()), pa.array(texts)], names=["doc_pk", "page_number", "text"])
    out = list(cut_batches(iter([b])))
    assert len(out) >= 5 and max(x.num_rows for x in out) <= scan.PIECE
    got = [[(c["text"], c["char_start"], c["char_end"]) for c in r] for x in out for r in x.column(2).to_pylist()]
    assert got == [cut_page(t) for t in texts]


def test_words_are_read_once_and_terms_counted_without_overlap():
    """Counts of a few texts against counting; the words that a task remembers are bounded."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(1, n)))
    asked = [[word(5) for _ in range(4)] for _ in range(30)]
    by = scan.Terms(pa.array(asked))
    texts = [" ".join(word(9) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "aaaa\taaaa"]
    rows = by.rows(pa.array(texts))
    got = by.scores(rows, 0, 30)
    assert got.tolist() == [[sum((t or "").count(w) for w in q) for t in texts] for q in asked]
    assert len(by.found) == len({w for t in texts for w in (t or "").split()})


def test_large_batches_are_cut():
    b = pa.RecordBatch.from_arrays([pa.array(range(3 * scan.ROWS + 5))], names=["k"])
    assert [x.num_rows for x in scan.gathered(iter([b]))] == [scan.ROWS] * 3 + [5]


def test_rows_are_made_once_for_all_blocks(spark, monkeypatch):
    """With several blocks of questions, vectors are hashed and texts prepared
    once, and tasks are no more than twice the cores."""
    kept = []
    monkeypatch.setattr(scan, "stored", lambda df, f=scan.stored: kept.append(df.columns) or f(df))
    monkeypatch.setattr(scan.scan_topk, "__defaults__", ("score", "rank", 4))
    q = spark.createDataFrame([(i, f"w{i} the") for i in range(9)], "question_id int, question string")
    c = spark.createDataFrame([(f"c{i:02}", f"the w{i}") for i in range(12)], "chunk_id string, text string").repartition(200)
    found = R.sparse_topk(hash_vectors(q, "question_id", "question"), hash_vectors(c, "chunk_id"), 2)
    assert kept[0] == ["chunk_id", "vector"] and len(kept) == 4
    assert found.where("semantic_rank = 1 and question_id < 9").count() == 9


def test_only_left_out_words_keep_the_smallest_keys(spark):
    """Ties of all chunks, in several batches of a task."""
    from corpusq.operators.fulltext import fulltext_search

    c = spark.createDataFrame([(f"c{(i * 7919) % 20000:05}", "x y" if i % 3 else "x z") for i in range(20000)], "chunk_id string, text string").coalesce(1)
    got = fulltext_search(spark.createDataFrame([(1, "-z"), (2, "w or -y")], "question_id int, question string"), c).collect()
    rows = [(f"c{(i * 7919) % 20000:05}", i % 3) for i in range(20000)]
    want = {1: sorted(k for k, m in rows if m)[:10], 2: sorted(k for k, m in rows if not m)[:10]}
    assert {n: [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.question_id == n] for n in want} == want


def test_short_rows_are_passed_over_by_bounds(monkeypatch):
    """Only rows that may be among the best are scored, and the best are those
    of counting, ties by key, over groups and batches; all questions go in one pass."""
    scored = []
    monkeypatch.setattr(scan.Terms, "scored", lambda self, seen, counts, q, f=scan.Terms.scored: scored.append(len(q) * counts.shape[1]) or f(self, seen, counts, q))
    monkeypatch.setattr(scan, "ROWS", 2000)
    rng = random.Random(7)
    words = ["the", "tha", "thath", "that", "aa", "aaa", "é"]
    texts = {f"c{i:04}": " ".join(rng.choice(words) for _ in range(200 if i % 97 == 0 else rng.randrange(12))) for i in range(6000)}
    asked = {i: [rng.choice(["th", "that", "aa", "a", "h", "é", "zz"]) for _ in range(4)] for i in range(50)}
    rows = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values()))], names=["k", "t"])
    ids, keys, scores = scan.score_rows(pa.table({"q": list(asked), "t": list(asked.values())}), scan.gathered(iter([rows])), scan.Terms, 3)
    got: dict[int, list] = {}
    for q, k, s in zip(ids, keys, scores):
        got.setdefault(q, []).append((-s, k))
    for q, terms in asked.items():
        hits = sorted((-sum(t.count(w) for w in terms), k) for k, t in texts.items())[:3]
        assert got.get(q, []) == [h for h in hits if h[0]]
    assert sum(scored) < len(asked) * len(texts) // 4
    assert scan.scan_topk.__defaults__[-1] >= 30_000


def test_hits_are_put_in_order_at_once():
    """Against sorting: several batches, questions with limits of their own, equal scores."""
    rng = random.Random(2)
    k = [rng.randrange(4) for _ in range(30)]
    top, every = scan.Top(k), []
    for b in range(5):
        names = [f"{rng.randrange(10**6)}-{b}" for _ in range(40)]
        hits = [(rng.randrange(30), rng.randrange(40), rng.randrange(3) / 2) for _ in range(300)]
        hits = list({(q, at): (q, at, s) for q, at, s in hits}.values())
        q, at, s = (np.array(x) for x in zip(*hits))
        top.add(q, at, s, scan.Keys(names))
        top.fold()
        every += [(q, -s, names[at]) for q, at, s in hits]
    want = [x for q in range(30) for x in sorted(e for e in every if e[0] == q)[: k[q]]]
    assert list(zip(top.q.tolist(), (-top.score).tolist(), top.key.tolist())) == want


def test_full_text_reads_what_can_reach_the_best(spark, monkeypatch):
    """Against counting: all forms of questions, batches of any size, with and
    without a score that the rest must reach; few chunks of common words are scored."""
    import math

    from corpusq.operators import fulltext as T

    rng = random.Random(3)
    words = [f"w{n}" for n in range(40)]
    text = {f"c{i:04}": [rng.choice(words[: rng.choice([3, 40])]) for _ in range(rng.randrange(1, 30))] for i in range(3000)}
    forms = ["w0 or w1 or w30", "w30", "w30 w31 or w1 w35", '"w0 w1" or w39', "w38 or -w0", '-"w0 w1" -w2', 'w0 -"w1 w2"', "w0_w1", 'w33 "w0 w1"', "zz", "zz or -w1", "w0 or w1 or w2"]
    asked = {n: T.parse_web_query(f) for n, f in enumerate(forms)}
    df = Counter(t for ws in text.values() for t in set(ws))
    idf = {t: math.log(1 + (len(text) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    mean = sum(map(len, text.values())) / len(text)

    def holds(part, ws):
        minus, at = part
        return minus != any(all(0 <= i + p < len(ws) and ws[i + p] == w for w, p in at) for i in range(len(ws)))

    want = {}
    for q, tree in asked.items():
        wanted = {w for a in tree for minus, at in a if not minus for w, _ in at}
        score = lambda ws: sum(idf[t] * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in wanted if t in ws)  # noqa: B023, E731
        want[q] = sorted((-round(score(ws), 9), k) for k, ws in text.items() if any(all(holds(p, ws) for p in a) for a in tree))[:5]
    value = [{"tree": [[{"minus": m, "words": [{"term": w, "place": p} for w, p in at]} for m, at in a] for a in tree], "weights": [{"term": t, "idf": idf[t]} for t in sorted({w for a in tree for m, at in a if not m for w, _ in at}) if t in idf]} for tree in asked.values()]
    kind = pa.struct([("tree", pa.list_(pa.list_(T._PART))), ("weights", pa.list_(pa.struct([("term", pa.string()), ("idf", pa.float64())])))])
    questions = pa.table({"q": list(asked), "v": pa.array(value, kind)})
    rows = pa.RecordBatch.from_arrays([pa.array(list(text)), pa.array(list(text.values()))], names=["k", "w"])
    read = []
    monkeypatch.setattr(T.Postings, "totals", lambda self, terms, f=T.Postings.totals: read.append(self.size(terms)) or f(self, terms))

    def found(size, least=None):
        read.clear()
        got: dict[int, list] = {}
        for q, k, s in zip(*scan.score_rows(questions, scan.gathered(iter([rows]), size), lambda a: T.Web(a, mean=mean, k1=1.2, b=0.75), 5, least)):
            got.setdefault(q, []).append((-round(s, 8), k))
        return {q: [(round(s, 8), k) for s, k in want[q]] for q in got} == got and set(got) == {q for q in want if want[q]}, sum(read)

    assert found(3000)[0] and found(77)[0]
    reach = np.array([-want[q][-1][0] if len(want[q]) == 5 else np.finfo(float).min for q in asked])
    same, size = found(3000, reach)
    assert same and size < found(3000)[1]
    # in Spark, a share of the chunks first
    c = spark.createDataFrame([(k, " ".join(ws)) for k, ws in text.items()], "chunk_id string, text string")
    monkeypatch.setattr(scan, "LEAST_ROWS", 1000)
    monkeypatch.setattr(scan, "SHARE", 8)
    kept = []
    monkeypatch.setattr(scan, "stored", lambda df, f=scan.stored: kept.append(f(df)) or kept[-1])
    got = T.fulltext_search(spark.createDataFrame(list(enumerate(forms)), "question_id int, question string"), c, 5).collect()
    for q in want:
        assert [r.chunk_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.rank)] == [k for _, k in want[q]]
    assert len(kept) == 2 and "score" in kept[1].columns


def test_hits_fetch_their_chunks_alone(spark, sf, monkeypatch):
    """Chunks are made once, and what is shown of the hits sorts no other chunk."""
    from corpusq.operators import fulltext as T
    from corpusq.plans import fixtures, search_queries  # noqa: F401
    from corpusq.plans.registry import QUERIES

    made = []
    monkeypatch.setattr(fixtures, "chunks", lambda *a, f=fixtures.chunks, **k: made.append(1) or f(*a, **k))
    for name in ("evidence_block", "hybrid_results", "source_rows"):
        made.clear()
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert len(made) == 1 and "BroadcastHashJoin [chunk_id" in plan, name
    hits = spark.createDataFrame([(i, f"c{i % 7}") for i in range(50)], "question_id int, chunk_id string")
    c = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(1000)], "chunk_id string, text string")
    few = sorted(T.of_hits(hits, c).select("question_id", "chunk_id", "text").collect())
    monkeypatch.setattr(T, "MOST_ROWS", 49)
    many = T.of_hits(hits, c).select("question_id", "chunk_id", "text")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert sorted(many.collect()) == few == [(i, f"c{i % 7}", f"text {i % 7}") for i in range(50)]
    assert "LeftSemi, BuildRight" in plan and "SortMergeJoin" in plan


def test_terms_are_looked_for_once_in_a_chunk(spark):
    """Many questions with the same hits: a text meets each term once, in no row of a question."""
    c = spark.createDataFrame([("a", 1, 1, "The cat, the DOG"), ("b", 2, 1, "dog é"), ("c", 3, 1, None)], "chunk_id string, doc_pk long, page_number int, text string")
    q = spark.createDataFrame([(i, "dog CAT the dog É %") for i in range(40)], "question_id int, question string")
    found = R.keyword_search(q, c)
    assert sorted((r.question_id, r.chunk_id, r.matched) for r in found.collect()) == sorted(x for i in range(40) for x in [(i, "a", "dog, cat, the, dog"), (i, "b", "dog, dog, é")])
    plan = found.select("matched")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(term" in plan and "contains" not in plan.lower()
    long = spark.createDataFrame([("l", "x " * R.LONG + "abab\u00e9 b", ["bab", "ab", "\u00e9 b", "ba\u00e9", "x x"]), ("s", "abab", ["bab", "c"])], "chunk_id string, low string, terms array<string>")
    assert sorted(map(tuple, R.terms_inside(long).collect())) == [("l", "ab"), ("l", "bab"), ("l", "x x"), ("l", "\u00e9 b"), ("s", "bab")]
