"""Language, language model, quality, decontamination, pages: held-out accuracy
and plain restatements."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusq.llm import html_text as H
from corpusq.llm import language_id as L
from corpusq.llm import language_model as M
from corpusq.llm import queries as Q
from corpusq.llm.decontaminate import Index, align, find_leaks
from corpusq.llm.quality import Model, features, learn_quality, score_quality

ODD = [(1, None, None), (2, "", "en"), (3, "!!! 123", "en"), (4, "the there then", "en"), (4, "the there then", "en"), (None, "der die das", "de"), (6, "der die das " * 5000, "de")]


def odd(spark):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in ODD], "doc_id long, text string, lang string, lang_pred string, score double")


def grams(text):
    f = L.folded()
    x = " " + "".join(chr(f[ord(c)]) if f[ord(c)] else " " for c in text) + " "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(x) - n + 1):
            g = x[i : i + n]
            if not (g == " " or g == "  " or (n == 3 and g[1] == " ")):
                out[sum(ord(c) << (21 * (2 - j)) for j, c in enumerate(g))] += 1
    return out


def test_gram_counts(monkeypatch):
    texts = ["Hello wörld  99 x", "", "!!!", "éÉ a", "日本 語", "a" * 50]
    for limit in (2_000_000, 7):
        monkeypatch.setattr(L, "PIECE_CHARS", limit)
        o, g, n = L.gram_counts(texts, np.arange(len(texts)))
        for i, t in enumerate(texts):
            assert dict(zip(g[o == i].tolist(), n[o == i].tolist())) == dict(grams(t))


def test_out_of_place_distance():
    rows = [(lang, g, k) for lang, t in (("a", "the cat the dog"), ("b", "der hund die katze")) for k, (g, _) in enumerate(sorted(grams(t).items(), key=lambda x: (-x[1], x[0]))[:400])]
    p = L.Profiles(rows)
    for text in ("the hund", "die dog katze"):
        own = [g for g, _ in sorted(grams(text).items(), key=lambda x: (-x[1], x[0]))[:400]]
        far = {}
        for lang in "ab":
            place = {g: k for x, g, k in rows if x == lang}
            far[lang] = sum(abs(place[g] - r) if g in place else 400 for r, g in enumerate(own))
        lang, score = p.predict([text])
        assert lang[0] == min("ab", key=lambda x: far[x]) and abs(score[0] - (1 - min(far.values()) / (400 * len(own)))) < 1e-12


def test_language_query(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op2_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_language_query_by_plain_loops(spark, sf):
    """Profiles learnt and distances added up one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    seen: dict[str, Counter] = {}
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 4 != 2 and d.lang is not None:
            seen.setdefault(d.lang, Counter()).update(grams(d.text or ""))
    by_rank = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400]]
    place = {lang: {g: k for k, g in enumerate(by_rank(c))} for lang, c in seen.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in Q.op2_language_id(spark, sf).collect()}
    for d in docs[::7]:
        own = by_rank(grams(d.text or ""))
        far = {lang: sum(abs(p[g] - r) if g in p else 400 for r, g in enumerate(own)) for lang, p in place.items()}
        best = min(sorted(far), key=far.get)
        want = ("und", 0.0) if not own else (best, 1 - far[best] / (400 * len(own)))
        assert got[d.doc_id][0] == want[0] and abs(got[d.doc_id][1] - want[1]) < 1e-9


def test_language_odd(spark):
    d = odd(spark)
    got = L.predict_language(d, L.learn_profiles(d)).collect()
    assert sorted(r.lang_pred for r in got) == ["de", "de", "en", "en", "und", "und", "und"]
    none = d.limit(0)
    assert L.predict_language(none, L.learn_profiles(none)).count() == 0
    assert {r.lang_pred for r in L.predict_language(d, L.learn_profiles(none)).collect()} == {"und"}


def test_language_model_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    tok = lambda x: (x or "").encode().lower().split() + [b"\n"]
    c = Counter()
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 7 != 2:
            c.update(tok(d.text))
    total, kinds = sum(c.values()), len(c)
    text = {d.doc_id: d.text for d in docs}
    rows = Q.op3_language_model(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = tok(text[r.doc_id])
        base = sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model():
    words = [M.END, *"abcdefghij"]
    return M.Lexicon(words, np.arange(20, 9, -1), 165, 13, [("zz", 3, 1), ("", 2, 1)])


def test_language_model_sums_to_one():
    lex = small_model()
    m = M.Model(lex)
    h = np.random.default_rng(0).standard_normal((5, M.UNITS + 1)).astype(np.float32)
    h[:, -1] = 1
    symbols = np.arange(lex.vocabulary + 2)
    p = np.array([[10 ** m.log10(h[i : i + 1], np.array([s]))[0] for s in symbols] for i in range(5)])
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_language_model_windows_carry_state():
    m = M.Model(small_model())
    docs = [np.array([1, 2, 3, 4, 5, 0]), np.array([0]), np.array([7, 8, 1, 0])]
    whole = m.score(docs, lanes=3, window=100)
    assert np.allclose(whole, m.score(docs, lanes=1, window=2), atol=1e-5) and np.allclose(whole, m.score(docs, lanes=2, window=3), atol=1e-5)


def test_language_model_gradient():
    """One step of training lowers the loss, as its numeric gradient says."""
    lex = small_model()
    stream = np.array([0, 1, 2, 3, 1, 2, 3, 1, 2, 3, 0] * 30)
    m = M.Model(lex)
    before = m.score([stream[1:]])[0]
    for _ in range(5):
        m.fit(stream, lanes=2, window=8)
    assert m.score([stream[1:]])[0] > before + 30


def test_language_model_learns_from_every_document(spark):
    """Each document has a word of its own, whose input weights must move."""
    d = spark.range(900).selectExpr("id AS doc_id", "concat('both w', id, ' end') AS text").repartition(3)
    lex = M.learn_lexicon(M.stored(M.count_words(d)))
    m = M.learn_model(M.code_documents(d, lex), lex)
    moved = np.abs(m.x - M.Model(lex).x).max(1)
    assert (moved[[lex.rank[f"w{i}".encode()] for i in range(900)]] > 1e-5).all()


def test_language_model_averages_by_tokens():
    rows = [(0, 1, [1.0, -3.0]), (0, 3, [2.0, 5.0]), (1, 4, [0.5])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([np.array(r[2], np.float32).tobytes() for r in rows], pa.binary())], names=["row", "tokens", "weights"])
    got = {r["row"]: np.frombuffer(r["weights"], np.int64) / (r["tokens"] * M.POINT) for b in M.add_weights(iter([batch])) for r in b.to_pylist()}
    assert np.allclose(got[0], [1.75, 3.0]) and np.allclose(got[1], [0.5])


def test_language_model_predicts_every_symbol():
    """The last symbols of a stream count, however many lanes there are."""
    lex = small_model()
    stream = np.array([0] + [1, 2] * 50 + [9])
    m = M.Model(lex)
    seen = m.fresh()
    m.fit(stream, lanes=7, window=3, seen=seen)
    assert (seen["v"][0][:, 9] > 1e-2).any() and np.isfinite(m.x).all()


def test_language_model_sums_of_runs():
    """Gradients of a symbol's input are added over short and long runs alike."""
    rng = np.random.default_rng(1)
    n = np.array([1, 2, 3, M.FEW, M.FEW + 1, 40, 1, 1, 2])
    rows = rng.standard_normal((n.sum(), 7)).astype(np.float32)
    first = np.cumsum(n) - n
    assert np.allclose(M.sums_of_runs(rows, first), np.add.reduceat(rows, first), atol=1e-5)
    assert np.allclose(M.sums_of_runs(rows[:1], first[:1]), rows[:1])


def test_language_model_long_documents_by_windows():
    """What is laid out ahead for several windows gives the scores of one window."""
    m, rng = M.Model(small_model()), np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 10, n), 0) for n in (2000, 700, 513, 512, 511, 0, 3, 1200)]
    whole = m.score(docs, lanes=8, window=3000)
    for lanes, window in ((3, 16), (8, 2), (1, 7)):
        assert np.allclose(whole, m.score(docs, lanes=lanes, window=window), rtol=1e-5)


def test_language_model_codes_texts_as_arrays():
    """Symbols, counts and parts of the scores against one word after the other."""
    lex = small_model()
    texts = ["a B zz", "", " ", "x\x1cy É9 É9\xa0q a", "\n\ta\x0bJ\r\n", "b" * 3000, ""]
    got = M.code_texts(lex, pa.array(["skip", *texts])[1:])
    for text, (s, tokens, known, base, extra, rest) in zip(texts, zip(*(x.to_pylist() for x in got))):
        words = text.encode().lower().split()
        held = [lex.rank.get(w, -1) for w in words]
        want = [lex.of_rank[r] if r >= 0 else lex.symbol(w) for w, r in zip(words, held)]
        assert np.frombuffer(s, "<i2").tolist() == [*want, 0] and tokens == len(words) + 1
        assert known == 1 + sum(r >= 0 for r in held) and dict(rest) == Counter(w.decode() for w, r in zip(words, held) if r < 0)
        assert math.isclose(base, lex.log_count[0] - lex.base * tokens + sum(lex.log_count[r] for r in held if r >= 0))
        assert math.isclose(extra, -sum(lex.leaf[x - lex.vocabulary] for x in want if x >= lex.vocabulary), abs_tol=1e-12)
    assert [x.type for x in M.code_texts(lex, pa.array([""]))] == [x.type for x in got]
    assert [len(x) for x in M.code_texts(lex, pa.array([], pa.string()))] == [0] * 6


def test_most_frequent_words_by_classes(spark, monkeypatch):
    monkeypatch.setattr(M, "VOCABULARY", 10)
    counts = spark.createDataFrame([(M.END, 7)] + [(f"w{k}", 1 + 1000 // (k + 1)) for k in range(1500)], "word string, c long").repartition(5)
    for head in (40, 300, 5000):
        got = M.most_frequent(counts, head)
        assert got[0] == (M.END, 7) and len(got) == min(head, 1501) == len(set(got))
        assert got[1:] == sorted(got[1:], key=lambda x: (-x[1], x[0]))
        least = got[-1][1]
        assert {f"w{k}" for k in range(1500) if 1 + 1000 // (k + 1) > 1.02 * least + 1} <= {w for w, _ in got}
    assert M.most_frequent(counts.limit(0), 40) == []


def test_language_model_odd(spark):
    d = odd(spark).withColumn("row", F.lit(1)).withColumn("__filler", F.lit(2))
    keep = ["doc_id", "score", "row", "__filler"]
    counts = M.stored(M.count_words(d))
    lex = M.learn_lexicon(counts)
    coded = M.code_documents(d, lex, keep=keep[:3])
    got = M.score_documents(coded, counts, lex, M.learn_model(coded, lex)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 and r.row == 1 for r in got)
    none = d.limit(0)
    counts = M.stored(M.count_words(none))
    lex = M.learn_lexicon(counts)
    empty = M.code_documents(none, lex)
    assert M.score_documents(empty, counts, lex, M.learn_model(empty, lex)).count() == 0
    coded = M.code_documents(d, lex)
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in M.score_documents(coded, counts, lex, M.learn_model(empty, lex)).collect())


def test_language_model_score_by_plain_loop(spark):
    """The query's score against one token after the other, in plain Python."""
    d = spark.createDataFrame([(k, " ".join(random.Random(k).choices(["a", "b", "cc", "dd", "rare%d" % k], k=40))) for k in range(60)], "doc_id long, text string")
    counts = M.stored(M.count_words(d))
    lex = M.learn_lexicon(counts, head=20)
    coded = M.code_documents(d, lex)
    m = M.learn_model(coded, lex)
    got = {r.doc_id: r.score for r in M.score_documents(coded, counts, lex, m).collect()}
    n = {r.word: r.c for r in counts.collect()}
    text = {r.doc_id: r.text for r in d.collect()}
    k, sigmoid = M.UNITS, lambda v: 1 / (1 + np.exp(-v))
    for i in range(0, 60, 7):
        h, last, total = np.zeros(k), 0, 0.0
        for w in [*text[i].split(), M.END]:
            s = lex.of_rank[lex.rank[w.encode()]] if w.encode() in lex.rank else lex.symbol(w.encode())
            g, hu = (m.x[last] + m.b).astype(float), h @ m.u
            z, r = sigmoid(g[:k] + hu[:k]), sigmoid(g[k : 2 * k] + hu[k : 2 * k])
            new = np.tanh(g[2 * k :] + r * hu[2 * k :])
            h = z * h + (1 - z) * new
            one = np.append(h, 1)
            p = np.exp(one @ m.w)
            p /= p.sum()
            if s < lex.vocabulary:
                q = np.exp(one @ m.v[s // M.CLASS])
                total += math.log10(p[s // M.CLASS] * q[s % M.CLASS] / q.sum())
            else:
                e = s - lex.vocabulary
                total += math.log10(p[lex.classes + e]) + math.log10(n.get(w, 0) + 1) - lex.leaf[e]
            last = s
        assert abs(total - got[i]) < 1e-3 * abs(total)


def test_quality(spark, sf):
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op7_quality(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_odd(spark):
    d = odd(spark)
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, 0), (4, 1), (4, 0), (6, None), (7, 5)], "doc_id long, quality int")
    assert score_quality(d, learn_quality(d, labels)).count() == len(ODD)
    assert all(r.score == 0.5 for r in score_quality(d, learn_quality(d, labels.limit(0))).collect())
    assert np.isfinite(features([t or "" for _, t, _ in ODD])).all()


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 15))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Model(x, y).score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_clashing_columns_are_replaced(spark):
    """A kept column named like an added one gives way to it."""
    d = odd(spark)
    rows = L.predict_language(d, L.learn_profiles(d), keep=["doc_id", "lang_pred", "score", "text"])
    assert rows.columns == ["doc_id", "text", "lang_pred", "score"] and {r.lang_pred for r in rows.collect()} <= {"de", "en", "und"}
    labels = spark.createDataFrame([(2, 1), (3, 0), (6, 0)], "doc_id long, quality int")
    rows = score_quality(d, learn_quality(d, labels), keep=["doc_id", "SCORE", "text"])
    assert rows.columns == ["doc_id", "text", "score", "predicted"] and all(r.score != 0.5 or r.predicted == 1 for r in rows.collect())
    pages = spark.createDataFrame([(1, "<article><p>Some text here.</p></article>", "old", 7)], "page_id long, html string, text string, n_chars int")
    rows = H.extract_text(pages, H.learn_pages(pages), keep=["page_id", "text", "n_chars"])
    assert rows.columns == ["page_id", "text", "n_chars"] and rows.first().n_chars == len(rows.first().text)


def test_quality_query_by_plain_loops(spark, sf, monkeypatch):
    """The query's scores against bins found and tables added up one by one."""
    held = []
    monkeypatch.setattr(Q, "learn_quality", lambda *a, **b: held.append(learn_quality(*a, **b)) or held[-1])
    rows = {r.doc_id: r.score for r in Q.op7_quality(spark, sf).collect()}
    m = held[0]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for d in sorted(rows)[::5]:
        x = features([texts[d]])[0]
        bin_of = lambda v, edges: sum(1 for e in edges if v > e)
        total = m.base
        for j, edges in enumerate(m.edges):
            total += m.table[j][bin_of(x[j], edges)]
        for (i, j), t in zip(m.pairs, m.square):
            total += t[bin_of(x[i], m.coarse[i]), bin_of(x[j], m.coarse[j])]
        assert abs(rows[d] - 1 / (1 + math.exp(-total))) < 1e-9
    assert len(m.pairs) > 0


def test_one_boosting_step_by_hand():
    """The best depth-two tree over a row of bins, against all of them."""
    from corpusq.llm import quality as G

    rng = np.random.default_rng(3)
    for _ in range(20):
        g, h = rng.standard_normal(6), rng.random(6) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + G.RIDGE)
        mid = max(range(1, 6), key=lambda k: gain(0, k) + gain(k, 6))
        want = np.zeros(6)
        if gain(0, mid) + gain(mid, 6) - gain(0, 6) > 1e-9:
            for a, b in ((0, mid), (mid, 6)):
                cut = max(range(a + 1, b), key=lambda k: gain(a, k) + gain(k, b), default=None)
                parts = [(a, b)] if cut is None or gain(a, cut) + gain(cut, b) - gain(a, b) <= 1e-9 else [(a, cut), (cut, b)]
                for p, q in parts:
                    want[p:q] = g[p:q].sum() / (h[p:q].sum() + G.RIDGE)
        else:
            want[:] = g.sum() / (h.sum() + G.RIDGE)
        assert np.allclose(G.shallow(g, h), want)


def edit(rng, text, n):
    t = list(text)
    for _ in range(n):
        p, k = rng.randrange(len(t)), rng.random()
        if k < 1 / 3:
            t[p] = "z"
        elif k < 2 / 3:
            t.insert(p, "z")
        else:
            del t[p]
    return "".join(t)


def distance(a, text):
    """Least edits of a anywhere in text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_alignment_equals_full_table():
    rng = random.Random(2)
    code = lambda s: np.array([ord(c) for c in s], np.uint32)
    for _ in range(60):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 20)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(30)))
        want = distance(item, text)
        hit = align(code(item), code(text), -len(item), len(text), 4)
        assert (hit[0] if hit else None) == (want if want <= 4 else None)
        if hit:
            assert distance(item, text[hit[1] : hit[2]]) == hit[0]


def test_planted_items_are_found():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(15, 50)))) for k in range(20)]
    index = Index(items)
    for k in range(150):
        i, text = items[k % 20]
        most = int(index.edits[i])
        planted = edit(rng, text, rng.randint(0, most))
        whole = " ".join(word() for _ in range(30)) + " " + planted + "\n" + " ".join(word() for _ in range(30))
        found = [x for x in index.find(whole) if x["item_id"] == i]
        assert found and found[0]["edits"] <= most
    assert index.find(" ".join(word() for _ in range(500))) == []


def test_short_items_as_whole_words():
    rng = random.Random(5)
    items = [(k, "".join(rng.choice("ab ,") for _ in range(rng.randrange(1, 5)))) for k in range(60)] + [(90, "42"), (90, "x,"), (91, "")]
    index = Index(items)
    norm = lambda s: " ".join(s.split()).lower()
    for _ in range(300):
        text = "".join(rng.choice("abA ,x\n4") for _ in range(rng.randrange(25))) + rng.choice(["", "42", "142", " 42."])
        t, want = norm(text), []
        for i, x in items:
            if x := norm(x):
                left = r"(?<![^\W_])" if x[0].isalnum() else ""
                right = r"(?![^\W_])" if x[-1].isalnum() else ""
                if re.search(left + re.escape(x) + right, t):
                    want.append((i, x))
        got = index.find(text)
        assert sorted((g["item_id"], norm(text[g["start"] : g["stop"]])) for g in got) == sorted(want)
        assert all(g["edits"] == 0 for g in got)
    assert Index(items, short_items=False).find("42 a b") == []


def test_decontaminate_query(spark, sf):
    norm = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    docs = {r.doc_id: norm(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in Q.op5_decontaminate(spark, sf).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} <= got
    assert all(distance(items[i], docs[d]) <= 0.07 * len(items[i]) for d, i in got)


def test_decontaminate_odd(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "a passage that is long enough"), (4, "A  passage that is long ENOUGH")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x a passage that\nis long enough y", 0), (3, "shorter", 0), (5, "in Short.", 0)], "doc_id long, text string, leaks int")
    for block in (10, 10**6):
        got = find_leaks(docs, bench, keep=["doc_id", "leaks", "text"], block_chars=block).collect()
        assert sorted((len(r.leaks), r.doc_id) for r in got) == [(0, 1), (0, 2), (0, 3), (1, 5), (2, 3)]
        assert sorted(x.item_id for r in got for x in r.leaks) == [3, 4, 4] and got[0].__fields__ == ["doc_id", "text", "leaks"]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 5


#: What the given pages use, written down for this test
IN_LINE = {"a", "b", "em", "i", "span", "strong", "br", "img", "code", "sub", "sup", "small"}
NO_END = {"br", "img", "hr", "input", "meta", "link"}
BESIDE = {"nav", "aside", "footer", "header", "form", "button", "script", "style"}
BESIDE_NAMES = {"comment", "comments", "sidebar", "ad", "ads", "advert", "cookie", "related", "share", "promo", "newsletter", "breadcrumb"}


def article_text(page):
    """The text of a page's article by the standard parser, block by block."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.out, self.now = [], [], []

        def flush(self):
            if whole := " ".join("".join(self.now).split()):
                self.out.append(whole)
            self.now = []

        def handle_starttag(self, tag, attrs):
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
            if tag in ("br", "img"):
                self.now.append(" ")
            if tag not in IN_LINE:
                self.flush()
            if tag not in NO_END:
                self.open.append((tag, tag in BESIDE or bool(set(re.findall("[a-z]+", named)) & BESIDE_NAMES)))

        def handle_endtag(self, tag):
            if tag not in IN_LINE:
                self.flush()
            if any(t == tag for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if any(t in ("article", "main") for t, _ in self.open) and not any(a for _, a in self.open):
                self.now.append(data)

    r = Reader()
    r.feed(page)
    r.flush()
    return "\n\n".join(r.out)


def test_pages_query(spark, sf):
    """Against a reading of the pages' articles that shares no code with the operator."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in Q.op8_html_text(spark, sf).collect():
        assert r.text == article_text(pages[r.page_id] or "") and r.n_chars == len(r.text)


def test_malformed_pages_take_linear_time():
    import time

    for part in ("<a ", '<a "', "<a \"> ", "<p><li>", "<textarea>", "<!-- ", "<a<a", "</textarea", "<ul><li><ul>", "&amp", "<"):
        page = part * (1_000_000 // len(part))
        start = time.process_time()
        H.blocks(page)
        assert time.process_time() - start < 30, part


@pytest.mark.parametrize("depth", [300, 5000])
def test_deep_pages_lose_nothing(spark, depth):
    """Articles around and inside many elements, with names that no model knows."""
    deep = "".join(f"<div class='{' '.join(f'n{chr(97 + k % 26)}{chr(97 + i % 26)}' for k in range(30))}'>" for i in range(depth))
    page = f"<nav><a href=1>One</a></nav><div>{deep}</div><div class=wrap>{'<div>' * depth}{'</div>' * depth}<article><p>First part of it, as it stands here.</p>{deep}<p>Inside of it all, a longer sentence, too.</p>{'</div>' * depth}<p>Last part of it, after the others.</p></article></div><footer>foot</footer>"
    found = H.blocks(page)[1:]
    assert [b.text for b in found] == ["First part of it, as it stands here.", "Inside of it all, a longer sentence, too.", "Last part of it, after the others.", "foot"]
    assert all("article" in b.tags and "p" in b.tags for b in found[:3])
    d = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert H.extract_text(d, H.learn_pages(pages)).first().text == "\n\n".join(b.text for b in found[:3])


def test_names_and_quotes_without_a_cap():
    page = f"<div class='{' '.join(f'x{chr(97 + i % 26)}{chr(97 + i // 26)}' for i in range(60))} comments'><p>one</p></div>" + '<p title="open>two</p>' * 21 + "<p title='a > b'>three</p>"
    found = H.blocks(page)
    assert "comments" in found[0].words and found[-1].text == "three" and sum(b.text.endswith("two") for b in found) >= 1
    assert [b.text for b in H.blocks('<p a=">x</p><p b="y">z</p>')] == ["x", "z"] and [b.text for b in H.blocks('<p a=">x</p><p b="">z</p>')] == ["x", "z"]
    assert [b.text for b in H.blocks("<p a='>x</p><p>y</p>" * 9)][-2:] == ["x", "y"]


#: Pages written by hand, in other ways than the made-up ones: what is the article, and what is not
OTHERS = [
    ("<body><div id=page><div class='navbar'><a href=/>Home</a> <a href=/b>About us</a></div><article><h1>A day out</h1><p>We went to the sea, and it rained, as it does.</p><p>Then we came home.</p></article><div class='sidebar'><ul><li><a href=/x>More</a></li></ul></div></div>", ["A day out", "We went to the sea, and it rained, as it does.", "Then we came home."]),
    ("<nav><a href=1>One</a><a href=2>Two</a></nav><main><h2>Report</h2><p>The council met on Monday, and agreed on little. Nobody minded.</p><aside><p>Subscribe now</p></aside><p>It will meet again in May, when all are back.</p></main><footer>&copy; Them</footer>", ["Report", "The council met on Monday, and agreed on little. Nobody minded.", "It will meet again in May, when all are back."]),
    ("<header><h3>Site</h3></header><main><p>Bread is flour, water, salt and time. The rest is patience.</p><ul><li>Mix it well, then wait.</li><li>Bake it hot, then wait again.</li></ul></main><div class=comments><div class=comment><p>Lovely, thank you, will try.</p></div></div><footer>All rights reserved</footer>", ["Bread is flour, water, salt and time. The rest is patience.", "Mix it well, then wait.", "Bake it hot, then wait again."]),
]


def test_layouts_written_by_hand(spark):
    chain = H.learn_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for page, article in OTHERS:
        assert H.extract(page, chain) == "\n\n".join(article)


def test_unseen_layouts():
    chain, train = H.Chain(), []
    for page in map(H.blocks, H.made_pages(150)):
        train.append((H.describe(page), [int(b.marked) for b in page]))
    chain.learn(train)
    wrong = total = 0
    for page in map(H.blocks, H.made_pages(100, seed=77)):
        wrong += sum(int(b.marked) != y for b, y in zip(page, chain.decode(H.describe(page))))
        total += len(page)
    assert wrong < 0.02 * total


def test_blocks():
    page = "<title>x</title><div class='a b'>one&amp;two <b>three</b><br>four<p>five<p>six</div><!-- <p>no --><script>var x='<p>'</script>seven &nbsp; eight<p></p>"
    assert [b.text for b in H.blocks(page)] == ["one&two three four", "five", "six", "seven eight"]
    assert H.blocks("") == [] and H.blocks("<script>never closed <p>") == [] and [b.text for b in H.blocks("</div></p>a<b")] == ["a<b"]


def test_pages_odd(spark):
    d = spark.createDataFrame([(1, "u", None, "c"), (2, "u", "", "c"), (2, "u", "<p>", "c"), (None, None, "<article><p>" + "long text here. " * 30000 + "</article>", "c")], "page_id long, url string, html string, text string")
    got = H.extract_text(d, H.learn_pages(d)).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.n_chars > 0 for r in got) == 1
    assert H.extract_text(d.limit(0), H.learn_pages(d.limit(0))).count() == 0


def test_chain_decode_is_best():
    """Viterbi against all sequences."""
    from itertools import product

    rng = random.Random(5)
    c = H.Chain()
    c.turn = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)]
    c.first, c.weight = [0.3, -0.2], {k: rng.gauss(0, 2) for k in "abcd"}
    rows = [[rng.choice("abcd")] for _ in range(8)]
    gain = c.gains(rows)
    score = lambda y: c.first[y[0]] + sum(g * s for g, s in zip(gain, y)) + sum(c.turn[a][b] for a, b in zip(y, y[1:]))
    assert abs(score(c.decode(rows)) - max(map(score, product((0, 1), repeat=8)))) < 1e-9


def test_html_sample_of_rare_landmarks(spark, monkeypatch):
    """All 60 distinct landmark pages among many others, each once."""
    held = []
    monkeypatch.setattr(H.Chain, "learn", lambda self, pages: held.append(len(pages)))
    page = "CASE WHEN id % 60 = 0 THEN concat('<article><p>Text ', id % 3600, '.</p></article>') ELSE concat('<p>Other ', id, '</p>') END AS html"
    H.learn_pages(spark.range(7200).selectExpr(page))
    assert held == [60 + H.MADE_PAGES]


def test_html_formulas_fallbacks_and_unclosed_elements():
    text = lambda page: [b.text for b in H.blocks(page)]
    assert text("<p>Let <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> hold.</p>") == ["Let x=2 hold."]
    assert text("<p>See <object data=a.swf>the table</object> <svg><g><text>A</text></g></svg>.</p>") == ["See the table A."]
    assert text("<noscript><p>Plain.</p></noscript><p>More.</p>") == ["Plain.", "More."]
    for name in ("object", "math", "noscript", "select", "video", "template"):
        assert text(f"<p>One.</p><{name}><p>Two.</p>") == ["One.", "Two."]
    assert text("<p>One.</p><script>var two") == ["One."]


def test_new_words_of_letters_go_straight_to_the_model(monkeypatch):
    """Ids are the library's, and words of ASCII letters are not looked at twice."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusq.llm.token_store import ChunkEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library, slow = ChunkEncoder(path), Tokenizer.from_file(path), []
    monkeypatch.setattr(ChunkEncoder, "coded", lambda self, chunk, f=ChunkEncoder.coded: slow.append(chunk) or f(self, chunk))
    texts = ["The thouhein of Thouhein, é Été 12 x", "ΑΣ THE <|startoftext|> the", "", "a\x1cb  c"]
    got = encoder.encode(texts)
    assert [list(memoryview(x).cast("I")) for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert slow and not any(w.isascii() and w.isalpha() for w in slow)
