"""Filter audit, line removal and importance draws against SQL and plain loops."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusq.llm import filter_audit as A
from corpusq.llm import importance as I
from corpusq.llm import line_dedup as L
from corpusq.llm import queries as Q

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_line_dedup", "op13_importance"])
def test_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = Q.QUERIES[name](spark, sf)
    found = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted(found.fetchall(), key=key)


# filter audit


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def odd_texts():
    rng = random.Random(2)
    parts = ["a", "Ab", "the ", " ", "\n", "\t", "\x0b", "\x1f", "\x85", "\xa0", "é", "日本", "🤣", "#", "|", "aa", "aaaaaaaaa", "aaaaaaaab", "\x00", "Z"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(300)]
    return ["", " ", "x", "\n\n", "word " * 500, "é" * 50, "aaaaaaaa aaaaaaaab aaaaaaaa"] + made


def test_measures():
    texts = odd_texts()
    want = [plain_measures(t) for t in texts]
    column = pa.array(["before", *texts])[1:]
    assert A.Audit().measures(column).tolist() == want
    assert A.Audit().measures(pa.array(texts, pa.large_string())).tolist() == want


def test_measures_in_parts(monkeypatch):
    monkeypatch.setattr(A, "PIECE", 37)
    texts = odd_texts() + ["x" * 200 + " y " + "x" * 200 + " y", "z" * 500]
    assert A.Audit().measures(pa.array(texts)).tolist() == [plain_measures(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash of no use, bytes still decide which words are the same."""
    monkeypatch.setattr(A, "powers", lambda base, n: np.zeros(n + 1, np.uint64))
    texts = odd_texts()[:60]
    assert A.Audit().measures(pa.array(texts)).tolist() == [plain_measures(t) for t in texts]


def plain_audit(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, s in docs:
        w, d, c, n, y = plain_measures(t or "")
        bad = (w < 200, 100 * d < 50 * w, 100 * c > 2 * n, y > 0, i is not None and i > least[t or ""])
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((s or "", {x for x, b in zip("ABCDE", bad) if b}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        own, lost = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = [r for r in own if not r[1] & set(order[:k])]
                gone = [r for r in before if f in r[1]]
                lost[f] += len(gone)
                fails = sum(f in r[1] for r in own)
                out[part, "".join(order), k + 1] = [len(before) - len(gone), len(gone), fails - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for (p, *_), v in out.items():
            if p == part:
                v[6] = lost[v[6]]
    return out


ODD = [(1, "one #two " * 150, "a"), (2, None, None), (3, "", ""), (4, "A B C", "a"), (4, "A B C", "b"), (None, "A B C", None), (None, None, "a"), (5, "w " * 300, "a"), (6, " ".join(f"x{i}" for i in range(250)), "b"), (6, " ".join(f"x{i}" for i in range(250)), "b"), (7, "A B C", "a")]


def test_audit_of_odd_rows(spark):
    labels = [(1, 1, 0), (4, None, 1), (4, 1, None), (None, 1, 1), (6, 0, 0), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in ODD], DOCS + ", n long, part long")
    got = A.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r)[:3]: list(r)[3:] for r in got.collect()} == plain_audit(ODD, labels)
    empty = A.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert empty.count() == 0
    bare = A.filter_audit(spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {tuple(r)[:3]: list(r)[3:] for r in bare.collect()} == plain_audit(ODD, [])


# lines


def plain_lines(docs, min_docs, min_chars, keep):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add((i, t or ""))
    out, seen, done = [], set(), {}
    for i, t in docs:
        lines, left = (t or "").split("\n"), []
        if (i, t or "") in done:
            out.append(done[i, t or ""])
            continue
        for line in lines:
            k = key(line)
            if len(k) < min_chars or len(holders[k]) < min_docs or (keep == "first" and k not in seen):
                left.append(line)
            seen.add(k)
        done[i, t or ""] = row = (i, len(lines), len(lines) - len(left), "\n".join(left))
        out.append(row)
    return sorted(out, key=str)


def run_lines(df, **how):
    left = L.apply_bitmaps(df, L.keep_bitmaps(df, **how)).select("doc_id", "n_lines", "n_dropped", "kept")
    return sorted((tuple(r) for r in left.collect()), key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (3, 0), (10, 4)])
def test_lines_by_plain_loops(spark, keep, min_docs, min_chars):
    rng = random.Random(min_docs)
    pool = ["", " ", "Menu", "menu ", "\tMENU\r", "İx", "ÉA", "éa", "common", "\x85", "a\x0bb"] + [f"line {i}" for i in range(30)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(60)]
    docs += [(None, None), (None, "common\nMenu"), (None, "common\nMenu"), (70, None), (71, ""), (72, "\n" * 300 + "Menu"), (73, "\n".join(f"own {i}" for i in range(400)) + "\nmenu\n" + "common\n" * 300), (74, "same"), (74, "other\nmenu"), (75, "x"), (75, "x")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(*r, 1, "z", 2) for r in docs], "doc_id long, text string, t long, h string, N_DROPPED long").repartition(5)
    assert run_lines(df, min_docs=min_docs, min_chars=min_chars, keep=keep) == plain_lines(docs, min_docs, min_chars, keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_in_most_documents(spark, keep):
    """Hot lines take the way of their own; rows of one text are many."""
    docs = [(i, f"Cookie notice\nbody {i}\ncookie notice") for i in range(700)] + [(i, "copy of a page\nCookie notice") for i in range(700, 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert run_lines(df, min_docs=10, keep=keep) == plain_lines(docs, 10, 1, keep)


def test_lines_of_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert run_lines(df) == [] and L.keep_bitmaps(df).count() == 0


# importance


def plain_importance(docs, target, percent=5, least=20, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    each, wanted = [features(t) for _, t in docs], [b for t in target for b in features(t)[1]]
    s, t = np.bincount([b for _, f in each for b in f], minlength=buckets).tolist(), np.bincount(np.array(wanted, int), minlength=buckets).tolist()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (w, f) in zip(docs, each):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_importance_by_plain_loops(spark):
    rng = random.Random(5)
    words = ["the", "The", "cat", "x1", "naïve", "日本", "z" * 70, "y" * 300, "w" * 9000]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\x00"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(None, None), (None, "a b c"), (400, ""), (401, "..."), (402, "one two"), (403, " ".join(words * 5)), (403, " ".join(words * 5))]
    target = ["the cat sat", None, "日本 the", "naïve " * 30]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words long, score string").repartition(4)
    got = I.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_importance(docs, target)
    none = I.importance_resample(df, spark.createDataFrame([], "text string"), percent=50)
    assert sorted((tuple(r) for r in none.collect()), key=str) == plain_importance(docs, [], percent=50)
    assert I.importance_resample(df.limit(0), df).count() == 0


def test_words_in_parts(monkeypatch):
    monkeypatch.setattr(I, "PART", 11)
    monkeypatch.setattr(I, "REMEMBER", 3)
    text = "The cat,sat on" * 3 + " " * 40 + "x" * 60 + " end the cat"
    sizes, found = I.Features(10_000).of([text, "", "a", text])
    w = re.findall("[a-z]+", text.lower())
    want = [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    assert sizes == [len(w), 0, 1, len(w)]
    assert found[0].tolist() == found[3].tolist() == want and len(found[1]) == 0


def test_crc_of_joined_parts():
    rng, shift = random.Random(1), I.Shift()
    pairs = [(rng.randbytes(rng.randrange(90)), rng.randbytes(n)) for n in [0, 1, 63, 64, 65, 127, 128, 4095, 100_000] for _ in range(3)]
    got = shift.join(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([zlib.crc32(b) for _, b in pairs], np.uint32), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
