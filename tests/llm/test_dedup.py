"""Near-duplicates against brute force, components, and the pipeline."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusq.llm import embedding_dedup as E
from corpusq.llm import queries as Q
from corpusq.llm import simhash as S
from corpusq.llm.components import connected_components
from corpusq.llm.embedding_dedup import embedding_links


def least(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == least({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tree_finds_all():
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:80]]
    tree = S.Tree()
    for v in values:
        tree.add(v)
    for v in values[:200]:
        assert sorted(tree.near(v, 2)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 2]


def test_simhash_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {d: fingerprint(t) for d, t in docs.items()}
    ids = sorted(fp)
    want = least(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    rows = Q.op10_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


def test_hot_shards_lose_nothing(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = least(signed, [(a, b) for a, x in zip(signed, values) for b, y in zip(signed, values) if a < b and (x ^ y).bit_count() <= 2])
    for shard in (10, 4096):
        got = {r.node: r.component for r in connected_components(S.near_fingerprints(df, 2, shard)).collect()}
        assert all(got.get(i, i) == want[i] for i in signed)


def test_simhash_odd(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  B"), (None, "a b"), (3, "a b"), (7, "x y z " * 20000)]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = S.simhash_groups(d).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (7, 7)]
    assert S.simhash_groups(d.limit(0)).count() == 0


def brute_links(rows):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    linked = []
    for k, (i, v, lab) in enumerate(rows):
        for j, w, other in rows[k + 1 :]:
            if lab is not None and lab == other and ok(v) and ok(w) and len(v) == len(w):
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                    linked.append((i, j))
    return linked


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    for g in range(25):
        c = rng.standard_normal(32)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (c + rng.standard_normal(32) * rng.choice([0, 0.05, 0.2])).astype(np.float32).tolist(), int(g % 3)))
    n = len(rows)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 2.0]]
    return rows + [(n + k, v, 1) for k, v in enumerate(odd)] + [(n + 10, rows[0][1], None)]


def test_embedding_links(spark):
    rows = vectors()
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    linked = brute_links(rows)
    want, n = least([r[0] for r in rows], linked), {r[0]: 0 for r in rows}
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n.values()) and all(got[i].n_links <= n[i] for i in n)
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_a_large_label_beside_small_ones(spark):
    """Labels over ``SMALL`` get filters of their own, the others share theirs."""
    rng = np.random.default_rng(11)
    rows = []
    for label, n in ((1, 5200), (2, 300), (3, 40)):
        x = rng.standard_normal((n, 24))
        x[n // 2 :] = x[rng.integers(0, n // 2, n - n // 2)] + rng.standard_normal((n - n // 2, 24)) * 0.2
        rows += [(len(rows) + i, v, label) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r.label, r.crowd) for r in E.with_crowd(df).select("label", "crowd").distinct().collect()} == {(1, 5793), (2, 300), (3, 300)}
    got, all_links = {r.vec_id: r for r in E.embedding_links(df).collect()}, []
    for label in (1, 2, 3):
        ids = [r[0] for r in rows if r[2] == label]
        x = np.array([r[1] for r in rows if r[2] == label])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
        n = np.bincount(np.concatenate([a, b]), minlength=len(ids))
        assert len(a) > len(ids) // 4 and all(got[i].n_links <= k for i, k in zip(ids, n.tolist()))
        assert sum(got[i].n_links for i in ids) >= 0.99 * n.sum()
        all_links += [(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist())]
    want = least([r[0] for r in rows], all_links)
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.98


def test_embedding_recall(spark):
    sf = "/root/testdata/sf0.01"
    d = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = Q.op9_embedding_dedup(spark, sf).collect()
    want = 2 * len(brute_links(d))
    assert len(rows) == len(d) and 0.97 * want <= sum(r.n_links for r in rows) <= want


def test_embedding_empty(spark):
    assert embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert embedding_links(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).collect()[0].kept


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    seen = docs
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id for r in seen.collect()}
        seen = stage(spark, seen, sf)
        assert seen.columns == names
        rows = seen.collect()
        after = {r.doc_id for r in rows}
        assert after <= before and len(after) == len(rows) and len(after) > 0.6 * len(before)
        if name == "near_duplicates":
            fp = {r.doc_id: fingerprint(r.text) for r in rows}
            assert len(set(fp.values())) == len(fp)
        seen = spark.createDataFrame(rows, docs.schema)
    left = {r.doc_id for r in P.run(spark, sf).collect()}
    assert left == after


def test_pipeline_odd(spark, sf):
    import corpus_pipeline as P

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the there then that", "en", "s", 1), (3, "the there then that", "en", "s", 1), (None, "the there then that", "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, d, sf).count() <= len(rows)
        assert stage(spark, d.limit(0), sf).count() == 0
    assert P.near_duplicates(spark, d, sf).count() == 2


def test_embedding_ties_repeats_and_doubles(spark):
    a = [1.0, 0.0]
    edge = [0.93, (1 - 0.93**2) ** 0.5]
    cosine = np.dot(a, edge) / np.linalg.norm(edge)
    rows = [(1, a, 1), (1, a, 1), (2, edge, 1), (3, [0.0, -1.0], 1), (None, [5.0, 5.0], 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_links(d, threshold=float(cosine)).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    near = [0.93 - 1e-9, (1 - (0.93 - 1e-9) ** 2) ** 0.5]
    close = spark.createDataFrame([(1, a, 1), (2, near, 1)], "vec_id long, embedding array<double>, label int")
    assert {r.n_links for r in embedding_links(close).collect()} == {0}


def test_hot_component_stays_where_it_is(spark):
    """A star with most of the links, and small ones beside it."""
    edges = [(0, k) for k in range(1, 700)] + [(k, k + 1) for k in range(1000, 1400, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == least({x for e in edges for x in e}, edges)
