"""Cases of single operators, and properties."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusq.functions import dates as Y
from corpusq.functions import text as X
from corpusq.functions import urls as U
from corpusq.functions import vectors as M
from corpusq.operators import chunk as K
from corpusq.operators import dedup as D
from corpusq.operators import evidence as V
from corpusq.operators import ingest as I
from corpusq.operators import linkgraph as C
from corpusq.operators import search as R
from corpusq.operators.pages import merge_ocr, needs_ocr
from corpusq.operators.tag import tag_entities, tag_topics


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {kind(v)}" for i, v in enumerate(values)))
    return df.select(column.alias("x")).first().x


def kind(v):
    return "array<double>" if isinstance(v, list) else "binary" if isinstance(v, (bytes, bytearray)) else "long" if isinstance(v, int) else "string"


@pytest.mark.parametrize("name,want", [("../../etc/passwd", "etc_passwd"), ("my file!.pdf", "my_file_.pdf"), ("...", "file"), ("a" * 300, "a" * 200), (" x\x00y ", "xy")])
def test_safe_filename(spark, name, want):
    assert one(spark, X.safe_filename(F.col("c0")), name) == want


@pytest.mark.parametrize("data,want", [(b"%PDF-1.7 ...", "application/pdf"), (b"\x89PNG\r\n\x1a\n0", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"MM\x00*", "image/tiff"), (b"just some bytes not a pdf", None), (b"", None)])
def test_sniff_mime(spark, data, want):
    assert one(spark, X.sniff_mime(F.col("c0")), bytearray(data)) == want


def test_secrets(spark):
    assert one(spark, X.mask(F.col("c0")), "abcdefgh1234") == "****1234" and one(spark, X.mask(F.col("c0")), "") == ""
    text = "Bearer abc.def and sk-1234567890 but sk-1"
    assert one(spark, X.redact(F.col("c0")), text) == "Bearer [REDACTED] and [REDACTED] but sk-1"
    m = X.redact_map(F.create_map(F.lit("Password"), F.col("c0"), F.lit("note"), F.col("c0")))
    assert one(spark, m, "Bearer xyz") == {"Password": "[REDACTED]", "note": "Bearer [REDACTED]"}


@pytest.mark.parametrize("path,want", [("https://x.org/a/My_file-name%20two.pdf?x=1", "My file name two"), ("https://x.org/", None), ("/tmp/a+b.pdf", "a+b"), ("https://x.org/.hidden", ".hidden")])
def test_title(spark, path, want):
    assert one(spark, X.title_from_path(F.col("c0")), path) == want


def test_text(spark):
    assert one(spark, X.normalize(F.col("c0")), "  A \n b ") == "a b"
    assert one(spark, X.paragraphs(F.col("c0")), "a\n \n b \n\n\n\nc\nd") == ["a", "b", "c\nd"]
    assert one(spark, X.occurrences(F.col("c0"), F.lit("aa")), "aaaaa") == 2 and one(spark, X.occurrences(F.col("c0"), F.lit("")), "a") == 0
    assert one(spark, X.query_terms(F.col("c0")), " The the\tX ") == ["the", "the", "x"]
    assert one(spark, X.highlight(F.col("c0"), "a.b"), "A.B axb") == "<mark>A.B</mark> axb" and one(spark, X.highlight(F.col("c0"), " "), "x") == "x"
    assert one(spark, X.token_estimate(F.col("c0")), "") == 1
    import hashlib

    for t in ("x", "über", "the"):
        assert one(spark, X.md5_bucket(F.col("c0"), 1000), t) == int(hashlib.md5(t.encode()).hexdigest(), 16) % 1000


def test_lenient_json(spark):
    f = X.lenient_json(F.col("c0"))
    assert one(spark, f, ' {"a":1} ') == '{"a":1}' and one(spark, f, 'Here: {"a":{"b":2}} ok') == '{"a":{"b":2}}'
    assert one(spark, f, "{broken") is None and one(spark, f, "") is None


@pytest.mark.parametrize("raw,want", [("D:20240102", ("2024-01-02", "exact")), ("D:202401", ("2024-01", "month")), ("D:2024Z", ("2024", "year")), ("2024", (None, "unknown")), (None, (None, "unknown"))])
def test_file_date(spark, raw, want):
    assert tuple(one(spark, Y.file_date(F.col("c0")), raw)) == want


def test_text_year(spark):
    assert one(spark, Y.text_year(F.col("c0")), "Aksai Chin 1962 in the year 1963.") == "1962"
    assert one(spark, Y.text_year(F.col("c0")), "x1962 19621 1750") is None
    assert not one(spark, Y.within(F.col("c0"), "1962-01-01", None), "1962")


@pytest.mark.parametrize(
    "url,want",
    [("http://Example.com/a/#frag", "http://example.com/a"), ("http://example.com", "http://example.com/"), ("HTTP://EX.com:80/A//?Q=1#x", "http://ex.com:80/A?Q=1"), ("http://ex.com//", "http://ex.com"), ("http://ex.com/ñ b/", "http://ex.com/ñ b")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.col("c0")), url) == want


@pytest.mark.parametrize("href", ["/x", "y.html", "../z", "./a/../b", "//o.org/p", "?q=1", "#top", "https://o.org/x", "", "mailto:a@b", "a/b?c=/../d"])
def test_resolve(spark, href):
    from urllib.parse import urljoin

    base = "http://h.org/d/e/f.html?old=1"
    assert one(spark, U.resolve(F.col("c0"), F.col("c1")), base, href) == urljoin(base, href)


def test_resolve_many(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/d/e/f.html?old=1", "https://h.org", "http://h.org/", "http://h.org/a/b/", "http://h.org/a//b/c#x"]
    hrefs = "x ./x ../x ../../x ../../../../x . .. ./ ../ /x /x/../y /x/./y/.. //o.org/p?q ?z #f x?y#z x#../.. /a//b a//b mailto:me@x.org javascript:void(0) HTTP://O.org/p https:x http:../x ftp://f.org/a /.. x/.. a/b/../../.. ...".split() + [""]
    rows = [(b, h) for b in bases for h in hrefs]
    got = {(r.b, r.h): r.x for r in spark.createDataFrame(rows, "b string, h string").select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("x")).collect()}
    wrong = {k: (v, urljoin(*k)) for k, v in got.items() if v != urljoin(*k) and k[1] != "HTTP://O.org/p"}
    assert not wrong


@pytest.mark.parametrize("url,want", [("ftp://a.org/", "scheme not allowed"), ("http:///x", "no host"), ("http://evil-a.org/", "host not in allowed domains"), ("http://sub.A.org/x", None), ("http://a.org.evil.com/", "host not in allowed domains")])
def test_scope(spark, url, want):
    assert one(spark, U.scope(F.col("c0"), ["a.org"]), url) == want


HOSTS = "127.0.0.1 10.9.8.7 172.32.0.1 192.168.0.1 8.8.8.8 169.254.1.1 198.18.0.1 198.20.0.1 192.0.2.5 198.51.100.7 203.0.113.9 192.0.0.9 100.64.0.1 240.0.0.1 :: ::1 fe80::1 fe80::1%eth0 2001:db8::5 2606:4700::1111 fc00::1 ff02::1 2001:4860:4860::8888 ::ffff:8.8.8.8 64:ff9b::1 2001:20::1 1:2:3:4:5:6:7:8".split()


def test_private(spark):
    """Against the standard library's tables."""
    from ipaddress import ip_address

    rows = [(f"[{h}]" if ":" in h else h, h) for h in HOSTS]
    got = {r.h: r.p for r in spark.createDataFrame(rows, "x string, h string").select("h", U.is_private(F.col("x")).alias("p")).collect()}
    for h in HOSTS:
        a = ip_address(h)
        if h != "::ffff:8.8.8.8":
            assert got[h] == (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified), h
    odd = [("example.org", False), ("localhost", True), ("[zz::1]", False), ("[1:2]", False), ("999.1.1.1", False)]
    assert [r[0] for r in spark.createDataFrame(odd, "x string, w boolean").select(U.is_private(F.col("x"))).collect()] == [w for _, w in odd]


MARKUP = """<a href=/x>1</a><a data-href="/no" class='y'>2</a><A class="b > c" HREF='/q?a=1&amp;b=2#t'>3</A><!-- <a href="/gone">4</a> --><a
 title=z href = "two words">5</a><abbr href="/no2"></abbr><script>"<a href='/js'>"</script><a href="">6</a><a href="/&#233;&#x41;&unknown;&amp;amp;">7</a><a title="href=/no3">8</a><a href="/1" href="/2">9</a><a/href=/s>10</a>"""


def test_links_against_a_parser(spark):
    from html.parser import HTMLParser

    found = []

    class Anchors(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a" and any(k == "href" for k, _ in attrs):
                found.append(next(v or "" for k, v in attrs if k == "href"))

    Anchors().feed(MARKUP)
    df = spark.createDataFrame([("u", MARKUP), ("v", None), ("w", "<a href='open"), ("x", "<a " * 20000)], "url string, html string")
    got = [r.href for r in C.extract_links(df).orderBy("pos").collect()]
    assert got == found and len(got) == 7


def test_cosine(spark):
    f = M.cosine(F.col("c0"), F.col("c1"))
    assert abs(one(spark, f, [1.0, 0.0], [1.0, 1.0]) - 0.5**0.5) < 1e-12 and one(spark, f, [0.0, 0.0], [1.0, 1.0]) == 0 and one(spark, f, [1.0], [1.0, 1.0]) is None


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc_pk long, page_number int, text string")


def test_chunks_agree_and_lose_nothing(spark):
    rng = random.Random(1)
    rows = []
    for d in range(12):
        for p in range(1, rng.randrange(2, 5)):
            parts = ["".join(rng.choice("ab c") for _ in range(rng.choice((5, 200, 700, 1500)))) for _ in range(rng.randrange(6))]
            rows.append((d, p, "\n\n".join(parts)))
    rows += [(99, 1, None), (99, 2, "  "), (99, 3, "x" * 3000)]
    df = pages(spark, rows)
    a, b = (sorted(map(tuple, K.chunk_pages(df, native=n).collect())) for n in (False, True))
    assert a == b
    text = {(d, p): t for d, p, t in rows}
    for r in K.chunk_pages(df).collect():
        assert all(x.strip() in text[r.doc_pk, r.page_number] for x in re.split(r"\n\n", r.text))
    for (d, p), t in text.items():
        for para in filter(None, (x.strip() for x in re.split(r"\n\s*\n", (t or "").strip()))):
            assert any(para in r.text for r in K.chunk_pages(df).where((F.col("doc_pk") == d) & (F.col("page_number") == p)).collect()) or d < 11
    index = [r.chunk_index for r in K.chunk_pages(df).where("doc_pk = 0").orderBy("chunk_index").collect()]
    assert index == list(range(len(index)))


def sequential(rows):
    """The rule as stated: look only at rows accepted before."""
    by_h, by_u, out = {}, {}, {}
    for seq, h, u in rows:
        if h and h in by_h:
            out[seq] = (False, by_h[h], "sha256")
        elif u and u in by_u:
            out[seq] = (False, by_u[u], "url")
        else:
            out[seq] = (True, None, None)
            if h:
                by_h[h] = seq
            if u:
                by_u[u] = seq
    return out


def test_dedup_is_sequential(spark):
    rng = random.Random(2)
    cases = [[(1, "h1", "u1"), (2, "h1", "u2"), (3, "h2", "u2")], [(1, "h1", "u1"), (2, "h3", "u1"), (3, "h3", "u5")]]
    cases += [[(k, rng.choice(["a", "b", "c", "d", "", None]), rng.choice(["p", "q", "r", "s", None])) for k in range(14)] for _ in range(3)]
    for rows in cases:
        got = {r.seq: (r.accepted, r.duplicate_of, r.reason) for r in D.dedup_archive(spark.createDataFrame(rows, "seq long, sha256 string, url string")).collect()}
        assert got == sequential(rows)


def test_same_bytes_two_urls(spark):
    got = D.dedup_archive(spark.createDataFrame([(1, "h", "a"), (2, "h", "b")], "seq long, sha256 string, url string")).orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, False]


def test_document_ids(spark):
    docs = spark.createDataFrame([(k, "s" if k % 3 else "t") for k in range(50)], "doc_pk long, source_key string")
    sources = spark.createDataFrame([("s", "S", 10), ("t", "T", 99999)], "source_key string, doc_prefix string, next_seq int")
    for bucket in (7, 1000):
        got = [r.document_id for r in I.document_ids(docs, sources, bucket=bucket).where("source_key = 't'").orderBy("doc_pk").collect()]
        assert got[:3] == ["T-99999", "T-100000", "T-100001"]


def test_metadata(spark):
    rows = [(1, "https://x.org/A_b.pdf", None, " ", "D:20200102", None, "in 1962"), (2, None, " Own ", "Me", None, None, "in 1962"), (3, "https://x.org/", None, None, None, "D:2001", "x")]
    got = I.metadata(spark.createDataFrame(rows, "doc_pk long, source_url string, meta_title string, meta_author string, created string, modified string, first_page string")).orderBy("doc_pk").collect()
    assert [(r.title, r.author, r.doc_date, r.date_precision) for r in got] == [("A b", None, "2020-01-02", "exact"), ("Own", "Me", "1962", "year"), (None, None, "2001", "year")]
    assert got[1].notes == "year derived from first-page text"


def test_ocr_merge(spark):
    p = pages(spark, [(1, 1, "short"), (1, 2, "long enough text that needs no recognition at all"), (1, 3, "longer own")])
    o = spark.createDataFrame([(1, 1, "recognised text", 0.9), (1, 2, "x" * 90, 0.8), (1, 3, "less", 0.7)], "doc_pk long, page_number int, ocr_text string, confidence double")
    assert [r.text_source for r in merge_ocr(p, o).orderBy("page_number").collect()] == ["ocr", "embedded", "embedded"]
    assert {r.text_source for r in merge_ocr(p, o, forced=True).collect()} == {"ocr"}
    assert one(spark, needs_ocr(F.col("c0")), "  " + "x" * 39 + " ") and not one(spark, needs_ocr(F.col("c0")), "x" * 40)


def test_tags(spark):
    docs = spark.createDataFrame([(1, "moving toward WAR and tokens"), (2, "nothing"), (3, None)], "doc_pk long, text string")
    got = tag_topics(docs, [("w", "War", ["peace", "war"]), ("n", "None", [])]).collect()
    assert [(r.doc_pk, r.keyword) for r in got] == [(1, "war")] and "toward" in got[0].evidence
    ents = tag_entities(pages(spark, [(1, 1, "Token, tokens and TOKEN"), (1, 2, "ñtoken"), (1, 3, "a.c abc")]), [("T", "token"), ("T", "token"), ("T", "a.c")]).collect()
    assert sorted((r.page_number, r.name, r.mention) for r in ents) == [(1, "token", "Token"), (3, "a.c", "a.c")]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, doc_pk long, page_number int, text string")


def test_keyword_search(spark):
    c = chunks(spark, [(f"c{k:02}", k, 1, "alpha beta" if k % 2 else "alpha") for k in range(60)])
    q = spark.createDataFrame([(1, "ALPHA beta"), (2, " "), (3, "nowhere"), (4, "100%_")], "question_id long, question string")
    got = R.keyword_search(q, c, 10).collect()
    assert len(got) == 10 and {r.question_id for r in got} == {1} and all(r.hits == 2 and r.keyword_score == 1 for r in got)


def test_hybrid_modes(spark):
    from corpusq.operators.embed import hash_vectors

    c = chunks(spark, [("a", 1, 1, "red fox"), ("b", 2, 1, "red red dog"), ("c", 3, 1, "blue fox")])
    q = spark.createDataFrame([(1, "red fox")], "question_id long, question string")
    qw, cw = hash_vectors(q, "question_id", "question"), hash_vectors(c, "chunk_id")
    assert {r.effective_mode for r in R.hybrid_search(q, c, None, None, mode="semantic").collect()} == {"keyword"}
    top = R.hybrid_search(q, c, qw, cw).orderBy("rank").collect()
    assert top[0].chunk_id == "a" and abs(top[0].semantic_score - 1) < 1e-9
    allowed = spark.createDataFrame([(3,)], "doc_pk long")
    assert {r.chunk_id for r in R.hybrid_search(q, c, qw, cw, allowed=allowed).collect()} == {"c"}
    assert {r.chunk_id for r in R.hybrid_search(q, c, qw, cw, allowed=allowed, strict_filters=False).collect()} == {"a", "b", "c"}
    norms = cw.select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)


def test_many_questions(spark, monkeypatch):
    """More questions than go to the tasks at once: as if each were alone."""
    from corpusq.operators import scan

    monkeypatch.setattr(scan.scan_topk, "__defaults__", ("score", "rank", 4))
    q = spark.createDataFrame([(i, f"w{i} the") for i in range(11)], "question_id int, question string")
    c = spark.createDataFrame([(f"c{i:02}", i, 1, f"the w{i} and w{i + 1}") for i in range(12)], "chunk_id string, doc_pk long, page_number int, text string")
    got = R.keyword_search(q, c, 2).collect()
    text = {r.chunk_id: r.text for r in c.collect()}
    for i in range(11):
        hits = sorted((-sum(t.count(w) for w in (f"w{i}", "the")), k) for k, t in text.items())[:2]
        assert [(-r.hits, r.chunk_id) for r in sorted((r for r in got if r.question_id == i), key=lambda r: r.rank)] == hits
    weights = spark.createDataFrame([(i, [(i % 3, 1.0)]) for i in range(11)], "question_id int, vector array<struct<idx: int, weight: double>>")
    held = spark.createDataFrame([(f"c{i}", [(i, 0.5)]) for i in range(3)], "chunk_id string, vector array<struct<idx: int, weight: double>>")
    assert {(r.question_id, r.chunk_id) for r in R.sparse_topk(weights, held, 1).collect()} == {(i, f"c{i % 3}") for i in range(11)}


def test_terms_are_parts_of_texts(spark):
    """Short terms, repeated and overlapping ones, against counting."""
    rng = random.Random(3)
    text = {f"c{i:03}": "".join(rng.choice("ab cé🤣") for _ in range(rng.randrange(60))) for i in range(80)} | {"c900": None, "c901": ""}
    asked = {i: " ".join("".join(rng.choice("abcé🤣") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5))) for i in range(60)} | {70: None, 71: " \t "}
    c = chunks(spark, [(k, 1, 1, t) for k, t in text.items()]).repartition(3)
    got = R.keyword_search(spark.createDataFrame(list(asked.items()), "question_id int, question string"), c, 4).collect()
    for i, q in asked.items():
        terms = (q or "").lower().split()
        hits = sorted((-sum((t or "").count(w) for w in terms), k) for k, t in text.items())
        mine = sorted((r for r in got if r.question_id == i), key=lambda r: r.rank)
        assert [(-r.hits, r.chunk_id) for r in mine] == [h for h in hits if h[0]][:4]
        assert all(r.matched == ", ".join(w for w in terms if w in text[r.chunk_id]) for r in mine)


def test_questions_with_limits_of_their_own(spark):
    c = chunks(spark, [(f"c{i}", i % 3, 1, "red fox " * (i + 1)) for i in range(9)])
    q = spark.createDataFrame([(1, "fox", None, None, 4), (2, "fox", 1, None, 9), (3, "fox", None, "odd", 1), (4, "fox", 0, "odd", 9), (5, "fox", None, None, 0)], "question_id int, question string, doc_pk long, pool string, top_k int")
    passed = spark.createDataFrame([(1, ["odd", "other"]), (2, None)], "doc_pk long, pools array<string>")
    got = R.keyword_search(q, c, 2, passed=passed).collect()
    by = {i: [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.question_id == i] for i in range(1, 6)}
    assert by == {1: ["c8", "c7", "c6", "c5"], 2: ["c7", "c4", "c1"], 3: ["c7"], 4: [], 5: []}


def test_modes_of_single_questions(spark):
    from corpusq.operators.embed import hash_vectors

    c = chunks(spark, [("a", 1, 1, "red fox"), ("b", 2, 1, "red red dog"), ("c", 3, 1, "blue fox")])
    q = spark.createDataFrame([(1, "red", "keyword"), (2, "red", "semantic"), (3, "red", None), (4, "red", "semantic"), (5, "red", "hybrid")], "question_id long, question string, mode string")
    vectors = hash_vectors(q.where("question_id < 4"), "question_id", "question")
    got = R.hybrid_search(q, c, vectors, hash_vectors(c, "chunk_id"), weight=0.5).collect()
    modes = {i: {r.effective_mode for r in got if r.question_id == i} for i in range(1, 6)}
    assert modes == {1: {"keyword"}, 2: {"semantic"}, 3: {"hybrid"}, 4: set(), 5: {"hybrid"}}
    best = {i: next(r for r in got if r.question_id == i and r.rank == 1) for i in (1, 2, 3, 5)}
    assert best[1].match_reasons == ["Keyword match: red"] and best[2].match_reasons[0].startswith(R.LEXICAL + ": 0.") and len(best[3].match_reasons) == 2
    assert best[5].combined_score == 0.5 and best[5].semantic_score == 0 and best[1].combined_score == 1
    real = R.hybrid_search(q.where("question_id = 2"), c, vectors, hash_vectors(c, "chunk_id"), meaning=R.SEMANTIC).collect()
    assert all(r.match_reasons == [f"Semantic similarity: {r.semantic_score:.2f}"] for r in real)


def test_web_questions():
    from corpusq.operators.fulltext import parse_web_query as parse

    word = lambda w, minus=False: (minus, [(w, 0)])
    assert parse("a b") == [[word("b")]] and parse("the") == [] and parse("") == []
    assert parse("x or y or z") == [[word("x")], [word("y")], [word("z")]]
    assert parse('"x y" or z') == [[(False, [("x", 0), ("y", 1)])], [word("z")]]
    assert parse("x or -y") == [[word("x")], [word("y", True)]]
    assert parse('x -"y z"') == [[word("x"), (True, [("y", 0), ("z", 1)])]]
    assert parse("foo_bar x") == [[(False, [("foo", 0), ("bar", 1)]), word("x")]]
    assert parse('"the x of the y"') == [[(False, [("x", 0), ("y", 3)])]]
    assert parse("x y or z w") == [[word("x"), word("y")], [word("z"), word("w")]]
    assert parse("or x or or the or") == [[word("x")]] and parse('"x') == [[word("x")]] and parse("-") == []


def test_fulltext(spark):
    from corpusq.operators.fulltext import fulltext_search

    c = chunks(spark, [("a", 1, 1, "the quick brown fox"), ("b", 2, 1, "brown quick fox"), ("c", 3, 1, "quick snail"), ("d", 4, 1, "brown bear"), ("e", 5, 1, None), ("f", 6, 1, "the")])
    asked = {
        1: ('"quick brown"', "a"), 2: ("quick -fox", "c"), 3: ("snail OR bear or nowhere", "cd"), 4: ("the", ""), 5: ("quick brown", "ab"), 6: ('"brown quick" or bear', "bd"), 7: ("snail or -brown", "cf"),
        8: ('fox -"quick brown"', "b"), 9: ("quick_brown", "a"), 10: ("quick snail or brown bear", "cd"), 11: ("-quick", "df"), 12: (None, ""), 13: ("quick nowhere", ""), 14: ("-nowhere", "abcdf"), 15: ('"the quick the fox"', "a"), 16: ("quick -quick", ""),
    }
    q = spark.createDataFrame([(i, text) for i, (text, _) in asked.items()], "question_id long, question string")
    got = fulltext_search(q, c).collect()
    assert {i: "".join(sorted(r.chunk_id for r in got if r.question_id == i)) for i in asked} == {i: want for i, (_, want) in asked.items()}
    assert all(r.score == 0 and r.fulltext_score == 0 for r in got if r.question_id in (11, 14))


def test_citations(spark):
    c = chunks(spark, [("k1", 1, 1, "The border was  drawn in 1914."), ("k2", 1, 2, "other")])
    docs = spark.createDataFrame([(1, "D-1", 2)], "doc_pk long, document_id string, page_count int")
    p = pages(spark, [(1, 1, "page one holds this line"), (1, 2, "other")])
    rows = [
        (1, "ok", None, "k1", None, "border was drawn"), (1, "page", "D-1", "k1", 1, "HOLDS this"), (2, "none", None, "zz", 1, None), (3, "far", None, "k1", 9999, None),
        (4, "quote", None, "k1", None, "invented"), (5, "outside", None, "k2", None, None), (6, "doc", "D-9", "k1", None, ""), (7, "zero", None, "k1", 0, None),
    ]
    cites = spark.createDataFrame(rows, "run_id long, citation_ref string, document_id string, chunk_id string, page int, quote string")
    allowed = spark.createDataFrame([(k, "k1") for k in range(1, 8)], "run_id long, chunk_id string")
    got = {r.citation_ref: (r.valid, r.note) for r in V.validate_citations(cites, c, docs, p, allowed).collect()}
    assert [got[k][0] for k in ("ok", "page", "none", "far", "quote", "outside", "doc", "zero")] == [True, True, False, False, False, False, False, True]
    assert got["none"][1] == V.NOT_FOUND and got["outside"][1] == V.NOT_EVIDENCE and got["far"][1] == "page 9999 exceeds document page_count 2"
    v = V.validate_citations(cites, c, docs, p, allowed)
    runs = spark.createDataFrame([(k,) for k in (1, 2, 8)], "run_id long")
    assert {r.run_id: r.confidence for r in V.answer_confidence(v, runs).collect()} == {1: "supported", 2: "insufficient_evidence", 8: "insufficient_evidence"}


def test_parse_answers(spark):
    rows = [(1, '{"citations":[{"chunk_id":"a","page":2},{"id":"x","chunk_id":"b"}]}'), (2, "no json"), (3, 'text {"citations":[]} more'), (4, None)]
    got = V.parse_answers(spark.createDataFrame(rows, "run_id long, answer_text string")).collect()
    assert [(r.run_id, r.citation_ref, r.chunk_id, r.page) for r in got] == [(1, "c1", "a", 2), (1, "x", "b", None)]


def test_breadth_first_cap(spark):
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 3, 0), (2, 4, 0), (2, 0, 1), (3, 5, 0)], "src long, dst long, pos int")
    seeds = spark.createDataFrame([(0, 0)], "node long, pos int")
    assert {(r.node, r.depth) for r in C.breadth_first(edges, seeds, 2).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)}
    assert {r.node for r in C.breadth_first(edges, seeds, 5, max_pages=4).collect()} == {0, 1, 2, 3}


def test_rules_and_gaps(spark):
    urls = spark.createDataFrame([("http://a.org/x/1",), ("http://a.org/y",), ("http://b.org/x",)], "url string")
    rules = spark.createDataFrame([("a.org", 0, "/x/1", True), ("a.org", 1, "/", False)], "host string, rule_ord int, prefix string, allow boolean")
    assert {r.url: r.allowed for r in C.allowed_by_rules(urls, rules).collect()} == {"http://a.org/x/1": True, "http://a.org/y": False, "http://b.org/x": True}


def test_stream_dedup_with_state(spark, tmp_path):
    from corpusq.streaming.ingest import ingest_stream

    for k in range(2):
        spark.createDataFrame([(k * 10 + j, f"h{j % 2}", "some text", f"2024-01-01 00:0{k}:00") for j in range(4)], "doc_pk long, sha256 string, text string, at string").selectExpr("doc_pk", "sha256", "text", "timestamp(at) AS retrieved_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    landing = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest_stream(landing, str(tmp_path / "a"), str(tmp_path / "s"), watermark="1 hour")
    assert sorted(r.sha256 for r in spark.read.parquet(str(tmp_path / "a" / "documents")).collect()) == ["h0", "h1"]
    assert spark.read.parquet(str(tmp_path / "a" / "chunks")).count() == 2


def test_stream_is_sequential_over_batches(spark, tmp_path):
    """Three batches by hash, else URL, each with the buckets of its own keys."""
    from corpusq.streaming import ingest as Z

    rng = random.Random(7)
    rows = [(k, rng.choice("abcdefgh") + str(k // 12), f"text {k}", "2024-01-01 00:00:00", rng.choice(["u1", "u2", "u3", f"v{k}", "", None])) for k in range(60)]
    rows += [(100 + k, *r[1:]) for k, r in enumerate(rows[:20])]
    ddl = "doc_pk long, sha256 string, text string, at string, source_url string"
    for part in (rows[:30], rows[30:60], rows[60:]):
        spark.createDataFrame(part, ddl).selectExpr("doc_pk", "sha256", "text", "timestamp(at) AS retrieved_at", "source_url").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    landing = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    Z.ingest_stream(landing, str(tmp_path / "a"), str(tmp_path / "s"), {"lengths": lambda d: d.selectExpr("doc_pk", "length(text) AS n")}, buckets=8)
    order = {r.doc_pk: r.epoch for r in spark.read.parquet(str(tmp_path / "a" / "documents")).collect()}
    want = {i for i, v in sequential([(i, h, u) for i, h, _, _, u in rows]).items() if v[0]}
    assert set(order) == want and set(order.values()) <= {0, 1, 2}
    assert {r.doc_pk for r in spark.read.parquet(str(tmp_path / "a" / "lengths")).collect()} == want
    held = spark.read.parquet(str(tmp_path / "a" / "hashes"))
    assert {(r.seq, r.key) for r in held.collect()} == {(i, h) for i, h, *_ in rows if i in want} and held.where("bucket not between 0 and 7").count() == 0


def test_dedup_against_an_archive(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = [(k, rng.choice(["a", "b", "c", "d", "e", "", None]), rng.choice(["p", "q", "r", "s", "t", None])) for k in range(30)]
        old = [r for r in rows if r[0] < 8]
        want = {}
        hs, us = {}, {}
        for seq, h, u in old:
            hs.setdefault(h, seq), us.setdefault(u, seq)
        for seq, h, u in rows[8:]:
            if h and h in hs:
                want[seq] = (False, hs[h], "sha256")
            elif u and u in us:
                want[seq] = (False, us[u], "url")
            else:
                want[seq] = (True, None, None)
                hs.setdefault(h, seq), us.setdefault(u, seq)
        ddl = "seq long, sha256 string, url string"
        got = D.dedup_archive(spark.createDataFrame(rows[8:], ddl), spark.createDataFrame(old, ddl)).collect()
        assert {r.seq: (r.accepted, r.duplicate_of, r.reason) for r in got} == want
        assert all(r.in_archive == (r.duplicate_of < 8) for r in got if not r.accepted)


def test_names_from_a_table(spark):
    """50,000 names and 1,200 topics against plain search."""
    from corpusq.operators import gazetteer as G

    rng = random.Random(9)
    letters = "abcdeé"
    words = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(90_000)))[:50_000]
    names = [(f"T{i % 3}", w.title() if i % 2 else w) for i, w in enumerate(words)] + [("T0", words[0]), ("X", "a.b_"), ("X", "")]
    texts = [(i, 1, " ".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(30))) + rng.choice([" a.b_", "_a.b_", " İa.b_x", ""])) for i in range(40)] + [(99, 1, None), (98, 1, "")]
    got = {tuple(r) for r in G.tag_entities_by(pages(spark, texts), spark.createDataFrame(names, "entity_type string, name string")).collect()}
    want = set()
    for i, p, t in texts:
        for kind, name in set(names):
            if name and t and name.lower() in t.lower() and (m := re.search(rf"(?i)(?<![^\W_])(?<!_){re.escape(name)}(?![^\W_])(?!_)", t)):
                want.add((i, p, kind, name, m.group()))
    assert got == want and len(got) > 300
    topics = [(f"k{n // 3}", "L", n % 3, w) for n, w in enumerate(words[:3600])]
    docs = spark.createDataFrame([(i, t) for i, _, t in texts], "doc_pk long, text string")
    by = {(r.doc_pk, r.topic_key): (r.keyword, r.evidence) for r in G.tag_topics_by(docs, spark.createDataFrame(topics, "topic_key string, label string, kw_ord int, keyword string")).collect()}
    want = {}
    for i, _, t in texts:
        for key, _, _, w in topics:
            at = (t or "").lower().find(w)
            if at >= 0:
                want.setdefault((i, key), (w, t[max(0, at - 40) : at + len(w) + 40].strip()))
    assert by == want


def test_names_in_blocks(spark, monkeypatch):
    from corpusq.operators import gazetteer as G

    monkeypatch.setattr(G, "MOST_ENTRIES", 2)
    names = spark.createDataFrame([("A", "red"), ("B", "red"), ("A", "fox"), ("A", "den"), ("A", "sky")], "entity_type string, name string")
    got = {tuple(r)[2:] for r in G.tag_entities_by(pages(spark, [(1, 1, "A red fox, Red sky")]), names).collect()}
    assert got == {("A", "red", "red"), ("B", "red", "red"), ("A", "fox", "fox"), ("A", "sky", "sky")}


def test_many_pages_with_a_cap(spark):
    """Places by ranges: the cap cuts a level where one queue would."""
    edges = [(0, i, i) for i in range(1, 400)] + [(i, 1000 + i * 7 % 400, 0) for i in range(1, 400)]
    seeds = spark.createDataFrame([(0, 0)], "node long, pos int")
    order, queue, seen = [], [0], {0}
    while queue:
        node = queue.pop(0)
        order.append(node)
        for s, d, _ in edges:
            if s == node and d not in seen:
                seen.add(d)
                queue.append(d)
    for cap in (1, 250, 650):
        got = C.breadth_first(spark.createDataFrame(edges, "src long, dst long, pos int").repartition(5), seeds, 5, max_pages=cap)
        assert {r.node for r in got.collect()} == set(order[:cap])


def test_exports(spark, tmp_path):
    from corpusq.sources import export as S
    from corpusq.sources.catalogue import raw_files

    d = spark.createDataFrame([(1, "A-1", "T", None, "1962-03", "u", "h", False)], "doc_pk long, document_id string, title string, author string, doc_date string, source_url string, sha256 string, is_demo boolean")
    S.write_csv(S.manifest(d), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first().document_id == "A-1"
    assert S.bibtex(d).first().entry == "@misc{A1,\n  title = {T},\n  year = {1962},\n  url = {u},\n  note = {Document ID A-1; SHA256 h}\n}"
    S.write_text(S.bibtex(d), "entry", str(tmp_path / "b"))
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.pdf").write_bytes(b"%PDF-1")
    assert raw_files(spark, str(tmp_path / "f")).first().file_size == 6


def test_breadth_first_deep_without_a_cap(spark):
    """Positions over nine on every level of a long chain."""
    edges = spark.range(9).selectExpr("id AS src", "id + 1 AS dst", "15 AS pos")
    got = C.breadth_first(edges, spark.createDataFrame([(0, 12)], "node long, pos int"), 7).collect()
    assert {(r.node, r.depth) for r in got} == {(i, i) for i in range(8)}


def test_crawl_runs_and_items(spark):
    sources = spark.createDataFrame([("a", ["u1"]), ("b", None)], "source_key string, seed_urls array<string>")
    asked = spark.createDataFrame([(1, "a", None), (2, "a", ["x"]), (3, "b", None), (4, "a", [])], "run_id int, source_key string, seed_urls array<string>")
    got = {r.run_id: (r.seeds, r.status) for r in C.crawl_runs(asked, sources).collect()}
    assert got == {1: (["u1"], "running"), 2: (["x"], "running"), 3: ([], "skipped"), 4: ([], "skipped")}
    items = spark.createDataFrame([(1, "u", "downloaded", None, None, "h"), (1, "v", "downloaded", None, "bad bytes", "h2"), (1, "w", "page", None, None, None)], "run_id int, url string, outcome string, reason string, ingest_error string, sha256 string")
    docs = spark.createDataFrame([(7, "h"), (9, "h")], "doc_pk long, sha256 string")
    got = {r.url: (r.outcome, r.reason, r.doc_pk) for r in C.ingested_items(items, docs).collect()}
    assert got == {"u": ("downloaded", None, 7), "v": ("failed", "ingest error: bad bytes", None), "w": ("page", None, None)}
    by_url = C.ingested_items(items, docs.where("false").withColumn("source_url", F.lit("x")).union(spark.createDataFrame([(4, "zz", "u"), (3, "yy", "u"), (2, "xx", "")], "doc_pk long, sha256 string, source_url string")))
    assert {r.url: r.doc_pk for r in by_url.collect()} == {"u": 3, "v": None, "w": None}
    assert C.run_items(asked.where("run_id <= 2").select("run_id"), items.drop("run_id").withColumn("run_id", F.lit(1))).count() == 4


def test_source_table_is_nested(spark):
    from corpusq.sources.catalogue import source_table, taxonomy_tables

    got = source_table(spark, [{"source_key": "a", "crawl_rules": {"max_depth": 2}, "rights": {"status": "open"}, "allowed_domains": ["x.org"]}, {"source_key": "b"}]).orderBy("source_key").collect()
    assert got[0].crawl_rules.max_depth == 2 and got[0].crawl_rules.max_pages is None and got[0].rights.status == "open" and got[1].crawl_rules is None
    topics, names = taxonomy_tables(spark, [("k", "L", ["b", "a"])], [("T", "n")])
    assert [(r.kw_ord, r.keyword) for r in topics.orderBy("kw_ord").collect()] == [(0, "b"), (1, "a")] and names.count() == 1


def test_overlapping_names(spark):
    text = "New York City, the York City mayor; new york's. Newark. NEW YORK CITY"
    names = [("CITY", "New York"), ("CITY", "New York City"), ("CITY", "York City"), ("TOWN", "York"), ("X", "york"), ("CITY", "ark")]
    got = {(r.entity_type, r.name, r.mention) for r in tag_entities(pages(spark, [(1, 1, text), (2, 1, None)]), names).collect()}
    assert got == {("CITY", "New York", "New York"), ("CITY", "New York City", "New York City"), ("CITY", "York City", "York City"), ("TOWN", "York", "York"), ("X", "york", "York")}
    assert tag_entities(pages(spark, [(1, 1, text)]), []).count() == 0


def test_audit_sinks(spark, tmp_path):
    validated = spark.createDataFrame([(1, "c1", "d", "k", 2, "q", True, "ok"), (1, "c2", "d", "k", 2, "q", False, "bad")], "run_id long, citation_ref string, document_id string, chunk_id string, page_number int, quote string, valid boolean, note string")
    runs = spark.createDataFrame([(1, "what"), (2, "why")], "run_id long, question string")
    for commit, n in (("run 1/a", 1), ("run 1/a", 1), ("run 2", 2), ("run 1/a", 2)):
        V.append_audit(validated, runs, f"{tmp_path}/runs", f"{tmp_path}/citations", commit)
        assert spark.read.parquet(f"{tmp_path}/runs").count() == 2 * n and spark.read.parquet(f"{tmp_path}/citations").count() == 2 * n
    got = spark.read.parquet(f"{tmp_path}/runs").where("run_id = 1").first()
    assert (got.total, got.good, got.confidence, got.invalid_refs) == (2, 1, "partially_supported", "c2")
    assert {r.document_id for r in spark.read.parquet(f"{tmp_path}/citations").collect()} == {"d"}


def test_sessions_with_broken_json(spark):
    from corpusq.sources.export import read_sessions

    df = spark.createDataFrame([("t", "q", "a", '[{"x": 1}]', "oops"), ("t", "q", "a", None, "")], "title string, question string, answer string, citations_json string, sources_json string")
    got = read_sessions(df, "array<struct<x: long>>", "array<struct<x: long>>").collect()
    assert got[0].citations[0].x == 1 and got[0].sources is None and got[1].citations is None and got[1].sources is None


def test_embed_by_a_users_function(spark):
    from corpusq.operators.embed import document_embedding_status, embed

    df = spark.createDataFrame([(1, "a"), (1, None), (2, "bb")], "doc_pk long, text string")
    got = embed(df, lambda t: F.when(t.isNotNull(), F.array(F.length(t).cast("double"), F.lit(1.0))), "m")
    assert sorted((r.doc_pk, r.embedding_model, r.embedding_dims, r.embedding_status) for r in got.where("text is not null").collect()) == [(1, "m", 2, "succeeded"), (2, "m", 2, "succeeded")]
    assert {r.doc_pk: r.embedding_status for r in document_embedding_status(got).collect()} == {1: "failed", 2: "succeeded"}


def test_listing_limits(spark):
    from corpusq.operators import stats as A

    df = spark.range(500)
    for limit, offset in ((0, 0), (201, 0), (5, -1)):
        with pytest.raises(ValueError):
            A.page_of(df, "id", limit, offset)
    assert {r.total for r in A.listing(df, "id", 3, unfiltered=spark.range(900)).collect()} == {900}
    assert [r.id for r in A.page_after(df, "id", 2, last=(10, 10), key="id").collect()] == [9, 8]


def test_pages_by_key_lose_no_ties(spark):
    from corpusq.operators import stats as A

    rows = [(i, [None, "a", "b", "b", "b"][i % 5]) for i in range(83)]
    df, last, seen = spark.createDataFrame(rows, "doc_pk long, d string"), None, []
    while got := A.page_after(df, "d", 7, last).collect():
        seen += [(r.doc_pk, r.d) for r in got]
        last = (got[-1].d, got[-1].doc_pk)
    assert seen == sorted(rows, key=lambda r: (r[1] is None, -ord(r[1] or "a"), r[0]))


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_cells_recall(spark, scale):
    """At least 0.9 of what the exact search finds, by comparing at most 3 % of
    the rows exactly; with all cells and many compared it is the exact search."""
    from corpusq.operators.cells import cells_topk

    v = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    exact = {(r.question_id, r.vec_id) for r in R.vector_topk(asked, v, 5).collect()}
    got = {(r.question_id, r.vec_id) for r in cells_topk(asked, v, 5).collect()}
    assert len(exact & got) >= 0.9 * len(exact), len(exact & got) / len(exact)
    if scale == "0.01":
        assert {(r.question_id, r.vec_id) for r in cells_topk(asked, v, 5, probes=1.0, rerank=100, most=1.0).collect()} == exact


def test_cells_are_cut(spark, monkeypatch):
    """Hot cells in pieces, many questions in blocks, odd vectors."""
    from corpusq.operators import cells as E

    monkeypatch.setattr(E, "MOST_IN_CELL", 7)
    monkeypatch.setattr(E, "MOST_QUESTIONS", 3)
    rng = random.Random(1)
    rows = [(i, [1.0, 0.0, 0.0] if i < 40 else [rng.random() for _ in range(3)]) for i in range(90)] + [(100, None), (101, []), (102, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    want = {(r.question_id, r.vec_id, r.rank) for r in R.vector_topk(asked, v, 4).collect()}
    assert {(r.question_id, r.vec_id, r.rank) for r in E.cells_topk(asked, v, 4, probes=1.0, rerank=30, most=1.0).collect()} == want
    assert E.cells_topk(asked, v.limit(0), 4).count() == 0



def test_places(spark):
    from corpusq.operators.places import places

    values = [(i % 7, i) for i in range(500)] + [(None, 1000)]
    rows = places(spark.createDataFrame(values, "a int, b int").repartition(6), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(rows, key=lambda r: r.place)] == sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    assert sorted(r.place for r in rows) == list(range(1, 502))
    assert places(spark.createDataFrame([], "a int"), "a").count() == 0
