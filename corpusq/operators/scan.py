"""One pass over a table for many questions, scored inside the tasks as arrays.

Questions are read in blocks of about ``MOST_QUESTIONS`` rows, each broadcast for
one pass and dropped after it; a task keeps the best rows of each question, and
what it found is written to the shared folder before the next block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusq.shared import ship, stored

MOST_QUESTIONS = 32768
#: Rows and bytes that a task scores at once, and questions
ROWS, BYTES, ASKED = 8192, 16 << 20, 256
#: Rows and words of about the same length that get one bound of their counts
GROUP, GROUP_WORDS = 256, 1 << 16
#: Rows and bytes of a batch that are turned into Python objects at once
PIECE, PIECE_BYTES = 1024, 4 << 20
#: Of that many stored rows, one in ``SHARE`` is searched first: it says what the others must reach
LEAST_ROWS, SHARE = 1 << 17, 32
#: Distinct words that a task remembers
MOST_WORDS = 1 << 18


def best(scored: DataFrame, k: int | Column, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each question.  Every task keeps k of its own first."""
    w = Window.partitionBy("question_id").orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


class Keys:
    """Keys of a batch, and the smallest of them."""

    def __init__(self, keys: list):
        self.keys = np.empty(len(keys), object)
        self.keys[:] = keys
        self.first = min(keys, default=None)


class Top:
    """The best rows of each question, of one task; ties: smaller key first.

    Hits wait until there are as many as are held, or a batch ends; then all are
    put in order at once.
    """

    def __init__(self, k: list[int], least: np.ndarray | None = None, limited: bool = False):
        self.k, self.limited = np.array(k, np.int64), limited
        self.least = np.full(len(k), np.finfo(float).min) if least is None else least.copy()
        self.held = np.zeros(len(k), np.int64)
        self.q, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), np.empty(0, object)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, q: int | np.ndarray, at: np.ndarray, score: np.ndarray, keys: Keys) -> None:
        """Hits: questions (one, or one each), places in the batch, and scores."""
        q, score = np.broadcast_to(q, len(at)), np.round(score, 9)
        some = np.flatnonzero((score >= self.least[q]) & (self.k[q] > 0))
        if len(some):
            self.waiting.append((q[some], score[some], keys.keys[at[some]]))
            self.size += len(some)
        if self.size > max(len(self.q), 1 << 16):
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        q, score, key = (np.concatenate(x) for x in zip((self.q, self.score, self.key), *self.waiting))
        self.waiting, self.size = [], 0
        order = np.lexsort((-score, q))
        q, score, key = q[order], score[order], key[order]
        same = (q[1:] == q[:-1]) & (score[1:] == score[:-1])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(tied):
            run = np.append(0, np.cumsum(~same))[tied].tolist()
            key[tied] = [k for _, k in sorted(zip(run, key[tied].tolist()))]
        n = np.bincount(q, minlength=len(self.k))
        kept = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) < self.k[q]
        self.q, self.score, self.key = q[kept], score[kept], key[kept]
        self.held = np.bincount(self.q, minlength=len(self.k))
        self.stops = np.cumsum(self.held)
        full = np.flatnonzero((n >= self.k) & (self.k > 0))
        self.least[full] = np.maximum(self.least[full], self.score[self.stops[full] - 1])

    def last(self, q: int) -> object:
        """The key of the worst row of a question that holds all it may."""
        return self.key[self.stops[q] - 1]


class Dense:
    """Cosine of unit vectors; vectors of another length are no hits.

    ``scores`` may be off by ``margin``; ``exact`` corrects those that may count,
    and what is not over ``floor`` is no hit.
    """

    floor, margin = -np.inf, 1e-9

    def __init__(self, asked: pa.Array):
        self.n, self.asked = len(asked), self.pack(asked)

    def pack(self, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Unit vectors by length; a zero vector stays zero, null and empty ones are left out."""
        flat, size = np.asarray(column.flatten(), float), np.array([len(x) if x.is_valid else 0 for x in column])
        stop, out = np.cumsum(size), {}
        for d in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == d)
            x = flat[(stop[at] - d)[:, None] + np.arange(d)]
            n = np.linalg.norm(x, axis=1, keepdims=True)
            out[d] = at, x / np.where(n == 0, 1, n)
        return out

    def rows(self, column: pa.Array):
        return len(column), self.pack(column)

    def scores(self, rows, lo: int, hi: int) -> np.ndarray:
        n, packed = rows
        out = np.full((hi - lo, n), -np.inf)
        for d, (at, m) in packed.items():
            if d in self.asked:
                mine, vectors = self.asked[d]
                a, b = np.searchsorted(mine, [lo, hi])
                out[np.ix_(mine[a:b] - lo, at)] = vectors[a:b] @ m.T
        return out

    def exact(self, rows, q: np.ndarray, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        return score.astype(float)


class Sparse:
    """Inner product of sparse unit vectors that share a dimension: in single
    precision for all, in double precision for those that may be among the best."""

    floor, margin = 0.0, 2e-5

    def __init__(self, asked: pa.Array, dims: int):
        self.n, self.dims = len(asked), dims
        self.asked = self.pack(asked)
        self.short = self.asked.astype(np.float32)

    def pack(self, column: pa.Array) -> np.ndarray:
        size = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
        flat = column.flatten()
        x = np.zeros((len(column), self.dims))
        x[np.repeat(np.arange(len(column)), size), flat.field("idx").to_numpy()] = flat.field("weight").to_numpy()
        return x

    def rows(self, column: pa.Array):
        x = self.pack(column)
        return x, np.ascontiguousarray(x.T.astype(np.float32))

    def scores(self, rows, lo: int, hi: int) -> np.ndarray:
        return self.short[lo:hi] @ rows[1]

    def exact(self, rows, q: np.ndarray, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        cut = [slice(lo, lo + 4096) for lo in range(0, len(at), 4096)]
        return np.concatenate([np.einsum("ij,ij->i", rows[0][at[c]], self.asked[q[c]]) for c in cut]) if cut else np.zeros(0)


def overlaps_itself(term: str) -> bool:
    """Whether two occurrences of a term can share characters."""
    return any(term.startswith(term[i:]) for i in range(1, len(term)))


class Found:
    """The terms that stand in each of the distinct words of a batch, as parts of
    it: the words are read once by an automaton over all asked terms."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.twice = np.array([overlaps_itself(t) for t in terms], bool)
        self.length = np.array([len(t) for t in terms], np.int64)
        self.tree = ahocorasick.Automaton()
        for n, t in enumerate(terms):
            self.tree.add_word(t, n)
        if terms:
            self.tree.make_automaton()
        self.read([])

    def __len__(self) -> int:
        return len(self.stops) - 1

    def read(self, words: list[str]) -> None:
        """The terms of word n are ``of[stops[n] : stops[n + 1]]``."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        of, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        edges = np.flatnonzero(np.diff(np.cumsum(size) // PIECE_BYTES, prepend=-1)).tolist() + [len(words)]
        for lo, hi in zip(edges, edges[1:]):
            # terms hold no white space, so none reaches into the next word
            met = np.fromiter(chain.from_iterable(self.tree.iter("\n".join(words[lo:hi]))) if self.terms else (), np.int64).reshape(-1, 2)
            word, term = np.searchsorted(np.cumsum(size[lo:hi]), met[:, 0], side="right"), met[:, 1]
            if len(lost := self.overlapped(word, term, met[:, 0])):
                word, term = np.delete(word, lost), np.delete(term, lost)
            of.append(term.astype(np.int32))
            counts.append(np.bincount(word, minlength=hi - lo))
        self.of, self.stops = np.concatenate(of), np.cumsum(np.concatenate(counts))

    def overlapped(self, word: np.ndarray, term: np.ndarray, end: np.ndarray) -> list[int]:
        """Occurrences that share characters with a counted one of the same term."""
        some = np.flatnonzero(self.twice[term])
        some = some[np.lexsort((end[some], term[some], word[some]))]
        w, t, e = word[some], term[some], end[some]
        near = np.flatnonzero((w[1:] == w[:-1]) & (t[1:] == t[:-1]) & (e[1:] - e[:-1] < self.length[t[1:]])) + 1
        lost: set[int] = set()
        if len(near):
            at, first = -1, np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1])))
            for start in np.unique(first[np.searchsorted(first, near, side="right") - 1]).tolist():
                at, counted = start + 1, e[start]
                while at < len(e) and w[at] == w[start] and t[at] == t[start]:
                    if e[at] - counted < self.length[t[start]]:
                        lost.add(int(some[at]))
                    else:
                        counted = e[at]
                    at += 1
        return sorted(lost)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - stops + sizes, sizes)


class Numbers(dict):
    """Words by the order in which they came."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Terms:
    """How often the terms of a question stand in a text, as parts of it.

    Terms hold no white space, so each stands inside a word, and a text's counts
    are the sums over its words.  Rows of a batch go by length, longest first, in
    groups; the largest count of each term in a group bounds the scores of its
    rows, and only questions that can reach their best so far are counted there.
    """

    # the more rows, the fewer words are read again
    rows_at_once, bytes_at_once = 1 << 15, 64 << 20

    def __init__(self, asked: pa.Array):
        every: dict[str, int] = {}
        of, times, stops, self.most = [], [], [0], 0
        for terms in asked.to_pylist():
            own = Counter(terms or [])
            of += [every.setdefault(t, len(every)) for t in own]
            times += own.values()
            stops.append(len(of))
            self.most = max(self.most, sum(own.values()))
        self.n, self.of, self.times, self.stops = len(asked), np.array(of, np.int64), np.array(times, float), np.array(stops)
        self.count, self.found = len(every), Found(list(every))

    def rows(self, column: pa.Array):
        """Words of all rows by number, and the rows in groups."""
        known, sizes, parts, longest = Numbers(), [], [], 0
        for lo in range(0, len(column), PIECE):
            low = column.slice(lo, PIECE).to_pylist()
            words = [words_of(t) for t in low]
            longest = max(longest, max(len(t or "") for t in low))
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
            parts.append(np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int32, sizes[-1].sum()))
        self.found.read(list(known))
        number, size = np.concatenate(parts), np.concatenate(sizes)
        n = np.diff(self.found.stops)
        matches = np.append(0, np.cumsum(n[number]))
        stops = np.append(0, np.cumsum(size))
        order = np.argsort(matches[stops[:-1]] - matches[stops[1:]], kind="stable")
        groups, held = [], 0
        for i, words in zip(order.tolist(), size[order].tolist()):
            if not groups or len(groups[-1]) == GROUP or held + words > GROUP_WORDS:
                groups.append([])
                held = 0
            groups[-1].append(i)
            held += words
        # single precision holds sums below 2**24 exactly
        kind = np.float32 if longest * self.most < 1 << 24 else np.float64
        return len(column), number, stops, n, [np.array(g) for g in groups], kind

    def counts(self, rows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms that stand in some rows, and how often in each of them."""
        _, number, stops, n, _, _ = rows
        size = stops[at + 1] - stops[at]
        words = number[ranges(stops[at], size)]
        term = self.found.of[ranges(self.found.stops[words], n[words])]
        row = np.repeat(np.repeat(np.arange(len(at)), size), n[words])
        seen = np.flatnonzero(np.bincount(term, minlength=self.count))
        local = np.zeros(self.count, np.int64)
        local[seen] = np.arange(len(seen))
        return seen, np.bincount(local[term] * len(at) + row, minlength=len(seen) * len(at)).reshape(len(seen), len(at))

    def scored(self, seen: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Scores of the rows that were counted, for some questions."""
        place = np.full(self.count, -1)
        place[seen] = np.arange(len(seen))
        size = self.stops[q + 1] - self.stops[q]
        at, of = ranges(self.stops[q], size), np.repeat(np.arange(len(q)), size)
        met = place[self.of[at]] >= 0
        at, of = at[met], of[met]
        out = np.zeros((len(q), counts.shape[1]), counts.dtype)
        if len(at):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[first]] = np.add.reduceat(counts[place[self.of[at]]] * self.times[at].astype(counts.dtype)[:, None], first)
        return out

    def scores(self, rows, lo: int, hi: int) -> np.ndarray:
        """Scores of all rows, for a range of questions."""
        out = np.zeros((hi - lo, rows[0]), rows[5])
        for at in rows[4]:
            seen, counts = self.counts(rows, at)
            out[:, at] = self.scored(seen, counts.astype(rows[5]), np.arange(lo, hi))
        return out

    def hits(self, rows, keys: Keys, top: Top) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Questions, rows and scores that may be among the best."""
        asked = np.flatnonzero(np.diff(self.stops))
        for at in rows[4]:
            seen, counts = self.counts(rows, at)
            if not len(seen):
                continue
            most = np.zeros(self.count)
            most[seen] = counts.max(1)
            bound = np.zeros(self.n)
            bound[asked] = np.add.reduceat(self.times * most[self.of], self.stops[asked])
            able = np.flatnonzero((bound > 0) & (bound >= top.least))
            counts = counts.astype(rows[5]) if len(able) else counts
            for lo in range(0, len(able), ASKED // 4):
                q = able[lo : lo + ASKED // 4]
                score = self.scored(seen, counts, q)
                i, j = np.nonzero(score >= np.maximum(top.least[q], 1).astype(score.dtype)[:, None])
                yield q[i], at[j], score[i, j].astype(float)
            if top.size > len(top.q) // 8:
                top.fold()


_odd_blanks = re.compile("[\x1c-\x1f]")
_java_blanks = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def words_of(low: str | None) -> list[str]:
    """Words between white space, as ``query_terms`` cuts them: Python also takes
    four control characters for white space."""
    if not low:
        return []
    return [w for w in _java_blanks.split(low) if w] if _odd_blanks.search(low) else low.split()


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that few rows and bytes are Python objects at once; a
    longer row stands alone."""
    for b in batches:
        step = max(1, min(PIECE, b.num_rows * PIECE_BYTES // max(b.nbytes, 1)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def gathered(batches: Iterator[pa.RecordBatch], rows: int | None = None, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = rows or ROWS
    for b in (b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows)):
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def scan_topk(questions: DataFrame, rows: DataFrame, scorer: Callable[[pa.Array], Dense | Sparse | Terms], k: int, score: str = "score", rank: str = "rank", block: int = MOST_QUESTIONS, *, pair: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``(question_id, key, score, rank)``: the best rows ``(key, value)`` of each
    question ``(question_id, value)``, exactly; ties: smaller key first.

    Questions may have ``top_k`` (how many of their own), ``doc_pk`` (only rows
    of that document; null asks all) and ``pool`` (only rows whose ``pools`` hold
    it; null asks all).  Rows then have ``doc_pk`` and ``pools``.  With ``pair``,
    the score of a question and a row as an expression (null is no hit), questions
    of one document are joined with its rows and leave the others alone.
    """
    spark, (qid, key) = rows.sparkSession, (questions.columns[0], rows.columns[0])
    ship(spark)
    limits = [c for c in ("doc_pk", "pool") if c in questions.columns]
    asks = questions.select(qid, questions.columns[1], *limits, *[c for c in ("top_k",) if c in questions.columns])
    given = rows.select(key, rows.columns[1], *[{"pool": "pools"}.get(c, c) for c in limits])
    kind_q, kind_k = (to_arrow_type(df.schema[c].dataType) for df, c in ((asks, qid), (given, key)))
    ddl = f"{qid} {asks.schema[qid].dataType.simpleString()}, {key} {given.schema[key].dataType.simpleString()}, {score} double"
    found = []
    if pair is not None and "doc_pk" in limits:
        found.append(own_rows(asks.where("doc_pk is not null"), given, pair, score))
        asks, given = asks.where("doc_pk is null").drop("doc_pk"), given.drop("doc_pk")
    blocks = math.ceil(asks.count() / block)
    ready = hasattr(rows, "_stored_at")
    if blocks > 1 and not ready:
        given, ready = stored(given), True
    of = getattr(scorer, "func", scorer)
    sizes = getattr(of, "rows_at_once", None), getattr(of, "bytes_at_once", BYTES)

    def searched(part: DataFrame, held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, least = held.value
            ids, keys, scores = score_rows(asked, gathered(batches, *sizes), scorer, k, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind_q), pa.array(keys, kind_k), pa.array(scores, pa.float64())], names=[qid, key, score])

        return stored(part.mapInArrow(run, ddl))

    # each task gives its best rows of every question, so there are no more tasks than cores can use
    cores = spark.sparkContext.defaultParallelism
    shares = [given.coalesce(2 * cores)]
    if blocks and ready and given.count() >= LEAST_ROWS:
        early = F.pmod(F.xxhash64(key), F.lit(SHARE)) == 0
        shares = [given.where(early).coalesce(cores), given.where(~early).coalesce(2 * cores)]
    for n in range(blocks or not found):
        part = asks.where(F.pmod(F.xxhash64(qid), F.lit(max(blocks, 1))) == n).toArrow()
        least = None
        for share in shares:
            held = spark.sparkContext.broadcast((part, least))
            found.append(searched(share, held))
            held.destroy()
            if share is not shares[-1]:
                least = reached(found[-1], part, k)
    most = questions.select(F.max("top_k")).first()[0] or 0 if "top_k" in questions.columns else k
    merged = reduce(DataFrame.unionByName, found).withColumnRenamed(qid, "question_id")
    top = best(merged, most, F.desc(score), F.col(key), rank=rank)
    if "top_k" in questions.columns:
        own = questions.select(F.col(qid).alias("question_id"), "top_k")
        top = top.join(own.hint("merge"), "question_id").where(F.col(rank) <= F.col("top_k")).drop("top_k")
    return top.withColumnRenamed("question_id", qid)


def reached(found: DataFrame, asked: pa.Table, k: int) -> np.ndarray:
    """The score of the last of the rows that each question of a block may have, out
    of those that were found for it: no worse row counts."""
    qid, key, score = found.columns
    ids = asked.column(0).to_pylist()
    own = dict(zip(ids, asked.column("top_k").to_pylist() if "top_k" in asked.column_names else [k] * len(ids)))
    most = max((n or 0 for n in own.values()), default=0)
    top = best(found.withColumnRenamed(qid, "question_id"), most, F.desc(score), F.col(key)).groupBy("question_id").agg(F.sort_array(F.collect_list(score), False).alias("scores")).toArrow()
    last = {q: s[own[q] - 1] for q, s in zip(top.column(0).to_pylist(), top.column(1).to_pylist()) if own[q] and len(s) >= own[q]}
    return np.array([last.get(q, np.finfo(float).min) for q in ids], float)


def own_rows(asks: DataFrame, given: DataFrame, pair: Callable[[Column, Column], Column], score: str) -> DataFrame:
    """Questions of one document with every row of it that is a hit."""
    (qid, value), (key, row) = asks.columns[:2], given.columns[:2]
    mine = asks.withColumnRenamed(value, "__asked").drop("top_k").hint("merge")
    both = given.join(mine, "doc_pk")
    if "pool" in asks.columns:
        both = both.where(F.col("pool").isNull() | F.coalesce(F.array_contains("pools", F.col("pool")), F.lit(False)))
    return both.select(qid, key, F.round(pair(F.col("__asked"), F.col(row)), 9).alias(score)).where(F.col(score).isNotNull())


def score_rows(asked: pa.Table, batches: Iterator[pa.RecordBatch], scorer, k: int, least: np.ndarray | None = None) -> tuple[list, list, list]:
    """Questions, keys and scores of the best rows of a task, without those under
    the ``least`` score of a question."""
    names = asked.column_names
    column = lambda c: asked.column(c).combine_chunks()
    ids = asked.column(0).to_pylist()
    by = scorer(column(names[1])) if ids else None
    docs = column("doc_pk").to_pylist() if "doc_pk" in names else None
    pools = column("pool").to_pylist() if "pool" in names else None
    top = Top([n or 0 for n in column("top_k").to_pylist()] if "top_k" in names else [k] * len(ids), least, bool(docs or pools))
    for b in batches if ids else ():
        b = b.sort_by(b.schema.names[0]) if getattr(by, "in_order", False) else b
        keys, rows = Keys(b.column(0).to_pylist()), by.rows(b.column(1))
        at_doc = places_of(enumerate([d] for d in b.column(b.schema.names.index("doc_pk")).to_pylist())) if docs else {}
        at_pool = places_of(enumerate(b.column(b.schema.names.index("pools")).to_pylist())) if pools else {}

        def allowed(q: np.ndarray | int, at: np.ndarray) -> np.ndarray:
            """Places of the pairs that the questions' limits let pass."""
            q, ok = np.broadcast_to(q, len(at)), np.ones(len(at), bool)
            for i in np.unique(q).tolist() if docs or pools else ():
                mine = np.flatnonzero(q == i)
                for wanted, where in ((docs, at_doc), (pools, at_pool)):
                    if wanted and wanted[i] is not None:
                        ok[mine] &= np.isin(at[mine], where.get(wanted[i], []))
            return np.flatnonzero(ok)

        for q, at, score in by.hits(rows, keys, top) if hasattr(by, "hits") else near_hits(by, rows, top, allowed):
            kept = allowed(q, at) if docs or pools else slice(None)
            top.add(q if np.ndim(q) == 0 else q[kept], at[kept], score[kept], keys)
        top.fold()
    return [ids[q] for q in top.q.tolist()], top.key.tolist(), top.score.tolist()


def near_hits(by: Dense | Sparse, rows, top: Top, allowed: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Questions, rows and scores that may be among the best, by products of matrices."""
    for lo in range(0, by.n, ASKED):
        hi = min(lo + ASKED, by.n)
        scores = by.scores(rows, lo, hi)
        bar = (np.maximum(top.least[lo:hi], by.floor) - by.margin).astype(scores.dtype)
        if by.floor >= 0:
            bar = np.maximum(bar, np.finfo(scores.dtype).smallest_subnormal)
        some = np.flatnonzero(scores.max(1, initial=-np.inf) >= bar)
        may = (scores if len(some) == len(scores) else scores[some]) >= bar[some][:, None]
        place = np.flatnonzero(may.ravel())
        i, at = np.divmod(place, may.shape[1])
        many = np.bincount(i, minlength=len(some)) > 4 * top.k[lo + some]
        few, kept = ~many[i], []
        for n in np.flatnonzero(many).tolist():
            # those that can't be among the first k of this batch alone
            own = np.flatnonzero(may[n])
            own, k = own[allowed(lo + some[n], own)], top.k[lo + some[n]]
            near = scores[some[n], own]
            if 0 < k < len(own):
                own = own[near >= np.partition(near, len(own) - k)[len(own) - k] - 2 * by.margin]
            kept.append((np.full(len(own), some[n]), own))
        q, at = (np.concatenate(x) for x in zip((some[i[few]], at[few]), *kept))
        score = by.exact(rows, lo + q, at, scores[q, at])
        hit = score > by.floor
        yield lo + q[hit], at[hit], score[hit]


def places_of(rows) -> dict[object, list[int]]:
    out: dict[object, list[int]] = {}
    for i, values in rows:
        for v in values or ():
            out.setdefault(v, []).append(i)
    return out
