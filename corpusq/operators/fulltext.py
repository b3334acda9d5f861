"""Full-text search: web-style questions over positional postings, by BM25.

A question is a list of alternatives (``or``); each is a list of parts that must
all hold.  A part is a word or a phrase, wanted or left out (``-``).  What stands
between quotes is a phrase, and so is a word that the index cuts into several
(``foo_bar``).  Words too common to search for vanish, but keep their place in a
phrase.  Words are not stemmed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.shared import ship, stored

from .scan import ASKED, BYTES, ROWS, Keys, Top, gathered, ranges, scan_topk

#: Rows of a table that is sent to the tasks, at most; a larger one is joined
MOST_ROWS = 200_000
#: Keys of hits that are sent to the tasks, at most; more are joined
MOST_HITS = 1_000_000
#: Questions of a pass, whose forms are Python objects in the tasks
MOST_PARSED = 16384
#: Words too common to search for.
STOP_WORDS = tuple("a an and are as at be but by for from if in into is it no not of on or such that the their then there these they this to was will with".split())
WORD = r"[\p{L}\p{N}]+"

_PART = pa.struct([("minus", pa.bool_()), ("words", pa.list_(pa.struct([("term", pa.string()), ("place", pa.int32())])))])
_TREE = "array<array<struct<minus: boolean, words: array<struct<term: string, place: int>>>>>"


def small_or_merged(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """A stored table with the join hint that its number of rows calls for."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def of_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored hits with the columns of their chunks.  If they are many, chunks that
    are no hits are left out before anything is sorted."""
    if hits.count() <= MOST_ROWS:
        return chunks.join(F.broadcast(hits), "chunk_id")
    met = small_or_merged(stored(hits.select("chunk_id").distinct()), MOST_HITS)
    return chunks.join(met, "chunk_id", "left_semi").join(hits.hint("merge"), "chunk_id")


def question_words(text: str) -> list[str]:
    """Words as the index cuts them: runs of letters and digits."""
    return re.findall(r"[^\W_]+", text)


def parse_web_query(text: str) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """Alternatives of parts ``(minus, [(word, place), ...])``, from a question in
    lower case; places count from a part's first word that is not a stop word."""
    out: list[list] = [[]]
    for minus, phrase, minus_word, word in re.findall(r'(-?)"([^"]*)"|(-?)(\S+)', text):
        if word == "or" and not minus_word:
            out.append([])
            continue
        kept = [(w, n) for n, w in enumerate(question_words(phrase or word)) if w not in STOP_WORDS]
        part = (bool(minus or minus_word), [(w, n - kept[0][1]) for w, n in kept])
        if kept and part not in out[-1]:
            out[-1].append(part)
    return [a for n, a in enumerate(out) if a and a not in out[:n]]


def parsed_questions(questions: DataFrame) -> DataFrame:
    """``(question_id, tree)``: the alternatives of each question, none for one
    without a word to search for."""
    ship(questions.sparkSession)
    asked = questions.select("question_id", F.lower(F.coalesce("question", F.lit(""))).alias("question"))
    kind = asked.schema["question_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = lambda part: {"minus": part[0], "words": [{"term": w, "place": n} for w, n in part[1]]}
        for b in batches:
            trees = [[[shape(p) for p in a] for a in parse_web_query(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, pa.list_(pa.list_(_PART)))], names=["question_id", "tree"])

    return asked.mapInArrow(run, f"question_id {kind}, tree {_TREE}")


class Web:
    """Scores of chunks, given as their words, for parsed questions.

    Words that some question asks for become postings with their places, by
    term, for a batch of chunks at once.  The largest share of each term in the
    batch bounds what a question can get there.  A question that has its best so
    far reads the postings of its rarer terms alone, those without which no chunk
    can reach it; what may reach it is scored by all its terms.  A chunk for which
    no alternative holds is no hit.
    """

    rows_at_once, bytes_at_once, in_order = 1 << 14, 64 << 20, True

    def __init__(self, asked: pa.Array, mean: float, k1: float, b: float):
        self.mean, self.k1, self.b = mean, k1, b
        # questions, their alternatives, their parts, their words
        trees, weights = asked.field("tree"), asked.field("weights")
        alternatives = trees.flatten()
        parts = alternatives.flatten()
        words = parts.field("words").flatten()
        coded = words.field("term").dictionary_encode()
        spots = list(zip(coded.indices.to_pylist(), words.field("place").to_pylist()))
        each = list(zip(parts.field("minus").to_pylist(), map(tuple, cut(spots, parts.field("words")))))
        every = cut(cut(each, alternatives), trees)
        # any of several words: every chunk with one of them is a hit
        self.trees = [None if all(len(a) == 1 and not a[0][0] and len(a[0][1]) == 1 for a in tree) else tree for tree in every]
        self.leaves_out = np.array([any(all(minus for minus, _ in a) for a in tree) for tree in every], bool)
        self.count, self.known = len(coded.dictionary), pa.array([*coded.dictionary.to_pylist(), *STOP_WORDS], pa.string())
        # the words that count for the score, the rarest of a question last; a word weighs the same in all
        sizes = lengths(weights)
        given, question = weights.flatten(), np.repeat(np.arange(len(sizes)), sizes)
        of = pc.index_in(given.field("term"), value_set=coded.dictionary).to_numpy().astype(np.int64)
        self.idf = np.zeros(self.count)
        self.idf[of] = given.field("idf").to_numpy()
        self.of, self.question, self.stops = of[np.lexsort((self.idf[of], question))], question, np.append(0, np.cumsum(sizes))
        self.mine = np.zeros(self.count)

    def rows(self, column: pa.Array) -> Postings:
        sizes = lengths(column)
        term = pc.index_in(column.flatten(), value_set=self.known).fill_null(-1).to_numpy()
        known = np.flatnonzero(term >= 0)
        term, stops = term[known], np.cumsum(sizes)
        row = np.searchsorted(stops, known, side="right")
        length = sizes - np.bincount(row[term >= self.count], minlength=len(sizes))
        asked = np.flatnonzero(term < self.count)
        term, row, known = term[asked], row[asked], known[asked]
        return Postings(term, row, known - (stops - sizes)[row], length, self)

    def hits(self, rows: Postings, keys: Keys, top: Top) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Questions with their hits, which are in the order of their keys.  Those
        that can't reach the best so far, whatever the words of these chunks, are
        passed over."""
        most = rows.most[self.of]
        sums = np.append(0, np.cumsum(most))
        bound = sums[self.stops[1:]] - sums[self.stops[:-1]]
        slack = 1e-9 * (1 + bound) + np.diff(self.stops) * np.finfo(float).eps * sums[-1]
        # the first terms of a question that don't reach its best even together
        below = sums[1:] - sums[self.stops[self.question]] < (top.least - slack)[self.question]
        idle = np.append(0, np.cumsum(below))
        idle = idle[self.stops[1:]] - idle[self.stops[:-1]]
        rest = sums[self.stops[:-1] + idle] - sums[self.stops[:-1]]
        # no word of the question stands here: chunks that it does not leave out, if there is no better
        plain = np.diff(np.append(0, np.cumsum(most > 0))[self.stops]) == 0
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q in np.flatnonzero((bound + slack >= top.least) & (~plain | (self.leaves_out & (top.least <= 0))) & (top.k > 0)).tolist():
            if plain[q]:
                if top.held[q] >= top.k[q] and keys.first > top.last(q):
                    continue
                at = rows.first_held(self.trees[q], rows.n if top.limited else int(top.k[q]))
                score = np.zeros(len(at))
            else:
                at, score = self.found(rows, q, top.least[q], slack[q], int(idle[q]), rest[q])
            if len(at) > top.k[q] and not top.limited:
                score = np.round(score, 9)
                near = np.flatnonzero(score >= np.partition(score, len(score) - top.k[q])[len(score) - top.k[q]])
                first = near[np.argsort(-score[near], kind="stable")[: top.k[q]]]
                at, score = at[first], score[first]
            if len(at):
                waiting.append((q, at, score))
            if len(waiting) == ASKED:
                yield joined(waiting)
                waiting = []
        if waiting:
            yield joined(waiting)

    def found(self, rows: Postings, q: int, least: float, slack: float, idle: int, rest: float) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that may be among the best of a question, in order, and their scores."""
        terms, tree, bar = self.of[self.stops[q] : self.stops[q + 1]], self.trees[q], least - slack
        size = rows.size(terms)
        if tree is not None and (least <= 0 or rows.at_most(tree) <= size):
            at = rows.held(tree)
            score = self.of_rows(rows, at, terms, size) if len(at) else np.zeros(0)
            kept = score >= bar
            return at[kept], score[kept]
        if idle and 4 * rows.size(terms[idle:]) < size:
            at, score = rows.scored(terms[idle:], bar - rest)
            score = self.of_rows(rows, at, terms, size)
            kept = score >= bar
            at, score = at[kept], score[kept]
        else:
            at, score = rows.scored(terms, bar)
        if tree is not None and len(at):
            kept = rows.holds(tree, at)
            at, score = at[kept], score[kept]
        return at, score

    def of_rows(self, rows: Postings, at: np.ndarray, terms: np.ndarray, size: int) -> np.ndarray:
        """Scores of some chunks by terms, which have ``size`` postings."""
        starts = rows.own_starts[at]
        sizes = rows.own_starts[at + 1] - starts
        if 4 * sizes.sum() > size + rows.n // 4:
            return rows.totals(terms)[at]
        self.mine[terms] = 1
        own = ranges(starts, sizes)
        out = np.bincount(np.repeat(np.arange(len(at)), sizes), self.mine[rows.own_term[own]] * rows.own_share[own], len(at))
        self.mine[terms] = 0
        return out


def lengths(column: pa.Array) -> np.ndarray:
    """Of lists; null: 0."""
    return pc.list_value_length(column).fill_null(0).to_numpy()


def cut(values: list, column: pa.Array) -> list[list]:
    """Values that stand for those of a column of lists, in their lists."""
    stops = np.cumsum(lengths(column)).tolist()
    return [values[lo:hi] for lo, hi in zip([0, *stops], stops)]


def joined(hits: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, at, score = zip(*hits)
    return np.repeat(q, [len(x) for x in at]), np.concatenate(at), np.concatenate(score)


class Postings:
    """Where the asked terms stand in a batch of ``n`` chunks."""

    def __init__(self, term: np.ndarray, row: np.ndarray, place: np.ndarray, length: np.ndarray, by: Web):
        self.n, terms = len(length), by.count
        order = np.sort((term.astype(np.int64) << 32) + np.arange(len(term))) & 0xFFFFFFFF
        term, row = term[order], row[order]
        self.spot, self.starts = (row << 40) + place[order], np.searchsorted(term, np.arange(terms + 1))
        # one entry for each term and chunk: how often, and its share of the score
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
        tf = np.diff(np.append(new, len(order)))
        once = term[new]
        self.once, self.once_starts = row[new], np.searchsorted(once, np.arange(terms + 1))
        self.share = by.idf[once] * tf * (by.k1 + 1) / (tf + by.k1 * (1 - by.b + by.b * length[self.once] / by.mean))
        # the largest share of each term
        self.most, some = np.zeros(terms), np.flatnonzero(np.diff(self.once_starts))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.share, self.once_starts[some])
        # the same entries by chunk
        by_row = np.sort((self.once << 32) + np.arange(len(new))) & 0xFFFFFFFF
        self.own_term, self.own_share = once[by_row], self.share[by_row]
        self.own_starts = np.append(0, np.cumsum(np.bincount(self.once, minlength=self.n)))
        self.parts: dict[tuple, np.ndarray] = {}

    def size(self, terms: np.ndarray) -> int:
        return int((self.once_starts[terms + 1] - self.once_starts[terms]).sum())

    def totals(self, terms: np.ndarray) -> np.ndarray:
        """Scores of all chunks by terms."""
        own = [slice(lo, hi) for lo, hi in zip(self.once_starts[terms].tolist(), self.once_starts[terms + 1].tolist())]
        return np.bincount(np.concatenate([self.once[x] for x in own]), np.concatenate([self.share[x] for x in own]), self.n)

    def scored(self, terms: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
        """Chunks with one of the terms whose scores by them reach a bar, in order, and the scores."""
        if len(terms) == 1:
            own = slice(self.once_starts[terms[0]], self.once_starts[terms[0] + 1])
            at, score = self.once[own], self.share[own]
            kept = score >= bar
            return at[kept], score[kept]
        score = self.totals(terms)
        at = np.flatnonzero(score >= bar if bar > 0 else score > 0)
        return at, score[at]

    def at_most(self, tree: list[list[tuple[bool, tuple]]]) -> int:
        """No more chunks than that hold an alternative."""
        size = lambda t: self.once_starts[t + 1] - self.once_starts[t]
        return sum(min((size(t) for minus, words in a if not minus for t, _ in words), default=self.n) for a in tree)

    def held(self, tree: list[list[tuple[bool, tuple]]]) -> np.ndarray:
        """Chunks for which an alternative holds."""
        found = []
        for alternative in tree:
            wanted = sorted((self.part(words) for minus, words in alternative if not minus), key=len)
            here = wanted[0] if wanted else np.arange(self.n)
            for minus, other in [(False, x) for x in wanted[1:]] + [(True, self.part(words)) for minus, words in alternative if minus]:
                if len(here) and (len(other) or not minus):
                    here = here[self.among(other, here) != minus]
            found.append(here)
        if len(found) == 1:
            return found[0]
        flag = np.zeros(self.n, bool)
        for here in found:
            flag[here] = True
        return np.flatnonzero(flag)

    def holds(self, tree: list[list[tuple[bool, tuple]]], at: np.ndarray) -> np.ndarray:
        """Whether an alternative holds, for some chunks in order."""
        out = np.zeros(len(at), bool)
        for alternative in tree:
            here = np.ones(len(at), bool)
            for minus, words in sorted(alternative, key=lambda p: len(p[1])):
                if here.any():
                    here &= self.among(self.part(words), at) != minus
            out |= here
        return out

    def first_held(self, tree: list[list[tuple[bool, tuple]]], k: int) -> np.ndarray:
        """The first k chunks for which an alternative holds that has nothing but words left out."""
        alone = [a for a in tree if all(minus for minus, _ in a)]
        n = 8 * k
        while True:
            at = np.arange(min(n, self.n))
            at = at[self.holds(alone, at)]
            if len(at) >= k or n >= self.n:
                return at[:k]
            n *= 8

    def among(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which chunks of ``at`` are in ``rows``; both are in order."""
        if 8 * len(at) > len(rows):
            flag = np.zeros(self.n, bool)
            flag[rows] = True
            return flag[at]
        place = np.searchsorted(rows, at)
        return rows[np.minimum(place, len(rows) - 1)] == at

    def part(self, words: tuple[tuple[int, int], ...]) -> np.ndarray:
        """The chunks that hold the words at their places to each other."""
        if len(words) == 1:
            return self.once[self.once_starts[words[0][0]] : self.once_starts[words[0][0] + 1]]
        if words not in self.parts:
            starts = None
            for t, off in sorted(words, key=lambda w: self.starts[w[0] + 1] - self.starts[w[0]]):
                here = self.spot[self.starts[t] : self.starts[t + 1]]
                if starts is None:
                    starts = here - off
                elif len(here):
                    place = np.searchsorted(here, starts + off)
                    starts = starts[here[np.minimum(place, len(here) - 1)] == starts + off]
                else:
                    starts = here
                if not len(starts):
                    break
            # a phrase that would begin before the text borders on the row before
            rows = (starts + (1 << 20)) >> 40
            self.parts[words] = rows[np.diff(rows, prepend=-1) > 0]
        return self.parts[words]


def counted(words: DataFrame) -> DataFrame:
    """``(term, df, total, kept, some)``: for some chunks at once, in how many of
    them each word stands; without a term: how many they are, how many of their
    words are searched for, and how many chunks have such words."""
    ship(words.sparkSession)
    names = ["term", "df", "total", "kept", "some"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = pa.array(STOP_WORDS, pa.string())
        for b in gathered(batches, 2 * ROWS, 4 * BYTES):
            column, sizes = b.column(0), lengths(b.column(0))
            coded = column.flatten().dictionary_encode()
            code, row, n = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), len(coded.dictionary)
            common = pc.is_in(coded.dictionary, value_set=stops).to_numpy(zero_copy_only=False)
            kept = sizes - np.bincount(row[common[code]], minlength=len(sizes))
            pairs = np.sort(code * len(sizes) + row)
            df = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] // max(len(sizes), 1), minlength=n)
            none = np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df), *[pa.array(none)] * 3], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *(pa.array([int(x)]) for x in (0, len(sizes), kept.sum(), (kept > 0).sum()))], names=names)

    return words.select("words").mapInArrow(run, "term string, df long, total long, kept long, some long")


def fulltext_search(questions: DataFrame, chunks: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(question_id, chunk_id, score, rank, fulltext_score)``: chunks for which
    an alternative of the question holds, by BM25 over all words it wants, and
    that over the question's best.  Ties: smaller chunk id first.

    Texts are cut into words once.  One pass over these counts the chunks of each
    asked word, another scores all questions (see ``scan_topk``).  An alternative that only leaves out holds for every
    chunk without its words; its chunks score by the other words of the question.
    Chunks without text are passed over.
    """
    parsed = stored(parsed_questions(questions))
    wanted = F.flatten(F.transform("tree", lambda a: F.flatten(F.transform(F.filter(a, lambda p: ~p["minus"]), lambda p: F.transform(p["words"], lambda w: w["term"])))))
    asked = stored(parsed.select("question_id", F.explode(F.array_distinct(wanted)).alias("term")))
    words = stored(chunks.where("text is not null").select("chunk_id", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words")))
    counts = stored(counted(words))
    df = counts.where("term is not null").join(small_or_merged(stored(asked.select("term").distinct())), "term").groupBy("term").agg(F.sum("df").alias("df"))
    # one row: corpus size and mean length
    total, kept, some = counts.where("term is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "kept", "some")]).first()
    idf = F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df.hint("merge"), "term").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("weights"))
    ready = parsed.where("size(tree) > 0").join(weights.hint("merge"), "question_id", "left").select("question_id", F.struct("tree", "weights").alias("value"))
    top = scan_topk(stored(ready), words, partial(Web, mean=kept / some if some else 1.0, k1=k1, b=b), k, block=MOST_PARSED)
    most = F.max("score").over(Window.partitionBy("question_id"))
    return top.withColumn("fulltext_score", F.when(most > 0, F.col("score") / most).otherwise(0.0))
