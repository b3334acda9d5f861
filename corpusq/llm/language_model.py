"""Log-likelihood of whole documents by a gated recurrent language model.

Tokens are words (A-Z lower-cased, cut at ASCII white space) and one end for
each document.  Word counts cover the whole learning share.  The output layer is
factored: a class first, then the word in its class.  The ``VOCABULARY`` most
frequent words stand in classes of ``CLASS`` by frequency rank, with a softmax
of their own; the other words stand in classes by their last two letters, and
within these by add-one relative frequency, so that every word, seen or not, has
a probability.

The recurrent weights are trained by truncated backpropagation on the whole
learning share, one pass of it dealt over ``ROUNDS`` rounds.  In a round every
partition goes on from the same weights over its own documents of that round;
then the weights are averaged by tokens.  What a task returns and what the
driver holds has a fixed size.  The weights depend on how the rows are
partitioned, not on the order in which tasks end.  Scoring carries the state
across windows from a document's first token to its last.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, pieces, quoted, stored

#: Words whose count every task holds; the others' counts are joined
HEAD = 200_000
VOCABULARY, CLASS, ENDINGS = 8192, 64, 64
UNITS, WINDOW, LANES, BLOCK = 32, 16, 384, 512
#: Windows whose symbols are laid out at once for scoring; rows of a symbol, at most, that are added for all symbols at once
AHEAD, FEW = 32, 5
#: Where the rounds of training end, in shares of the documents
ROUNDS = (1 / 16, 6 / 16, 1)
FIT_WINDOW, FIT_LANES, MOST_LANES, RATE, SEED = 24, 48, 384, 0.1, 3
#: Tokens trained on together in a task, about; floats in a row of averaged weights
FIT_POOL, ROW = 1_000_000, 8192
#: Tokens of a partition in a round of training, about, at least: smaller ones are put together
FIT_LEAST = 500_000
#: Tokens scored together in a task, about
POOL = 3_000_000
END = "\n"
#: No weight and bias of the output grows beyond this, so that no exponential overflows
MOST, MOST_BIAS = 3.5, 25


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


#: Bytes of text coded at once, about
PIECE = 4_000_000

_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
_white = np.zeros(256, bool)
_white[np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8)] = True


def cut_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of an Arrow array of texts without nulls, one after the other,
    and for each text, and the end, how many words stand before it."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    low = _lower[np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]]
    edges, white = edges - edges[0], _white[low]
    first = np.zeros(len(low) + 1, bool)
    first[edges] = True
    first[1:] |= white
    start = np.flatnonzero(~white & first[:-1])
    first[:-1] |= white
    stop = np.flatnonzero(~white & first[1:]) + 1
    kept = low[~white]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(stop - start))), pa.py_buffer(kept)])
    return words, np.searchsorted(start, edges)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, c)`` over all rows, and the number of rows under the word ``END``."""
    src = docs.select(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            for a in range(0, len(seen), 100_000):
                some = items[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "c"])

        for b in batches:
            for part in pieces(b):
                for t in part.column(0).to_pylist():
                    seen.update(words_of(t))
                seen[END.encode()] += part.num_rows
            if len(seen) > 600_000:
                items = list(seen.items())
                yield from flush()
                seen.clear()
        items = list(seen.items())
        yield from flush()

    return src.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Counts and classes of the words that every task holds."""

    def __init__(self, words: list[str], counts: np.ndarray, total: int, kinds: int, endings: list[tuple[str, int, int]]):
        """``words`` by rank, ``END`` first; ``total`` tokens and ``kinds`` of
        them in all; ``endings``: (letters, tokens, kinds) of the words beyond
        the vocabulary, the last for all other endings."""
        self.rank = {w.encode(): i for i, w in enumerate(words)}
        self.count = counts
        self.total, self.kinds = total, kinds
        self.vocabulary = min(VOCABULARY, len(words))
        self.classes = -(-self.vocabulary // CLASS)
        self.ending = {x[0]: i for i, x in enumerate(endings[:-1])}
        self.leaf = np.log10(np.array([n + v + 1 for _, n, v in endings], float))
        self.mass = np.array([n + 1 for _, n, _ in endings], float)
        other = len(endings) - 1
        self.of_rank = np.array([i if i < self.vocabulary else self.vocabulary + self.ending.get(w[-2:], other) for i, w in enumerate(words)], np.int64)
        self.base = np.log10(total + kinds + 1)
        self.log_count = np.log10(counts + 1.0)

    def symbol(self, word: bytes) -> int:
        """Model symbol of a word that no task holds."""
        return self.vocabulary + self.ending.get(word.decode()[-2:], len(self.leaf) - 1)


def most_frequent(counts: DataFrame, head: int) -> list[tuple[str, int]]:
    """``END`` and the most frequent words, at most ``head`` in all, by frequency.

    A long list is drawn by classes of nearly equal counts, so that no task gets
    the longest lists of all others: whole classes from the top, and of the class
    that does not fit the words with the lowest hashes.
    """
    order = [(F.col("word") != END).cast("int"), F.desc("c"), "word"]
    if head <= VOCABULARY:
        return [(r.word, r.c) for r in counts.orderBy(*order).limit(head).collect()]
    words, near = counts.where(F.col("word") != END), F.floor(F.log2("c") * 64)
    left, last, size = head - 1, -1, 0
    # at most 64 classes for each power of two
    for r in sorted(words.groupBy(near.alias("k")).count().collect(), key=lambda r: -r.k):
        if r["count"] > left:
            last, size = r.k, r["count"]
            break
        left -= r["count"]
    parts = [counts.where(F.col("word") == END), words.where(near > last)]
    if size:
        parts.append(lowest(words.where(near == last), "word", limit=left, total=size))
    found = [(w, c) for p in parts for t in [p.select("word", "c").toArrow()] for w, c in zip(t.column(0).to_pylist(), t.column(1).to_pylist())]
    return sorted(found, key=lambda x: (x[0] != END, -x[1], x[0]))


def learn_lexicon(counts: DataFrame, head: int = HEAD) -> Lexicon:
    """Gather what is bounded from stored ``counts``: the head and the endings."""
    ranked = most_frequent(counts, head) or [(END, 0)]
    words, c = [w for w, _ in ranked], np.array([n for _, n in ranked], np.int64)
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    k = min(VOCABULARY, len(words))
    last = F.struct(F.lit(int(c[k - 1])).alias("c"), F.lit(words[k - 1]).alias("w"))
    beyond = counts.where((F.col("word") != END) & ((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > last["w"]))))
    by = beyond.groupBy(F.right("word", F.lit(2)).alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    top = by.orderBy(F.desc("n"), "e").limit(ENDINGS - 1).collect()
    n, v = int(total - c[:k].sum()), int(kinds - (k if kinds else 0))
    ends = [(r.e, r.n, r.v) for r in top]
    ends.append(("", n - sum(x[1] for x in ends), v - sum(x[2] for x in ends)))
    return Lexicon(words, c, int(total), int(kinds), ends)


class Model:
    """A gated recurrent network over symbols, with a class-factored softmax.

    The last row of ``w`` and of each class's ``v`` is its bias: states carry a 1.
    """

    def __init__(self, lexicon: Lexicon):
        rng = np.random.default_rng(SEED)
        n, k, c = lexicon.vocabulary, UNITS, lexicon.classes
        symbols = n + len(lexicon.leaf)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.x = normal(symbols, 3 * k, scale=0.1)  # gates' input by symbol: keep, reset, new
        self.u = normal(k, 3 * k, scale=1 / np.sqrt(k))
        self.b = np.zeros(3 * k, np.float32)
        self.b[:k] = 1
        self.w = normal(k + 1, c + len(lexicon.leaf), scale=0.01)
        mass = np.zeros(c * CLASS)
        mass[:n] = lexicon.count[:n] + 1.0
        bias = np.log(np.concatenate([mass.reshape(c, CLASS).sum(1), lexicon.mass]))
        self.w[k] = bias - np.log(np.exp(bias).sum())
        self.v = normal(c, k + 1, CLASS, scale=0.01)
        with np.errstate(divide="ignore"):
            self.v[:, k] = np.maximum(np.log(mass.reshape(c, CLASS) / mass.reshape(c, CLASS).sum(1, keepdims=True)), -MOST_BIAS)
        self.n, self.classes = n, c

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < self.n, symbol // CLASS, self.classes + symbol - self.n).astype(np.uint8)

    def states(self, given: np.ndarray, h: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (with a 1) after each row of ``given`` symbols, from ``h`` on, as
        rows in order; and the last ones.  ``kept`` gets what going back needs.

        Each gate is an array of its own, a row for each lane, so that no step
        goes over parts of rows.
        """
        k, (width, lanes) = UNITS, given.shape
        gain = self.x.take(given.ravel(), axis=0)
        gain += self.b
        gain = np.ascontiguousarray(gain.reshape(width, lanes, 3, k).transpose(0, 2, 1, 3))
        u, ends = by_gate(self.u), given == 0
        ended, out = ends.any(1).tolist(), np.empty((width, lanes, k), np.float32)
        for t in range(width):
            before = h
            if ended[t]:  # an end forgets the document
                before = h.copy()
                before[ends[t]] = 0
            hu, zr, new = before @ u, gain[t, :2], gain[t, 2]
            zr += hu[:2]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr
            h = np.multiply(r, hu[2], out=out[t])
            new += h
            # tanh by the exponential, which is faster
            new *= 2
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
            np.subtract(before, new, out=h)
            h *= z
            h += new
            if kept is not None:
                kept.append((z, r, new, hu[2], before))
        flat = np.ones((width, lanes, k + 1), np.float32)
        flat[:, :, :k] = out
        return flat.reshape(-1, k + 1), h

    def by_class(self, cls: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Rows in order of their class, and where each class of words begins."""
        order = np.argsort(cls, kind="stable")
        return order, np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()

    def log10(self, h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of each symbol's class and of its place in it, given states.
        Rows go in blocks that stay in the processor's cache."""
        cls, ones = self.class_of(symbol), np.ones(max(CLASS, self.w.shape[1]), np.float32)
        out = np.empty(len(h), np.float32)
        for a in range(0, len(h), BLOCK):
            logits = h[a : a + BLOCK] @ self.w
            own = logits[np.arange(len(logits)), cls[a : a + BLOCK]]
            np.exp(logits, out=logits)
            out[a : a + BLOCK] = own - np.log(logits @ ones[: self.w.shape[1]])
        order, edge = self.by_class(cls)
        order = order[: edge[-1]]
        grouped, places = h[order], symbol[order] % CLASS
        found = np.empty(len(order), np.float32)
        for c in range(self.classes):
            a, b = edge[c], edge[c + 1]
            if a < b:
                inner = grouped[a:b] @ self.v[c]
                own = inner[np.arange(b - a), places[a:b]]
                np.exp(inner, out=inner)
                found[a:b] = own - np.log(inner @ ones[:CLASS])
        out[order] += found
        return out.astype(np.float64) / np.log(10)

    def score(self, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
        """log10 likelihood of each document's symbols (the end is the last)."""
        total = np.zeros(len(docs))
        if not docs:
            return total
        # longest first, each to the lane with the least in it
        lanes = min(lanes, len(docs))
        heap = [(0, i) for i in range(lanes)]
        rows: list[list[int]] = [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            size, i = heapq.heappop(heap)
            rows[i].append(d)
            heapq.heappush(heap, (size + len(docs[d]), i))
        rows = sorted(rows, key=lambda r: -sum(len(docs[d]) for d in r))
        line = [np.concatenate([docs[d] for d in r]) for r in rows]
        owner = [np.repeat(np.array(r, np.int32), [len(docs[d]) for d in r]) for r in rows]
        sizes = np.array([len(x) for x in line])
        h, last = np.zeros((lanes, UNITS), np.float32), np.zeros(lanes, np.int16)
        for start in range(0, int(sizes[0]), window):
            live = int(np.searchsorted(-sizes, -start))
            h, last = h[:live], last[:live]
            if start % (window * AHEAD) == 0:
                begin, width = start, min(window * AHEAD, int(sizes[0]) - start)
                symbols, owners = np.zeros((live, width), np.int16), np.full((live, width), -1, np.int32)
                for i in range(live):
                    part = line[i][start : start + width]
                    symbols[i, : len(part)], owners[i, : len(part)] = part, owner[i][start : start + width]
            at = slice(start - begin, start - begin + window)
            symbol, mine = symbols[:live, at], owners[:live, at]
            given = np.concatenate([last[None], symbol.T[:-1]])
            flat, h = self.states(given, h)
            last, who, wanted = symbol[:, -1], mine.T.ravel(), symbol.T.ravel()
            real = who >= 0
            if not real.all():
                who, wanted, flat = who[real], wanted[real], flat[real]
            total += np.bincount(who, self.log10(flat, wanted), len(docs))
        return total

    def fresh(self) -> dict[str, np.ndarray]:
        """Sums of squared gradients before any step: one for each symbol's
        input, else one for each weight."""
        return {n: np.full((len(self.x), 1) if n == "x" else getattr(self, n).shape, 1e-2, np.float32) for n in WEIGHTS}

    def fit(self, stream: np.ndarray, lanes: int = FIT_LANES, window: int = FIT_WINDOW, seen: dict[str, np.ndarray] | None = None) -> None:
        """Truncated backpropagation over one pass of a stream of documents.
        Each symbol after the first is predicted once.  ``seen`` is carried on."""
        size = len(stream) - 1
        if size < 1:
            return
        seen = self.fresh() if seen is None else seen
        lanes = max(1, min(lanes, size // window))
        length = -(-size // lanes)
        grid = np.zeros((2, lanes * length), np.int16)
        grid[0, :size], grid[1, :size] = stream[:-1], stream[1:]
        grid = np.ascontiguousarray(grid.reshape(2, lanes, length).transpose(0, 2, 1))
        real = (np.arange(lanes * length) < size).reshape(lanes, length).T
        k, scale, ones = UNITS, np.float32(1 / lanes), np.ones(max(CLASS, self.w.shape[1]), np.float32)

        def move(p, s, g):
            np.clip(g, -1, 1, out=g)
            part = g * g
            s += part
            np.sqrt(s, out=part)
            g *= RATE
            g /= part
            p -= g

        def move_output(p, s, g):
            move(p, s, g)
            np.clip(p[..., :k, :], -MOST, MOST, out=p[..., :k, :])
            np.clip(p[..., k, :], -MOST_BIAS, MOST_BIAS, out=p[..., k, :])

        h = np.zeros((lanes, k), np.float32)
        for start in range(0, length, window):
            given, wanted = grid[:, start : start + window]
            width, kept = len(given), []
            flat, h = self.states(given, h, kept)
            symbol, live = wanted.ravel(), real[start : start + window].ravel()
            cls = self.class_of(symbol)
            if not live.all():
                cls[~live] = len(self.w[0])
            dh, dw, out = np.empty((len(flat), k), np.float32), np.zeros(self.w.shape[::-1], np.float32), np.ascontiguousarray(self.w[:k].T)
            for i in range(0, len(flat), BLOCK):
                part, own = flat[i : i + BLOCK], cls[i : i + BLOCK]
                p = part @ self.w
                np.exp(p, out=p)
                p *= (scale / (p @ ones[: p.shape[1]]))[:, None]
                if live[i : i + BLOCK].all():
                    p[np.arange(len(p)), own] -= scale
                else:
                    at = np.flatnonzero(live[i : i + BLOCK])
                    p[at, own[at]] -= scale
                    p[~live[i : i + BLOCK]] = 0
                np.matmul(p, out, out=dh[i : i + BLOCK])
                dw += p.T @ part
            order, edge = self.by_class(cls)
            order = order[: edge[-1]]
            grouped, places, inner = flat[order], symbol[order] % CLASS, np.empty((len(order), k), np.float32)
            dv = np.zeros_like(self.v)
            for c in range(self.classes):
                i, j = edge[c], edge[c + 1]
                if i < j:
                    q = grouped[i:j] @ self.v[c]
                    np.exp(q, out=q)
                    q *= (scale / (q @ ones[:CLASS]))[:, None]
                    q[np.arange(j - i), places[i:j]] -= scale
                    np.matmul(q, self.v[c, :k].T, out=inner[i:j])
                    np.matmul(grouped[i:j].T, q, out=dv[c])
            dh[order] += inner
            move_output(self.w, seen["w"], dw.T)
            move_output(self.v, seen["v"], dv)
            self.back(given, kept, dh.reshape(width, lanes, k), seen, move)

    def back(self, given: np.ndarray, kept: list, dh: np.ndarray, seen: dict[str, np.ndarray], move) -> None:
        """Gradients of the recurrent weights and inputs, from those of the states."""
        k, (width, lanes) = UNITS, given.shape
        gate, over, part = np.empty((4, width, lanes, k), np.float32), np.zeros((lanes, k), np.float32), np.empty((lanes, k), np.float32)
        ends, u = given == 0, np.ascontiguousarray(by_gate(self.u).transpose(0, 2, 1))
        ended, all_before = ends.any(1).tolist(), np.empty((width, lanes, k), np.float32)
        for t in range(width - 1, -1, -1):
            z, r, new, hu, before = kept[t]
            over += dh[t]
            gz, gr, reach, dn = gate[:, t]  # reach: what gets to the recurrent part of new
            np.subtract(1, z, out=part)
            np.multiply(over, part, out=dn)
            part *= z
            np.subtract(before, new, out=gz)
            gz *= over
            gz *= part
            np.multiply(new, new, out=part)
            np.subtract(1, part, out=part)
            dn *= part
            np.subtract(1, r, out=part)
            part *= r
            np.multiply(dn, hu, out=gr)
            gr *= part
            np.multiply(dn, r, out=reach)
            all_before[t] = before
            over *= z
            for g, v in zip((gz, gr, reach), u):
                over += np.matmul(g, v, out=part)
            if ended[t]:
                over[ends[t]] = 0
        flat, gate = given.ravel(), gate.reshape(4, -1, k)
        du = np.concatenate(all_before.reshape(-1, k).T @ gate[:3], axis=1)
        dx = np.concatenate((gate[0], gate[1], gate[3]), axis=1)
        order = np.argsort(flat, kind="stable")
        ordered, dx_in_order = flat[order], dx.take(order, axis=0)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows, gx = ordered[first], sums_of_runs(dx_in_order, first)
        np.clip(gx, -1, 1, out=gx)
        move(self.u, seen["u"], du)
        move(self.b, seen["b"], dx.sum(0))
        seen["x"][rows] += (gx * gx).mean(1, keepdims=True)
        self.x[rows] -= RATE * gx / np.sqrt(seen["x"][rows])


def by_gate(u: np.ndarray) -> np.ndarray:
    """Recurrent weights as a matrix for each gate."""
    return np.ascontiguousarray(u.reshape(UNITS, 3, UNITS).transpose(1, 0, 2))


def sums_of_runs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; a run begins at each of ``first``.  Short runs
    are added row by row for all of them, long ones each on its own."""
    n = np.diff(np.append(first, len(rows)))
    out = rows.take(first, axis=0)
    short = np.flatnonzero((n > 1) & (n <= FEW))
    for j in range(1, FEW):
        short = short[n[short] > j]
        out[short] += rows.take(first[short] + j, axis=0)
    for i in np.flatnonzero(n > FEW).tolist():
        np.add.reduce(rows[first[i] : first[i] + n[i]], axis=0, out=out[i])
    return out


WEIGHTS = ("x", "u", "b", "w", "v")


def flat_weights(m: Model, seen: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x[n].ravel() for x in (vars(m), seen) for n in WEIGHTS])


def put_weights(m: Model, seen: dict[str, np.ndarray], flat: np.ndarray) -> None:
    at = 0
    for box in (vars(m), seen):
        for n in WEIGHTS:
            size = box[n].size
            box[n] = flat[at : at + size].reshape(box[n].shape).astype(np.float32)
            at += size


def code_documents(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Every text as the model's symbols, written out: ``kept`` (a struct of the
    ``keep`` columns, so no name can clash), ``symbols`` (16-bit integers, the end
    last), ``tokens``, ``known``, ``base`` and ``extra`` (the parts of both scores
    that this task knows), and ``rest`` (words whose count no task holds)."""
    keep = ["doc_id"] if keep is None else keep
    kept = F.struct(*[F.col(quoted(c)) for c in keep], F.lit(0).alias("__filler"))
    src = docs.select(kept.alias("kept"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = ["kept", "symbols", "tokens", "known", "base", "extra", "rest"]
    schema = f"kept {src.schema['kept'].dataType.simpleString()}, symbols binary, tokens long, known long, base double, extra double, rest map<string, bigint>"

    def run(batches):
        lex = shared.value
        for b in batches:
            for part in pieces(b, limit=PIECE):
                yield pa.RecordBatch.from_arrays([part.column(0), *code_texts(lex, part.column(1))], names=names)

    return stored(src.mapInArrow(run, schema))


def learn_model(coded: DataFrame, lexicon: Lexicon) -> Model:
    """Train the recurrent weights on all coded documents, inside their partitions.

    Each document belongs to one round, by its hash, and is read there from its
    first symbol to its last.  Partitions that are small for a round are put
    together, as weights that saw few tokens say little when they are averaged.
    """
    share = F.pmod(F.xxhash64("symbols"), F.lit(1 << 20))
    sc = coded.sparkSession.sparkContext
    model = Model(lexicon)
    seen, low = model.fresh(), 0
    for end in ROUNDS:
        high = int(end * (1 << 20))
        given = sc.broadcast(pickle.dumps((model, seen)))

        def run(batches, given=given):
            m, seen = pickle.loads(given.value)
            parts, size, total = [np.zeros(1, "<i2")], 0, 0

            def fit():
                m.fit(np.concatenate(parts), max(FIT_LANES, min(MOST_LANES, size // 6144)), seen=seen)

            for b in batches:
                for x in b.column(0):
                    parts.append(np.frombuffer(x.as_buffer(), "<i2"))
                    size += len(parts[-1])
                    if size > FIT_POOL:
                        fit()
                        parts, size, total = [np.zeros(1, "<i2")], 0, total + size
            total += size
            if size:
                fit()
            if total:
                flat = flat_weights(m, seen)
                for a in range(0, len(flat), ROW * 8):
                    rows = range(a, min(a + ROW * 8, len(flat)), ROW)
                    arrays = [pa.array([i // ROW for i in rows], pa.int32()), pa.array([total] * len(rows), pa.int64()), pa.array([flat[i : i + ROW].tobytes() for i in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["row", "tokens", "weights"])

        tasks = max(1, (high - low) * lexicon.total // (FIT_LEAST << 20))
        trained = coded.where((share >= low) & (share < high)).select("symbols").coalesce(tasks).mapInArrow(run, "row int, tokens long, weights binary")
        averaged = stored(trained.repartition("row").mapInArrow(add_weights, "row int, tokens long, weights binary")).orderBy("row").collect()
        if averaged:
            put_weights(model, seen, np.concatenate([np.frombuffer(r.weights, np.int64) / (r.tokens * POINT) for r in averaged]))
        low = high
    return model


#: Weights times tokens are added as whole numbers of this part of one, so that their order does not matter
POINT = 1 << 16


def add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weights times tokens, and of tokens, by row."""
    sums: dict[int, list] = {}
    for b in batches:
        for row, n, w in zip(*(c.to_pylist() for c in b.columns)):
            part = np.rint(np.frombuffer(w, np.float32).astype(float) * (n * POINT)).astype(np.int64)
            if row in sums:
                sums[row][0] += n
                sums[row][1] += part
            else:
                sums[row] = [n, part]
    for row, (n, w) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["row", "tokens", "weights"])


def code_texts(lex: Lexicon, texts: pa.Array) -> list[pa.Array]:
    """Symbols (the end last), tokens, known, base, extra and rest of each text.
    Each distinct word of the texts is looked up once."""
    cut, before = cut_words(texts)
    words, rows = cut.dictionary_encode(), len(texts)
    kinds, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
    owner = np.repeat(np.arange(rows), np.diff(before))
    rank = np.fromiter(map(lex.rank.get, kinds, repeat(-1)), np.int64, len(kinds))
    held, symbol = rank >= 0, lex.of_rank[rank]
    far = np.flatnonzero(~held)
    symbol[far] = [lex.symbol(kinds[i]) for i in far.tolist()]
    log = np.where(held, lex.log_count[rank], 0)
    leaf = symbol >= lex.vocabulary
    extra = np.where(leaf, log, 0)
    extra[leaf] -= lex.leaf[symbol[leaf] - lex.vocabulary]

    def by_text(of_word: np.ndarray) -> np.ndarray:
        return np.bincount(owner, of_word[which], rows).astype(float)

    tokens, out = np.diff(before) + 1, np.zeros(len(which) + rows, "<i2")
    out[np.arange(len(which)) + owner] = symbol[which]
    ends = (before + np.arange(rows + 1)) * 2
    pairs, n = np.unique((owner * max(1, len(kinds)) + which)[~held[which]], return_counts=True)
    text, word = np.divmod(pairs, max(1, len(kinds)))
    rest = words.dictionary.take(pa.array(word)).cast(pa.large_string()).cast(pa.string())
    return [
        pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)]),
        pa.array(tokens),
        pa.array(by_text(held & (lex.count[rank] > 0)).astype(np.int64) + int(lex.count[0] > 0)),
        pa.array(by_text(log) + lex.log_count[0] - lex.base * tokens),
        pa.array(by_text(extra)),
        pa.MapArray.from_arrays(pa.array(np.searchsorted(text, np.arange(rows + 1)), pa.int32()), rest, pa.array(n, pa.int64())),
    ]


def score_documents(coded: DataFrame, counts: DataFrame, lexicon: Lexicon, model: Model) -> DataFrame:
    """The kept columns of coded documents with ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` (a kept column of such a name
    is replaced).

    Null and empty texts: their only token is the end.  A text of any length is
    scored whole, the state carried from window to window.  Each row stands
    alone, so repeated rows and ties give repeated results (but for rounding),
    and an empty table an empty one.  A model that learnt from nothing scores
    every word as new.  Words whose count no task holds are joined with the
    stored ``counts``, each once for a document.
    """
    shared = coded.sparkSession.sparkContext.broadcast(model)
    src = coded.select("kept", "tokens", "known", "base", "extra", "rest", "symbols")
    schema = f"kept {coded.schema['kept'].dataType.simpleString()}, tokens long, known long, base double, score double, rest map<string, bigint>"

    def run(batches):
        m, pool, size = shared.value, [], 0

        def flush():
            t = pa.Table.from_batches(pool).combine_chunks()
            score = m.score([np.frombuffer(x.as_buffer(), "<i2") for x in t.column("symbols")]) + t.column("extra").to_numpy()
            t = t.drop_columns(["symbols", "extra"]).add_column(4, "score", pa.array(score))
            yield from t.to_batches(max_chunksize=2000)

        for b in batches:
            pool.append(b)
            size += b.column(6).nbytes // 2
            if size > POOL:
                yield from flush()
                pool, size = [], 0
        if pool:
            yield from flush()

    scored = stored(src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    # added up inside the tasks first; a frequent word's rows are split by the join
    rest = scored.select("row", F.explode("rest").alias("word", "n")).join(counts.hint("merge"), "word")
    sums = rest.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log"))
    every = scored.drop("rest").join(sums.hint("merge"), "row", "left")
    log, new = F.coalesce("log", F.lit(0.0)), ("n_tokens", "n_known", "train_tokens", "base_score", "score", "__filler")
    return every.select(
        *[F.col(f"kept.{quoted(c)}") for c in coded.schema["kept"].dataType.names if c.lower() not in new],
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("score") + log).alias("score"),
    )
