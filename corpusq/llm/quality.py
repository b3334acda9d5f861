"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its quantile bins, grown by cyclic
boosting: in every round each feature in turn gets one shallow tree on the
current gradients.  Pairs of features with the most left to explain then get
two-dimensional tables the same way.  A score is a sum of looked-up values.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, lowest, map_text, quoted, stored

#: Labelled rows that a model is fitted on, at most: those whose id hashes lowest
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.15, 1.0

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "stops", "symbols", "other_letters",
    "log_lines", "words_a_line", "new_words", "new_lines", "shortest_line", "bare_words",
)

#: Classes of bytes: 0 control, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 stops, 6 other ASCII, 7 first of several, 8 later
_class = np.zeros(256, np.int64)
_class[33:127] = 6
_class[list(b".,;:?!'\"-()")] = 5
_class[list(b" \t\r\n")] = 4
_class[48:58], _class[65:91], _class[97:123] = 3, 2, 1
_class[0xC0:], _class[0x80:0xC0] = 7, 8


def features(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; finite for every text."""
    n = len(texts)
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data])
    owner = np.repeat(np.arange(n), sizes)
    c = np.bincount(owner * 9 + _class[np.frombuffer(b"".join(data), np.uint8)], minlength=9 * n).reshape(n, 9).astype(float)
    own = np.zeros((n, 6))
    for i, d in enumerate(data):
        words, lines = d.split(), [x for x in d.split(b"\n") if x]
        bare = sum(map(bytes.isalnum, words)) if d.isascii() else sum(map(str.isalnum, texts[i].split()))
        own[i] = len(words), len(set(words)), len(lines), len(set(lines)), min(map(len, lines), default=0), bare
    words, new, lines, new_lines, shortest, bare = own.T
    chars = c.sum(1) - c[:, 8]
    letters = c[:, 1] + c[:, 2] + c[:, 7]
    ink = np.maximum(chars - c[:, 4] - c[:, 0], 1)
    return np.stack(
        [
            np.log1p(chars), np.log1p(words), ink / np.maximum(words, 1), letters / ink, c[:, 2] / np.maximum(letters, 1), c[:, 3] / ink, c[:, 5] / ink, c[:, 6] / ink, c[:, 7] / ink,
            np.log1p(lines), np.log1p(words / np.maximum(lines, 1)), new / np.maximum(words, 1), new_lines / np.maximum(lines, 1), np.log1p(shortest), bare / np.maximum(words, 1),
        ],
        axis=1,
    )


def shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a depth-two tree over a row of bins with gradients g, weights h."""

    def value(a, b):
        return g[a:b].sum() / (h[a:b].sum() + RIDGE)

    def split(a, b):
        if b - a < 2:
            return None
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        gain = cg[:-1] ** 2 / (ch[:-1] + RIDGE) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + RIDGE) - cg[-1] ** 2 / (ch[-1] + RIDGE)
        k = int(gain.argmax())
        return a + k + 1 if gain[k] > 1e-9 else None

    out = np.zeros(len(g))
    mid = split(0, len(g))
    for a, b in [(0, len(g))] if mid is None else [(0, mid), (mid, len(g))]:
        k = split(a, b) if mid is not None else None
        for x, y in [(a, b)] if k is None else [(a, k), (k, b)]:
            out[x:y] = value(x, y)
    return out


def shallow_pair(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of the best four-quadrant split of a square of bins."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quadrants(c):
        a, right, low, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return np.stack([a, right - a, low - a, all_ - right - low + a])

    v = quadrants(cg) / (quadrants(ch) + RIDGE)
    gain = (quadrants(cg) * v).sum(0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v[:, i, j]
    return out


class Model:
    """Edges of bins and lookup tables."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape if len(x) else (0, len(FEATURES))
        #: with no row of one class, one of the other counts
        p = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(p / (1 - p)))
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], q)) if n else np.zeros(0) for j in range(k)]
        coarse = np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
        self.coarse = [np.unique(np.quantile(x[:, j], coarse)) if n else np.zeros(0) for j in range(k)]
        self.table = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.square: list[np.ndarray] = []
        if n and 0 < y.sum() < n:
            self.fit(x, y)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        at, f = self.bins(x, self.edges), np.full(len(x), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j, b in enumerate(at):
                g, h = slopes()
                m = len(self.table[j])
                step = RATE * shallow(np.bincount(b, g, m), np.bincount(b, h, m))
                self.table[j] += step
                f += step[b]
        low = self.bins(x, self.coarse)
        sizes = [len(e) + 1 for e in self.coarse]

        def square(i, j, v):
            return np.bincount(low[i] * sizes[j] + low[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

        g, h = slopes()
        gains = {
            (i, j): float((square(i, j, g) ** 2 / (square(i, j, h) + RIDGE)).sum())
            for i, j in combinations(range(len(sizes)), 2)
            if sizes[i] > 1 and sizes[j] > 1
        }
        self.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
        self.square = [np.zeros((sizes[i], sizes[j])) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for t, (i, j) in zip(self.square, self.pairs):
                g, h = slopes()
                step = RATE * shallow_pair(square(i, j, g), square(i, j, h))
                t += step
                f += step[low[i], low[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for t, b in zip(self.table, self.bins(x, self.edges)):
            f += t[b]
        low = self.bins(x, self.coarse)
        for t, (i, j) in zip(self.square, self.pairs):
            f += t[low[i], low[j]]
        return 1 / (1 + np.exp(-f))


def add_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    def make():
        def work(texts):
            x = features(texts)
            return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))]

        return work

    return map_text(docs, text_col, keep, [("features", "array<double>")], make)


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled documents, at most ``rows`` of them (lowest hash of the id).

    Labels other than 0 and 1 and ids with contrary labels are left out; a
    repeated label counts once.  Without labelled rows every score is 0.5.  Null
    and empty texts count like others; rows that repeat an id count each.
    """
    label = F.col(quoted(label_col)).cast("int")
    known = labels.where(label.isin(0, 1)).groupBy(F.col(quoted(id_col)).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    x = add_features(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), ["id"])
    # written once: counted, and then drawn from
    labelled = stored(x.join(known.hint("merge"), "id"))
    fit = lowest(labelled, "id", "features", limit=rows, total=labelled.count()).collect()
    drop_stored(labelled)
    return Model(np.array([r.features for r in fit], float).reshape(-1, len(FEATURES)), np.array([r.y for r in fit], float))


def score_quality(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, null and empty texts too) and ``predicted``
    (1 if the score is at least 0.5).

    Each row stands alone: repeated rows and ties give repeated results, an empty
    table an empty one, a text of any length is read whole.  A ``keep`` column
    named like an added one is replaced.
    """

    def make():
        def work(texts):
            s = model.score(features(texts))
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return work

    return map_text(docs, text_col, ["doc_id"] if keep is None else keep, [("score", "double"), ("predicted", "int")], make)
