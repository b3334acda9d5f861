"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (1 to 3 letters,
words padded with a blank on either side), in order of frequency.  A document's
own profile is compared to each by the out-of-place distance: the sum, over the
document's n-grams, of how far each is from its place in the language profile,
or the profile's length where it is missing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_CHARS, map_text, pieces, quoted

#: n-grams of a profile
PROFILE = 400

_folded: np.ndarray | None = None


def folded() -> np.ndarray:
    """For each code point: its lower-case letter's code point, or 0 if not a letter."""
    global _folded
    if _folded is None:
        t = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if unicodedata.category(s := chr(c))[0] == "L":
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _folded = t
    return _folded


def gram_counts(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count n-grams for each owner: (owner, gram, count), in no order.  ``owner``
    ascends.  A gram is up to three code points packed at 21 bits each."""
    table = folded()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < PIECE_CHARS):
            size += len(texts[stop]) + 1
            stop += 1
        # a blank on either side of every text
        joined = "".join(f"\n{t}\n" for t in texts[start:stop])
        owners = np.repeat(owner[start:stop], [len(t) + 2 for t in texts[start:stop]])
        letter = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)]
        # one long text is counted in parts, each n-gram where it starts
        for a in range(0, len(letter), 2 * PIECE_CHARS):
            b = a + 2 * PIECE_CHARS
            found.append(_count(letter[a : b + 2], owners[a : b + 2], min(b, len(letter)) - a))
        start = stop
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e
    if len(found) == 1:
        return found[0]
    return _merged(found)


def _merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal owners and grams added up."""
    o, g, n = (np.concatenate(x) for x in zip(*found))
    if not len(o):
        return o, g, n
    order = np.lexsort((g, o))
    o, g, n = o[order], g[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (g[1:] != g[:-1])]))
    return o[first], g[first], np.add.reduceat(n, first)


def _count(letter: np.ndarray, owners: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count the n-grams that begin at the first ``starts`` places.  Only the
    three letters at each place are sorted; shorter n-grams are their prefixes."""
    # alphabet of this piece, in code-point order; 0 is the blank
    used = np.flatnonzero(np.bincount(letter))
    if not len(used) or used[0]:
        used = np.concatenate([[0], used])
    name = np.where(used == 0, 32, used)  # a blank is written as one, unlike the end of a short n-gram
    place = np.zeros(used[-1] + 1, np.uint64)
    place[used] = np.arange(len(used), dtype=np.uint64)
    small = np.concatenate([place[letter], np.zeros(2, np.uint64)])
    width = int(len(used)).bit_length()
    turn = np.concatenate([[True], owners[1:] != owners[:-1]])
    local = owners[turn]
    head = (np.cumsum(turn)[:starts] - 1).astype(np.uint64) << np.uint64(3 * width)
    one, two, three = small[:starts], small[1 : 1 + starts], small[2 : 2 + starts]
    pair = (one | two) > 0  # what crosses into the next text begins with two blanks
    key = np.sort((head | one << np.uint64(2 * width) | two << np.uint64(width) | three)[pair])
    count = np.ones(len(key), np.int64)
    mask = np.uint64((1 << width) - 1)
    out = []
    for n in (3, 2, 1):
        if len(key):
            if n < 3:
                key = key >> np.uint64(width)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, count = key[first], np.add.reduceat(count, first)
        letters = [name[((key >> np.uint64(width * j)) & mask).astype(np.int64)] for j in range(n - 1, -1, -1)]
        # a blank stands only at the ends, and not alone
        ok = letters[1] > 32 if n == 3 else letters[0] > 32 if n == 1 else np.ones(len(key), bool)
        gram = sum(x.astype(np.int64) << (21 * (2 - j)) for j, x in enumerate(letters))
        out.append((local[(key >> np.uint64(n * width)).astype(np.int64)][ok], gram[ok], count[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Profiles ``(lang, gram, place)`` from all rows with a language.

    Counts are added up over the whole table; ties go to the smaller gram.  A
    language whose texts hold no letter has no profile.
    """
    src = docs.where(F.col(quoted(lang_col)).isNotNull()).select(
        F.col(quoted(lang_col)).cast("string").alias("lang"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held, size = [], 0

        for b in batches:
            for p in pieces(b):
                owner = np.array([names.setdefault(x, len(names)) for x in p.column(0).to_pylist()], np.int64)
                order = np.argsort(owner, kind="stable")
                texts = p.column(1).to_pylist()
                held.append(gram_counts([texts[i] for i in order], owner[order]))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [_merged(held)]
                    size = 0
        if held:
            o, g, n = _merged(held)
            back = np.array(list(names), object)
            for a in range(0, len(o), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(back[o[a : a + 100_000]], pa.string()), pa.array(g[a : a + 100_000]), pa.array(n[a : a + 100_000], pa.int64())], names=["lang", "gram", "n"]
                )

    counts = src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place - 1).where(F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    """All language profiles as one lookup table."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.place = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)  # last column: no profile has it
        at = {g: i for i, g in enumerate(self.grams.tolist())}
        index = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.place[index[lang], at[gram]] = place

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (1 - distance / largest distance) of each text."""
        n = len(texts)
        if not len(self.grams):
            return ["und"] * n, np.zeros(n)
        owner, gram, count = gram_counts(texts, np.arange(n))
        # n-grams of a document in order of frequency, ties by gram
        order = np.lexsort((gram, -count, owner))
        owner, gram = owner[order], gram[order]
        first = np.searchsorted(owner, np.arange(n))
        rank = np.arange(len(owner)) - first[owner]
        top = rank < self.size
        owner, gram, rank = owner[top], gram[top], rank[top]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        grams = np.bincount(owner, minlength=n)
        far = np.stack([np.bincount(owner, np.where((p := row[at]) < 0, self.size, np.abs(p - rank)), minlength=n) for row in self.place])
        score = 1 - far / np.maximum(grams * self.size, 1)
        best = score.argmax(0)  # ties: the first in alphabetical order
        value = np.clip(score[best, np.arange(n)], 0, 1)
        return ["und" if g == 0 else self.langs[i] for i, g in zip(best, grams)], np.where(grams == 0, 0.0, value)


def predict_language(docs: DataFrame, profiles: DataFrame, keep: list[str] | None = None, text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) by the nearest profile.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned.  A tie goes to the language first in alphabetical order.
    Profiles are at most ``size`` rows for each language, so they are sent to
    every task.  A text of any length is read whole; repeated rows give repeated
    results, an empty table an empty one.  A ``keep`` column named like an added
    one is replaced.
    """
    rows = [(r.lang, r.gram, r.place) for r in profiles.collect()]

    def make():
        p = Profiles(rows, size)

        def work(texts):
            lang, score = p.predict(texts)
            return [pa.array(lang, pa.string()), pa.array(score)]

        return work

    return map_text(docs, text_col, ["doc_id"] if keep is None else keep, [("lang_pred", "string"), ("score", "double")], make)
