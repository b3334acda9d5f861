"""Benchmark decontamination by q-gram counting and banded alignment.

An occurrence of an item of m characters with at most e edits shares at least
m + 1 - q - q*e of its q-grams with the text, on diagonals (text position minus
item position) no more than e apart.  Shared q-grams are counted in overlapping
bands of diagonals, twice e + 1 wide; bands that reach the bound are verified by
alignment inside the band.  Items shorter than a q-gram have none to share; they
are looked up as they stand, as whole words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_text, quoted, stored

#: Characters of a q-gram, edits allowed for each character of an item
Q = 8
EDITS = 0.1
#: Characters of benchmark text indexed at once
BLOCK_CHARS = 4_000_000

LEAKS = "array<struct<item_id: long, start: long, stop: long, edits: int>>"

_step = np.uint64(0x9E3779B97F4A7C15)
_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its lower case (where that is one character), whether
    it is white space, and whether it is a letter or a digit."""
    global _tables
    if _tables is None:
        low, blank, word = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool), np.zeros(0x110000, bool)
        for c in range(0x110000):
            s = chr(c)
            if len(x := s.lower()) == 1:
                low[c] = ord(x)
            blank[c], word[c] = s.isspace(), s.isalnum()
        low[blank] = 32
        _tables = low, blank, word
    return _tables


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, white space as single blanks, none at the ends; and the place
    in the text of each character kept."""
    low, blank, _ = tables()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = blank[code]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    if len(at) and space[at[0]]:
        at = at[1:]
    if len(at) and space[at[-1]]:
        at = at[:-1]
    return low[code[at]], at


def qgram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """A hash of every run of q characters, built by doubling."""
    h, size, factor = code.astype(np.uint64) + np.uint64(1), 1, _step
    done, done_size = None, 0
    n = len(code)
    while True:
        if q & size:
            if done is None:
                done, done_size = h, size
            else:
                keep = max(0, n - done_size - size + 1)
                done = done[:keep] * factor + h[done_size : done_size + keep]
                done_size += size
        if size * 2 > q:
            return done[: max(0, n - q + 1)]
        keep = max(0, n - 2 * size + 1)
        h = h[:keep] * factor + h[size : size + keep]
        size, factor = size * 2, np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)


class Index:
    """The q-grams of a block of items; and the items shorter than one, by length."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDITS, short_items: bool = True):
        self.q, self.id, self.code = q, [], []
        hashes, owner, place = [], [], []
        #: length -> what an item of that length reads as -> the ids of such items
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, text in items:
            code, _ = normal(text or "")
            if len(code) < q:
                if short_items and len(code):
                    self.short.setdefault(len(code), {}).setdefault(code.tobytes(), []).append(i)
                continue
            h = qgram_hashes(code, q)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.id)))
            place.append(np.arange(len(h)))
            self.id.append(i)
            self.code.append(code)
        size = np.array([len(c) for c in self.code], np.int64)
        #: edits allowed: the share asked for, as long as the bound stays positive
        self.edits = np.minimum((size * rate).astype(np.int64), (size - q) // q)
        self.least = size + 1 - q - q * self.edits
        self.width = self.edits + 1
        self.hash = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.owner = np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.place = np.concatenate([*place, np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        self.short_hash = {n: np.unique(np.concatenate([qgram_hashes(np.frombuffer(x, np.uint32), n) for x in some])) for n, some in self.short.items()}

    def find(self, text: str) -> list[dict]:
        """Items that occur in the text: best place of each."""
        code, at = normal(text)
        return sorted(self.find_short(code, at) + self.find_long(code, at), key=lambda x: (x["item_id"], x["start"]))

    def find_short(self, code: np.ndarray, at: np.ndarray) -> list[dict]:
        """First place of each item shorter than a q-gram: all of its characters,
        with no letter or digit going on before its first or after its last."""
        _, _, word = tables()
        out = []
        for n, some in self.short.items():
            h = qgram_hashes(code, n)
            pos = np.flatnonzero(np.isin(h, self.short_hash[n]))
            inside = word[code]
            before = (pos > 0) & inside[pos - 1] & inside[pos] if len(pos) else np.zeros(0, bool)
            after = (pos + n < len(code)) & inside[np.minimum(pos + n, len(code) - 1)] & inside[pos + n - 1] if len(pos) else before
            pos = pos[~(before | after)]
            found: dict[bytes, int] = {}
            # a hash stands for one text but for chance; every other place of it is looked at then
            _, first = np.unique(h[pos], return_index=True)
            for p in pos[first].tolist():
                if (x := code[p : p + n].tobytes()) in some:
                    found[x] = p
                else:
                    for p2 in pos[h[pos] == h[p]].tolist():
                        if (x := code[p2 : p2 + n].tobytes()) in some:
                            found.setdefault(x, p2)
            for x, p in found.items():
                out += [{"item_id": i, "start": int(at[p]), "stop": int(at[p + n - 1]) + 1, "edits": 0} for i in some[x]]
        return out

    def find_long(self, code: np.ndarray, at: np.ndarray) -> list[dict]:
        """Items of a q-gram or more, by counting in bands and alignment."""
        if not len(self.hash) or len(code) < self.q:
            return []
        h = qgram_hashes(code, self.q)
        pos = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        first = np.searchsorted(self.hash, h[pos], "left")
        n = np.searchsorted(self.hash, h[pos], "right") - first
        if not n.any():
            return []
        pos = np.repeat(pos, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        item = self.owner[entry]
        band = (pos - self.place[entry]) // self.width[item]
        # a diagonal lies in two bands: the one that begins at its multiple of the width, and the one before
        longest = max(map(len, self.code))
        most = len(code) + longest + 4
        key = item * most + band + longest + 2
        key, shared = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item, band = key // most, key % most - longest - 2
        full = shared >= self.least[item]
        out: dict[int, dict] = {}
        regions: list[list[int]] = []
        for i, b in zip(item[full].tolist(), band[full].tolist()):
            if regions and regions[-1][0] == i and b <= regions[-1][2] + 1:
                regions[-1][2] = b
            else:
                regions.append([i, b, b])
        for i, b0, b1 in regions:
            w, e = int(self.width[i]), int(self.edits[i])
            hit = align(self.code[i], code, b0 * w - e, (b1 + 2) * w + e, e)
            if hit and (i not in out or hit[0] < out[i]["edits"]):
                edits, start, stop = hit
                out[i] = {"item_id": self.id[i], "start": int(at[start]), "stop": int(at[stop - 1]) + 1 if stop > start else int(at[start]), "edits": edits}
        return list(out.values())


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Best occurrence of the item on diagonals low..high of the text with at
    most ``most`` edits: (edits, start, stop), or None.  Ties: the first end,
    then the shortest."""

    def fill(a: np.ndarray, b: np.ndarray, low: int, begin: np.ndarray) -> np.ndarray | None:
        # cell d of row i stands for i characters of a and i + low + d of b
        width, steps = len(begin), np.arange(len(begin))
        padded = np.full(len(a) + width + 1, 0xFFFFFFFF, np.uint32)
        s, t = max(0, low), min(len(b), low + len(padded))
        if t > s:
            padded[s - low : t - low] = b[s:t]
        row = np.minimum.accumulate(begin - steps) + steps
        for i in range(len(a)):
            new = row + (padded[i : i + width] != a[i])
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
            if row.min() > most:
                return None
        return row

    width = high - low + 1
    far = 1 << 30
    # an occurrence begins inside the text
    begin = np.where((np.arange(width) + low >= 0) & (np.arange(width) + low <= len(text)), 0, far)
    last = fill(item, text, low, begin)
    if last is None:
        return None
    ends = np.arange(width) + low + len(item)
    last = np.where((ends >= 0) & (ends <= len(text)), last, far)
    d = int(last.argmin())
    if last[d] > most:
        return None
    stop = int(ends[d])
    # backwards from that end, to find the start
    reach = int(last[d])
    back = np.full(2 * reach + 1, far)
    back[reach] = 0
    row = fill(item[::-1], text[:stop][::-1], -reach, back)
    starts = stop - (np.arange(len(back)) - reach + len(item))
    row = np.where((starts >= 0) & (starts <= stop), row, far)
    best = np.flatnonzero(row == row.min())
    return int(last[d]), int(starts[best].max()), stop


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text: str = "text", q: int = Q, edits: float = EDITS, block_chars: int = BLOCK_CHARS, short_items: bool = True) -> DataFrame:
    """Add ``leaks``: the benchmark items that occur in each text, with place
    (in characters of the text) and edits, by item; one entry for an item.

    Null and empty texts hold none.  An item whose text is null or blank never
    matches.  One with fewer than ``q`` characters after normalising is found
    where it stands unchanged as whole words; such strings stand in ordinary
    text as well, so ``short_items=False`` leaves them out.  Items that repeat an
    id are searched for one by one.

    A text of any length is searched whole; repeated rows give repeated results,
    an empty table an empty one; a ``keep`` column named ``leaks`` is replaced.

    The benchmark is read in blocks of about ``block_chars`` characters.  One
    block is held at a time: with more of them, what each finds is written out
    by place of the row, and put together at the end; the texts are never
    shuffled.
    """
    items = benchmark.select(F.col(quoted(item_col)).cast("long").alias("item_id"), F.col(quoted(item_text)).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    spark, keep = docs.sparkSession, [c for c in (["doc_id"] if keep is None else keep) if c.lower() != "leaks"]

    def block(k: int):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()])

        def make():
            index = Index(held.value, q, edits, short_items)
            return lambda texts: [pa.array([index.find(t) for t in texts], pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int32())])))]

        return held, make

    if blocks == 1:
        return map_text(docs, text_col, keep, [("leaks", LEAKS)], block(0)[1])
    # rows get a place; a written table keeps it the same for every block
    row = fresh("__row", docs.columns)
    rows = stored(docs.select(*dict.fromkeys([*map(quoted, keep), quoted(text_col)])).withColumn(row, F.monotonically_increasing_id()))
    found = None
    for k in range(blocks):
        held, make = block(k)
        here = stored(map_text(rows, text_col, [row], [("leaks", LEAKS)], make).where(F.size("leaks") > 0))
        held.destroy()
        found = here if found is None else found.unionByName(here)
    leaks = found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return rows.join(leaks.hint("merge"), row, "left").select(*[F.col(quoted(c)) for c in keep], F.coalesce("leaks", F.array().cast(LEAKS)).alias("leaks"))
