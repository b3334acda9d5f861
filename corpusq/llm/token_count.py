"""Token counts without token ids: byte-pair merging over a linked list with a
heap of adjacent pairs.  The count is the initial symbols minus the merges."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import LONGEST, REMEMBERED, Vocabulary, vocabulary
from .common import map_text


class Counter(dict):
    """Tokens of a unit of text, computed when first asked for.  What it holds is
    bounded by ``REMEMBERED`` bytes and as many of an older generation."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.old, self.size = v, {}, 0
        #: classes of symbols: merging needs only which pairs join, and in what order
        self.rank, self.merged, self.shift, self.byte_id = v.rank, v.merged, v.shift, v.byte_id

    def __missing__(self, unit: str) -> int:
        if (n := self.old.pop(unit, None)) is None:
            if unit in self.v.special:
                n = 1
            elif unit.lstrip(" ").isalpha() or len(parts := self.v.pre_tokens(unit)) == 1:
                n = self.count(unit.encode())
            else:
                n = sum(map(self.__getitem__, parts))
        if len(unit) <= LONGEST:
            self.size += len(unit) + 170
            if self.size > REMEMBERED:
                self.old, self.size = dict(self), 0
                self.clear()
            self[unit] = n
        return n

    def count(self, word: bytes) -> int:
        """Initial symbols minus merges."""
        get, merged, shift = self.rank.get, self.merged, self.shift
        sym = list(map(self.byte_id.__getitem__, word))
        n = len(sym)
        #: rank of each symbol's pair with the next one, or None
        pair = [get(a << shift | b) for a, b in zip(sym, sym[1:])]
        # heap items: rank and left position in one integer
        width = n.bit_length()
        heap = [r << width | i for i, r in enumerate(pair) if r is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push, mask = heapq.heappop, heapq.heappush, (1 << width) - 1
        pair.append(None)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            x = pop(heap)
            i = x & mask
            r = x >> width
            if pair[i] != r:
                continue  # one side has been merged away since
            merges += 1
            s, j = merged[r], after[i]
            sym[i], pair[j] = s, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(s << shift | sym[k])) is not None:
                    push(heap, r << width | i)
                pair[i] = r
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                if (r := get(sym[h] << shift | s)) is not None:
                    push(heap, r << width | h)
                pair[h] = r
        return n - merges


_counters: dict[str, Counter] = {}


def token_count(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, limit: int = 1024) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts: 0 bytes, 0 tokens, not over the limit.  A text of any
    length is counted whole.  Rows map one to one, so repeated rows and ties
    give repeated results, and an empty table an empty one.  A ``keep`` column
    named like an added one is replaced by it.
    """

    def make():
        v = vocabulary(path)
        get = _counters.setdefault(path, Counter(v)).__getitem__

        def work(texts):
            n = [sum(map(get, v.units(t))) for t in texts]
            return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]

        return work

    return map_text(df, text_col, ["doc_id"] if keep is None else keep, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], make)
