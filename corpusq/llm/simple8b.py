"""Simple-8b word-aligned coding of unsigned integers, vectorised with numpy.

A 64-bit word holds a 4-bit selector and 60 bits: one of fourteen ways to split
them into equal fields.  Selector 0 is an escape: its payload is an index into
the block's section of raw 64-bit values, for integers of more than 60 bits.
Values are coded in blocks of ``BLOCK``; words never span two blocks, and the
directory holds each block's first word and first raw value, so that any block,
or all of them at once, can be decoded.

Layout (little-endian): magic ``S8B1``, u32 zero, u64 values, u64 words, u64 raw
values; u64 first word of each block, u64 first raw value of each block; words;
raw values.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
MAGIC = b"S8B1\0\0\0\0"

#: How many fields, of how many bits, for selectors 1 to 14.
FIELDS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

_most = max(FIELDS)
_count = np.array([1, *FIELDS], np.int64)


#: bits of each value under 2^16
_small = np.ceil(np.log2(np.arange(1, 1 << 16, dtype=np.float64) + 0.5)).astype(np.uint8)
_small = np.concatenate([np.zeros(1, np.uint8), _small])


def bit_length(v: np.ndarray) -> np.ndarray:
    if not len(v) or v.max() < 1 << 16:
        return _small[v.astype(np.uint16)]
    high = (v >> np.uint64(32)).astype(np.float64)
    low = (v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Code a one-dimensional array of unsigned integers."""
    v = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(v), -(-len(v) // BLOCK)
    grid = np.zeros((blocks, BLOCK + _most), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = v
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = bit_length(grid.ravel()).reshape(grid.shape)
    # widest value among the next k, for growing k: the last selector that fits packs most
    choice = np.where(bits[:, :BLOCK] <= 60, 14, 0).astype(np.uint8)
    wide, k = bits, 1
    for s in range(13, 0, -1):
        step = FIELDS[s - 1] - k
        wide = np.maximum(wide[:, : wide.shape[1] - step], wide[:, step:])
        k = FIELDS[s - 1]
        np.copyto(choice, s, where=wide[:, :BLOCK] <= BITS[s - 1])
    # all blocks advance together from word to word
    at, lanes = np.zeros(blocks, np.int64), np.arange(blocks)
    rows, cols = [], []
    live = lanes
    while len(live):
        rows.append(live)
        cols.append(at[live])
        at[live] += _count[choice[live, at[live]]]
        live = live[at[live] < BLOCK] if len(live) and at[live].max() >= BLOCK else live
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    last = np.full(blocks, BLOCK)
    if blocks:
        last[-1] = n - (blocks - 1) * BLOCK
    inside = col < last[row]
    row, col = row[inside], col[inside]
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    sel = choice[row, col]
    words = sel.astype(np.uint64) << np.uint64(60)
    place, cells = row * grid.shape[1] + col, grid.ravel()
    for s in range(1, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            at, word = place[mine], words[mine]
            for k in range(FIELDS[s - 1]):
                word |= cells[at + k] << np.uint64(k * BITS[s - 1])
            words[mine] = word
    escapes = np.flatnonzero(sel == 0)
    raw = grid[row[escapes], col[escapes]]
    first_word = np.searchsorted(row, np.arange(blocks)).astype(np.uint64)
    first_raw = np.searchsorted(row[escapes], np.arange(blocks)).astype(np.uint64)
    words[escapes] |= np.arange(len(escapes), dtype=np.uint64) - first_raw[row[escapes]]
    head = np.array([n, len(words), len(raw)], "<u8")
    return b"".join([MAGIC, *(x.astype("<u8").tobytes() for x in (head, first_word, first_raw, words, raw))])


def decode(data: bytes) -> np.ndarray:
    """The values that ``encode`` was given, as unsigned 64-bit integers."""
    if data[:8] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, n_words, n_raw = map(int, np.frombuffer(data, "<u8", 3, 8))
    blocks = -(-n // BLOCK)
    rest = np.frombuffer(data, "<u8", offset=32)
    first_word, first_raw = rest[:blocks].astype(np.int64), rest[blocks : 2 * blocks].astype(np.int64)
    words, raw = rest[2 * blocks : 2 * blocks + n_words], rest[2 * blocks + n_words :][:n_raw]
    sel = (words >> np.uint64(60)).astype(np.int64)
    taken = np.concatenate([[0], np.cumsum(_count[sel])])
    block = np.repeat(np.arange(blocks), np.diff(np.append(first_word, n_words)))
    at = taken[:-1] - taken[first_word][block] + block * (BLOCK + _most)
    out = np.zeros(blocks * (BLOCK + _most), np.uint64)
    for s in range(1, 15):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            k = np.arange(FIELDS[s - 1])
            mask = np.uint64((1 << BITS[s - 1]) - 1)
            out[at[mine, None] + k] = (words[mine, None] >> (k * BITS[s - 1]).astype(np.uint64)) & mask
    escapes = np.flatnonzero(sel == 0)
    out[at[escapes]] = raw[first_raw[block[escapes]] + (words[escapes] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out.reshape(blocks, BLOCK + _most)[:, :BLOCK].ravel()[:n]
