"""Byte-level byte-pair encoding: shared tables and pre-tokenising, encoding by
speculation and verification, and decoding.

Null text counts as empty; an empty text has no ids.  Special-token strings in
a text become their id, as the vocabulary file's library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, quoted

#: The pre-token pattern of byte-level vocabularies, and the
#: characters with the Unicode White_Space property.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0  -     　"

#: Bytes that a Python worker remembers of words it has met, twice at most;
#: longer units are not remembered
REMEMBERED, LONGEST = 32_000_000, 200


def spaced(pattern: str) -> str:
    """The pattern with exactly White_Space for \\s; Python's also has four separators."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


_pre_token = regex.compile(spaced(PRE_TOKEN))
_unit = re.compile(spaced(r" ?\S+|\s+(?!\S)|\s+"))
#: anything that the cut at blanks and line ends cannot handle
_odd = re.compile(r"[\x01\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def unassigned(first: int, stop: int) -> re.Pattern:
    """Characters of a range that this Python's Unicode tables do not know; the library's may."""
    known = [unicodedata.category(chr(c)) != "Cn" for c in range(first, stop)]
    edges = [first + k for k in range(len(known)) if known[k] != (k == 0 or known[k - 1])] + [stop]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2])) + "]")


_unknown, _unknown_far = unassigned(0, 0x10000).search, unassigned(0x10000, 0x110000).search


class Vocabulary:
    """Tables of a byte-level vocabulary file (tokenizers' JSON layout)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level vocabulary without normaliser or prefix space is needed")
        self.path, self.library = path, None
        symbol = byte_symbols()
        back = {c: b for b, c in symbol.items()}
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * self.size
        for text, i in vocab.items():
            self.token[i] = text.encode() if text in self.special else bytes(map(back.__getitem__, text))
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.byte_id = [vocab[symbol[b]] for b in range(256)]
        #: (left id, right id) as one integer -> rank, and rank -> merged id
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        self.shift = self.size.bit_length()
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a] << self.shift | vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pre_tokens(self, unit: str) -> list[str]:
        """The pre-tokens of a unit.  Where it has a character that Python's
        Unicode tables lack, the library cuts it, as it may know the character."""
        if unit.isascii() or not (_unknown(unit) or max(unit) > "\uffff" and _unknown_far(unit)):
            return _pre_token.findall(unit)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [unit[a:b] for _, (a, b) in self.library.pre_tokenize_str(unit)]

    def units(self, text: str) -> list[str]:
        """Cut a text at white space only: a unit is a run of other characters
        with the blank before it, or white space.  No pre-token spans two
        units, and units repeat far more than texts."""
        if self.special and any(s in text for s in self.special):
            out: list[str] = []
            for k, part in enumerate(self.split_special.split(text)):
                out += [part] if k % 2 else _unit.findall(part)
            return out
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _odd.search(text):
            return _unit.findall(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")


_open: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One copy of the tables per Python process."""
    if path not in _open:
        _open[path] = Vocabulary(path)
    return _open[path]


class Codec:
    """Encode words by greedy longest match, keep a word's tokens if every
    adjacent pair is one that merging itself would leave, and merge the other
    words exactly."""

    def __init__(self, path: str):
        self.v = v = vocabulary(path)
        n = len(v.merged)
        #: left and right half, and rank, of each merged token; -1 for bytes
        self.left = np.full(v.size, -1, np.int64)
        self.right = np.full(v.size, -1, np.int64)
        self.made = np.full(v.size, -1, np.int64)
        keys = np.fromiter(v.rank, np.int64, n)
        ranks = np.fromiter(v.rank.values(), np.int64, n)
        merged = np.array(v.merged, np.int64)[ranks]
        self.left[merged], self.right[merged], self.made[merged] = keys >> v.shift, keys & ((1 << v.shift) - 1), ranks
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        #: a token made by two rules has no one history: nothing is then proposed
        self.proposes = len(set(v.merged)) == n
        reachable = {v.token[i] for i in v.byte_id} | {v.token[i] for i in v.merged}
        self.ids = {t: i for i, t in enumerate(v.token) if t in reachable}
        for text, i in v.special.items():
            if self.ids.get(text.encode()) == i:
                del self.ids[text.encode()]
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in v.special.items()}
        #: units met lately, and those met before that: each is bounded in bytes
        self.forget()
        #: a token is proposed only if merging its own bytes gives it back
        self.ids = {t: i for t, i in self.ids.items() if len(t) == 1 or self.merge(t) == [i]}
        #: lengths of the tokens that begin with three bytes, longest first
        sizes: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                sizes.setdefault(t[:3], set()).add(len(t))
        self.lengths = {p: tuple(sorted(s, reverse=True)) for p, s in sizes.items()}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest-ranked adjacent pair, leftmost first."""
        v, shift = self.v, self.v.shift
        sym = [v.byte_id[b] for b in word]
        if len(sym) > 64:
            return self.merge_long(sym)
        none, get, merged = 1 << 40, v.rank.get, v.merged
        ranks = [get(a << shift | b, none) for a, b in zip(sym, sym[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            sym[i : i + 2] = [merged[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(sym[i - 1] << shift | sym[i], none)
            if i < len(ranks):
                ranks[i] = get(sym[i] << shift | sym[i + 1], none)
        return sym

    def merge_long(self, sym: list[int]) -> list[int]:
        """The same with a heap, for words without white space over many bytes."""
        v, shift, rank, n = self.v, self.v.shift, self.v.rank, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get(sym[i] << shift | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = v.merged[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(sym[i] << shift | sym[k])) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(sym[h] << shift | sym[i])) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return [s for s in sym if s >= 0]

    def propose(self, word: bytes) -> list[int] | None:
        """Greedy longest match, or None where no valid token fits."""
        out, at, n, get, lengths = [], 0, len(word), self.ids.get, self.lengths.get
        while at < n:
            for size in lengths(word[at : at + 3], ()):
                if at + size <= n and (i := get(word[at : at + size])) is not None:
                    at += size
                    break
            else:
                if at + 2 <= n and (i := get(word[at : at + 2])) is not None:
                    at += 2
                elif (i := get(word[at : at + 1])) is not None:
                    at += 1
                else:
                    return None
            out.append(i)
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a with b; a number above all ranks where none exists."""
        keys = a << self.v.shift | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would merging leave this boundary alone?

        Undo both histories together, latest merge first.  Whenever the pieces
        beside the boundary were neighbours from the merge that made the older
        one until a later merge took one of them, a rule joining them must not
        come earlier than that later merge.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        #: the merge that ends this state: (rank, 1 if it is right of the boundary)
        limit = np.full(len(a), 1 << 39)
        right_end = np.zeros(len(a), bool)
        while len(live):
            join = self.pair_rank(a, b)
            # equal ranks: the same rule applies left to right; the joining
            # pair overlaps the one at its left only if that pair comes first
            bad = (join < limit) | ((join == limit) & right_end)
            ok[live[bad]] = False
            ra, rb = self.made[a], self.made[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_right = rb >= ra  # on a tie the right one was merged later
            limit = np.where(undo_right, rb, ra)
            right_end = undo_right
            a, b = np.where(undo_right, a, self.right[a]), np.where(undo_right, self.left[b], b)
        return ok

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units that are not remembered."""
        parts = [(u, [u.encode()] if u.lstrip(" ").isalpha() else [p.encode() for p in self.v.pre_tokens(u)]) for u in units]
        words = list({w for _, ps in parts for w in ps})
        done: dict[bytes, list[int]] = {}
        guesses = [self.propose(w) if self.proposes else None for w in words]
        tried = [(w, g) for w, g in zip(words, guesses) if g is not None]
        if tried:
            counts = np.fromiter((len(g) for _, g in tried), np.int64, len(tried))
            flat = np.fromiter(chain.from_iterable(g for _, g in tried), np.int64, int(counts.sum()))
            owner = np.repeat(np.arange(len(tried)), counts)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            key, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            good = self.compatible(key >> 32, key & 0xFFFFFFFF)[back]
            failing = np.zeros(len(tried), bool)
            failing[owner[inner[~good]]] = True
            done = {w: g for (w, g), f in zip(tried, failing) if not f}
        for w in words:
            if w not in done:
                done[w] = self.merge(w)
        pack = lambda n, *ids: struct.pack(f"<{n}I", *ids)
        found = {}
        for u, ps in parts:
            ids = done[ps[0]] if len(ps) == 1 else [i for p in ps for i in done[p]]
            found[u] = pack(len(ids), *ids)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.v.units(t) for t in texts]
        known = self.known
        missing = set(chain.from_iterable(cut)) - known.keys()
        again = missing & self.older.keys()
        known.update((u, self.older.pop(u)) for u in again)
        new = self.learn(missing - again)
        known.update(new)
        out = [b"".join(map(known.__getitem__, units)) for units in cut]
        for u, ids in new.items():
            if len(u) > LONGEST and u not in self.special:
                del known[u]
            else:
                # a string, its ids and their place in the memory take about this much
                self.size += len(u) + len(ids) + 190
        if self.size > REMEMBERED:
            self.known, self.older, self.size = dict(self.special), known, 0
        return out

    def forget(self) -> None:
        self.known, self.older, self.size = dict(self.special), {}, 0


def decoder(path: str):
    """A function from ids to text; bytes that are not UTF-8 become U+FFFD."""
    token = vocabulary(path).token.__getitem__
    return lambda ids: b"".join(map(token, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of ``text_col`` as binary (little-endian unsigned
    32-bit) and, where ``decoded`` names a column, the text decoded from them.

    Keeps the ``keep`` columns (default ``doc_id``; one named like an added
    column is replaced).  Null text counts as empty, and empty text has no ids.
    Rows map one to one, so repeated rows and ties give repeated results, and an
    empty table an empty one.  A text of any length is encoded whole; what a
    Python worker remembers of its words is bounded in bytes.
    """
    add = [(ids, "binary"), *([(decoded, "string")] if decoded else [])]

    def make():
        c, text_of = codec(path), decoder(path)

        def work(texts):
            found = c.encode(texts)
            return [pa.array(found, pa.binary()), *([pa.array(map(text_of, found), pa.string())] if decoded else [])]

        return work

    return map_text(df, text_col, ["doc_id"] if keep is None else keep, add, make)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the decoded text of a binary ``ids`` column (a column of that name is
    replaced); null and empty ids give ''.  Only the vocabulary's token list is
    held.  Rows map one to one; an empty table gives an empty one."""
    kept = df.select(*[quoted(c) for c in df.columns if c.lower() != decoded.lower()])
    at = kept.columns.index(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        text_of = decoder(path)
        for b in batches:
            texts = pa.array([text_of(x or b"") for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=schema.names)

    return kept.mapInArrow(run, schema)
