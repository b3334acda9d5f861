"""Token-id files: every document's ids in ascending document order, coded with
Simple-8b, written by Spark and read back.

A file set is a folder of Parquet files, one per range of documents.  A row is
a segment of consecutive documents: ``part`` and ``segment`` (its place),
``base`` (ids before it in its part), ``n_ids``, ``doc_id`` (array),
``lengths`` (Simple-8b of the documents' id counts) and ``ids`` (Simple-8b).
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .bpe import SPACE, byte_symbols, spaced, unassigned
from .common import pieces, quoted

#: ids in a segment, about
SEGMENT_IDS = 1_000_000
#: Bytes that a Python worker remembers of runs of characters, twice at most;
#: longer runs are not remembered
REMEMBERED, LONGEST = 100_000_000, 200
#: Bytes of text cut at once, about
PIECE = 4_000_000

STORE_SCHEMA = "part int, segment int, base long, n_ids long, doc_id array<long>, lengths binary, ids binary"

_symbol = byte_symbols()
#: The same for whole strings of bytes, but for the blank
_symbols = str.maketrans({chr(b): c for b, c in _symbol.items() if b != 0x20})
_blank = re.compile(f"[{SPACE}]+")

#: Classes of the bytes of a lower-cased text of ASCII and the letters from U+00C0
#: to U+00FF, whose two bytes both count as letters; other lead bytes are ``RARE``
WHITE, LETTER, DIGIT, OTHER, RARE = range(5)
_class = np.full(256, OTHER, np.uint8)
_class[np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8)] = WHITE
_class[0x30:0x3A] = DIGIT
_class[0x61:0x7B] = _class[0x80:0xC0] = _class[0xC3] = LETTER
_class[0xC0:0xC3] = _class[0xC4:] = RARE
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20
#: The cut of the vocabulary that ``ChunkEncoder.cut_bytes`` restates
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkEncoder(dict):
    """Ids of texts by the tokenizers library, for a lower-casing vocabulary whose
    pre-tokeniser drops white space.

    Texts of ASCII and the letters from U+00C0 to U+00FF are lower-cased and cut
    into pre-tokens as arrays of bytes, many texts at once, and each distinct
    pre-token (a key of bytes) is merged by the library once.  The ids of other
    texts are those of their runs of non-blank characters (keys of str), each
    normalised, cut and merged by the library once; a run that holds a
    special-token string goes through it whole, and so does a text with a
    character that the library may know and Python does not."""

    def __init__(self, path: str):
        super().__init__()
        self.old, self.size = {}, 0
        self.unknown, self.unknown_far = unassigned(0, 0x10000).search, unassigned(0x10000, 0x110000).search
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        cut, byte = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or not cut["invert"] or cut["behavior"] != "Removed" or byte["use_regex"] or byte["add_prefix_space"]:
            raise ValueError("a lower-casing vocabulary that drops white space is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.cut = regex.compile(spaced(cut["pattern"]["Regex"])).findall
        self.by_bytes = cut["pattern"]["Regex"] == CUT and bool(spec["model"]["end_of_word_suffix"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merge = self.tokenizer.model.tokenize
        # the library's model alone, over pre-tokens between blanks
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.suffix = spec["model"]["end_of_word_suffix"]
        # the four bytes of every id
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.id_bytes = [struct.pack("<I", i) for i in range(max(size, 1 + max(self.tokenizer.get_vocab().values(), default=0)))]
        self.last = np.zeros(len(self.id_bytes), bool)
        self.last[[i for t, i in self.model.get_vocab().items() if t.endswith(self.suffix or "\n")]] = True

    def piece(self, piece: str) -> bytes:
        """Ids of a normalised pre-token by the library's model."""
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join(map(_symbol.__getitem__, piece.encode()))
        coded = self.id_bytes
        return b"".join([coded[t.id] for t in self.merge(piece)])

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge_all(self, parts: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens by the library's model, which is asked once for all:
        the last id of each is one that ends a word."""
        text = b" ".join(parts).decode("latin-1").translate(_symbols)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stop = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        if len(stop) != len(parts):
            return [self.piece(p.decode()) for p in parts]
        coded = ids.tobytes()
        return [coded[a:b] for a, b in zip([0, *stop], stop)]

    def look_up(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens; those of white space are none."""
        found = list(map(self.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i in new:
            found[i] = b"" if parts[i].isspace() else self.old.pop(parts[i], None)
        unmet = [i for i in new if found[i] is None]
        for i, ids in zip(unmet, self.merge_all([parts[i] for i in unmet])) if unmet else ():
            found[i] = ids
        for i in new:
            self.remember(parts[i], found[i])
        return found

    def __missing__(self, chunk: str) -> bytes:
        # most words are letters of ASCII, and need no look at anything else
        if (ids := self.old.pop(chunk, None)) is None:
            if chunk.isascii() and chunk.isalpha():
                coded = self.id_bytes
                ids = b"".join([coded[t.id] for t in self.merge(chunk.lower())])
            else:
                ids = self.coded(chunk)
        self.remember(chunk, ids)
        return ids

    def remember(self, chunk: str | bytes, ids: bytes) -> None:
        n = len(chunk)
        if n <= LONGEST:
            self.size += n + len(ids) + 130
            if self.size > REMEMBERED:
                self.old, self.size = dict(self), 0
                self.clear()
            self[chunk] = ids

    def coded(self, chunk: str) -> bytes:
        if not chunk.isascii() and (self.unknown(chunk) or max(chunk) > "\uffff" and self.unknown_far(chunk)):
            raise LookupError("a character of another Unicode version")
        low = chunk.lower() if plain(chunk) else self.normalize(chunk)
        if low.isalpha():
            return self.piece(low)
        if any(s in chunk for s in self.special):
            return self.whole(chunk)
        if low[:-1].isalpha():
            # a run of letters and one other character
            return self[low[:-1]] + self[low[-1]]
        parts = self.cut(low)
        return self.piece(low) if parts == [low] else b"".join(map(self.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow array without nulls."""
        if not len(column):
            return []
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        far = self.far_rows(data, edges)
        if not len(far):
            return self.encode_bytes(data, edges)
        near = np.ones(len(column), bool)
        near[far] = False
        out = np.empty(len(column), object)
        out[near] = self.encode_column(column.filter(pa.array(near)))
        for i in far.tolist():
            out[i] = self.encode_text(column[i].as_py().decode())
        return out.tolist()

    def far_rows(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Rows that ``encode_bytes`` can't do: with other characters than it
        knows, or with a special-token string."""
        if not self.by_bytes:
            return np.arange(len(edges) - 1)
        second = np.flatnonzero(data == 0xC3) + 1
        found = [np.flatnonzero(_class[data] == RARE), second[np.isin(data[second], (0x97, 0xB7))]]  # the signs \u00d7, \u00f7
        raw = data.tobytes()
        for s in self.special:
            if (b := s.encode()) in raw:
                found.append(np.array([m.start() for m in re.finditer(re.escape(b), raw)]))
        return np.unique(np.searchsorted(edges, np.concatenate(found), "right") - 1)

    @staticmethod
    def cut_bytes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower-cased bytes of texts, and where a pre-token or white space begins."""
        size = len(data)
        low = np.zeros(size + 3, np.uint8)
        low[:size] = _lower[data]
        second = np.flatnonzero(data == 0xC3) + 1
        low[second] += (low[second] <= 0x9E).astype(np.uint8) << 5
        kind = _class[low]
        new, first = kind == DIGIT, np.zeros(size + 3, bool)
        new[1:] |= kind[1:] != kind[:-1]
        first[edges] = True
        new |= first
        # 's and the like begin with a quote that no other sign stands before
        q = np.flatnonzero(low[:size] == 0x27)
        q = q[new[q] & new[q + 1] & (kind[q + 1] == LETTER) & ~first[q + 1]]
        if len(q):
            a, b = low[q + 1], low[q + 2]
            two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (b == ord("l")) & (a == b)) & ~first[q + 2]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            new[q[one | two] + 1] = False
            new[q[one] + 2] = True
            new[q[two] + 3] = True
        return low[:size], np.flatnonzero(new[:size])

    def encode_bytes(self, data: np.ndarray, edges: np.ndarray) -> list[bytes]:
        low, starts = self.cut_bytes(data, edges)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(low))), pa.py_buffer(low)])
        coded = cut.dictionary_encode()
        found = self.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes, which = np.fromiter(map(len, found), np.int64, len(found)) // 4, coded.indices.to_numpy()
        begin, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        n = sizes[which]
        stop = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(begin[which] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
        at = (stop[np.searchsorted(starts, edges)] * 4).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def encode_text(self, text: str) -> bytes:
        raw = text
        # words that differ in case only are remembered once; a special-token
        # string counts only as it stands, not where lower-casing makes one
        if plain(text):
            low = text.lower()
            text = text if any(s in low for s in self.special) else low
        # str.split() also cuts at the four information separators, which are not White_Space
        words = filter(None, _blank.split(text)) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        try:
            return b"".join(map(self.__getitem__, words))
        except LookupError:
            return self.whole(raw)


def plain(text: str) -> bool:
    """The library's normaliser does to it just what str.lower() does: it is
    composed, and no letter of it is lowered by context or to two letters."""
    return text.isascii() or ("\u03a3" not in text and "\u0130" not in text and unicodedata.is_normalized("NFC", text))


_encoders: dict[str, ChunkEncoder] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every document, each followed by ``end_id``, to ``path``.

    Documents are in ascending ``id_col`` order (null ids first; rows with the
    same id in the order of their text's hash, repeated rows each).  Null and
    empty texts: their only id is ``end_id``.  A text of any length is encoded
    whole, and its ids stand in one segment, which is then as long as it needs.
    An empty table writes no segment.  Other columns are not written, whatever
    their names.
    """
    src = docs.select(
        F.col(quoted(id_col)).cast("long").alias("doc_id"),
        F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"),
    )
    tie = F.xxhash64("text")
    ordered = src.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    end = struct.pack("<I", end_id)

    def run(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = ChunkEncoder(tokenizer)
        encode = _encoders[tokenizer].encode_column
        docs_, coded, size, base, ordinal = [], [], 0, 0, 0

        def segment():
            lengths = np.array([len(x) // 4 for x in coded], np.uint64)
            ids = np.frombuffer(b"".join(coded), "<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([0], pa.int32()),
                    pa.array([ordinal], pa.int32()),
                    pa.array([base], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([docs_], pa.list_(pa.int64())),
                    pa.array([simple8b.encode(lengths)], pa.binary()),
                    pa.array([simple8b.encode(ids)], pa.binary()),
                ],
                names=["part", "segment", "base", "n_ids", "doc_id", "lengths", "ids"],
            )

        for b in batches:
            for part in pieces(b, limit=PIECE):
                coded += [x + end for x in encode(part.column(1))]
                docs_ += part.column(0).to_pylist()
                size = sum(map(len, coded)) // 4  # of this segment
                if size >= SEGMENT_IDS:
                    yield segment()
                    docs_, coded, base, ordinal = [], [], base + size, ordinal + 1
        if docs_:
            yield segment()

    ordered.mapInArrow(run, STORE_SCHEMA).withColumn("part", F.spark_partition_id()).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a token file set: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit)."""
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    # one row for each file: its ids and those of the files before it
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))

    def run(batches):
        for b in batches:
            part, _, base, _, doc, lengths, ids = (b.column(i) for i in range(7))
            for r in range(b.num_rows):
                n = simple8b.decode(lengths[r].as_py()).astype(np.int64)
                flat = simple8b.decode(ids[r].as_py()).astype("<u4")
                stop = np.cumsum(n)
                rows = doc[r].values
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), part[r].as_py(), np.int32)),
                        rows,
                        pa.array(base[r].as_py() + stop - n),
                        pa.array(n),
                        pa.array([flat[e - k : e].tobytes() for e, k in zip(stop.tolist(), n.tolist())], pa.binary()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    documents = store.select("part", "segment", "base", "n_ids", "doc_id", "lengths", "ids").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")
    # bounded: sixteen bytes for each file of the set
    return documents.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("part_base")).alias("start"), "n_tokens", "ids")

