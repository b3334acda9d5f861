"""Importance of documents for a target: hashed n-gram counts of both.

Words come from the pre-tokenizer of the tokenizers library, split by an
expression over text with A to Z in lower case; nothing is trained.  A feature is
a window of one to three words, from the offsets of its first to those of its
last.  Its crc32 is put together from those of its words, as arrays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from corpusq.operators.places import places

from .common import pieces, quoted, stored

#: What a word is, and what parts two words.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Fixed value: the reversed polynomial of crc32.
POLYNOMIAL = 0xEDB88320
#: Characters given to the pre-tokenizer at once.
PART = 1 << 18
#: Words that a task remembers.
REMEMBER = 200_000


def advance(x: np.ndarray) -> np.ndarray:
    """A crc after one more zero byte, without the final inversions."""
    for _ in range(8):
        x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return x


def apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of crcs, given for each value of each of their bytes."""
    out = table[0][x & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Shift:
    """crc(a + b) from crc(a), crc(b) and the length of b."""

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
        few = [table]
        for _ in range(64):
            few.append(advance(few[-1]))
        # lengths 0 to 63, then 64, 128, 256, ...
        self.few, self.many = np.stack(few[:64]), [few[64]]
        while len(self.many) < 26:
            self.many.append(apply(self.many[-1], self.many[-1]))

    def join(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        low = length & 63
        out = self.few[low, 0, a & np.uint32(255)]
        for k in (1, 2, 3):
            out = out ^ self.few[low, k, (a >> np.uint32(8 * k)) & np.uint32(255)]
        high = length >> 6
        for k in range(int(high.max(initial=0)).bit_length()):
            at = np.flatnonzero(high >> k & 1)
            out[at] = apply(self.many[k], out[at])
        return out ^ b


def text_parts(text: str) -> Iterator[str]:
    """A text in parts of about ``PART`` characters that cut no word."""
    at = 0
    while len(text) - at > PART:
        cut = BETWEEN.search(text, at + PART)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class Features:
    """Buckets of the word n-grams of texts."""

    def __init__(self, buckets: int, longest: int = 3) -> None:
        self.split, self.shift = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True), Shift()
        self.buckets, self.longest = buckets, longest
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[tuple[int, int, int]] = []

    def look_up(self, word: str) -> int:
        raw = word.encode()
        self.known[word] = n = len(self.rows)
        self.rows.append((zlib.crc32(raw), zlib.crc32(b" " + raw), len(raw) + 1))
        return n

    def words(self, text: str) -> np.ndarray:
        """``(crc, crc of a blank and the word, its length with the blank)``."""
        found = []
        for part in text_parts(text.encode().lower().decode()):
            known, look_up = self.known, self.look_up
            ids = [known[w] if w in known else look_up(w) for w, _ in self.split.pre_tokenize_str(part)]
            table = np.array(self.rows, np.int64).reshape(-1, 3) if len(ids) * 20 > len(self.rows) else np.array([self.rows[i] for i in ids], np.int64).reshape(-1, 3)
            found.append(table[ids] if len(table) == len(self.rows) and len(ids) else table[: len(ids)])
            if len(self.rows) > REMEMBER:
                self.forget()
        return np.concatenate(found)

    def of(self, texts: list[str]) -> tuple[list[int], list[np.ndarray]]:
        """How many words each text has, and the buckets of its features."""
        each = [self.words(t) for t in texts]
        sizes = [len(w) for w in each]
        every = np.concatenate(each) if each else np.zeros((0, 3), np.int64)
        crc, joined, length = every[:, 0].astype(np.uint32), every[:, 1].astype(np.uint32), every[:, 2]
        runs = [crc % np.uint32(self.buckets)]
        for k in range(1, self.longest):
            crc = self.shift.join(crc[:-1], joined[k:], length[k:]) if len(crc) else crc
            runs.append(crc % np.uint32(self.buckets))
        out, at = [], 0
        for n in sizes:
            out.append(np.concatenate([r[at : at + max(0, n - k)] for k, r in enumerate(runs)]))
            at += n
        return sizes, out


def code_features(docs: DataFrame, keep: list[Column], text: Column, buckets: int) -> DataFrame:
    """The ``keep`` columns, ``n_words``, ``n_features`` and ``codes``: the bucket
    of every feature as a little-endian number of 16 bits, or of 32 if there are
    more buckets.

    Null text has no words.  Repeated rows are coded again, an empty table stays
    empty, a text of any length is read whole, in parts that cut no word.  Kept
    columns must not have these names.
    """
    src = docs.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("__text"))
    schema = src.drop("__text").schema.add("n_words", "long").add("n_features", "long").add("codes", "binary")
    names, kind = schema.names, code_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for b in batches:
            for part in pieces(b):
                sizes, found = features.of(part.column(part.num_columns - 1).to_pylist())
                new = [pa.array(sizes, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype(kind).tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=names)

    return src.mapInArrow(run, schema)


def code_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(coded: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows.  A task gives at most one row for
    each bucket; what reaches the driver is one number for each bucket."""
    kind = code_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for codes in b.column(0):
                total += np.bincount(np.frombuffer(codes.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in coded.select("codes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By how much a feature speaks for the target, in thousandths, rounded down."""
    n = len(source)
    up = (target + 1).astype(float) * (source.sum() + n)
    return np.floor(1000 * np.log(up / ((source + 1).astype(float) * (target.sum() + n)))).astype(np.int64)


def weigh(coded: DataFrame, gains: np.ndarray) -> DataFrame:
    """Sum of the gains of each row's features (``weight``), without its codes."""
    kind = code_type(len(gains))
    schema = coded.drop("codes").schema.add("weight", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(b.schema.names.index("codes"))
            weight = [int(gains[np.frombuffer(c.as_buffer(), kind)].sum()) for c in codes]
            rest = [c for n, c in zip(b.schema.names, b.columns) if n != "codes"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(weight, pa.int64())], names=names)

    return coded.mapInArrow(run, schema)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents drawn without replacement in proportion to their importance for
    ``target`` (a table with the text column): ``(id, n_features, weight, score,
    rank)`` for every document.

    ``score`` is the weight with noise that depends on ``seed`` and id (a null
    id counts as empty).  Of those with ``least_words`` words or more, ``percent``
    in a hundred are drawn, the highest scores first, ties by smaller id (null
    first), then smaller weight; ``rank`` is null for the others.  Null text has
    no features and weight 0.  Rows that are equal in all this share nothing:
    each has its own rank.  Empty tables give no rows, an empty target counts 0.
    """
    coded = stored(code_features(docs, [F.col(quoted(id_col)).alias("id")], F.col(quoted(text_col)), buckets))
    wanted = code_features(target, [], F.col(quoted(text_col)), buckets)
    gains = bucket_gains(bucket_counts(coded, buckets), bucket_counts(wanted, buckets))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = stored(weigh(coded, gains).withColumn("score", F.col("weight") + noise))
    able = F.col("n_words") >= least_words
    # one row: how many can be drawn
    draw = percent * weighed.where(able).count() // 100
    ranked = places(weighed.where(able), F.desc("score"), F.asc("id"), F.asc("weight"), F.asc("n_features"), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = weighed.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


#: SQL for DuckDB of the registered query.
SQL = r"""WITH steps AS (SELECT list(r ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) AS r FROM (SELECT unnest(range(256)) AS b))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM d),
asked AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM b),
doc_grams AS (SELECT doc_id, g, count(*) AS n FROM grams GROUP BY ALL),
known AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM doc_grams UNION SELECT g FROM asked)),
hashed AS (SELECT g, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM known, steps),
s AS (SELECT bucket, sum(n) AS s FROM doc_grams JOIN hashed USING (g) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM asked JOIN hashed USING (g) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000)::DOUBLE / ((coalesce(s, 0) + 1) * (tt + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM doc_grams JOIN hashed USING (g) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * (SELECT count(*) FROM drawn) // 100 THEN place END AS rank FROM scored LEFT JOIN drawn USING (doc_id)"""
