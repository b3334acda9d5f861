"""How filters on documents interact: what each removes in every order.

Words, distinct words, capitals, code points and symbols of a text come from one
run of a byte transducer over it, given by two tables: the next state, and what
is put out on the way.  Both are applied to a whole batch of texts as arrays.
Word spans go into a hash table by document; a span counts as known only if its
bytes equal those that stand there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, spread_join, stored

#: Bytes that the transducer runs over at once.
PIECE = 1 << 19
#: White space, and the symbols that fail condition D.
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#$%&*|"
#: States of the transducer, and its outputs
GAP, WORD = 0, 1
BEGIN, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
MEASURES = ["words", "distinct_words", "capitals", "code_points", "symbols"]


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """``(to, out)``: next state and outputs by state and byte.  Blanks are single
    bytes, and no byte of a longer UTF-8 sequence equals one, so the next state
    is the same from both states; only the beginning of a word depends on it."""
    byte = np.arange(256)
    to = np.where(np.isin(byte, list(BLANKS)), GAP, WORD).astype(np.uint8)
    out = np.where((byte >= 65) & (byte <= 90), CAPITAL, 0) | np.where(byte & 0xC0 != 0x80, POINT, 0) | np.where(np.isin(byte, list(SYMBOLS)), SYMBOL, 0)
    begins = np.where(to == WORD, BEGIN, 0)
    return np.stack([to, to]), np.stack([out | begins, out]).astype(np.uint8)


TO, OUT = transducer()
#: Odd multiplier of the hash, its inverse modulo 2**64, and their powers
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Audit:
    """Measures of the texts of a batch."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, PIECE), powers(INVERSE, PIECE)

    def measures(self, column: pa.Array) -> np.ndarray:
        """A row of ``MEASURES`` for each text of a string column without nulls."""
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out, n = np.zeros((len(column), len(MEASURES)), np.int64), len(column)
        first = 0
        while first < n:
            last = int(np.searchsorted(at, at[first] + PIECE, "right")) - 1
            if last <= first:
                out[first] = self.long(data[at[first] : at[first + 1]])
                first += 1
                continue
            last = min(last, n)
            piece = data[at[first] : at[last]]
            out[first:last] = self.piece(piece, at[first : last + 1] - at[first])[0]
            first = last
        return out

    def piece(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Measures of the texts between the offsets, and the spans of their
        distinct words: start and stop."""
        n, size = len(at) - 1, len(data)
        out = np.zeros((n, len(MEASURES)), np.int64)
        if not size:
            return out, [np.zeros(0, np.int64)] * 2
        to = TO[GAP][data]
        state = np.empty_like(to)
        state[0], state[1:] = GAP, to[:-1]
        starts = at[:-1][at[:-1] < at[1:]]
        state[starts] = GAP
        put = OUT[state, data]
        # a word ends before a blank and at the end of its text
        ends = np.zeros(size + 1, bool)
        ends[1:-1] = to[1:] == GAP
        ends[at[1:]] = True
        ends[1:] &= to == WORD
        ends[0] = False
        begin, stop = np.flatnonzero(put & BEGIN), np.flatnonzero(ends)
        text = np.searchsorted(at, begin, "right") - 1
        new = self.distinct(data, begin, stop, text)
        for j, bit in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            total = np.concatenate([[0], np.cumsum(put & bit != 0)])
            out[:, j] = total[at[1:]] - total[at[:-1]]
        out[:, 0] = np.bincount(text, minlength=n)
        out[:, 1] = np.bincount(text[new], minlength=n)
        return out, [begin[new], stop[new]]

    def distinct(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which spans hold a word for the first time in their text.

        All spans are put into one open table at once.  A free slot goes to the
        smallest span that wants it; a span that meets another text or other
        bytes tries the next slot.
        """
        n = len(begin)
        if not n:
            return np.zeros(0, bool)
        if len(data) + 1 > len(self.up):
            self.up, self.down = powers(BASE, len(data)), powers(INVERSE, len(data))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])
        value = (run[stop] - run[begin]) * self.down[begin]
        length = stop - begin
        mixed = (value ^ (text.astype(np.uint64) << np.uint64(40)) ^ length.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        bits = max(4, int(2 * n).bit_length())
        slot, mask = (mixed >> np.uint64(64 - bits)).astype(np.int64), (1 << bits) - 1
        table = np.full(1 << bits, -1, np.int64)
        first, todo = np.zeros(n, bool), np.arange(n)
        words = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", words, 0, (1,))
        while len(todo):
            s = slot[todo]
            free = table[s] < 0
            table[s[free][::-1]] = todo[free][::-1]
            owner = table[s]
            mine = owner == todo
            first[todo[mine]] = True
            like = ~mine & (value[owner] == value[todo]) & (length[owner] == length[todo]) & (text[owner] == text[todo])
            at = np.flatnonzero(like)
            like[at] = same_bytes(eight, begin[owner[at]], begin[todo[at]], length[todo[at]])
            todo = todo[~(mine | like)]
            slot[todo] = (slot[todo] + 1) & mask
        return first

    def long(self, data: np.ndarray) -> np.ndarray:
        """Measures of a text over ``PIECE`` bytes: parts that end at a blank, and
        the distinct words of all parts in a set."""
        out, seen, at = np.zeros(len(MEASURES), np.int64), set(), 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            if end < len(data):
                gaps = np.flatnonzero(TO[GAP][data[at:end]] == GAP)
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # one word over the whole part: on to where it ends
                    while end < len(data) and not len(gaps := np.flatnonzero(TO[GAP][data[end : end + PIECE]] == GAP)):
                        end = min(end + PIECE, len(data))
                    end = end + int(gaps[0]) + 1 if end < len(data) else end
            part = data[at:end]
            counts, (begin, stop) = self.piece(part, np.array([0, len(part)]))
            out += counts[0]
            raw = part.tobytes()
            seen.update(raw[b:e] for b, e in zip(begin.tolist(), stop.tolist()))
            at = end
        out[1] = len(seen)
        return out


def same_bytes(eight: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans from a and b are equal: eight bytes at a time."""
    same, todo, done = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(todo):
        left = np.minimum(length[todo] - done, 8).astype(np.uint64)
        cut = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        equal = (eight[a[todo] + done] ^ eight[b[todo] + done]) & cut == 0
        same[todo[~equal]] = False
        done += 8
        todo = todo[equal & (length[todo] > done)]
    return same


def text_measures(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """The ``keep`` columns, and ``MEASURES`` of each text as longs.

    Null text counts as empty, which has 0 of everything.  Repeated rows are
    measured again, an empty table stays empty, a text of any length is read
    whole, in parts.  Kept columns must not have these names.
    """
    src = docs.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("__text"))
    schema = src.drop("__text").schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit = Audit()
        for b in batches:
            found = audit.measures(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(found[:, j]) for j in range(len(MEASURES)))], names=names)

    return src.mapInArrow(run, schema)


#: Failure conditions by letter, over the measures and ``copy``.
CONDITIONS: dict[str, Column | str] = {
    "A": "words < 200",
    "B": "100 * distinct_words < 50 * words",
    "C": "100 * capitals > 2 * code_points",
    "D": "symbols > 0",
    "E": "copy",
}


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, fails, good, toxic, n)``: how many documents of each source fail
    which conditions (bit k for the k-th of ``CONDITIONS``).

    A document is a copy if another with a smaller id has its text (by 256 bits
    of hash); one without an id is never a copy, and makes none.  Null text
    equals empty text, null source equals an empty one.  A document's labels are
    good or toxic if any row of its id says so; rows without an id have none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    measured = text_measures(docs, [F.col("doc_id").alias("id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("t")], F.col("text"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    own = [c for c in CONDITIONS if c != "E"]
    bits = lambda names: sum((F.when(F.expr(CONDITIONS[c]), 1 << list(CONDITIONS).index(c)).otherwise(0) for c in names), F.lit(0))
    rows = stored(measured.select("id", "part", "t", bits(own).cast("int").alias("own")).join(marks.hint("merge"), "id", "left"))
    first = stored(rows.groupBy("t").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    marked = spread_join(rows, first, "t", "n", rows.count()).withColumn("copy", copy)
    fails = (F.col("own") + bits(["E"])).cast("int").alias("fails")
    yes = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return marked.groupBy("part", fails, yes("good"), yes("toxic")).agg(F.count("*").alias("n"))


def steps(spark: SparkSession, letters: str) -> DataFrame:
    """``(filter_order, step, bit, before)``: every order of the filters, its
    steps, the step's filter and those before it as bits.  Their number is fixed
    by the filters, whatever the data: 600 for five."""
    bit = {c: 1 << k for k, c in enumerate(letters)}
    rows = [("".join(p), k + 1, bit[c], sum(bit[x] for x in p[:k])) for p in permutations(letters) for k, c in enumerate(p)]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def interactions(failed: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step.

    ``failed``: ``(part, fails, good, toxic, n)``.  Counted once into an array
    of all combinations for each part; the steps are sums over it.
    """
    size = 1 << len(letters)
    count = lambda m, ok: F.sum(F.when((F.col("fails") == m) & ok, F.col("n")).otherwise(0))
    cells = lambda ok: F.array(*[count(m, ok) for m in range(size)])
    parts = failed.groupBy("part").agg(cells(F.lit(True)).alias("cells"), cells(F.col("good")).alias("good"), cells(F.col("toxic")).alias("toxic"))
    each = parts.crossJoin(F.broadcast(steps(failed.sparkSession, letters)))

    def total(cells: str, ok) -> Column:
        picked = F.transform(F.col(cells), lambda n, m: F.when(ok(m), n).otherwise(F.lit(0).cast("long")))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda s, n: s + n)

    bit, before = F.col("bit"), F.col("before")
    has = lambda m, bits: m.bitwiseAND(bits) != 0
    here = lambda m: has(m, bit) & ~has(m, before)
    out = each.select(
        "part",
        "filter_order",
        "step",
        "bit",
        total("cells", lambda m: ~has(m, bit) & ~has(m, before)).alias("kept"),
        total("cells", here).alias("removed"),
        total("cells", lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        F.get("cells", bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the five filters removes, in every order, by source.

    One row, zeros included, for each source (``part``; null is empty), order
    and step; see ``failures`` for odd rows.  An empty table gives no rows.
    Other columns of both tables are not read.
    """
    return interactions(failures(docs, labels), "".join(CONDITIONS))


#: SQL for DuckDB of the registered query.
SQL = r"""WITH RECURSIVE orders AS (SELECT '' AS o UNION ALL SELECT o || c FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(o, c)),
steps AS (SELECT o AS filter_order, i AS step, substr(o, i, 1) AS f, substr(o, 1, i - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS i) WHERE length(o) = 5),
measured AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM measured LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM failed GROUP BY ALL),
each AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS bad, before <> '' AND translate(fails, before, '') <> fails AS gone FROM cells, steps),
summed AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE NOT bad AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE bad AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE bad AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = f), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE bad AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE bad AND NOT gone), 0) AS toxic_lost FROM each GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed"""
