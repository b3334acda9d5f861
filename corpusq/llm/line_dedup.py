"""Lines that many documents share, by DataFrame functions alone.

Hashes of lines are dealt out by ranges, sorted by hash, document and position
in each range, and streamed: the first line of each document is told from its
repeats, documents are counted, and what is to go is emitted as positions.  They
come back as one compressed bitmap for each document; the text is never shuffled
for it.  A hash that holds over a 500th of the lines (so there are under 500) is
counted with partial sums and sent to the tasks instead of being dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import let

from .common import quoted, stored

#: White space that does not count at either end of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_lines(text: Column) -> Column:
    """The parts of a text between line feeds; null and empty are one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(id, t, pos, h)``: every line that counts, by the hash of its key.

    ``t`` is the hash of the whole text.  Both hashes have 128 bits.
    """
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    keys = F.transform(text_lines(F.translate(text, UPPER, LOWER)), lambda x: F.btrim(x, F.lit(BLANKS)))
    each = docs.select(F.col(quoted(id_col)).alias("id"), text_hash(text).alias("t"), F.posexplode(keys).alias("pos", "key"))
    return each.where(F.char_length("key") >= min_chars).select("id", "t", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("h"))


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, t, n_dropped, bitmap)``: which lines of a document go, for the
    documents that lose one.

    A line's key is the line without white space at either end, A to Z in lower
    case.  Keys of ``min_chars`` code points or more that stand in ``min_docs``
    documents or more lose all their lines with ``keep="none"``, and all but the
    first, by id and position, with ``keep="first"`` (null ids come first).

    Documents are rows; rows that are equal in id and text share a bitmap, and
    count as one document.  Null text is one empty line; empty lines never go
    unless ``min_chars`` is 0.  A text of any length is read whole.  An empty
    table gives none.
    """
    lines = stored(line_occurrences(docs, id_col, text_col, min_chars))
    doc = F.struct("id", "t")
    rows = lines.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    rows = stored(rows)
    # one row: how many lines can go at all
    total = rows.agg(F.sum("n")).first()[0] or 0
    many = F.broadcast(rows.where(F.col("n") > total // 500 + 64).select("h"))

    hot = lines.join(many, "h")
    # two steps of partial sums: documents of a hash, then their number
    of_doc = hot.groupBy("h", "id", "t").agg(F.min("pos").alias("pos"))
    found = of_doc.groupBy("h").agg(F.count("*").alias("docs"), F.min(F.struct("id", "t", "pos")).alias("first")).where(F.col("docs") >= min_docs)
    gone = [hot.join(F.broadcast(found), "h").select("id", "t", "pos", "first")]

    order = Window.partitionBy("h").orderBy("id", "t", "pos")
    whole = Window.partitionBy("h").orderBy("id", "t", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = lines.join(many, "h", "left_anti").repartitionByRange("h").sortWithinPartitions("h", "id", "t", "pos")
    streamed = dealt.withColumn("new", ~F.coalesce(F.lag(doc).over(order) == doc, F.lit(False)).cast("boolean"))
    streamed = streamed.withColumn("docs", F.count_if("new").over(whole)).withColumn("first", F.first(F.struct("id", "t", "pos")).over(whole))
    gone.append(streamed.where(F.col("docs") >= min_docs).select("id", "t", "pos", "first"))

    dropped = gone[0].unionByName(gone[1])
    if keep == "first":
        dropped = dropped.where(~F.struct("id", "t", "pos").eqNullSafe(F.col("first")))
    places = dropped.groupBy("id", "t").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    return places.select(F.col("id").alias(id_col), "t", F.size("places").alias("n_dropped"), packed(F.col("places")).alias("bitmap"))


def packed(places: Column) -> Column:
    """A bitmap as run lengths: kept, dropped, kept, dropped, ... from sorted
    places to drop.  A run under 128 takes a byte, others four with the top bit
    set; what is kept after the last dropped line is left out."""

    def runs(p: Column) -> Column:
        firsts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
        lasts = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
        pairs = F.arrays_zip(firsts.alias("a"), lasts.alias("b"), F.concat(F.array(F.lit(-1)), lasts).alias("before"))
        real = F.slice(pairs, 1, F.size(firsts))
        return F.flatten(F.transform(real, lambda r: F.array(r["a"] - r["before"] - 1, r["b"] - r["a"] + 1)))

    one = lambda n: F.when(n < 128, F.lpad(F.hex(n), 2, "0")).otherwise(F.lpad(F.hex(n.cast("long") + (1 << 31)), 8, "0"))
    return F.unhex(F.array_join(F.transform(let(places, runs), one), ""))


def kept_lines(text: Column, bitmap: Column) -> Column:
    """The lines of a text that its bitmap keeps; all without one."""

    def lengths(codes: Column) -> Column:
        size = lambda c: F.when(F.length(c) == 2, F.conv(c, 16, 10).cast("int")).otherwise((F.conv(c, 16, 10).cast("long") - (1 << 31)).cast("int"))
        return F.transform(codes, size)

    codes = F.regexp_extract_all(F.hex(F.coalesce(bitmap, F.lit(b""))), F.lit("[0-7][0-9A-F]|[89A-F][0-9A-F]{7}"), F.lit(0))
    flags = F.flatten(F.transform(lengths(codes), lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return let(flags, lambda f: F.filter(text_lines(text), lambda x, i: F.coalesce(F.get(f, i), F.lit(True))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: str = "kept", dropped: str = "n_dropped") -> DataFrame:
    """The documents with the text that stays (``kept``), the number of lines
    they had (``n_lines``) and lost.  Columns of these names are replaced."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    key = [F.col(quoted(id_col)).alias("__id"), F.col("t").alias("__t")]
    marks = bitmaps.select(*key, F.col("n_dropped").alias("__lost"), F.col("bitmap").alias("__map"))
    mine = docs.withColumn("__t2", text_hash(text))
    same = mine[quoted(id_col)].eqNullSafe(marks["__id"]) & (F.col("__t2") == F.col("__t"))
    both = mine.join(marks.hint("merge"), same, "left")
    new = {kept.lower(), "n_lines", dropped.lower()}
    rest = [F.col(quoted(c)) for c in docs.columns if c.lower() not in new]
    return both.select(
        *rest,
        F.size(text_lines(F.col(quoted(text_col)))).cast("long").alias("n_lines"),
        F.coalesce("__lost", F.lit(0)).cast("long").alias(dropped),
        F.array_join(kept_lines(F.col(quoted(text_col)), F.col("__map")), "\n").alias(kept),
    )


#: SQL for DuckDB of the registered query.
SQL = r"""WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id"""
