"""Helpers the training-data operators share: Arrow mapping over a text column,
split rules, samples, joins on keys of which a few may be hot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.shared import drop_stored, passing, scratch, ship, stored, table  # noqa: F401  used by the operators

#: Bytes of text handled at once inside a Python task.
PIECE_CHARS = 500_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def prepare(spark: SparkSession, records: int = 512) -> None:
    """Ship the package and keep Arrow batches small, for long texts.  A batch
    size that the user has set stays."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary")) % modulus


def lowest(df: DataFrame, *by: str, limit: int, total: int) -> DataFrame:
    """The ``limit`` rows with the lowest hashes of the ``by`` columns.  ``total``
    is about the number of rows of ``df``: a task offers only rows that can be
    among them, so what reaches the driver does not grow with the number of tasks."""
    share = F.pmod(F.xxhash64(*by), F.lit(1 << 31))
    # a quarter more than are needed, and 200: to get fewer is many standard errors away
    likely = min(1.0, (1.25 * limit + 200) / max(total, 1))
    return df.where(share < int(likely * (1 << 31))).orderBy(share, *by).limit(limit)


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """Inner join with ``right``, which has one row for each key and in ``n`` how
    many rows of ``left`` hold it; ``total`` is their number.

    A key that holds over a 500th of the rows (so under 500 keys) is broadcast,
    and its rows stay where they are; only the others are dealt out by the key.
    """
    keys = [key] if isinstance(key, str) else key
    hot = F.col(n) > total // 500 + 64
    few = right.where(hot)
    near = left.join(F.broadcast(few), keys)
    far = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.where(~hot).hint("merge"), keys)
    return near.unionByName(far)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, longer if a column of that name (ignoring case) is taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def map_text(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    add: list[tuple[str, str]],
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
) -> DataFrame:
    """Run a batch function over a text column inside the partitions.

    ``make()`` is called once per task and returns a function from a list of
    texts (null becomes empty) to one Arrow array per added column.  The
    ``keep`` columns pass through; one whose name equals an added column
    (ignoring case) is replaced by it.  A text that is kept is sent once.
    """
    new = {n.lower() for n, _ in add}
    keep = [c for c in keep if c.lower() not in new]
    given = [F.col(quoted(c)) for c in keep]
    if text_col in keep and df.schema[text_col].dataType == T.StringType():
        at = keep.index(text_col)
    else:
        at = len(keep)
        given.append(F.col(quoted(text_col)).cast("string").alias(fresh("__text", keep)))
    src = df.select(*given)
    schema = T.StructType(src.schema.fields[: len(keep)])
    for name, kind in add:
        schema = schema.add(T.StructType.fromDDL(f"{quoted(name)} {kind}").fields[0])
    names, kept = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for part in pieces(b, at):
                arrays = work([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *arrays], names=names)

    return src.mapInArrow(run, schema)


def pieces(b: pa.RecordBatch, at: int = -1, limit: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text (column ``at``) or one row."""
    sizes = pc.binary_length(b.column(at % b.num_columns)).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + (n or 0) > limit:
            yield b.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < len(sizes):
        yield b.slice(start)
