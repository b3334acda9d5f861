"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that ``scratch`` has given out and nothing has removed yet
_given: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; a local session without one gets
    a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    _given.append(f"{base}/corpusq-{uuid.uuid4().hex}")
    return _given[-1]


def stored(df: DataFrame) -> DataFrame:
    """Write and read back: cuts the lineage, gives a true size, survives lost
    executors."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at)
    back._stored_at = at
    return back


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, [df._stored_at])


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if p in _given:
            _given.remove(p)


def clean(spark: SparkSession) -> None:
    """Remove all tables that operators wrote to the shared folder in this
    session.  Results that were not written yet can't be read after it."""
    remove(spark, list(_given))


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Remove the tables written inside the block when it ends, but for those
    of ``stored`` that are put in the list."""
    before, keep = set(_given), []
    yield keep
    read = {df._stored_at for df in keep}
    remove(spark, [p for p in _given if p not in before and p not in read])


def ship(spark: SparkSession) -> None:
    """Let executors import this package: add it as a py-file unless
    PYTHONPATH already leads to it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root.endswith(".zip") or root in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_corpusq_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "corpusq.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "corpusq")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._corpusq_shipped = True
