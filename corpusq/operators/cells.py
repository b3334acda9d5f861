"""Approximate vector search: cells that grow with the table, and codes.

Cells come from two levels of k-means over a bounded sample, about as many as the
square root of the rows.  Every row is indexed by its nearest cell and by a code
of what is left of it beside the cell's centre (a byte for four dimensions).  A
question meets the codes in its nearest cells; the best of them are compared
exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.vectors import dot, unit
from corpusq.shared import ship, stored

from .embed import has_embedding
from .fulltext import small_or_merged
from .scan import best

#: Questions of a pass
MOST_QUESTIONS = 4096
#: Rows that cells and codes are learnt from, at most; rows of a cell, and of its sample, at least
SAMPLE, CODE_SAMPLE, LEAST = 50_000, 10_000, 8
#: Codes of a cell that are compared in one task, about; larger cells are cut
MOST_IN_CELL = 50_000
DIMS, ITERATIONS = 4, 8


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centres of each row, in order."""
    far = (centres**2).sum(1) / 2 - x @ centres.T
    if n == 1:
        return far.argmin(1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of Lloyd's iterations from rows drawn at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ITERATIONS):
        own = nearest(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


@dataclass
class Cells:
    """Centres, and for each four dimensions the codes' centres of what is left."""

    centres: np.ndarray
    codes: list[np.ndarray]

    def code(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = x - self.centres[cell]
        return np.stack([nearest(left[:, DIMS * j : DIMS * j + DIMS], c)[:, 0] for j, c in enumerate(self.codes)], 1).astype(np.uint8)

    def decode(self, code: np.ndarray, cell: int) -> np.ndarray:
        return self.centres[cell] + np.concatenate([c[code[:, j]] for j, c in enumerate(self.codes)], 1)


def learn_cells(sample: np.ndarray, rows: int, seed: int = 5) -> Cells:
    """Cells for a table of so many rows, from a sample of its unit vectors."""
    want = max(1, min(math.isqrt(rows), len(sample) // LEAST))
    coarse = kmeans(sample, max(1, math.isqrt(want)), seed)
    own, centres = nearest(sample, coarse)[:, 0], []
    for c in range(len(coarse)):
        mine = sample[own == c]
        if len(mine):
            centres.append(kmeans(mine, max(1, round(want * len(mine) / len(sample))), seed + c))
    cells = Cells(np.concatenate(centres), [])
    few = sample[:CODE_SAMPLE]
    left = few - cells.centres[nearest(few, cells.centres)[:, 0]]
    cells.codes = [kmeans(left[:, j : j + DIMS], 256, seed) for j in range(0, sample.shape[1], DIMS)]
    return cells


def cells_topk(questions: DataFrame, vectors: DataFrame, k: int, probes: float = 0.6, rerank: int = 10, most: float = 0.03, key: str = "vec_id", column: str = "embedding", seed: int = 5) -> DataFrame:
    """``(question_id, key, score, rank)``: about what ``vector_topk`` finds.

    ``probes``: the share of cells whose codes a question looks at (four cells at
    least; vectors without clusters need many, others few).  ``rerank`` times k
    rows of each question are compared exactly, but no more than a share ``most``
    of all rows, and k at least.  Cells are
    learnt from at most ``SAMPLE`` rows (those whose key hashes lowest); every
    row is indexed.  Null and empty vectors are passed over; all others must be
    of one length.  With all probes and a large ``rerank`` the result is exact.
    """
    ship(vectors.sparkSession)
    ready = lambda df, name, c: df.select(F.col(name), unit(F.col(c)).alias("vector")).where(has_embedding(F.col("vector")))
    rows, asked = ready(vectors, key, column), ready(questions, "question_id", "embedding")
    total = rows.count()
    sample = np.array([r.vector for r in rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("vector").collect()])
    if not len(sample):
        return asked.select("question_id").join(rows.select(key), F.lit(False)).select("question_id", key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    cells = learn_cells(sample, total, seed)
    looks = min(len(cells.centres), max(4, math.ceil(probes * len(cells.centres))))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    flat = lambda b: np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = nearest(flat(b), cells.centres)[:, 0] if b.num_rows else np.zeros(0, int)
            code = cells.code(flat(b), cell) if b.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=[key, "cell", "code"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = nearest(flat(b), cells.centres, looks) if b.num_rows else np.zeros((0, 1), int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["question_id", "vector", "cells"])

    index = stored(rows.mapInArrow(put, f"{key} {kind(rows, key)}, cell int, code binary"))
    # one row for each cell: into how many pieces it is cut
    pieces = index.groupBy("cell").agg(F.ceil(F.count("*") / MOST_IN_CELL).cast("int").alias("pieces"))
    cut = F.broadcast(stored(pieces))
    dealt = index.join(cut, "cell").select(key, "code", "cell", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int").alias("piece"))
    meets = asked.mapInArrow(look, f"question_id {kind(asked, 'question_id')}, vector array<double>, cells array<int>")
    meets = stored(meets.withColumn("cell", F.explode("cells")).join(cut, "cell").select("question_id", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")))
    few = max(k, min(rerank * k, int(most * total)))
    names = ["question_id", key, "near"]

    def compare(own: pa.Table, by: pa.Table) -> pa.Table:
        ids, keys, out = by.column("question_id"), own.column(key), ([], [], [])
        if own.num_rows and by.num_rows:
            code = np.array([np.frombuffer(c.as_buffer(), np.uint8) for c in own.column("code")])
            q = np.array(by.column("vector").to_pylist())
            near = q @ cells.decode(code, own.column("cell")[0].as_py()).T
            n = min(few, near.shape[1])
            top = np.argpartition(-near, n - 1, axis=1)[:, :n]
            out = (np.repeat(np.arange(len(q)), n), top.ravel(), np.take_along_axis(near, top, 1).ravel())
        take = lambda c, at: c.take(pa.array(at, pa.int64()))
        return pa.table([take(ids, out[0]), take(keys, out[1]), pa.array(out[2], pa.float64())], names=names)

    found = []
    blocks = max(1, math.ceil(questions.count() / MOST_QUESTIONS))
    for n in range(blocks):
        some = meets.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == n)
        pair = dealt.groupBy("cell", "piece").cogroup(some.groupBy("cell", "piece"))
        near = pair.applyInArrow(compare, f"question_id {kind(asked, 'question_id')}, {key} {kind(rows, key)}, near double")
        found.append(best(near, few, F.desc("near"), F.col(key)).select("question_id", key))
    likely = stored(reduce(DataFrame.unionByName, found))
    again = asked.withColumnRenamed("vector", "asked")
    both = rows.join(small_or_merged(likely), key).join(again.hint("merge"), "question_id")
    scored = both.select("question_id", key, F.round(dot(F.col("vector"), F.col("asked")), 9).alias("score"))
    return best(scored, k, F.desc("score"), F.col(key))
