"""Near-duplicate vectors by spherical-cap filters.

Filters are directions from a structured product code: the dimensions are cut
into parts, each part has its own random unit vectors, and a filter is one of
them from every part.  A vector passes the filters whose direction it exceeds
by a threshold; they are list-decoded part by part with a bound on what the
remaining parts can add.

Vectors are joined on their filters.  Filters with the same leading parts stand
in one shard, as many as about a tile of vectors needs, so a vector goes out once
for each of its shards, not of its filters; a shard's vectors are compared.  A
pair is counted at the smallest shard that both are in, so links are never
written out: a shard gives each vector's number of links and a forest that holds
their components together.  A shard with many vectors (a large group of near
copies) is cut into tiles that are compared in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, spread_join, stored
from .components import connected_components

#: Vectors of one tile side, at most (about)
TILE = 1536
#: Chance of missing a pair exactly at the threshold that the filters are laid out for
MISS = 1e-5
#: Filters that every vector passes, at least
LEAST = 12
#: Shards over a tile of vectors that are broadcast, at most; more are joined
MOST_LARGE = 100_000
#: Other vectors of a label expected at a filter, and the share of them that pass it, at most
CROWD, SHARE = 48, 0.01
#: Distinct vectors up to which labels have the same filters
SMALL = round(CROWD / SHARE)
SEED = 9


class Caps:
    """Filters for ``dim`` dimensions, for a label of about ``n`` distinct vectors.

    More vectors get narrower caps, and more of them, so that a filter's crowd
    stays the same.
    """

    def __init__(self, dim: int, n: int, threshold: float):
        normal = NormalDist()
        passing = min(SHARE, CROWD / max(n, 1))
        z = normal.inv_cdf(1 - passing)
        # chance that a vector passes a filter that its partner passes
        tail = [normal.inv_cdf(1 - passing * (k + 0.5) / 64) for k in range(64)]
        slack = math.sqrt(max(1 - threshold**2, 1e-9))
        both = sum(normal.cdf((threshold * x - z) / slack) for x in tail) / 64
        codes = math.log(1 / MISS) / both / passing
        self.parts = min(dim, max(2, math.ceil(math.log(codes) / math.log(256))))
        self.base = math.ceil(codes ** (1 / self.parts))
        rng = np.random.default_rng(SEED)
        self.cut = [dim * k // self.parts for k in range(self.parts + 1)]
        self.code = []
        for a, b in zip(self.cut, self.cut[1:]):
            c = rng.standard_normal((self.base, b - a))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        self.bound = z / math.sqrt(dim) * math.sqrt(self.parts)
        #: filters of one shard: those with the same leading parts
        lead = next((k for k in range(1, self.parts) if n * codes * passing / self.base**k <= 3 * TILE), self.parts)
        self.shard = self.base ** (self.parts - lead)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for all filters that the unit rows of ``x`` exceed, by
        row.  A row that exceeds fewer than ``LEAST`` is decoded again with a
        lower threshold of its own, as its neighbours will be."""
        bound = np.full(len(x), self.bound)
        rows, codes, todo = [], [], np.arange(len(x))
        while len(todo):
            row, code = self.above(x[todo], bound[todo])
            enough = (np.bincount(row, minlength=len(todo)) >= min(LEAST, self.base**self.parts)) | (bound[todo] < -1)
            rows.append(todo[row[enough[row]]])
            codes.append(code[enough[row]])
            todo = todo[~enough]
            bound[todo] -= 0.05
        row, code = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*codes, np.zeros(0, np.int64)])
        order = np.argsort(row, kind="stable")
        return row[order].astype(np.int64), code[order].astype(np.int64)

    def above(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain = [x[:, a:b] @ c.T for a, b, c in zip(self.cut, self.cut[1:], self.code)]
        rest = np.concatenate([np.cumsum([g.max(1) for g in gain[::-1]], axis=0)[::-1], np.zeros((1, len(x)))])
        row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, g in enumerate(gain):
            sums = total[:, None] + g[row]
            at, c = np.nonzero(sums + rest[k + 1][row][:, None] >= bound[row][:, None])
            row, code, total = row[at], code[at] * self.base + c, sums[at, c]
        return row, code


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_crowd(vectors: DataFrame) -> DataFrame:
    """Add ``crowd``, for how many vectors the filters of a row's label are laid
    out.  A label over ``SMALL`` has its own, in steps of half a power of two,
    so that few layouts are made; all others have that of the largest of them."""
    sizes = stored(vectors.groupBy("label").agg(F.count("*").alias("n")))
    usual = sizes.where(F.col("n") <= SMALL).agg(F.max("n")).first()[0] or 0
    step = F.ceil(F.pow(F.lit(2.0), F.ceil(F.log2("n") * 2) / 2))
    large = sizes.where(F.col("n") > SMALL).select("label", step.cast("long").alias("crowd"))
    few = large.count() <= MOST_LARGE
    joined = vectors.join(F.broadcast(large) if few else large.hint("merge"), "label", "left")
    return joined.withColumn("crowd", F.coalesce("crowd", F.lit(usual).cast("long")))


def pass_filters(vectors: DataFrame, threshold: float) -> DataFrame:
    """``(node, label, dim, copies, embedding, shards)`` for distinct vectors with
    their ``crowd``."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    names = ["node", "label", "dim", "copies", "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caps: dict[tuple[int, int], Caps] = {}
        for b in batches:
            layouts = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 5)])
            for layout in np.unique(layouts, axis=1).T:
                part = b.filter(pa.array((layouts == layout[:, None]).all(0))).select(names)
                key = (int(layout[0]), int(layout[1]))
                if key not in caps:
                    caps[key] = Caps(*key, threshold)
                c = caps[key]
                row, code = c.decode(matrix(part.column(4)))
                pair = np.unique(np.stack([row, code // c.shard]), axis=1)
                offsets = np.searchsorted(pair[0], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(pair[1]))], names=[*names, "shards"])

    return vectors.select(*names, "crowd").mapInArrow(run, f"node long, label {kind['label']}, dim int, copies long, embedding {kind['embedding']}, shards array<long>")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading columns in sorted rows."""
    held, last = [], None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *turns.tolist(), b.num_rows] if b.num_rows else []
        for a, z in zip(edges, edges[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def tile_links(x: np.ndarray, y: np.ndarray | None, mx: np.ndarray, my: np.ndarray | None, threshold: float):
    """Links inside a tile: (linked, counted here) as boolean matrices; ``mx`` and
    ``my`` mark the smaller shards that each row is in."""
    near = (x @ (x if y is None else y).T) >= threshold
    if y is None:
        np.fill_diagonal(near, False)
    if not mx.shape[1] or not near.any():
        return near, near
    return near, near & ((mx @ (mx if my is None else my).T) == 0)


def marks(lists: pa.ListArray) -> np.ndarray:
    """A row for each list, a column for each value in any of them: 1 where it is."""
    size = np.diff(lists.offsets.to_numpy())
    _, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    out = np.zeros((len(lists), int(column.max()) + 1 if len(column) else 0), np.float32)
    out[np.repeat(np.arange(len(lists)), size), column] = 1
    return out


def components_of(near: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(passed: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``(node, links, root)``: links counted at a shard's tile, and a node that
    this tile connects it to."""
    where = ["label", "dim", "shard"]
    rows = passed.select("label", "dim", F.explode("shards").alias("shard"), "node", "copies", "embedding", "shards")
    large = stored(passed.select("label", "dim", F.explode("shards").alias("shard")).groupBy(*where).agg(F.count("*").alias("n")).where(F.col("n") > tile))
    few = large.count() <= MOST_LARGE
    tiles = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least("cut", j).alias("one"), F.greatest("cut", j).alias("two")))
    placed = (
        rows.join(F.broadcast(large) if few else large.hint("merge"), where, "left")
        .withColumn("cuts", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))
        .withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        .withColumn("t", F.explode(tiles))
        .select(*where, "t.one", "t.two", "cut", "node", "copies", "embedding", F.filter("shards", lambda s: s < F.col("shard")).alias("smaller"))
        .repartition(*where, "one", "two")
        .sortWithinPartitions(*where, "one", "two")
    )

    def run(batches):
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for t in runs(batches, 5):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
            cut, node, copies = (t.column(c).to_numpy() for c in ("cut", "node", "copies"))
            x, m, n = matrix(t.column("embedding").chunk(0)), marks(t.column("smaller").chunk(0)), len(node)
            links = np.zeros(n, np.int64)
            if one == two:
                near, here = tile_links(x, None, m, None, threshold)
                links = here @ copies
            else:
                a, b = np.flatnonzero(cut == one), np.flatnonzero(cut == two)
                linked, here = tile_links(x[a], x[b], m[a], m[b], threshold)
                near = np.zeros((n, n), bool)
                near[np.ix_(a, b)] = linked
                near |= near.T
                links[a], links[b] = here @ copies[b], here.T @ copies[a]
            some = near.any(1)
            if some.any():
                root = components_of(near)
                out.append((node[some], links[some], node[root[some]]))
                size += len(out[-1][0])
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["node", "links", "root"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["node", "links", "root"])

    return placed.mapInArrow(run, "node long, links long, root long")


def embedding_links(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and not null, their lengths are
    equal, and their cosine in double precision reaches the threshold (which
    must be positive; a cosine equal to it links).  A vector that is null,
    empty, zero, or holds a null or non-finite component links with nothing: 0
    links, its own id, kept.  Arrays of doubles are compared as doubles, of
    other numbers as floats.  Identical vectors are one node with a count; rows
    that repeat an id are vectors of their own.  A vector of any length is
    compared whole.  An empty table gives an empty one; other columns are not
    read, whatever their names.  Nothing but numbers of rows reaches the driver.
    """
    element = "double" if vectors.schema[vector_col].dataType.simpleString() == "array<double>" else "float"
    v, label = F.col(quoted(vector_col)).cast(f"array<{element}>"), F.col(quoted(label_col))
    fine = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda c: F.coalesce(c != 0, F.lit(False))),
        F.lit(False),
    ) & label.isNotNull()
    # -0.0 and 0.0 are one value, here as in grouping
    clean = F.when(fine, F.transform(v, lambda c: F.when(c == 0, F.lit(0).cast(element)).otherwise(c)))
    rows = vectors.select(F.col(quoted(id_col)).alias("vec_id"), label.alias("label"), clean.alias("embedding"))
    # equal vectors of a label by two hashes of 64 bits
    same = ["h", "h2"]
    hashed = rows.where("embedding is not null").withColumn("h", F.xxhash64("label", "embedding")).withColumn("h2", F.xxhash64(F.lit("second"), "embedding", "label"))
    distinct = stored(
        hashed.groupBy(*same)
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    sized = with_crowd(distinct.select("node", "label", F.size("embedding").alias("dim"), "copies", "embedding"))
    passed = stored(pass_filters(sized, threshold))
    found = stored(compare(passed, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = stored(
        distinct.select("node", *same, "copies", "first")
        .join(links.hint("merge"), "node", "left")
        .join(joined.hint("merge"), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = stored(classes.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    nodes, total = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    named = stored(spread_join(classes, least, "component", "n", nodes).select(*same, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = spread_join(hashed.select("vec_id", *same), named, same, "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # a vector whose class has no id but null is its own
    every = linked.unionByName(alone).withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return every.select(F.col("vec_id").alias(id_col), "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
