"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints within ``radius`` bits agree on at least one of ``radius + 1``
bands of their bits, so each band value is a shard of its own.  A shard's
distinct fingerprints form a BK-tree (children keyed by their distance to the
parent); each is looked up by following only edges within the radius.  A shard
over ``SHARD`` fingerprints is cut into several trees, and its fingerprints are
looked up in each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, quoted, spread_join, stored
from .components import Forest, connected_components

#: Fingerprints of one tree, at most (about)
SHARD = 4096

_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def fingerprints(texts: list[str], words: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space.  A text of
    fewer words is one shingle; one without words has fingerprint 0.
    """
    digest, join = xxhash.xxh64_intdigest, b" ".join
    sizes, hashes = [], []
    for t in texts:
        w = t.encode().lower().split()
        if len(w) >= words:
            found = list(map(digest, map(join, zip(*(w[i:] for i in range(words)))), repeat(seed)))
        else:
            found = [digest(join(w), seed)] if w else []
        sizes.append(len(found))
        hashes += found
    n, size = len(texts), np.array(sizes, np.int64)
    each = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    base = np.repeat(np.arange(n) * 256, size)
    out = np.zeros(n, np.uint64)
    for j in range(8):
        seen = np.bincount(base + each[:, j], minlength=256 * n).reshape(n, 256).astype(np.float32)
        on = (seen @ _bits) * 2 > size[:, None]
        out |= np.packbits(on, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * j)
    return out


def add_fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [pa.array(fingerprints(texts).view(np.int64))]

    return map_text(docs, text_col, ["doc_id"] if keep is None else keep, [("fp", "long")], make)


class Tree:
    """A BK-tree over fingerprints (Python integers)."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.child: list[dict[int, int]] = []

    def add(self, fp: int) -> None:
        at, new = 0, len(self.value)
        self.value.append(fp)
        self.child.append({})
        while new:
            d = (self.value[at] ^ fp).bit_count()
            at_next = self.child[at].setdefault(d, new)
            if at_next == new:
                return
            at = at_next

    def near(self, fp: int, radius: int) -> list[int]:
        """Places of the values within the radius."""
        found, stack, value, child = [], [0] if self.value else [], self.value, self.child
        while stack:
            at = stack.pop()
            d = (value[at] ^ fp).bit_count()
            if d <= radius:
                found.append(at)
            if kids := child[at]:
                if len(kids) <= 2 * radius + 1:
                    stack += [k for e, k in kids.items() if -radius <= e - d <= radius]
                else:
                    stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Runs of equal leading columns in sorted rows, as lists of columns."""
    held: list[list] | None = None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        start, n = 0, b.num_rows
        for i in range(1, n + 1):
            if i == n or any(cols[k][i] != cols[k][start] for k in range(keys)):
                run = [c[start:i] for c in cols]
                if held is not None and all(held[k][0] == run[k][0] for k in range(keys)):
                    for h, r in zip(held, run):
                        h += r
                else:
                    if held is not None:
                        yield held
                    held = run
                start = i
    if held is not None:
        yield held


def near_fingerprints(fps: DataFrame, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """Links ``(a, b)`` that connect distinct values of ``fp`` within ``radius``
    bits: enough of them to make the same components, a forest for each tree."""
    bands = radius + 1
    edge = [64 * k // bands for k in range(bands + 1)]
    parts = F.array(*[F.shiftrightunsigned("fp", edge[k]).bitwiseAND(F.lit((1 << (edge[k + 1] - edge[k])) - 1)) for k in range(bands)])
    rows = fps.select("fp", F.posexplode(parts).alias("band", "part"))
    sizes = rows.groupBy("band", "part").agg(F.count("*").alias("n")).where("n > 1")
    cuts = F.ceil(F.col("n") / shard).cast("int")
    cut = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.struct(F.least("cut", j).alias("tree"), F.greatest("cut", j).alias("seek")))
    placed = (
        rows.join(sizes.hint("merge"), ["band", "part"])
        .withColumn("cuts", cuts)
        .withColumn("cut", cut)
        .select("band", "part", "cut", "fp", F.explode(tiles).alias("t"))
        .select("band", "part", "t.tree", "t.seek", (F.col("cut") == F.col("t.tree")).alias("planted"), (F.col("cut") == F.col("t.seek")).alias("sought"), "fp")
        .repartition("band", "part", "tree", "seek")
        .sortWithinPartitions("band", "part", "tree", "seek")
    )

    def run(batches):
        a, b = [], []
        for _, _, _, _, planted, sought, fp in groups(batches, 4):
            value = [x & 0xFFFFFFFFFFFFFFFF for x in fp]
            tree, spot, forest = Tree(), [], Forest(len(fp))
            for i, p in enumerate(planted):
                if p:
                    tree.add(value[i])
                    spot.append(i)
            for i, s in enumerate(sought):
                if s:
                    for k in tree.near(value[i], radius):
                        forest.join(i, spot[k])
            for i in range(len(fp)):
                if (r := forest.root(i)) != i:
                    a.append(fp[i])
                    b.append(fp[r])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = 2, keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``fp``, ``class_fp`` (the smallest fingerprint of its
    class), ``component_id`` and the ``keep`` columns.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id reachable (null if every id there is
    null).  Null, empty and wordless texts have fingerprint 0 and link like any
    other; a text of any length is read whole.  Equal fingerprints are one node,
    so copies and repeated rows are never expanded into pairs.  An empty table
    gives an empty one; a ``keep`` column named like an added one is replaced.
    """
    new = ("fp", "class_fp", "component_id", "__copies")
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in new]
    marked = stored(add_fingerprint(docs, text_col, [*dict.fromkeys([id_col, *keep])]))
    nodes = stored(marked.groupBy("fp").agg(F.min(quoted(id_col)).alias("first"), F.count("*").alias("__copies")))
    found = connected_components(near_fingerprints(nodes.select("fp"), radius))
    classes = stored(nodes.join(found.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", "__copies", F.coalesce("component", "fp").alias("component")))
    least = stored(classes.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    total, rows = classes.agg(F.count("*"), F.coalesce(F.sum("__copies"), F.lit(0))).first()
    named = stored(spread_join(classes, least, "component", "n", total).select("fp", "__copies", F.col("component").alias("class_fp"), "component_id"))
    return spread_join(marked, named, "fp", "__copies", rows).select(*[F.col(quoted(c)) for c in keep], *new[:3])
