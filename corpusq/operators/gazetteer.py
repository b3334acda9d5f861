"""Topic and entity tags by a taxonomy that is a table, of any size.

An automaton over all its entries reads a text once and finds every entry in it.
Entries are sent to the tasks in blocks of at most ``MOST_ENTRIES``; each block
is one pass, and what it found is written before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.shared import ship, stored

MOST_ENTRIES = 500_000

Found = Callable[[list[tuple]], Callable[[str], Iterator[tuple]]]


class Folding(dict):
    """Each character in lower case, if that is one character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = c.upper().lower()
        self[code] = low = low if len(low) == 1 else c
        return low


FOLDING = Folding()


def fold(text: str) -> str:
    """Lower case that keeps every place in the text."""
    return text.lower() if text.isascii() else text.translate(FOLDING)


def automaton(words: dict[str, int]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, n in words.items():
        a.add_word(w, n)
    if words:
        a.make_automaton()
    return a


def topic_finder(entries: list[tuple]) -> Callable[[str], Iterator[tuple]]:
    """(topic_key, label, keyword, evidence) of a text, for entries (topic_key,
    label, kw_ord, keyword): each topic once, by the first of its keywords that
    stands in the text, and the text around where that stands first."""
    words: dict[str, int] = {}
    by: list[list[tuple]] = []
    for topic, label, order, keyword in entries:
        if keyword:
            n = words.setdefault(keyword.lower(), len(words))
            if n == len(by):
                by.append([])
            by[n].append((order, keyword, topic, label))
    tree = automaton(words)

    def find(text: str) -> Iterator[tuple]:
        first: dict[int, int] = {}
        for end, n in tree.iter(text.lower()) if words else ():
            first.setdefault(n, end)
        least: dict[tuple, tuple] = {}
        for n, end in first.items():
            for order, keyword, topic, label in by[n]:
                best = least.get((topic, label))
                if best is None or (order, keyword) < best[:2]:
                    least[topic, label] = (order, keyword, end - len(keyword.lower()) + 1)
        for (topic, label), (_, keyword, at) in least.items():
            yield topic, label, keyword, text[max(0, at - 40) : at + len(keyword) + 40].strip()

    return find


def entity_finder(entries: list[tuple]) -> Callable[[str], Iterator[tuple]]:
    """(entity_type, name, mention) of a text, for entries (entity_type, name):
    names that stand in it as whole words, ignoring case, with their first mention."""
    words: dict[str, int] = {}
    by: list[tuple[int, list[tuple]]] = []
    for kind, name in entries:
        if name:
            n = words.setdefault(fold(name), len(words))
            if n == len(by):
                by.append((len(name), []))
            by[n][1].append((kind, name))
    tree = automaton(words)
    inside = lambda c: c.isalnum() or c == "_"

    def find(text: str) -> Iterator[tuple]:
        first: dict[int, int] = {}
        for end, n in tree.iter(fold(text)) if words else ():
            if n not in first:
                at = end + 1 - by[n][0]
                if not (at and inside(text[at - 1])) and not (end + 1 < len(text) and inside(text[end + 1])):
                    first[n] = at
        for n, at in first.items():
            for kind, name in by[n][1]:
                yield kind, name, text[at : at + by[n][0]]

    return find


def tagged(texts: DataFrame, keep: list[str], text: str, entries: DataFrame, together: str, finder: Found, fields: list[str]) -> DataFrame:
    """The ``keep`` columns of each text with what a finder gives, a row for each.
    Entries of one ``together`` are in one block.  Null texts have nothing."""
    spark = texts.sparkSession
    ship(spark)
    src = texts.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    schema = src.select(*keep).schema
    for f in fields:
        schema = schema.add(f, "string")
    names, entries = schema.names, stored(entries.distinct())
    blocks = max(1, -(-entries.count() // MOST_ENTRIES))
    found = []
    for n in range(blocks):
        part = entries.where(F.pmod(F.xxhash64(together), F.lit(blocks)) == n)
        held = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            find = finder(held.value)
            for b in batches:
                at, rows = [], []
                for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    own = list(find(t))
                    at += [i] * len(own)
                    rows += own
                kept = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[j] for r in rows], pa.string()) for j in range(len(fields)))], names=names)

        found.append(stored(src.mapInArrow(run, schema)))
        held.destroy()
    return reduce(DataFrame.unionByName, found)


def tag_topics_by(docs: DataFrame, topics: DataFrame, key: str = "doc_pk", text: str = "text") -> DataFrame:
    """One row for each document and topic, as ``tag_topics`` gives; ``topics``:
    ``(topic_key, label, kw_ord, keyword)``.  A topic's keywords are in one block."""
    return tagged(docs, [key], text, topics.select("topic_key", "label", "kw_ord", "keyword"), "topic_key", topic_finder, ["topic_key", "label", "keyword", "evidence"])


def tag_entities_by(pages: DataFrame, names: DataFrame, key: str = "doc_pk", text: str = "text") -> DataFrame:
    """``(key, page_number, entity_type, name, mention)`` as ``tag_entities`` gives;
    ``names``: ``(entity_type, name)``."""
    return tagged(pages, [key, "page_number"], text, names.select("entity_type", "name"), "name", entity_finder, ["entity_type", "name", "mention"])
