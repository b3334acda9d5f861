"""Topic and entity tags with their evidence.

A taxonomy is a configuration: a list of a few hundred entries that becomes part
of the expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import let, quoted_pattern, snippet

Topics = list[tuple[str, str, list[str]]]
Names = list[tuple[str, str]]


def topic_hits(text: Column, topics: Topics) -> Column:
    """Array of (key, label, keyword, evidence): each topic once, by the first of
    its keywords that the text contains, ignoring case."""
    low, found = F.lower(text), []
    for key, label, words in topics:
        hit = F.lit(None).cast("struct<topic_key: string, label: string, keyword: string, evidence: string>")
        for w in reversed(words):
            at = F.instr(low, w.lower())
            row = F.struct(F.lit(key).alias("topic_key"), F.lit(label).alias("label"), F.lit(w).alias("keyword"), snippet(text, at, F.lit(len(w))).alias("evidence"))
            hit = F.when(at > 0, row).otherwise(hit)
        found.append(hit)
    return F.array_compact(F.array(*found))


def tag_topics(docs: DataFrame, topics: Topics, key: str = "doc_pk", text: str = "text") -> DataFrame:
    """One row for each document and topic."""
    return docs.select(key, F.explode(topic_hits(F.col(text), topics)).alias("t")).select(key, "t.*")


def layers(names: Names) -> list[list[str]]:
    """Distinct names (ignoring case) in groups in which no two can overlap in a
    text: neither holds the other, nor begins with words that the other ends with."""

    def may_overlap(a: str, b: str) -> bool:
        ends = [a[m.start() :] for m in re.finditer(r"(?<!\w)\S", a)]
        return a in b or b in a or any(b.startswith(e) for e in ends) or any(a.startswith(b[m.start() :]) for m in re.finditer(r"(?<!\w)\S", b))

    out: list[list[str]] = []
    for name in dict.fromkeys(folded(n) for _, n in names):
        for group in out:
            if not any(may_overlap(name, other) for other in group):
                group.append(name)
                break
        else:
            out.append([name])
    return out


def folded(name: str) -> str:
    return name.upper().lower()


def tag_entities(pages: DataFrame, names: Names, key: str = "doc_pk", text: str = "text") -> DataFrame:
    """``(key, page_number, entity_type, name, mention)``: names that stand on a
    page as whole words, ignoring case, with their first mention; repeats once.

    A page is read once for each layer of names that cannot overlap, by one
    pattern of alternatives (usually once or twice), not once for each name.
    """
    if not names:
        return pages.limit(0).select(key, "page_number", *[F.lit("").alias(c) for c in ("entity_type", "name", "mention")])
    known = F.create_map(
        *[
            x
            for low in dict.fromkeys(folded(n) for _, n in names)
            for x in (F.lit(low), F.array(*[F.struct(F.lit(k).alias("entity_type"), F.lit(n).alias("name")) for k, n in dict.fromkeys(names) if folded(n) == low]))
        ]
    )
    fold = lambda m: F.lower(F.upper(m))

    def first_mentions(found: Column) -> Column:
        """(folded name, first mention) of mentions in order."""
        low = F.transform(found, fold)
        return let(low, lambda all_: F.transform(F.array_distinct(all_), lambda x: F.struct(x.alias("low"), F.get(found, F.array_position(all_, x).cast("int") - 1).alias("mention"))))

    hits = []
    for group in layers(names):
        either = "|".join(quoted_pattern(n) for n in sorted(group, key=len, reverse=True))
        pattern = r"(?iu)(?<![\p{L}\p{N}_])(" + either + r")(?![\p{L}\p{N}_])"
        hits.append(let(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), first_mentions))
    rows = pages.where(F.col(text).isNotNull()).select(key, "page_number", F.explode(F.flatten(F.array(*hits))).alias("h"))
    named = rows.select(key, "page_number", F.explode(known[F.col("h.low")]).alias("n"), F.col("h.mention").alias("mention"))
    return named.select(key, "page_number", "n.entity_type", "n.name", "mention")


def dimension(tags: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """Existing rows and those that tags bring in, each key once."""
    fresh = tags.select(*key).distinct().join(existing.select(*key).hint("merge"), list(key), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)
