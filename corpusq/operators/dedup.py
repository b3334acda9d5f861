"""Exact de-duplication in arrival order, and fixity of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.shared import stored

from .fulltext import small_or_merged


def dedup_archive(arrivals: DataFrame, archive: DataFrame | None = None, seq: str = "seq", sha: str = "sha256", url: str = "url") -> DataFrame:
    """``(seq, accepted, duplicate_of, in_archive, reason)`` for arrivals with
    distinct ``seq``.

    A row is rejected if a row accepted before it has its hash, or else its URL;
    rejected rows reject nobody.  Empty and null values never match.  All rows
    of ``archive`` (the same columns) were accepted before; ``duplicate_of`` is
    the smallest of them that match, and ``in_archive`` says so.  What the
    archive holds of the arrivals' hashes and URLs is all that is read of it.

    Rounds: a row that is the first of the open rows with its hash and with its
    URL is accepted; open rows that match an accepted one are rejected.  Two or
    three rounds settle ordinary tables.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    keyed = lambda df: df.select(F.col(seq).alias("seq"), blank(sha).alias("h"), blank(url).alias("u"))
    rows = stored(_in_archive(keyed(arrivals), None if archive is None else keyed(archive)))
    undecided, accepted = rows.where("old_h is null and old_u is null").select("seq", "h", "u"), None
    while True:
        first_h = undecided.where("h is not null").groupBy("h").agg(F.min("seq").alias("first_h"))
        first_u = undecided.where("u is not null").groupBy("u").agg(F.min("seq").alias("first_u"))
        marked = undecided.join(first_h.hint("merge"), "h", "left").join(first_u.hint("merge"), "u", "left")
        won = stored(marked.where("coalesce(first_h, seq) = seq and coalesce(first_u, seq) = seq").select("seq", "h", "u"))
        accepted = won if accepted is None else accepted.union(won)
        rest = undecided.join(won.select("seq").hint("merge"), "seq", "left_anti")
        undecided = stored(_matched(rest, won).where("by_h is null and by_u is null").select("seq", "h", "u"))
        if undecided.isEmpty():
            break
    # which row a rejected one repeats is known when all accepted ones are
    own = accepted.select("seq", F.lit(True).alias("accepted"))
    old = rows.select("seq", "old_h", "old_u")
    judged = _matched(rows, accepted).join(own.hint("merge"), "seq", "left").join(old.hint("merge"), "seq")
    lost = F.col("accepted").isNull()
    by_h, by_u = F.coalesce("old_h", "by_h"), F.coalesce("old_u", "by_u")
    from_old = F.when(by_h.isNotNull(), F.col("old_h").isNotNull()).otherwise(F.col("old_u").isNotNull())
    return judged.select(
        "seq",
        (~lost).alias("accepted"),
        F.when(lost, F.coalesce(by_h, by_u)).alias("duplicate_of"),
        F.when(lost, from_old).alias("in_archive"),
        F.when(lost, F.when(by_h.isNotNull(), "sha256").otherwise("url")).alias("reason"),
    )


def _in_archive(rows: DataFrame, archive: DataFrame | None) -> DataFrame:
    """Rows with the smallest row of an archive that has their hash (``old_h``),
    and their URL (``old_u``)."""
    if archive is None:
        none = F.lit(None).cast(rows.schema["seq"].dataType)
        return rows.withColumn("old_h", none).withColumn("old_u", none)
    for key in ("h", "u"):
        wanted = small_or_merged(stored(rows.where(F.col(key).isNotNull()).select(key).distinct()))
        held = archive.join(wanted, key, "left_semi").groupBy(key).agg(F.min("seq").alias(f"old_{key}"))
        rows = rows.join(held.hint("merge"), key, "left")
    return rows


def _matched(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows with the earlier accepted rows of their hash and of their URL; among
    accepted rows each hash and each URL stands once."""
    by_h = accepted.where("h is not null").select("h", F.col("seq").alias("own_h"))
    by_u = accepted.where("u is not null").select("u", F.col("seq").alias("own_u"))
    earlier = lambda c: F.when(F.col(c) < F.col("seq"), F.col(c))
    both = rows.join(by_h.hint("merge"), "h", "left").join(by_u.hint("merge"), "u", "left")
    return both.select("seq", "h", "u", earlier("own_h").alias("by_h"), earlier("own_u").alias("by_u"))


def dedup_by_hash(docs: DataFrame, key: str = "doc_pk", sha: str = "sha256") -> DataFrame:
    """``(key, accepted, duplicate_of)``: the first of each hash is accepted.

    One aggregation and a join; a hash that many rows share is joined in parts.
    """
    own = docs.select(key, sha)
    first = own.where(F.col(sha) != "").groupBy(sha).agg(F.min(key).alias("first"))
    joined = own.join(first.hint("merge"), sha, "left")
    same = F.coalesce(F.col("first"), F.col(key)) == F.col(key)
    return joined.select(key, same.alias("accepted"), F.when(~same, F.col("first")).alias("duplicate_of"))


def fixity_audit(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """``(path, state)``: ok, changed, missing or unknown, of recorded
    ``(path, sha256)`` against the hashes found."""
    both = recorded.select("path", F.col("sha256").alias("wanted")).join(found.select("path", F.col("sha256").alias("seen")), "path", "full_outer")
    state = F.when(F.col("seen").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("wanted") == F.col("seen"), "ok").otherwise("changed")
    return both.select("path", state.alias("state"))
