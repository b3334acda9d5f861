"""Links between fetched pages, breadth-first reach, and the crawl log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions import urls as U
from corpusq.functions.text import decode_references, let, sniff_mime
from corpusq.operators.places import places
from corpusq.shared import stored

#: An anchor from its name to the value of its first href attribute: other
#: attributes, whose values may be quoted and hold a >, come before it.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
HREF = rf"""(?is)<a(?=[\s/])(?:[\s/]++(?!href[\s=])[^\s=>/]++(?:\s*+=\s*+{_VALUE})?+)*+[\s/]++href\s*+=\s*+({_VALUE})"""
#: What holds no anchors: comments, scripts and styles
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|template)\b.*?(?:</\1\s*>|$)"


def extract_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, href, pos)`` of every anchor of a page, in order: its first href,
    quoted or not, with character references decoded.  Comments, scripts and
    styles hold none."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    each = pages.select(F.col(url).alias("src"), F.posexplode(F.regexp_extract_all(shown, F.lit(HREF), F.lit(1))).alias("pos", "raw"))
    bare = F.regexp_replace("raw", r"""^(["'])(.*)\1$""".replace("^", "(?s)^"), "$2")
    return each.select("src", decode_references(bare).alias("href"), "pos")


def scoped_links(links: DataFrame, domains: list[str]) -> DataFrame:
    """``(src, dst, pos)``: links resolved and normalised, in scope, the first of
    each target on a page."""
    full = links.select("src", U.normalize_url(U.resolve(F.col("src"), F.col("href"))).alias("dst"), "pos")
    return full.where(let(U.host(F.col("dst")), lambda h: U.host_allowed(h, domains))).groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """``(node, depth)`` of what the seeds reach over ``(src, dst, pos)``; nodes at
    ``max_depth`` are not expanded.  With ``max_pages``, levels are visited in
    order of parent and link, and the visit stops there.

    A level is a join with the edges and an anti-join with what has been seen;
    each is written out, so a level's plan does not hold the levels before it.
    """
    front = seeds.select(F.col("node"), F.lit(0).alias("depth"), F.struct(F.lit(0).cast("long").alias("place"), F.col("pos").cast("long").alias("pos")).alias("first")).groupBy("node", "depth").agg(F.min("first").alias("first"))
    seen, depth, left = None, 0, max_pages
    while True:
        if left is not None:
            front = places(front, "first.place", "first.pos", "node").where(F.col("place") <= left)
        else:
            front = front.withColumn("place", F.lit(0).cast("long"))  # without a cap the order inside a level is not asked for
        front = stored(front.select("node", "depth", "place"))
        seen = front if seen is None else seen.union(front)
        if left is not None:
            left -= front.count()
        if depth == max_depth or left == 0 or front.isEmpty():
            return seen.select("node", "depth")
        depth += 1
        reached = edges.join(front.select(F.col("node").alias("src"), "place").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("place", F.col("pos").cast("long").alias("pos"))).alias("first"))
        front = reached.join(seen.select("node").hint("merge"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "first")


def classify_fetches(log: DataFrame, domains: list[str], extensions: list[str]) -> DataFrame:
    """Add ``outcome``: blocked, failed, downloaded, skipped or page, of a log
    with url, http_status, content_type and first bytes (``head``)."""
    url, kind = F.col("url"), F.lower(F.coalesce("content_type", F.lit("")))
    document = U.is_document(url, extensions) | F.contains(kind, F.lit("application/pdf"))
    no_pdf = F.lower(url).endswith(".pdf") & ~F.coalesce(sniff_mime(F.col("head")) == "application/pdf", F.lit(False))
    page = F.contains(kind, F.lit("html")) | url.endswith(".html") | url.endswith("/")
    return log.withColumn(
        "outcome",
        F.when(U.scope(url, domains).isNotNull(), "blocked")
        .when(F.col("http_status").isNull() | (F.col("http_status") >= 400), "failed")
        .when(document & no_pdf, "failed")
        .when(document, "downloaded")
        .when(~page, "skipped")
        .otherwise("page"),
    )


def crawl_report(log: DataFrame, errors: int = 100) -> DataFrame:
    """Per run: counters, duration in seconds and the first errors."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    counts = log.groupBy("run_id").agg(
        F.count("*").alias("urls_seen"),
        n("blocked").alias("urls_blocked"),
        n("failed").alias("urls_failed"),
        n("downloaded").alias("urls_downloaded"),
        n("skipped").alias("urls_skipped"),
        n("page").alias("pages_read"),
        F.round((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6, 2).alias("duration_seconds"),
    )
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "url"))
    shown = log.where("outcome = 'failed'").select("run_id", "ts", "url").withColumn("n", first).where(F.col("n") <= errors)
    texts = shown.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "url"))), lambda x: x["url"]), "\n").alias("errors"))
    return counts.join(texts.hint("merge"), "run_id", "left").withColumn("errors", F.coalesce("errors", F.lit("")))


def allowed_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``allowed``: the first rule of the URL's host (by ``rule_ord``) whose
    prefix begins its path decides; without one it is allowed."""
    keyed = urls.withColumn("__h", U.host(F.col("url"))).withColumn("__p", F.when(U.path(F.col("url")) == "", F.lit("/")).otherwise(U.path(F.col("url"))))
    hit = keyed.join(rules.select(F.col("host").alias("__h"), "prefix", "allow", "rule_ord").hint("merge"), "__h").where(F.col("__p").startswith(F.col("prefix")))
    first = hit.groupBy("url").agg(F.min_by("allow", "rule_ord").alias("allow"))
    return urls.join(first.hint("merge"), "url", "left").select(*urls.columns, F.coalesce("allow", F.lit(True)).alias("allowed"))


def politeness_gaps(log: DataFrame, per_second: float) -> DataFrame:
    """Fetches that follow the one before at the same host too soon."""
    w = Window.partitionBy("host").orderBy("ts", "url")
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6
    return log.withColumn("gap_seconds", gap).where(F.col("gap_seconds") < 1 / per_second)


def crawl_runs(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``seeds``, ``status`` and ``note`` to requests ``(run_id, source_key,
    seed_urls)``: the seeds given, or else (null) those of the source; a run
    without any is skipped."""
    own = sources.select("source_key", F.col("seed_urls").alias("__own"))
    seeds = F.coalesce("seed_urls", "__own", F.array().cast("array<string>"))
    none = F.size(seeds) == 0
    return requests.join(own.hint("merge"), "source_key", "left").select(
        "run_id", "source_key", seeds.alias("seeds"), F.when(none, "skipped").otherwise("running").alias("status"), F.when(none, F.lit("no seed URLs configured — nothing crawled")).alias("note")
    )


def ingested_items(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Crawl items ``(run_id, url, outcome, reason, ingest_error)`` with the key of
    the document that a download became: by ``sha256``, else by its URL where
    documents have a ``source_url``.  A download whose ingest failed is failed,
    with the reason; no other item is touched."""
    got = F.col("outcome") == "downloaded"
    broken = got & F.col("ingest_error").isNotNull()
    first = documents.groupBy("sha256").agg(F.min("doc_pk").alias("__doc"))
    joined, doc = items.join(first.hint("merge"), "sha256", "left"), F.col("__doc")
    if "source_url" in documents.columns:
        by_url = documents.where("source_url <> ''").groupBy(F.col("source_url").alias("url")).agg(F.min("doc_pk").alias("__by_url"))
        joined, doc = joined.join(by_url.hint("merge"), "url", "left"), F.coalesce("__doc", "__by_url")
    return joined.select(
        "run_id",
        "url",
        F.when(broken, "failed").otherwise(F.col("outcome")).alias("outcome"),
        F.when(broken, F.concat(F.lit("ingest error: "), "ingest_error")).otherwise(F.col("reason")).alias("reason"),
        F.when(got & ~broken, doc).alias("doc_pk"),
    )


def run_items(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Every run with its items; a run without any stays, with nulls."""
    return runs.join(items.hint("merge"), "run_id", "left")
