"""Link-graph reachability over captured pages (J4, J5) and crawl statistics (A5).

Breadth-first search done one level at a time with joins. The frontier of a level is a set of URLs per
target; URLs visited on earlier levels are removed with an anti-join, both sides of which are distinct,
so a URL linked from millions of pages is one row. The search runs until a frontier is empty, or to
``max_depth`` levels below the seeds if one is given. Each level is written as a table under the
session's checkpoint folder, so lineage stays short and a lost executor recomputes at most one level.

What a level needs of the links, the captures and the URLs visited so far lies in the buckets that its keys
fall into. All three are kept in folders by bucket of the dedup key, and a narrow level, as there are many of in a
deep site, reads a few folders instead of everything. Visited URLs are a list of tables: one for each of the
last levels, and runs into which these are compacted.

A page budget (``max_pages``, off by default) keeps the first pages of each target in the order of a queue: by
level, then by the page that links first, then by the place of the link. A level is cut by ranks that need
no window over a host (``operators.ranks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.functions import urls as U
from exposa.operators import analysis as A
from exposa.operators import discovery as D
from exposa.operators.ranks import ranked
from exposa.session import Buckets, bucket_of, materialize

#: Levels, and runs, of visited URLs that are kept before they become one.
KEPT = 8


def page_seeds(captures: DataFrame) -> DataFrame:
    """Every captured 200 HTML page as a seed (J5 seeds)."""
    c = captures.where((F.col("status_code") == 200) & D.is_html(F.col("content_type")))
    return D.with_target_of(c.select("url"), "url").select(F.col("tg_host").alias("hostname"), "url")


def edges_of(links: DataFrame) -> DataFrame:
    """In-scope links by the dedup keys of their page and target, with their place on the page."""
    e = U.with_normalized(links.where("in_scope").withColumnRenamed("normalized_url", "link_key"), "page_url", "page_key")
    e = U.with_parts(e, "url", "x_")
    return e.select("page_key", F.col("url").alias("link_url"), "link_key", U.should_crawl("x_path").alias("crawlable"),
                    F.col("tag_rank").cast("int").alias("tag_rank"), F.col("pos").cast("int").alias("pos"))


class Visited:
    """(hostname, key) of the levels so far."""

    def __init__(self):
        self.levels: list[DataFrame] = []
        self.runs: list[Buckets] = []

    def add(self, level: DataFrame) -> None:
        self.levels.append(level.select("hostname", "key"))
        if len(self.levels) == KEPT:
            self.runs.append(Buckets(_union(self.levels), "key"))
            self.levels = []
        if len(self.runs) == KEPT:
            self.runs = [Buckets(_union([r.read() for r in self.runs]), "key")]

    def without(self, urls: DataFrame, buckets: list[int] | None) -> DataFrame:
        """The rows of ``urls`` not visited, their keys being in ``buckets``."""
        seen = self.levels + [r.read(buckets) for r in self.runs]
        return urls.join(_union(seen), ["hostname", "key"], "left_anti") if seen else urls


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Where a URL stands in the queue: its first page's rank, and the link's place on that page.
ORDER = ["parent_rank", "tag_rank", "pos", "first_url"]


def crawl(captures: DataFrame, targets: DataFrame, links: DataFrame, seeds: DataFrame | None = None,
          max_depth: int | None = None, max_pages: int | None = None) -> DataFrame:
    """What a crawl of each target from its base URL (and the seeds) reaches: (hostname, url,
    normalized_url, depth, kind, links). ``page``: a crawled response with status 200, ``links`` the links
    found on it; ``file``: the same, not HTML; ``link``: an in-scope link found on a crawled page, at its
    least depth. A URL has one row per kind. Of a target no more than ``max_pages`` pages are crawled."""
    caps = Buckets(A.keyed_status(captures).withColumnRenamed("normalized_url", "key"), "key")
    edges = Buckets(edges_of(links), "page_key")
    start = targets.select("hostname", F.col("base_url").alias("url"), F.lit(0).alias("parent_rank"))
    if seeds is not None:
        start = start.unionByName(seeds.select("hostname", "url", F.lit(1).alias("parent_rank")))
    found = U.with_normalized(start, "url", "key").select(
        "hostname", "url", "key", F.col("parent_rank").cast("bigint").alias("parent_rank"), F.lit(0).alias("tag_rank"),
        F.lit(0).alias("pos"), F.col("url").alias("first_url"), F.lit(True).alias("crawlable"))
    found = materialize(found.withColumn("bucket", bucket_of("key")))

    visited, pages, linked = Visited(), [], []
    depth = 0
    while max_depth is None or depth <= max_depth:
        frontier = found.where("crawlable")
        buckets = sorted(r.bucket for r in frontier.select("bucket").distinct().collect())  # at most session.BUCKETS
        if not buckets:
            break
        level = frontier.groupBy("hostname", "key").agg(F.min("url").alias("url"), F.min(F.struct(*ORDER)).alias("o"))
        level = visited.without(level.select("hostname", "key", "url", "o.*"), buckets)
        level = materialize(level.join(caps.read(buckets), "key", "left").withColumn("depth", F.lit(depth)))
        visited.add(level)
        ok = level.where(F.col("status_code") == 200)
        ok = _within_budget(ok, pages, max_pages) if max_pages is not None else ok.withColumn("rank", F.lit(0).cast("bigint"))
        pages.append(ok)
        html = ok.where(D.is_html(F.col("content_type"))).select("hostname", F.col("key").alias("page_key"), "rank")
        # a URL's links on the level: its least spelling, and its first place in the queue if it gets there
        place = F.struct(F.col("rank").alias("parent_rank"), "tag_rank", "pos", F.col("link_url").alias("first_url"))
        found = html.join(edges.read(buckets), "page_key").groupBy("hostname", F.col("link_key").alias("key")).agg(
            F.min("link_url").alias("url"), F.min(F.when(F.col("crawlable"), place)).alias("o"))
        found = found.select("hostname", "key", "url", "o.*", F.col("o").isNotNull().alias("crawlable"),
                             F.lit(depth + 1).alias("depth"), bucket_of("key").alias("bucket"))
        found = materialize(found)
        linked.append(found)
        depth += 1
    if not pages:  # no target
        nothing = frontier.where(F.lit(False)) if max_depth is None or max_depth >= 0 else found.where(F.lit(False))
        return materialize(nothing.select("hostname", "url", F.col("key").alias("normalized_url"), F.lit(0).alias("depth"),
                                          F.lit("page").alias("kind"), F.lit(0).cast("bigint").alias("links")))
    out_degree = edges.read().groupBy("page_key").agg(F.count("*").alias("links"))
    reached = _union([p.select("hostname", "url", "key", "depth", "content_type") for p in pages])
    counted = reached.join(out_degree, reached["key"] == out_degree["page_key"], "left").select(
        "hostname", "url", "key", "depth", D.is_html(F.col("content_type")).alias("html"), F.coalesce("links", F.lit(0)).alias("links"))
    page = counted.select("hostname", "url", "key", "depth", F.lit("page").alias("kind"),
                          F.when(F.col("html"), F.col("links")).otherwise(F.lit(0)).alias("links"))
    file = counted.where("not html").select("hostname", "url", "key", "depth", F.lit("file").alias("kind"),
                                            F.lit(0).cast("bigint").alias("links"))
    link = _union(linked).groupBy("hostname", "key").agg(F.min(F.struct("depth", "url")).alias("f")).select(
        "hostname", F.col("f.url").alias("url"), "key", F.col("f.depth").alias("depth"), F.lit("link").alias("kind"),
        F.lit(0).cast("bigint").alias("links"))
    return materialize(page.unionByName(file).unionByName(link).withColumnRenamed("key", "normalized_url"))


def _within_budget(ok: DataFrame, before: list[DataFrame], max_pages: int) -> DataFrame:
    """The level's pages that a target's budget still allows, with their rank on the level."""
    level = ranked(ok, "hostname", ORDER)
    if before:
        taken = _union([p.select("hostname") for p in before]).groupBy("hostname").agg(F.count("*").alias("taken"))
        level = level.join(taken, "hostname", "left")
    else:
        level = level.withColumn("taken", F.lit(0))
    return materialize(level.where(F.col("rank") <= max_pages - F.coalesce("taken", F.lit(0))).drop("taken"))


def crawl_statistics(crawl_rows: DataFrame) -> DataFrame:
    """Per host: pages crawled, links found on crawled pages, distinct URLs among them (A5)."""
    return crawl_rows.groupBy("hostname").agg(
        F.count(F.when(F.col("kind") == "page", 1)).cast("long").alias("pages_crawled"),
        F.sum("links").cast("long").alias("total_urls_found"),
        F.count(F.when(F.col("kind") == "link", 1)).cast("long").alias("unique_urls_found"))
