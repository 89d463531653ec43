"""URL discovery as table jobs: capture rows in, URL rows out.

* ``html_links`` (L1): link attributes of 11 tag kinds, grouped by tag kind then document order.
* ``js_links`` / ``css_links`` (L2, L3): string and ``url(...)`` references in script and style
  bodies.
* ``robots_urls`` / ``sitemap_urls`` (S4, S5): directives and ``<loc>`` entries of captured
  robots.txt and sitemap.xml files.
* ``candidate_urls_all`` (J3): every target x the curated candidate paths, generated by ``explode``
  of a literal array (no join). Candidates that are already known lose in the dedup, which ranks
  their source last, so no anti-join is needed.
* ``known_urls``, ``candidate_rows`` (J2) and ``dedup_urls`` (J1): all sources and first-wins dedup by
  normalized URL. First-wins is a ``min`` over an ordered struct per key, which Spark aggregates
  partially before the shuffle, so a URL linked from millions of pages costs one row per map
  task, not one task holding every copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.functions import fixed
from exposa.functions import references as R
from exposa.functions import scope as S
from exposa.functions import urls as U
from exposa.session import materialize

LINK_TAGS = [t for t, _ in fixed.LINK_TAG_ATTRS]
# A start tag up to its closing '>', read as a parser reads it: white space and slashes, attribute names, and values
# that may be quoted only right after '='. So a quote inside a name or a bare value is a plain character, '>' inside
# a quoted value does not end the tag, and a quote that is never closed does not swallow the page. Possessive
# quantifiers: the alternatives start with different characters, so nothing is ever given back.
TAG_REGEX = (r"(?i)<(?:" + "|".join(LINK_TAGS) + r""")[\s/](?:[\s/]++|[^\s/>][^\s/>=]*+"""
             r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+>""")
# One attribute with its value, if it has one.
ATTR_REGEX = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?"""
PY_TRIM = (r"^[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+"
           r"|[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+$")


def _tagger(name: str, i: int):
    """(value, position) -> struct(name=i, pos, v), for ``transform`` over extracted matches."""
    return lambda v, j: F.struct(F.lit(i).alias(name), j.alias("pos"), v.alias("v"))


def strip_markup_noise(html: Column) -> Column:
    """Remove comments and the bodies of script/style elements (their text is not markup)."""
    h = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    h = F.regexp_replace(h, r"(?is)(<script\b[^>]*>).*?</script\s*>", "$1")
    return F.regexp_replace(h, r"(?is)(<style\b[^>]*>).*?</style\s*>", "$1")


def attribute(tag_html: Column, name: str) -> Column:
    """The value of an attribute of a start tag, unquoted; the last one counts; '' without."""
    inside = F.regexp_replace(tag_html, r"^<[A-Za-z0-9]+|>$", "")
    own = F.filter(F.regexp_extract_all(inside, F.lit(ATTR_REGEX), 0),
                   lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    return unquote(F.regexp_extract(F.coalesce(F.try_element_at(own, F.lit(-1)), F.lit("")), r"(?s)=\s*(.*)$", 1))


def unquote(v: Column) -> Column:
    return F.regexp_replace(v, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")


def with_target_of(df: DataFrame, url_col: str, prefix: str = "tg_") -> DataFrame:
    """Site (``{prefix}host``) and base domain of a capture's own URL."""
    df = U.with_parts(df, url_col, f"{prefix}p_")
    df = df.withColumn(f"{prefix}host", U.site(f"{prefix}p_scheme", f"{prefix}p_netloc"))
    df = df.withColumn(f"{prefix}base_domain", U.base_domain(U.hostname_of_netloc(f"{prefix}p_netloc")))
    return df.drop(*[f"{prefix}p_{k}" for k in U.PART_NAMES])


def in_site(prefix: str, host: str, base_domain: str, include_subdomains) -> Column:
    """Scope (F1) of a URL in its parts, by its site; one with user information is out."""
    own = F.when(~F.col(f"{prefix}netloc").contains("@"), U.site(f"{prefix}scheme", f"{prefix}netloc"))
    return S.in_scope(F.coalesce(own, F.lit("")), host, base_domain, include_subdomains)


def finish_links(df: DataFrame, base_col: str, href_col: str, include_subdomains: bool) -> DataFrame:
    """Valid-link filter (F2), resolution (U4), dedup key (U3) and scope flag (F1)."""
    df = df.where(S.is_valid_link(F.col(href_col)))
    df = U.with_resolved(df, base_col, href_col, "url")
    df = U.with_normalized(df, "url", "normalized_url", keep_parts=True, prefix="l_")
    df = df.withColumns({
        "in_scope": in_site("l_", "tg_host", "tg_base_domain", include_subdomains),
        "in_scope_with_subdomains": in_site("l_", "tg_host", "tg_base_domain", True)})
    return df.drop(*[f"l_{k}" for k in U.PART_NAMES])


def is_html(content_type: Column) -> Column:
    """An HTML response; one without a content type is read as HTML."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return (ct == "") | ct.contains("text/html")


def html_links(captures: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """(page_url, hostname, tag_rank, pos, context, href, url, normalized_url, in_scope,
    in_scope_with_subdomains) for HTML captures with status 200."""
    c = captures.where((F.col("status_code") == 200) & is_html(F.col("content_type")))
    c = c.select(F.col("url").alias("page_url"), F.col("body"))
    c = with_target_of(c, "page_url")
    c = c.select("page_url", "tg_host", "tg_base_domain",
                 F.posexplode(F.regexp_extract_all(strip_markup_noise(F.col("body")), F.lit(TAG_REGEX), 0))
                 .alias("pos", "tag_html"))
    c = c.withColumn("tag", F.lower(F.regexp_extract("tag_html", r"^<([A-Za-z]+)", 1)))
    rank = context = value = None
    for i, (tag, attr) in enumerate(fixed.LINK_TAG_ATTRS):
        here = F.col("tag") == tag
        rank = F.when(here, F.lit(i)) if rank is None else rank.when(here, F.lit(i))
        context = F.when(here, F.lit(f"{tag}.{attr}")) if context is None else context.when(here, F.lit(f"{tag}.{attr}"))
    for attr in dict.fromkeys(a for _, a in fixed.LINK_TAG_ATTRS):
        here = F.col("tag").isin([t for t, a in fixed.LINK_TAG_ATTRS if a == attr])
        own = attribute(F.col("tag_html"), attr)
        value = F.when(here, own) if value is None else value.when(here, own)
    c = c.select("page_url", "tg_host", "tg_base_domain", rank.alias("tag_rank"), (F.col("pos") + 1).alias("pos"),
                 context.alias("context"), R.decode(value).alias("href"))
    c = c.where(F.col("href") != "")
    return materialize(finish_links(c, "page_url", "href", include_subdomains).select(
        "page_url", F.col("tg_host").alias("hostname"), "tag_rank", "pos", "context", "href", "url", "normalized_url",
        "in_scope", "in_scope_with_subdomains"))


def _script_or_style_bodies(captures: DataFrame, tag: str, media: str) -> DataFrame:
    """Inline blocks of every 200 response (block: their number), and the whole bodies of responses
    that are scripts or style sheets themselves (block 0)."""
    c = captures.where(F.col("status_code") == 200).select(
        F.col("url").alias("page_url"), "body", F.lower(F.coalesce("content_type", F.lit(""))).contains(media).alias("own"))
    c = with_target_of(c, "page_url")
    body = F.regexp_replace(F.coalesce("body", F.lit("")), r"(?s)<!--.*?-->", "")
    blocks = F.regexp_extract_all(body, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), 1)
    return c.select("page_url", "tg_host", "tg_base_domain", F.posexplode(
        F.when(F.col("own"), F.array(F.coalesce("body", F.lit("")))).otherwise(blocks)).alias("block", "text"))


def js_links(captures: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """Quoted absolute URLs, quoted root paths and ``url(...)`` in scripts (L2). The
    first two take the whole match without quotes; ``url(...)`` takes its argument."""
    s = _script_or_style_bodies(captures, "script", "javascript")
    arrays = []
    for i, pat in enumerate(fixed.JS_PATTERNS):
        grp = 1 if i == 2 else 0
        arrays.append(F.transform(F.regexp_extract_all("text", F.lit(pat), grp),
                                  _tagger("pattern", i)))
    s = s.select("page_url", "tg_host", "tg_base_domain", "block", F.explode(F.concat(*arrays)).alias("m"))
    s = s.select("page_url", "tg_host", "tg_base_domain", "block", F.col("m.pattern").alias("pattern"),
                 (F.col("m.pos") + 1).alias("pos"),
                 F.regexp_replace(F.col("m.v"), r"""^['"()]+|['"()]+$""", "").alias("href"))
    return materialize(finish_links(s, "page_url", "href", include_subdomains).select(
        "page_url", "block", "pattern", "pos", "href", "url", "normalized_url", "in_scope"))


def css_links(captures: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """``url(...)`` and ``@import`` references in style blocks, ``data:`` skipped (L3)."""
    s = _script_or_style_bodies(captures, "style", "css")
    arrays = [F.transform(F.regexp_extract_all("text", F.lit(pat), 1),
                          _tagger("pattern", i))
              for i, pat in enumerate(fixed.CSS_PATTERNS)]
    s = s.select("page_url", "tg_host", "tg_base_domain", "block", F.explode(F.concat(*arrays)).alias("m"))
    s = s.select("page_url", "tg_host", "tg_base_domain", "block", F.col("m.pattern").alias("pattern"),
                 (F.col("m.pos") + 1).alias("pos"), F.col("m.v").alias("href"))
    s = s.where((F.col("href") != "") & ~F.col("href").startswith("data:"))
    s = U.with_resolved(s, "page_url", "href", "url")
    s = U.with_normalized(s, "url", "normalized_url", keep_parts=True, prefix="l_")
    s = s.withColumn("in_scope", in_site("l_", "tg_host", "tg_base_domain", include_subdomains))
    return materialize(s.select("page_url", "block", "pattern", "pos", "href", "url", "normalized_url",
                                "in_scope"))


def _probe_files(captures: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """The 200 capture of the file ``name`` at the root of each target's site: of the target's scheme first, then
    the one seen last."""
    # narrow the captures to this file name before the shuffle, so only these rows are in it
    c = captures.where(F.col("status_code").isin(200, 304) & F.lower("url").contains("/" + name)).select(
        "url", "body", "status_code", "captured_at", F.coalesce("etag", "last_modified").alias("validator"))
    c = U.with_parts(c, "url", "p_").where((F.col("p_path") == "/" + name) & (F.col("p_query") == ""))
    # a 304 says that the response of its version before it still holds
    c = c.groupBy("url", U.site("p_scheme", "p_netloc").alias("hostname"), F.col("p_scheme").alias("c_scheme"), "validator").agg(
        F.max("captured_at").alias("seen"),
        F.max(F.when(F.col("status_code") == 200, F.struct("captured_at", F.coalesce("body", F.lit("")).alias("body")))).alias("n"))
    c = c.where(F.col("n").isNotNull()).groupBy("hostname", "c_scheme").agg(
        F.max(F.struct(F.col("seen").alias("captured_at"), "n.body")).alias("c"))
    best = F.max(F.struct(F.col("c_scheme") == F.col("scheme"), "c.captured_at", "c.body"))
    return (targets.select("hostname", "base_domain", "base_url", "scheme").join(c, "hostname")
            .groupBy("hostname", "base_domain", "base_url").agg(best.alias("b"))
            .select("hostname", "base_domain", "base_url", "b.body"))


def robots_urls(captures: DataFrame, targets: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """Disallow/Allow/Sitemap values of each target's robots.txt, joined to the base URL."""
    r = _probe_files(captures, targets, "robots.txt")
    r = r.select("hostname", "base_domain", "base_url",
                 F.posexplode(F.split(F.coalesce("body", F.lit("")), "\n", -1)).alias("line_no", "line"))
    r = r.withColumn("line", F.regexp_replace("line", PY_TRIM, ""))
    directive = F.lit(False)
    for d in fixed.ROBOTS_DIRECTIVES:
        directive = directive | F.col("line").startswith(d)
    r = r.where(directive).withColumn("value", F.regexp_replace(
        F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1), PY_TRIM, ""))
    r = r.where((F.col("value") != "") & (F.col("value") != "/"))
    r = U.with_resolved(r, "base_url", "value", "url")
    r = U.with_normalized(r, "url", "normalized_url", keep_parts=True, prefix="l_")
    r = r.withColumn("in_scope", in_site("l_", "hostname", "base_domain", include_subdomains))
    return materialize(r.select("hostname", (F.col("line_no") + 1).alias("line_no"), "value", "url",
                                "normalized_url", "in_scope"))


def sitemap_urls(captures: DataFrame, targets: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """Every ``<loc>`` text of each target's sitemap.xml, plus the ``<sitemap><loc>`` entries
    again with context ``sitemap_index`` (S5)."""
    s = _probe_files(captures, targets, "sitemap.xml")
    body = F.coalesce(F.col("body"), F.lit(""))
    locs = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc\s*>"), 1),
                       lambda v, j: F.struct(F.lit(0).alias("kind"), j.alias("pos"), v.alias("v")))
    idx = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<sitemap\b[^>]*>.*?<loc\b[^>]*>(.*?)</loc\s*>"), 1),
                      lambda v, j: F.struct(F.lit(1).alias("kind"), j.alias("pos"), v.alias("v")))
    s = s.select("hostname", "base_domain", F.explode(F.concat(locs, idx)).alias("m"))
    s = s.select("hostname", "base_domain", F.col("m.kind").alias("kind"), (F.col("m.pos") + 1).alias("pos"),
                 F.regexp_replace(R.decode(F.col("m.v")), PY_TRIM, "").alias("url"))
    s = s.where(F.col("url") != "")
    s = U.with_normalized(s, "url", "normalized_url", keep_parts=True, prefix="l_")
    s = s.withColumn("in_scope", in_site("l_", "hostname", "base_domain", include_subdomains))
    return materialize(s.select("hostname", "kind", "pos", "url", "normalized_url",
                                F.when(F.col("kind") == 1, F.lit("sitemap_index")).alias("context"),
                                "in_scope"))


def candidate_urls_all(targets: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """targets x candidate paths resolved against the base URL, each path once."""
    listed = list(dict.fromkeys(fixed.candidate_paths() if paths is None else paths))
    structs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(p).alias("path")) for i, p in enumerate(listed)])
    structs = structs.cast("array<struct<rank:int,path:string>>")  # also without paths
    c = targets.select("hostname", "base_url", F.explode(structs).alias("c"))
    c = c.select("hostname", "base_url", F.col("c.rank").alias("rank"), F.col("c.path").alias("path"))
    c = U.with_resolved(c, "base_url", "path", "url")
    return materialize(U.with_normalized(c, "url", "normalized_url"))


def known_urls(captures: DataFrame, targets: DataFrame, links: DataFrame, robots: DataFrame,
               sitemaps: DataFrame) -> DataFrame:
    """Discovered URL rows but for the candidates (J2): captured pages and the in-scope links of all
    captured pages (HTML; a superset of what a crawl reaches), robots.txt entries (ROBOTS), sitemap
    entries (SITEMAP). Columns: hostname, source, context, order keys, url, normalized_url."""
    pages = captures.where(F.col("status_code") == 200).select("url")
    pages = with_target_of(pages, "url")
    pages = U.with_normalized(pages, "url", "normalized_url")
    none = F.lit(None).cast("string").alias("context")
    page_rows = pages.select(F.col("tg_host").alias("hostname"), F.lit("HTML").alias("source"), none,
                             F.lit(0).alias("k1"), F.lit(-1).alias("k2"), F.lit(0).alias("k3"),
                             F.col("url").alias("parent"), "url", "normalized_url")
    link_rows = links.where("in_scope").select(
        "hostname", F.lit("HTML").alias("source"), "context", F.lit(0).alias("k1"), F.col("tag_rank").alias("k2"),
        F.col("pos").alias("k3"), F.col("page_url").alias("parent"), "url", "normalized_url")
    robot_rows = robots.where("in_scope").select(
        "hostname", F.lit("ROBOTS").alias("source"), none, F.lit(1).alias("k1"), F.lit(0).alias("k2"),
        F.col("line_no").alias("k3"), F.lit("").alias("parent"), "url", "normalized_url")
    sm_rows = sitemaps.where("in_scope").select(
        "hostname", F.lit("SITEMAP").alias("source"), "context", F.lit(2).alias("k1"), F.col("kind").alias("k2"),
        F.col("pos").alias("k3"), F.lit("").alias("parent"), "url", "normalized_url")
    return materialize(page_rows.unionByName(link_rows).unionByName(robot_rows).unionByName(sm_rows))


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """The candidates in the columns of ``known_urls``."""
    return candidates.select("hostname", F.lit("COMMON_PATHS").alias("source"), F.col("path").alias("context"),
                             F.lit(3).alias("k1"), F.lit(0).alias("k2"), F.col("rank").alias("k3"),
                             F.lit("").alias("parent"), "url", "normalized_url")


def dedup_urls(rows: DataFrame) -> DataFrame:
    """First row per normalized URL by (source order, parent, tag rank, position)."""
    first = F.min(F.struct("k1", "parent", "k2", "k3", "url", "source", "context", "hostname"))
    d = rows.groupBy("normalized_url").agg(first.alias("f"))
    return d.select("normalized_url", F.col("f.hostname").alias("hostname"), F.col("f.url").alias("url"),
                    F.col("f.source").alias("source"), F.col("f.context").alias("context"), F.col("f.k3").alias("rank"))
