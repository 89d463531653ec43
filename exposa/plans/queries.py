"""Registered queries: one per operator of the inventory. Each takes (spark, sf_dir) and returns
a flat DataFrame whose columns are all aliased (integers as bigint) so results compare
column-by-column with the SQL oracle in ``exposa.plans.oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.functions import classify as C
from exposa.functions import content as T
from exposa.functions import fixed
from exposa.functions import references as CR
from exposa.functions import scope as S
from exposa.functions import secrets as X
from exposa.functions import urls as U
from exposa.operators import addresses as AD
from exposa.operators import analysis as A
from exposa.operators import discovery as D
from exposa.operators import graph as G
from exposa.operators import path_index as PI
from exposa.operators import redirects as RD
from exposa.operators import report as R
from exposa.operators import wrapped as WR
from exposa.plans.scan import DataScan, scan_for
from exposa.sources import captures as SRC

L = "bigint"


def _scan(spark, d) -> DataScan:
    return scan_for(spark, d)


# ---------------------------------------------------------------- sources and sinks (S)
def captures_load(spark, d):
    c = _scan(spark, d).captures
    return c.select("url", F.col("status_code").cast(L).alias("status_code"), "content_type", "content_length",
                    "server", "location", "captured_at", "is_current", "etag", "last_modified", "title", "error",
                    F.array_join(F.sort_array(F.map_keys("headers")), ",").alias("header_names"), F.length("body").cast(L).alias("body_chars"))


def content_sample(spark, d):
    c = _scan(spark, d).captures
    s = T.response_sample(F.col("body"), F.col("status_code"), F.col("content_type"), None)
    return c.select("url", F.length(s).cast(L).alias("sample_chars"))


def page_title(spark, d):
    c = _scan(spark, d).captures.where(F.col("status_code") == 200)
    s = T.response_sample(F.col("body"), F.col("status_code"), F.col("content_type"), None)
    return c.select("url", T.page_title(s, F.col("content_type")).alias("title"))


def robots_urls(spark, d):
    return _scan(spark, d).robots.select(
        "hostname", F.col("line_no").cast(L).alias("line_no"), "value", "url", "normalized_url", "in_scope")


def sitemap_urls(spark, d):
    return _scan(spark, d).sitemaps.select(
        "hostname", F.col("kind").cast(L).alias("kind"), F.col("pos").cast(L).alias("pos"), "url",
        "normalized_url", "context", "in_scope")


def report_json(spark, d):
    """The report's findings, a row per finding and secret (one row without a secret)."""
    f = _scan(spark, d).report_findings()
    return f.select("hostname", "normalized_url", "severity", "title", "description", "evidence", "remediation", "url",
                    "resource_type", "is_accessible", F.posexplode_outer("secrets").alias("pos", "s")).select(
        "hostname", "normalized_url", "severity", "title", "description", "evidence", "remediation", "url",
        "resource_type", "is_accessible", F.col("pos").cast(L).alias("secret_pos"), F.col("s.type").alias("secret_type"),
        F.col("s.redacted_value").alias("redacted_value"), F.col("s.confidence").alias("confidence"))


def report_header(spark, d):
    """The report's header, flat: a row per target."""
    h = _scan(spark, d).report_header()
    return h.select("hostname", "target.base_url", "target.base_domain", "target.scheme",
                    F.col("target.port").cast(L).alias("port"), F.col("configuration.include_subdomains").alias("include_subdomains"),
                    "start_time", "end_time", "statistics.*")


def report_url_list(spark, d):
    return R.url_list(_scan(spark, d).resources).select("hostname", "line")


def report_sections(spark, d):
    return _scan(spark, d).report_sections()


# ---------------------------------------------------------------- URL projections (U)
def _page_parts(spark, d):
    p = _scan(spark, d).pages.select("page_id", "url")
    return U.with_parts(p, "url", "")


def url_parts(spark, d):
    p = _page_parts(spark, d)
    return p.select("page_id", "scheme", "netloc", "path", "query", "fragment")


def _link_urls(spark, d) -> DataFrame:
    """Distinct resolved link URLs plus candidate and captured URLs."""
    s = _scan(spark, d)
    links = s.links.select("url")
    cands = s.candidates.select("url")
    captured = s.captures.select("url")
    return links.unionByName(cands).unionByName(captured).distinct()


def url_extension(spark, d):
    u = U.with_parts(_link_urls(spark, d), "url", "u_")
    return u.select("url", U.extension("u_path").alias("extension"))


def normalize_url(spark, d):
    s = _scan(spark, d)
    u = s.pages.select("url").unionByName(s.links.select("url")).distinct()
    return U.with_normalized(u, "url", "normalized_url").select("url", "normalized_url")


def resolve_links(spark, d):
    return _scan(spark, d).links.select("page_url", F.col("pos").cast(L).alias("pos"), "href", "url")


def normalize_target(spark, d):
    h = _page_hosts(spark, d)
    t = S.with_target(h.withColumnRenamed("host", "original_url"), "original_url", "t_")
    return t.select("original_url", F.col("t_scheme").alias("scheme"), F.col("t_hostname").alias("hostname"),
                    F.col("t_port").cast(L).alias("port"), F.col("t_base_domain").alias("base_domain"),
                    F.col("t_normalized").alias("normalized_target"), F.col("t_error").alias("error"))


def _page_hosts(spark, d):
    return SRC.hosts(_scan(spark, d).pages)


def base_domain(spark, d):
    h = _page_hosts(spark, d)
    return h.select("host", U.base_domain(F.col("host")).alias("base_domain"))


def target_base_url(spark, d):
    return _scan(spark, d).targets.select("hostname", "base_url")


def file_category(spark, d):
    u = U.with_parts(_link_urls(spark, d), "url", "u_")
    return u.select("url", U.file_category("u_path").alias("file_category"))


def should_crawl(spark, d):
    u = U.with_parts(_link_urls(spark, d), "url", "u_")
    return u.select("url", U.should_crawl("u_path").alias("should_crawl"))


# ---------------------------------------------------------------- filters (F)
def scope_filter(spark, d):
    return _scan(spark, d).links.select("page_url", F.col("pos").cast(L).alias("pos"), "url", "in_scope",
                                        "in_scope_with_subdomains")


def _raw_hrefs(spark, d) -> DataFrame:
    c = _scan(spark, d).captures.where(F.col("status_code") == 200)
    tags = F.regexp_extract_all(D.strip_markup_noise(F.col("body")), F.lit(D.TAG_REGEX), 0)
    return c.select(F.explode(tags).alias("tag")).where(F.col("tag").rlike(r"^<[aA][\s/]")).select(
        CR.decode(D.attribute(F.col("tag"), "href")).alias("href"))


def valid_links(spark, d):
    h = _raw_hrefs(spark, d).groupBy("href").agg(F.count("*").cast(L).alias("occurrences"))
    return h.select("href", "occurrences", S.is_valid_link(F.col("href")).alias("is_valid"))


def _location_hosts(spark, d) -> DataFrame:
    c = _scan(spark, d).captures.where(F.col("location").isNotNull())
    c = U.with_parts(c.select("location"), "location", "l_")
    return c.select(U.hostname_of_netloc("l_netloc").alias("host")).where(F.col("host").isNotNull())


def private_hosts(spark, d):
    h = _page_hosts(spark, d).unionByName(_location_hosts(spark, d)).distinct()
    return h.select("host", S.is_private_ip(F.col("host")).alias("is_private"),
                    S.private_reason(F.col("host")).alias("reason"))


#: Ranges that the registered query adds to the private ones, as a user may.
MORE_RANGES = ["192.168.0.0/17", "192.168.128.0/20", "10.1.4.0/22", "10.1.7.2", "0.0.0.0/0"]


def address_ranges(spark, d):
    h = _page_hosts(spark, d).unionByName(_location_hosts(spark, d)).distinct()
    return AD.in_ranges(h, "host", AD.ranges(spark, fixed.PRIVATE_RANGES + MORE_RANGES))


def unsafe_urls(spark, d):
    s = _scan(spark, d)
    u = s.captures.select("url").unionByName(
        s.captures.where(F.col("location").isNotNull()).select(F.col("location").alias("url"))).distinct()
    u = U.with_parts(u, "url", "u_")
    return u.select("url", S.is_unsafe_host(U.hostname_of_netloc("u_netloc")).alias("is_unsafe"))


def _redirects(spark, d) -> DataFrame:
    s = _scan(spark, d)
    c = s.captures.where(F.col("status_code").isin(fixed.REDIRECT_STATUSES) & F.col("location").isNotNull()
                         & (F.col("location") != ""))
    c = D.with_target_of(c.select("url", "status_code", "location"), "url")
    c = U.with_parts(U.with_parts(c, "location", "l_"), "url", "u_")
    c = c.withColumns({"l_host": U.hostname_of_netloc("l_netloc"), "u_host": U.hostname_of_netloc("u_netloc")})
    return c.withColumn("verdict", S.redirect_verdict(
        F.col("l_host"), S.is_private_ip(F.col("l_host")), F.col("u_host"), F.col("tg_base_domain")))


def redirect_verdict(spark, d):
    return _redirects(spark, d).select("url", F.col("status_code").cast(L).alias("status_code"),
                                       "location", "verdict")


def redirects_blocked(spark, d):
    r = _redirects(spark, d)
    return r.groupBy(F.col("tg_host").alias("hostname")).agg(
        F.count(F.when(F.col("verdict").startswith("blocked"), 1)).cast(L).alias("redirects_blocked"))


def redirect_chains(spark, d):
    return RD.redirect_chains(_scan(spark, d).captures).withColumn("final_status", F.col("final_status").cast(L))


def redirect_hops(spark, d):
    return RD.redirect_hops(_scan(spark, d).captures)


def path_safety(spark, d):
    s = _scan(spark, d)
    p = s.links.select(F.col("href").alias("path")).unionByName(
        s.candidates.select("path")).distinct()
    return p.select("path", S.is_safe_path(F.col("path")).alias("is_safe"))


def secret_scan_gate(spark, d):
    r = _scan(spark, d).analyzed.where(F.col("has_response"))
    return r.select("normalized_url", T.secret_scan_gate(F.col("is_accessible"), F.col("content_type"),
                                                         F.col("content_length")).alias("scan"))


def directory_listing(spark, d):
    c = _scan(spark, d).captures
    s = T.response_sample(F.col("body"), F.col("status_code"), F.col("content_type"), None)
    return c.select("url", F.coalesce((F.col("status_code") == 200) & T.is_directory_listing(s, F.col("content_type")),
                                      F.lit(False)).alias("is_directory_listing"))


# ---------------------------------------------------------------- link extraction (L)
def html_links(spark, d):
    return _scan(spark, d).links.select(
        "page_url", F.col("tag_rank").cast(L).alias("tag_rank"), F.col("pos").cast(L).alias("pos"),
        "context", "href", "url", "normalized_url", "in_scope")


def js_links(spark, d):
    return D.js_links(_scan(spark, d).captures).select(
        "page_url", F.col("block").cast(L).alias("block"), F.col("pattern").cast(L).alias("pattern"),
        F.col("pos").cast(L).alias("pos"), "href", "url", "in_scope")


def css_links(spark, d):
    return D.css_links(_scan(spark, d).captures).select(
        "page_url", F.col("block").cast(L).alias("block"), F.col("pattern").cast(L).alias("pattern"),
        F.col("pos").cast(L).alias("pos"), "href", "url", "in_scope")


# ---------------------------------------------------------------- joins and sets (J)
def dedup_urls(spark, d):
    return _scan(spark, d).urls.select("normalized_url", "hostname", "url", "source", "context")


def union_sources(spark, d):
    r = _scan(spark, d).discovered
    return r.groupBy("hostname", "source").agg(F.count("*").cast(L).alias("rows"),
                                               F.countDistinct("normalized_url").cast(L).alias("distinct_urls"))


def candidate_urls(spark, d):
    r = _scan(spark, d).urls.where(F.col("source") == "COMMON_PATHS")
    return r.select("hostname", F.col("rank").cast(L).alias("rank"), F.col("context").alias("path"), "url", "normalized_url")


def _reached(crawl):
    return crawl.select("hostname", "url", "normalized_url", F.col("depth").cast(L).alias("depth"), "kind")


def crawl_reachability(spark, d):
    return _reached(_scan(spark, d).crawl)


def seed_reachability(spark, d):
    return _reached(_scan(spark, d).seeded_crawl)


#: Budget and depth of the registered budgeted crawl; the cut is the feature.
CRAWL_BUDGET = (3, 3)


def crawl_budget(spark, d):
    s, (pages, depth) = _scan(spark, d), CRAWL_BUDGET
    return _reached(G.crawl(s.captures, s.targets, s.links, G.page_seeds(s.captures), depth, pages))


def resource_secrets(spark, d):
    r = _scan(spark, d).resources.where(F.col("secret_count") > 0)
    return r.select("normalized_url", "secret_count", "has_critical_secret")


def risk_lookup(spark, d):
    r = _scan(spark, d).resources
    return r.select("normalized_url", "resource_type", (F.col("secret_count") > 0).alias("has_secrets"),
                    "is_accessible", "base_severity")


def catch_all_hosts(spark, d):
    return A.catch_all_hosts(_scan(spark, d).captures)


# ---------------------------------------------------------------- classification (C)
def _classified_links(spark, d):
    u = U.with_parts(_link_urls(spark, d), "url", "u_")
    return C.with_classification(u, "u_path")


def path_category(spark, d):
    return _classified_links(spark, d).select("url", "category")


def path_index(spark, d):
    """Categories of distinct paths through the index of patterns."""
    paths = U.with_parts(_link_urls(spark, d), "url", "u_").select(F.col("u_path").alias("path"))
    return PI.categories(paths).select("path", "category")


def classify_urls(spark, d):
    return _classified_links(spark, d).select("url", F.col("class_type").alias("resource_type"),
                                              F.col("class_severity").alias("severity"))


def sensitive_documents(spark, d):
    u = U.with_parts(_link_urls(spark, d), "url", "u_")
    fn = F.lower(C.filename_of(F.col("u_path")))
    return u.where(C.ends_with_any(fn, fixed.SENSITIVE_DOC_EXTENSIONS)).select("url", C.has_sensitive_keyword(fn).alias("has_keyword"))


def soft_404(spark, d):
    r = _scan(spark, d).analyzed.where(F.col("status_code") == 200)
    return r.select("normalized_url", "ext", "filename", "catch_all", "soft_404")


def analyze_resources(spark, d):
    r = _scan(spark, d).analyzed
    return r.select("normalized_url", "hostname", "source", F.col("status_code").cast(L).alias("status_code"),
                    "category", "resource_type", "severity", "is_accessible", "is_directory_listing",
                    "description", "analysis_note")


def path_exposure(spark, d):
    s = _scan(spark, d)
    r = A.path_exposure(s.candidates, s.captures)
    return r.select("normalized_url", "hostname", "resource_type", "severity", "is_accessible")


def resource_groups(spark, d):
    return _scan(spark, d).groups.select("normalized_url", "hostname", "group_name")


# ---------------------------------------------------------------- secrets (X)
def _document_secrets(spark, d):
    return A.secret_matches(_scan(spark, d).documents, ["doc_id"], "text")


def secret_matches(spark, d):
    m = _document_secrets(spark, d)
    return m.select("doc_id", F.col("line_number").cast(L).alias("line_number"),
                    F.col("match_pos").cast(L).alias("match_pos"), "secret_type",
                    F.col("confidence").cast(L).alias("confidence"))


def wrapped_secrets(spark, d):
    """Secrets that run over line ends, in all captured bodies."""
    c = _scan(spark, d).captures.where(F.col("status_code") == 200).select("url", "captured_at", "body")
    m = WR.wrapped_secrets(c, ["url", "captured_at"], "body")
    return m.select("url", "captured_at", F.col("line_number").cast(L).alias("line_number"), F.col("end_line").cast(L).alias("end_line"),
                    "secret_type", "redacted_value", F.col("confidence").cast(L).alias("confidence"))


def secret_redaction(spark, d):
    m = _document_secrets(spark, d)
    return m.select("doc_id", F.col("line_number").cast(L).alias("line_number"),
                    F.col("match_pos").cast(L).alias("match_pos"), "secret_type", "redacted_value")


def secret_severity(spark, d):
    r = _scan(spark, d).resources.where(F.col("secret_count") > 0)
    return r.select("normalized_url", "has_critical_secret", "base_severity", "assessed_severity")


def redacted_snippet(spark, d):
    docs = _scan(spark, d).documents
    return docs.select("doc_id", X.redacted_snippet(F.col("text")).alias("snippet"))


def secret_summary(spark, d):
    return R.secret_summary(_scan(spark, d).resources)


# ---------------------------------------------------------------- risk and findings (R)
def assess_risk(spark, d):
    return _scan(spark, d).resources.select("normalized_url", "assessed_severity")


def risk_modifiers(spark, d):
    return _scan(spark, d).resources.select("normalized_url", "is_current", "base_severity", "assessed_severity")


def findings(spark, d):
    return _scan(spark, d).findings.select("normalized_url", "hostname", "resource_type", "severity",
                                           "finding_severity")


def finding_text(spark, d):
    return _scan(spark, d).findings.select("normalized_url", "title", F.col("finding_description").alias("description"),
                                           "remediation")


def finding_evidence(spark, d):
    return _scan(spark, d).findings.select("normalized_url", "evidence")


# ---------------------------------------------------------------- aggregates and top-k (A, T)
def scan_statistics(spark, d):
    s = _scan(spark, d)
    return R.scan_statistics(s.discovered, s.resources)


def severity_counts(spark, d):
    s = _scan(spark, d)
    return R.severity_counts(s.resources, s.findings)


def sensitive_file_count(spark, d):
    return R.sensitive_file_count(_scan(spark, d).resources)


def group_counts(spark, d):
    return R.group_counts(_scan(spark, d).groups)


def crawl_statistics(spark, d):
    return G.crawl_statistics(_scan(spark, d).seeded_crawl)


def top_findings(spark, d):
    return R.top_findings(_scan(spark, d).findings)


def top_resources(spark, d):
    return R.top_resources(_scan(spark, d).groups)


def historical_urls(spark, d):
    return R.historical_urls(_scan(spark, d).resources)


def findings_by_severity(spark, d):
    return R.findings_by_severity(_scan(spark, d).findings).select(
        "hostname", "finding_severity", F.col("severity_rank").cast(L).alias("severity_rank"), "url", "title")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in [
        captures_load, content_sample, page_title, robots_urls, sitemap_urls, report_json,
        report_header, report_url_list, report_sections,
        url_parts, url_extension, normalize_url, resolve_links, normalize_target, base_domain,
        target_base_url, file_category, should_crawl,
        scope_filter, valid_links, private_hosts, address_ranges, unsafe_urls, redirect_verdict, redirect_chains, redirect_hops, path_safety,
        secret_scan_gate, directory_listing,
        html_links, js_links, css_links,
        dedup_urls, union_sources, candidate_urls, crawl_reachability, seed_reachability, crawl_budget,
        resource_secrets, risk_lookup, catch_all_hosts,
        path_category, path_index, classify_urls, sensitive_documents, soft_404, analyze_resources,
        path_exposure, resource_groups,
        secret_matches, wrapped_secrets, secret_redaction, secret_severity, redacted_snippet, secret_summary,
        assess_risk, risk_modifiers, findings, finding_text, finding_evidence,
        scan_statistics, severity_counts, sensitive_file_count, group_counts, crawl_statistics,
        redirects_blocked, top_findings, top_resources, historical_urls, findings_by_severity,
    ]
}
