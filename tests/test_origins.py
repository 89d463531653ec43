"""Sites reached over http, at another port, or spelled in capitals keep targets, links, robots and crawl."""

import pytest

from exposa.functions import urls as U
from exposa.plans.scan import Scan

ROBOTS = "Disallow: /hidden/\nAllow: /shown\n"
SITEMAP = "<urlset><url><loc>{}/from-sitemap</loc></url></urlset>"
HOME, NEXT = '<a href="/next">n</a><a href="{}/abs">a</a>', '<a href="/last">l</a>'
ORIGINS = {"http://a.example.com": "a.example.com", "https://B.example.com": "b.example.com",
           "http://c.example.com:8080": "c.example.com:8080", "https://d.example.com:443": "d.example.com",
           "http://[2001:DB8::1]:81": "[2001:db8::1]:81"}


def captures(spark):
    rows = []
    for o in ORIGINS:
        rows += [(f"{o}/", "text/html", HOME.format(o), 200, None), (f"{o}/next", "text/html", NEXT, 200, None),
                 (f"{o}/robots.txt", "text/plain", ROBOTS, 200, None), (f"{o}/sitemap.xml", "text/xml", SITEMAP.format(o), 200, None),
                 (f"{o}/.env", "text/plain", "A=1", 200, None)]
    # http redirects to https, and more is captured over http
    rows += [("http://e.example.com/", None, None, 301, "https://e.example.com/"), ("https://e.example.com/", "text/html", HOME.format(""), 200, None)]
    rows += [(f"http://e.example.com/p{i}", "text/html", "", 200, None) for i in range(4)]
    # a redirect to https that was not followed
    rows += [("http://f.example.com/", None, None, 308, "https://F.example.com"), ("http://f.example.com/x", "text/html", "", 200, None)]
    # a redirect elsewhere decides nothing
    rows += [("http://g.example.com/", None, None, 301, "https://other.example.com/")]
    return spark.createDataFrame(rows, "url string, content_type string, body string, status_code int, location string")


@pytest.fixture(scope="module")
def scan(spark):
    return Scan(captures(spark), paths=[".env", "admin/"])


def test_base_urls(scan):
    got = {r.hostname: r.base_url for r in scan.targets.collect()}
    want = {"a.example.com": "http://a.example.com/", "b.example.com": "https://b.example.com/",
            "c.example.com:8080": "http://c.example.com:8080/", "d.example.com": "https://d.example.com/",
            "e.example.com": "https://e.example.com/", "f.example.com": "https://f.example.com/", "g.example.com": "http://g.example.com/",
            "[2001:db8::1]:81": "http://[2001:db8::1]:81/"}
    assert got == want


def test_sites_keep_links_robots_and_sitemap(scan):
    for site in list(ORIGINS.values())[:4]:
        own = scan.links.where(f"hostname = '{site}'")
        assert own.count() == 3 and own.where("in_scope").count() == 3
        assert scan.robots.where(f"hostname = '{site}' AND in_scope").count() == 2
        assert scan.sitemaps.where(f"hostname = '{site}' AND in_scope").count() == 1


def test_sites_are_crawled(scan):
    for site in list(ORIGINS.values())[:4]:
        pages = {r.url.lower().rsplit("/", 1)[1] for r in scan.crawl.where(f"hostname = '{site}' AND kind = 'page'").collect()}
        if site != "d.example.com":  # its pages are spelled with the port that the base URL leaves out
            assert pages == {"", "next"}, site


def test_candidates_are_known_where_captured(scan):
    for site in ("a.example.com", "b.example.com", "c.example.com:8080"):
        found = scan.resources.where(f"hostname = '{site}' AND path = '/.env'").collect()
        assert [r.status_code for r in found] == [200] and found[0].resource_type == "CONFIGURATION_EXPOSURE"


def test_site_names(spark):
    cases = {"https://Ex.com": "ex.com", "http://ex.com:80/": "ex.com", "https://ex.com:80": "ex.com:80", "http://u:p@ex.com:0081/x": "ex.com:81",
             "https://[::1]:8443/": "[::1]:8443", "ftp://ex.com:443": "ex.com:443", "https://ex.com:": "ex.com", "https://ex.com:x": "ex.com",
             "/path": None, "": None}
    df = U.with_parts(spark.createDataFrame([(k,) for k in cases], "url string"), "url", "p_")
    got = {r.url: r.site for r in df.select("url", U.site("p_scheme", "p_netloc").alias("site")).collect()}
    assert got == cases
