"""URL parsing, joining and scope checks against the standard library and the scanner's cases."""

from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from exposa.functions import scope as S
from exposa.functions import urls as U

BASES = ["https://example.com/a/b/c.html?x=1#f", "http://ex.org", "https://ex.org/dir/"]
HREFS = ["/x", "x", "../x", "../../../x", "./", "..", "?q=2", "#frag", "", "//other.com/p",
         "https://o.com/z/", "a//b/../c", "/a//b/../c", "HTTPS://Ex.org/Up", "x;p?q#f", "g/./h/."]


def test_resolve_matches_urljoin(spark):
    df = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "base string, href string")
    for r in U.with_resolved(df, "base", "href", "r").collect():
        assert r.r == urljoin(r.base, r.href), (r.base, r.href)


def test_normalize_and_host(spark):
    urls = ["https://Example.com:8443/a/b/?q=1#x", "http://u:p@H.com/x;p", "https://ex.com",
            "https://ex.com/", "https://ex.com/page/", "https://[::1]:80/a"]
    df = U.with_normalized(spark.createDataFrame([(u,) for u in urls], "u string"), "u", "n", keep_parts=True)
    for r in df.select("u", "n", U.hostname_of_netloc("_n_netloc").alias("h")).collect():
        p = urlparse(r.u)
        path = p.path[:-1] if p.path != "/" and p.path.endswith("/") else p.path
        exp = f"{p.scheme}://{p.netloc.lower()}{path}" + (f"?{p.query}" if p.query else "")
        assert r.n == exp
        assert r.h == p.hostname


def test_base_domain_and_private(spark):
    hosts = {"example.com": "example.com", "www.example.com": "example.com",
             "api.example.com": "example.com", "example.co.uk": "example.co.uk",
             "www.example.co.uk": "example.co.uk", "api.v1.example.com": "example.com",
             "sub.sub.example.com": "example.com"}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    for r in df.select("h", U.base_domain(F.col("h")).alias("b")).collect():
        assert r.b == hosts[r.h]
    private = {"192.168.1.1": True, "10.0.0.1": True, "172.16.0.1": True, "127.0.0.1": True,
               "8.8.8.8": False, "1.1.1.1": False, "example.com": False, "169.254.169.254": True,
               "172.32.0.1": False, "::1": True, "fd00::1": True, "fe80::1": True}
    df = spark.createDataFrame([(h,) for h in private], "h string")
    for r in df.select("h", S.is_private_ip(F.col("h")).alias("p")).collect():
        assert r.p == private[r.h], r.h


def test_redirect_verdicts(spark):
    cases = {"https://example.com/page": "allowed", "https://api.example.com": "allowed",
             "https://evil.com": "blocked_domain", "http://localhost": "blocked_domain",
             "http://192.168.1.1": "blocked_private", "/login": "relative"}
    df = U.with_parts(spark.createDataFrame([(c,) for c in cases], "loc string"), "loc", "l_")
    h = U.hostname_of_netloc("l_netloc")
    v = S.redirect_verdict(h, S.is_private_ip(h), F.lit("example.com"), F.lit("example.com"))
    for r in df.select("loc", v.alias("v")).collect():
        assert r.v == cases[r.loc]


def test_targets(spark):
    raw = ["https://example.com", "example.com", "https://www.example.com", "https://example.com:8443",
           "https://example.com/path/to/resource", "", "192.168.1.1"]
    df = S.with_target(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw", "t_")
    got = {r.raw: r for r in df.collect()}
    assert got["example.com"].t_base_url == "https://example.com/"
    assert got["https://example.com:8443"].t_port == 8443
    assert got["https://example.com:8443"].t_base_url == "https://example.com:8443/"
    assert got["https://www.example.com"].t_base_domain == "example.com"
    assert got[""].t_error == "empty"
    assert got["192.168.1.1"].t_error == "private_address"


def test_random_urls_match_stdlib(spark):
    """Seeded random URL fragments: split, dedup key and join agree with the standard library."""
    import random
    rnd = random.Random(7)
    atoms = ["http", "https", "ftp", "HTTP", ":", "//", "/", "a", "b.c", "..", ".", "?", "#", "q=1",
             ";p", "@", "u:p@", "[::1]", ":80", "%20", " ", "x.php", "", "-", "~", "&", "=",
             "mailto:", "\t", "ex.com", "A.COM"]
    bases = ["https://ex.com/a/b/c?x=1#f", "http://ex.org", "https://ex.org/d/", "http://h.com/a;p?q"]
    rows = [(rnd.choice(bases), "".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 7))))
            for _ in range(1000)]
    df = spark.createDataFrame(rows, "base string, href string")
    df = U.with_resolved(df, "base", "href", "r")
    df = U.with_normalized(df, "href", "n", keep_parts=True, prefix="h_")
    for r in df.collect():
        try:
            exp = urljoin(r.base, r.href)
            p = urlparse(r.href)
        except ValueError:
            continue
        path = p.path[:-1] if p.path != "/" and p.path.endswith("/") else p.path
        assert r.r == exp, (r.base, r.href)
        assert r.n == f"{p.scheme}://{p.netloc.lower()}{path}" + (f"?{p.query}" if p.query else "")
        assert (r.h_scheme, r.h_netloc, r.h_path, r.h_query, r.h_fragment) == (
            p.scheme, p.netloc, p.path, p.query, p.fragment)
