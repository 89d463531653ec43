"""Headers of any spelling, and recaptures that answer 304."""

from exposa.operators import analysis as A
from exposa.plans.scan import Scan
from exposa.sources.captures import as_captures


def test_header_names_in_any_case(spark):
    df = spark.createDataFrame([
        ("https://ex.com/a", {"Content-TYPE": "text/html", "ETag": '"1"', "Last-Modified": "Mon", "SERVER": "nginx", "Set-Cookie": "a=1",
                              "set-cookie": "b=2", "Content-Length": "12", "X": None}, None, "<title> T </title>"),
        ("https://ex.com/b", {"location": "/x", "Content-Length": "many"}, "text/plain", None), ("https://ex.com/c", {}, None, ""),
        ("https://ex.com/d", None, None, "body")], "url string, headers map<string,string>, content_type string, body string")
    a, b, c, d = as_captures(df).orderBy("url").collect()
    assert (a.content_type, a.etag, a.last_modified, a.server, a.content_length, a.title) == ("text/html", '"1"', "Mon", "nginx", 12, "T")
    assert sorted(a.headers) == ["content-length", "content-type", "etag", "last-modified", "server", "set-cookie", "x"]
    assert a.headers["set-cookie"] in ("a=1, b=2", "b=2, a=1")
    assert (b.location, b.content_type, b.content_length) == ("/x", "text/plain", None)
    assert c.headers == {} and c.content_length == 0 and d.headers is None and d.content_length == 4 and d.redirect_chain is None


def test_given_columns_count_before_headers(spark):
    df = spark.createDataFrame([("https://ex.com/", {"Server": "h", "ETag": "h"}, "own", None, ["https://ex.com/0"], "timeout", "t")],
                               "url string, headers map<string,string>, server string, etag string, redirect_chain array<string>, error string, title string")
    r = as_captures(df).first()
    assert (r.server, r.etag, r.redirect_chain, r.error, r.title, r.final_url) == ("own", "h", ["https://ex.com/0"], "timeout", "t", "https://ex.com/")


ROWS = [
    # version v1, then v2, then 304 for v1: v1 holds again, and is as current as the 304
    ("https://ex.com/.env", 200, '"v1"', None, 1, False, "text/plain", "A=1"), ("https://ex.com/.env", 200, '"v2"', None, 2, True, "text/html", "<html>"),
    ("https://ex.com/.env", 304, '"v1"', None, 3, True, None, None),
    # 304 of a version that was not captured decides nothing
    ("https://ex.com/b.log", 200, '"v1"', None, 1, True, "text/plain", "2024-01-01 x"), ("https://ex.com/b.log", 304, '"v9"', None, 5, False, None, None),
    # without a validator, 304 confirms responses without one
    ("https://ex.com/c.sql", 200, None, None, 1, False, "text/plain", "CREATE TABLE x"), ("https://ex.com/c.sql", 304, None, None, 2, True, None, None),
    # Last-Modified where there is no ETag
    ("https://ex.com/d.pem", 200, None, "Mon", 4, True, "text/html", "<html>"), ("https://ex.com/d.pem", 200, None, "Sun", 1, True, "text/plain", "-----BEGIN"),
    ("https://ex.com/d.pem", 304, None, "Sun", 9, False, None, None),
    # 304 alone
    ("https://ex.com/e.sql", 304, '"v1"', None, 1, True, None, None),
    ("https://ex.com/robots.txt", 200, '"r1"', None, 1, True, "text/plain", "Disallow: /one"),
    ("https://ex.com/robots.txt", 200, '"r2"', None, 2, True, "text/plain", "Disallow: /two"), ("https://ex.com/robots.txt", 304, '"r1"', None, 3, True, None, None),
]
SCHEMA = "url string, status_code int, etag string, last_modified string, captured_at long, is_current boolean, content_type string, body string"


def test_304_stands_for_the_capture_before_it(spark):
    caps = spark.createDataFrame(ROWS, SCHEMA)
    s = Scan(caps, paths=[])
    got = {r.path: r for r in s.resources.collect()}
    assert (got["/.env"].status_code, got["/.env"].content_type, got["/.env"].soft_404, got["/.env"].is_current) == (200, "text/plain", False, True)
    assert (got["/b.log"].status_code, got["/b.log"].is_current) == (200, True)
    assert (got["/c.sql"].status_code, got["/c.sql"].is_current) == (200, True)
    assert (got["/d.pem"].content_type, got["/d.pem"].is_current, got["/d.pem"].soft_404) == ("text/plain", False, False)
    assert "/e.sql" not in got  # known only where a response was 200
    assert [r.value for r in s.robots.collect()] == ["/one"]
    status = {r.normalized_url: (r.status_code, r.content_type) for r in A.keyed_status(as_captures(caps)).collect()}
    assert status["https://ex.com/e.sql"] == (304, None) and status["https://ex.com/.env"] == (200, "text/plain")


def test_many_recaptures_are_few_rows(spark):
    rows = [("https://ex.com/x", 304 if i % 3 else 200, f'"{i % 2}"', None, i, True, "text/plain", str(i)) for i in range(600)]
    c = as_captures(spark.createDataFrame(rows, SCHEMA))
    assert A.keyed_status(c).count() == 1
    s = Scan(c, paths=[])
    assert [r.captured_at for r in s.resources.collect()] == [597]  # version 1 was shown last, by 599; 597 fetched it last
