"""Redirect chains by pointer doubling against walks by hand."""

import random

from exposa.operators import redirects as RD
from exposa.sources.captures import as_captures

SCHEMA = "url string, status_code int, location string, captured_at long"


def chains(spark, rows):
    return {r.url: r for r in RD.redirect_chains(as_captures(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_chain_across_hosts(spark):
    got = chains(spark, [
        ("https://ex.com/a", 301, "/b", 1), ("https://ex.com/b", 302, "https://www.ex.com/c#top", 1), ("https://www.ex.com/c", 307, "d?x=1", 1),
        ("https://www.ex.com/d?x=1", 308, "https://evil.net/", 1), ("https://evil.net/", 301, "http://10.0.0.1/x", 1),
        ("https://ex.com/ok", 200, None, 1), ("https://ex.com/to-ok", 303, "ok", 1), ("https://ex.com/no-place", 302, None, 1),
        ("https://ex.com/empty", 302, "", 1), ("https://ex.com/found", 201, "/ok", 1)])
    a = got["https://ex.com/a"]
    assert (a.hops, a.final_url, a.outcome, a.final_status, a.verdict, a.blocked_hop) == (5, "http://10.0.0.1/x", "unseen", None, "blocked_domain", 4)
    d = got["https://www.ex.com/d?x=1"]
    assert (d.hops, d.verdict, d.blocked_hop) == (2, "blocked_domain", 1)
    evil = got["https://evil.net/"]
    assert (evil.hops, evil.verdict, evil.blocked_hop) == (1, "blocked_private", 1)
    ok = got["https://ex.com/to-ok"]
    assert (ok.hops, ok.final_url, ok.outcome, ok.final_status, ok.verdict) == (1, "https://ex.com/ok", "final", 200, "relative")
    assert set(got) == {"https://ex.com/a", "https://ex.com/b", "https://www.ex.com/c", "https://www.ex.com/d?x=1", "https://evil.net/",
                        "https://ex.com/to-ok"}


def test_loops(spark):
    rows = [("https://ex.com/self", 301, "/self", 1), ("https://ex.com/z", 301, "/m", 1), ("https://ex.com/m", 301, "https://o.net/k", 1),
            ("https://o.net/k", 301, "https://ex.com/z", 1), ("https://ex.com/a-tail", 302, "/b-tail", 1), ("https://ex.com/b-tail", 302, "/z", 1)]
    got = chains(spark, rows)
    assert got["https://ex.com/self"].loop == "https://ex.com/self"
    for u in ("z", "m", "a-tail", "b-tail"):
        r = got[f"https://ex.com/{u}"]
        assert (r.outcome, r.loop, r.hops, r.final_url) == ("loop", "https://ex.com/m", None, None)
        assert r.verdict == "blocked_domain"
    assert got["https://ex.com/a-tail"].blocked_hop == 4 and got["https://ex.com/m"].blocked_hop == 1


def test_the_capture_that_counts(spark):
    got = chains(spark, [("https://ex.com/x", 301, "/old", 1), ("https://ex.com/x", 301, "/new", 2), ("https://ex.com/y", 301, "/z", 9),
                         ("https://ex.com/y", 200, None, 1)])
    assert {u: r.final_url for u, r in got.items()} == {"https://ex.com/x": "https://ex.com/new"}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 300, []
    monkeypatch.setattr(RD, "materialize", lambda df, f=RD.materialize: written.append(1) or f(df))
    got = chains(spark, [(f"https://ex.com/{i}", 301, f"/{i + 1}", 1) for i in range(n)])
    assert all(got[f"https://ex.com/{i}"].hops == n - i for i in range(n))
    assert len(written) <= 14


def test_random_graphs_against_walks(spark):
    r = random.Random(8)
    nodes = [f"https://h{i % 7}.ex{i % 2}.com/{i}" for i in range(120)]
    edges = {u: r.choice(nodes) for u in nodes if r.random() < .85}
    hub = nodes[0]
    edges |= {u: hub for u in nodes[60:90]}
    got = chains(spark, [(u, 302, v, 1) for u, v in edges.items()])
    for u in edges:
        way, at = [u], edges[u]
        while at in edges and at not in way:
            way.append(at)
            at = edges[at]
        row = got[u]
        if at in way:
            assert row.loop == min(way[way.index(at):]) and row.outcome == "loop"
        else:
            assert (row.hops, row.final_url, row.outcome) == (len(way), at, "unseen")
        hosts = [edges[x].split("/")[2] for x in way]
        start = u.split("/")[2]
        blocked = [k for k, h in enumerate(hosts, 1) if h != start and not h.endswith("." + ".".join(start.split(".")[-2:]))]
        assert row.blocked_hop == (blocked[0] if blocked else None)


def test_no_captures(spark):
    assert chains(spark, []) == {}
    assert RD.redirect_hops(as_captures(spark.createDataFrame([], SCHEMA))).collect() == []
