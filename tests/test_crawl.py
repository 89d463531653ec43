"""The join-based crawl against a direct search over the same captured pages."""

import random
from collections import deque

from exposa.operators import discovery as D
from exposa.operators import graph as G
from exposa.operators.ranks import ranked
from exposa.sources.captures import as_captures

PAGES = {
    "https://ex.com/": '<a href="/a">a</a><a href="/b">b</a><a href="/a">again</a><img src="/i.png">',
    "https://ex.com/a": '<a href="/c">c</a><a href="/">home</a><a href="/doc.pdf">d</a>',
    "https://ex.com/b": '<a href="/c">c</a><a href="/missing">m</a>',
    "https://ex.com/c": '<a href="/d">d</a><a href="/doc.jsp">t</a>',
    "https://ex.com/d": '<a href="/e">e</a>',
}


NULL_TYPE = {"https://ex.com/b"}
FILES = {"https://ex.com/doc.jsp": "plain"}


def brute(max_depth, seeds=()):
    """A crawl by hand: least depth of each page, links found, and how many."""
    import re
    pages = PAGES | FILES
    depth_of, queue, links, found = {}, deque([("https://ex.com/", 0), *((s, 0) for s in seeds)]), {}, 0
    while queue:
        url, depth = queue.popleft()
        if url in depth_of or max_depth is not None and depth > max_depth:
            continue
        depth_of[url] = depth
        if url not in PAGES:
            continue
        for href in re.findall(r'(?:href|src)="([^"]+)"', PAGES[url]):
            link = "https://ex.com" + href
            found += 1
            links[link] = min(links.get(link, depth + 1), depth + 1)
            if not link.endswith((".png", ".pdf")):
                queue.append((link, depth + 1))
    return {(u, d) for u, d in depth_of.items() if u in pages}, set(links.items()), found


def test_crawl_matches_a_search_by_hand(spark):
    rows = [(u, None if u in NULL_TYPE else "text/html", b) for u, b in PAGES.items()]
    rows += [(u, "application/x", b) for u, b in FILES.items()]
    caps = as_captures(spark.createDataFrame(rows, "url string, content_type string, body string"))
    targets = spark.createDataFrame([("ex.com", "https://ex.com/")], "hostname string, base_url string")
    links = D.html_links(caps)
    for max_depth, seeds in [(None, []), (1, []), (None, ["https://ex.com/d"])]:
        start = spark.createDataFrame([("ex.com", u) for u in seeds], "hostname string, url string") if seeds else None
        got = G.crawl(caps, targets, links, start, max_depth)
        by_kind = {k: {(r.url, r.depth) for r in got.where(f"kind = '{k}'").collect()} for k in ("page", "file", "link")}
        pages, found, n = brute(max_depth, seeds)
        assert by_kind["page"] == pages
        assert by_kind["link"] == found
        assert by_kind["file"] == {p for p in pages if p[0] in FILES}
        stats = G.crawl_statistics(got).collect()[0]
        assert (stats.pages_crawled, stats.total_urls_found, stats.unique_urls_found) == (len(pages), n, len(found))


def test_long_chain_has_no_end(spark):
    n = 12
    caps = as_captures(spark.createDataFrame([(f"https://ex.com/{i or ''}", "text/html", f'<a href="/{i + 1}">x</a>') for i in range(n)],
                                             "url string, content_type string, body string"))
    targets = spark.createDataFrame([("ex.com", "https://ex.com/")], "hostname string, base_url string")
    got = G.crawl(caps, targets, D.html_links(caps))
    assert got.where("kind = 'page'").count() == n
    assert got.where("kind = 'page'").agg({"depth": "max"}).first()[0] == n - 1


def budget_brute(pages, base, seeds, max_pages, max_depth):
    """A queue by hand, as a live crawler keeps it."""
    import re
    queue, visited, crawled, found = deque([(base, 0), *((s, 0) for s in sorted(seeds))]), set(), [], {}
    while queue and len(crawled) < max_pages:
        url, depth = queue.popleft()
        if url in visited or depth > max_depth:
            continue
        visited.add(url)
        if url not in pages:
            continue
        crawled.append((url, depth))
        links = [(tag, m.start(), m.group(2)) for tag in ("a", "img", "iframe")
                 for m in re.finditer(rf'<{tag} (href|src)="([^"]+)"', pages[url])]
        for _, _, href in links:
            link = base.rstrip("/") + href
            found[link] = min(found.get(link, depth + 1), depth + 1)
            if not link.endswith(".png"):
                queue.append((link, depth + 1))
    return set(crawled), set(found.items())


def test_page_budget_follows_the_queue(spark):
    r = random.Random(6)
    sites = {}
    for h in range(4):
        base = f"https://h{h}.com/"
        names = [base] + [f"{base}p{i}" for i in range(40 if h else 200)]
        sites[base] = {}
        for n in names:
            if r.random() < .85 or n == base:
                tags = [r.choice(['<a href="/p{}">', '<iframe src="/p{}">', '<img src="/i{}.png">']).format(r.randrange(len(names) + 5))
                        for _ in range(r.randrange(1, 9))]
                sites[base][n] = "text" + "".join(tags)
    rows = [(u, "text/html", b) for pages in sites.values() for u, b in pages.items()]
    caps = as_captures(spark.createDataFrame(rows, "url string, content_type string, body string"))
    targets = spark.createDataFrame([(b[8:-1], b) for b in sites], "hostname string, base_url string")
    links = D.html_links(caps)
    seeds = [(b[8:-1], f"{b}p{i}") for b in sites for i in (7, 3)]
    for budget, depth, seeded in [(5, 9, False), (12, 2, True)]:
        start = spark.createDataFrame(seeds, "hostname string, url string") if seeded else None
        got = G.crawl(caps, targets, links, start, depth, budget).collect()
        for base, pages in sites.items():
            own = [s for h, s in seeds if h == base[8:-1]] if seeded else []
            want_pages, want_links = budget_brute(pages, base, own, budget, depth)
            mine = [x for x in got if x.hostname == base[8:-1]]
            assert {(x.url, x.depth) for x in mine if x.kind == "page"} == want_pages, (base, budget, depth)
            assert {(x.url, x.depth) for x in mine if x.kind == "link"} == want_links


def test_ranks_without_a_window_over_the_group(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < .7 else f"g{r.randrange(5)}", r.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, a long, i long").repartition(7)
    got = {(x.g, x.i): x.rank for x in ranked(df, "g", ["a", "i"]).collect()}
    for g in {x[0] for x in rows}:
        order = sorted((a, i) for h, a, i in rows if h == g)
        assert [got[g, i] for _, i in order] == list(range(1, len(order) + 1))


def test_deep_site_reads_little_on_each_level(spark, monkeypatch):
    """A level takes the buckets of its keys only; visited URLs are compacted as levels come."""
    n = 11
    caps = as_captures(spark.createDataFrame([(f"https://ex.com/{i or ''}", "text/html", f'<a href="/{i + 1}">x</a><a href="/">h</a>') for i in range(n)],
                                             "url string, content_type string, body string"))
    targets = spark.createDataFrame([("ex.com", "https://ex.com/")], "hostname string, base_url string")
    taken, runs = [], []
    read, add = G.Buckets.read, G.Visited.add
    monkeypatch.setattr(G.Buckets, "read", lambda self, buckets=None: (buckets is not None and taken.append(len(buckets)), read(self, buckets))[1])
    monkeypatch.setattr(G.Visited, "add", lambda self, level: (add(self, level), runs.append(len(self.levels) + len(self.runs)))[0])
    got = G.crawl(caps, targets, D.html_links(caps))
    assert got.where("kind = 'page'").count() == n
    assert max(taken) <= 2 and max(runs) <= 2 * G.KEPT


def test_buckets_hold_all_rows(spark):
    df = spark.range(500).selectExpr("cast(id % 90 AS string) AS key", "id")
    b = G.Buckets(df, "key")
    assert sorted(b.read().select("key", "id").collect()) == sorted(df.collect())
    keys = ["5", "17"]
    own = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "key string").select(G.bucket_of("key")).collect()]
    some = b.read(own)
    assert some.where("key IN ('5', '17')").count() == df.where("key IN ('5', '17')").count() and some.count() < 100


def test_no_captures(spark):
    caps = as_captures(spark.createDataFrame([], "url string, content_type string, body string"))
    targets = spark.createDataFrame([], "hostname string, base_url string")
    assert G.crawl(caps, targets, D.html_links(caps)).count() == 0
