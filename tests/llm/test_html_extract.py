import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from exposa.llm import html_extract as H

PAGES = [
    ("plain", "<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><article><h1>Head &amp; x</h1>"
     "<p>One  two\n three<b>!</b><p>Four&nbsp;five<br>six</article><footer>foot</footer></body>", "Head & x\nOne two three!\nFour five six"),
    ("script", "<article><p>a</p><script>var t='</p><p>no</p>';</script><!-- <p>c</p> --><p>b</p></article>", "a\nb"),
    ("noise", "<main><div class='cookie-notice'>x</div><div id=comments><p>c</p></div><p>real</p><form><p>f</p></form>"
     "<aside>s</aside><div role=navigation>n</div><p hidden>h</p></main>", "real"),
    ("open", "<nav><ul><li>menu<article><p>text <b>bold", "text bold"),
    ("bare", "just text &lt;here&gt;", "just text <here>"),
    ("empty", "", ""), ("null", None, ""), ("nothing", "<html><body><nav>x</nav></body></html>", ""),
    ("entities", "<article><p>&eacute;&#233;&#xe9; &unknown; &#128512;</p></article>", "ééé &unknown; 😀"),
    ("table", "<article><table><tr><td>a<td>b</tr></table><ul><li>c<li>d</ul><pre>e\n  f</pre></article>", "a\nb\nc\nd\ne f"),
    ("header", "<body><header>site</header><article><header><h1>title</h1></header><p>x</p></article></body>", "title\nx"),
    ("two", "<article><p>a</p></article><div>between</div><article><p>b</p></article>", "a\nb"),
    ("beside", "<body class='page with-sidebar no-header'><div class='content has-ads'><p>kept</p></div><div class='right-sidebar'>s</div></body>", "kept"),
    ("malformed", "<article><p class=>a</p></p></b><p>b</i></div>c</article>", "a\nb\nc"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows],
                                 "page_id long, url string, html string, host string, removed string")


def test_pages(spark):
    rows = [(i, f"http://{name}.net/", html) for i, (name, html, _) in enumerate(PAGES)] + [(None, None, "<p>x"), (3, "u", "<p>x")]
    out = H.extract(frame(spark, rows)).collect()
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    for i, (name, _, want) in enumerate(PAGES):
        assert got[i, f"http://{name}.net/"] == want, name
    assert got[None, None] == "x" == got[3, "u"]


def template(i):
    return (f"<body><div class=top>Welcome to our site</div><div class=box><p>Text {i} of its own kind</p></div>"
            f"<div class=end>All rights reserved</div></body>")


def test_style_tree_removes_what_a_host_repeats(spark):
    rows = [(i, f"http://one.net/{i}", template(i)) for i in range(12)] + [(100, "http://other.net/", template(100))]
    text = {r["page_id"]: r["text"] for r in H.extract(frame(spark, rows)).collect()}
    assert all(text[i] == f"Text {i} of its own kind" for i in range(12))
    assert text[100] == "Welcome to our site\nText 100 of its own kind\nAll rights reserved"  # a host's only page


def test_template_inside_an_article_goes_and_copies_stay(spark):
    page = "<article><h1>{0}</h1><p>Body {0}</p><div class=follow>Follow us</div></article>"
    rows = [(i, f"http://one.net/{i}", page.format(i)) for i in range(10)]
    rows += [(50 + i, f"http://copies.net/{i}", "<article><p>same text</p></article>") for i in range(20)]
    rows += [(80 + i, f"http://bare.net/{i}", "<div><p>same text</p></div>") for i in range(20)]
    text = {r["page_id"]: r["text"] for r in H.extract(frame(spark, rows)).collect()}
    assert all(text[i] == f"{i}\nBody {i}" for i in range(10))
    assert all(text[i] == "same text" for i in [*range(50, 70), *range(80, 100)])


def test_importance(spark):
    counts = spark.createDataFrame([("h", "/p", H.PAGE, 0, 8), ("h", "/p", H.STYLE, 1, 8), ("h", "/p", H.CONTENT, 5, 8),
                                    ("h", "/q", H.PAGE, 0, 8), *[("h", "/q", H.CONTENT, i, 1) for i in range(8)],
                                    ("h", "/r", H.PAGE, 0, 4), ("h", "/r", H.CONTENT, 9, 4)],
                                   "host string, path string, kind byte, value long, n long")
    assert [tuple(r) for r in H.unimportant(counts).collect()] == [("h", "/p", 5)]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    rows = [(i, f"http://one.net/{i}", template(i)) for i in range(12)]
    assert all(r["text"] == f"Text {r['page_id']} of its own kind" for r in H.extract(frame(spark, rows)).collect())


def test_empty_table(spark):
    assert H.extract(frame(spark, [])).collect() == []


MARKUP = [
    ("<div><p>The text</p></div><div id=comments><article class=comment-body><p>c</p></article></div>", "The text"),
    ("<div><p>The text</p></div><article class=comment-body><p>c</p></article>", "The text"),
    ("<p>The text</p><aside><article><p>teaser</p></article></aside>", "The text"),
    ("<article><p>a</p></article><nav><li>menu<main><p>b", "a\nb"),
    ("<html><head><title>t</title><body><p>The text</p></body></html>", "The text"),
    ("<head><meta charset=utf-8><title>t</title><p>The text", "The text"),
    ("<head><title>t</title>The text", "The text"),
    ("<body><form action=x><div><p>The text</p><select><option>o</select></div></form></body>", "The text"),
    ("<body><p>The text is longer</p><form><p>f</p></form></body>", "The text is longer"),
]


def test_markup_neither_loses_nor_keeps_whole_texts():
    for html, want in MARKUP:
        assert H.main_text(H.PageParser().parse(html), set()) == want, html


def test_all_removed_is_empty(spark):
    only = "<body><div class=top>Welcome to our site</div><div class=end>All rights reserved</div></body>"
    rows = [(i, f"http://one.net/{i}", template(i)) for i in range(12)] + [(50, "http://one.net/x", only)]
    text = {r["page_id"]: r["text"] for r in H.extract(frame(spark, rows)).collect()}
    assert text[50] == "" and text[3] == "Text 3 of its own kind"


def test_a_repeated_paragraph_goes_and_shared_ones_stay(spark):
    page = ("<article><h1>Head {0}</h1><p>First text number {0} of its own</p><p>Subscribe to our newsletter</p>"
            "<p>{1}</p><p>Last text number {0}</p></article>")
    rows = [(i, f"http://one.net/{i}", page.format(i, "quoted by some" if i % 3 == 0 else f"other {i}")) for i in range(12)]
    # near copies of one article: what they share is the article
    copy = "<article><h1>Long head</h1><p>A text that all the copies of the article hold</p><p>Copy {0}</p></article>"
    rows += [(100 + i, f"http://near.net/{i}", copy.format(i)) for i in range(9)]
    # a part of a site only
    rows += [(200 + i, f"http://few.net/{i}", page.format(i, "x")) for i in range(4)]
    out = H.extract(frame(spark, rows)).collect()
    text = {r["page_id"]: r["text"] for r in out}
    for i in range(12):
        own = "quoted by some" if i % 3 == 0 else f"other {i}"
        assert text[i] == f"Head {i}\nFirst text number {i} of its own\n{own}\nLast text number {i}"
    assert all(text[100 + i] == f"Long head\nA text that all the copies of the article hold\nCopy {i}" for i in range(9))
    assert all("Subscribe to our newsletter" in text[200 + i] for i in range(4))


def brute_texts(pages):
    """The style tree in plain dictionaries over all pages of a host."""
    parsed = [(url, H.PageParser().parse(html or "")) for url, html in pages]
    hosts = defaultdict(dict)
    for (url, html), (_, p) in zip(pages, parsed):
        host = (url or "").partition("://")[2]
        p.host = re.split("[/?#]", host)[0].lower()
        hosts[p.host][tuple((path, content) for path, content, _ in p.blocks)] = (list(p.blocks), dict(p.nodes))
        p.kept = list(p.blocks)
    gone = defaultdict(set)
    for host, distinct in hosts.items():
        held, shown, standing = defaultdict(Counter), defaultdict(Counter), {}
        for blocks, nodes in distinct.values():
            for path, content in {(b[0], b[1]) for b in blocks}:
                held[path][content] += 1
            standing.update((b[0], b[2]) for b in blocks)
            for path, tags in nodes.items():
                shown[path][">".join(tags)] += 1
        for path in held:
            m = sum(any(b[0] == path for b in blocks) or path in nodes for blocks, nodes in distinct.values())
            if m < 5:
                continue
            importance = {c: 1 - math.log(n) / math.log(m) for c, n in held[path].items()}
            if standing[path] == H.PLAIN:
                gone[host] |= {(path, c) for c, x in importance.items() if x < 0.05}
                continue
            style = -sum(n / m * math.log(n / m) for n in shown[path].values()) / math.log(m)
            mean = sum(importance[c] * n for c, n in held[path].items()) / sum(held[path].values())
            if 0.1 * style + 0.9 * mean < 0.4:
                gone[host] |= {(path, c) for c, x in importance.items() if x < 0.4}
    out = []
    for _, p in parsed:
        blocks = [b for b in p.blocks if b[2] != H.OUTSIDE] or p.blocks
        plain = [b for b in blocks if b[2] == H.PLAIN]
        template = sum(len(b[1]) for b in plain if (b[0], b[1]) in gone[p.host])
        stays = 2 * template > sum(len(b[1]) for b in plain)
        out.append("\n".join(b[1] for b in blocks if (b[0], b[1]) not in gone[p.host] or stays and b[2] == H.PLAIN))
    return out


def random_pages(r, n):
    """Pages of few hosts, made of shares of templates, notices in articles, copies and texts of their own."""
    for i in range(n):
        host = r.choice(["a.net", "a.net", "A.net", "b.net", "c.net", ""])
        own = " ".join(r.choice(["one", "two", "three", "four"]) + str(r.randrange(400)) for _ in range(r.randrange(1, 9)))
        parts = [f"<h1>{r.choice([own[:9], 'Same head'])}</h1>", f"<p>{own}</p>", r.choice(["", "<p>Subscribe now</p>"]) if host == "b.net"
                 else "<p>Read more of our stories</p>", r.choice(["", "<div class=follow>Follow us</div>", f"<div class=note>{own[::-1]}</div>"])]
        if r.random() < 0.2:
            parts = ["<p>An article that was copied</p>", "<p>of two blocks</p>"]
        body = "".join(parts)
        yield (None if host == "" else f"http://{host}/{i}",
               r.choice([f"<div class=top>Site</div><article>{body}</article>"] * 4 + [f"<div class=top>Site</div><div class=main>{body}</div>", None]))


def test_against_a_brute_force_tree(spark):
    pages = list(random_pages(random.Random(12), 160))
    got = {r["page_id"]: r["text"] for r in H.extract(frame(spark, [(i, u, h) for i, (u, h) in enumerate(pages)])).collect()}
    want = brute_texts(pages)
    assert [got[i] for i in range(len(pages))] == want
    assert any("Read more" in (h or "") and "Read more" not in t and t for (_, h), t in zip(pages, want))


def test_given_pages_against_a_brute_force_tree(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = [(r["page_id"], r["url"], r["html"]) for r in table.collect()]
    got = {r["page_id"]: r["text"] for r in H.extract(table).collect()}
    assert [got[i] for i, _, _ in pages] == brute_texts([(u, h) for _, u, h in pages])
    counts = H.node_counts(table.select(H.host_of(table["url"]).alias("host"), "html"))
    assert counts.where(F.col("kind").isin(H.CONTENT, H.PLAIN_CONTENT)).count() > 1000


def test_very_long_page(spark):
    html = "<article>" + "".join(f"<p>paragraph {i} of many</p>" for i in range(40_000)) + "<p>" + "long " * 200_000 + "</p></article>"
    row = H.extract(frame(spark, [(1, "http://l.net/", html), (2, "http://l.net/2", html)])).collect()
    assert {r["page_id"] for r in row} == {1, 2} and len({r["text"] for r in row}) == 1
    assert row[0]["text"].count("\n") == 40_000 and row[0]["text"].endswith("long long")
